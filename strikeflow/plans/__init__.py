"""End-to-end plans built from the operators."""

from strikeflow.plans.incremental import History
from strikeflow.plans.model import DispatchModel

__all__ = ["DispatchModel", "History"]
