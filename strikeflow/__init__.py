"""strikeflow: demand-response dispatch valuation as Spark DataFrame plans.

Typical use::

    from strikeflow.params import Params
    from strikeflow.plans.model import DispatchModel

    model = DispatchModel.from_frames(ticks, settlement, lolp, Params())
    model.monthly_value().show()

Every step is a DataFrame -> DataFrame function (see ``operators``); the
``plans`` package wires them into the report pipeline.
"""

__all__ = ["params", "schemas"]
