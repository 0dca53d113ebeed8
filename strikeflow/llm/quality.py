"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Boolean Column that rejects a text, with a Column that says how
much work it is.  On a seeded sample the cascade counts the rows that each rule
rejects and adds up its work; the rules then run in order of rejections per
work, and a row that one of them rejects is not put to the rest.  Work is
counted in code points and words, not by the clock, so that the order is the same
at every run.  A text is split into words once for all rules.  The verdict is
that no rule rejects, which is the same in any order: the sample decides the
speed only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, let, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Limits of the rules beside the two base rules; clean prose of any of the
#: corpus' languages stays far inside them.
MAX_SYMBOLS_PER_100_WORDS = 20
MAX_DUP_LINE_PERCENT = 50
MIN_MEAN_WORD, MAX_MEAN_WORD = 2, 25
SAMPLE_ROWS = 2000
#: Work of a rule: a code point searched for symbols counts 1.  The others are
#: their times beside that, over the documents of the test tables: searching for
#: lines, for white space, and comparing the windows that begin at a word.
LINE_WORK, CHARS_WORK, WINDOW_WORK = 0.5, 1.5, 60


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true or false, never null, for every row; ``work`` is a number, or one per row."""

    name: str
    rejects: Column
    work: Column | float = 1.0


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points in words, i.e. outside white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE}]")))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(worded_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _repeated_positions(w: Column) -> Column:
    """Sorted first positions of the windows whose words occur at least twice in ``w``."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
        lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("key"), i.alias("at")),
    )
    return let(
        F.sort_array(windows),
        lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda x, i: (x["key"] == F.get(s, i - 1)["key"]) | F.coalesce(x["key"] == F.get(s, i + 1)["key"], F.lit(False))),
                lambda x: x["at"],
            )
        ),
    )


def _covered(starts: Column) -> Column:
    """Words covered by windows that begin at the sorted ``starts``."""
    gaps = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def repeat_words(w: Column) -> Column:
    """Of the word array ``w``: words in windows found twice or more, the first included.

    Equal windows have equal hashes, so distinct hashes prove that nothing
    repeats; only other texts are sorted by the windows' words themselves.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
    )
    return (
        F.when(F.size(w) <= WINDOW, 0)
        .when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), 0)
        .otherwise(let(_repeated_positions(w), _covered))
        .cast("long")
    )


def default_rules(text: str = "text", of: Column | None = None) -> list[Rule]:
    """The base rules and the three limits above, on the column named ``text``; ``of``: its words, if there already."""
    t = F.col(text)
    w = words(t) if of is None else of
    n, length = F.size(w), F.coalesce(F.length(t), F.lit(0))
    return [
        Rule("few_words", n < MIN_WORDS),
        Rule("repeated_words", let(w, lambda x: 100 * repeat_words(x) > MAX_REPEAT_PERCENT * F.size(x)), 1 + WINDOW_WORK * n),
        Rule("symbols", 100 * n_symbols(t) > MAX_SYMBOLS_PER_100_WORDS * n, 1 + length),
        Rule("duplicate_lines", let(worded_lines(t), lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x))) > MAX_DUP_LINE_PERCENT * F.size(x)), 1 + LINE_WORK * length),
        Rule("word_length", let(word_chars(t), lambda x: ~x.between(MIN_MEAN_WORD * n, MAX_MEAN_WORD * n)), 1 + CHARS_WORK * length),
    ]


def stat_rules() -> list[Rule]:
    """``default_rules`` on the columns that ``statistics`` adds."""
    c = F.col
    return [
        Rule("few_words", c("n_words") < MIN_WORDS),
        Rule("repeated_words", 100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words")),
        Rule("symbols", 100 * c("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * c("n_words")),
        Rule("duplicate_lines", 100 * c("n_dup_lines") > MAX_DUP_LINE_PERCENT * c("n_lines")),
        Rule("word_length", ~c("word_chars").between(MIN_MEAN_WORD * c("n_words"), MAX_MEAN_WORD * c("n_words"))),
    ]


def order_rules(df: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Rule]:
    """``rules`` by rejections per work on a sample of about ``sample_rows`` rows; equals stay in the order given.

    One aggregate over the sample gives both.  The same table gives the same
    order at every run.
    """
    n = df.count()
    if not n:
        return list(rules)
    work = [r.work if isinstance(r.work, Column) else F.lit(float(r.work)) for r in rules]
    found = (
        df.sample(min(1.0, sample_rows / n), seed)
        .agg(*[F.count(F.when(r.rejects, 1)).alias(f"r{i}") for i, r in enumerate(rules)], *[F.sum(w.cast("double")).alias(f"w{i}") for i, w in enumerate(work)])
        .first()
    )
    score = [found[f"r{i}"] / found[f"w{i}"] if found[f"w{i}"] else 0.0 for i in range(len(rules))]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-score[i], i))]


def verdict(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules aren't evaluated."""
    first = F.lit(None).cast("string")
    for rule in reversed(rules):
        first = F.when(rule.rejects, F.lit(rule.name)).otherwise(first)
    return first


def shared_verdict(order: Sequence[str], text: str = "text") -> Column:
    """``verdict`` of the default rules in the given order of names, on one split of the text."""

    def of(w: Column) -> Column:
        rules = {r.name: r for r in default_rules(text, w)}
        return verdict([rules[name] for name in order])

    return let(words(F.col(text)), of)


def _decided(df: DataFrame, rules: Sequence[Rule] | None, text: str, sampling: dict) -> Column:
    if rules is not None:
        return verdict(order_rules(df, rules, **sampling))
    return shared_verdict([r.name for r in order_rules(df, default_rules(text), **sampling)], text)


def cascade(df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", into: str = "rejected_by", **sampling) -> DataFrame:
    """``df`` with column ``into``: the rule that rejected the row, null where the row is kept.

    A null text counts as empty and falls to ``few_words``.  Equal texts get
    the same fate, an empty table gives an empty result, other columns pass
    through; a column named like ``into`` is replaced.  Which of several
    rejecting rules is named depends on the order that the sample gives; whether one rejects doesn't.
    """
    return df.withColumn(into, _decided(df, rules, text, sampling))


def quality_filter(df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", **sampling) -> DataFrame:
    """The rows that no rule rejects, with the columns of ``df``."""
    return df.where(_decided(df, rules, text, sampling).isNull())


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    t = F.col(text)
    counted = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeat")))
    lines = let(worded_lines(t), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return (
        df.withColumns({"_w": counted, "_l": lines, "word_chars": word_chars(t), "n_symbols": n_symbols(t)})
        .withColumns({"n_words": F.col("_w.n"), "n_repeat_words": F.col("_w.repeat"), "n_lines": F.col("_l.n"), "n_dup_lines": F.col("_l.dup")})
        .drop("_w", "_l")
    )


def quality_report(docs: DataFrame) -> DataFrame:
    """Statistics and verdict of every document.

    A null or empty text has no words and fails; repeated rows get the same
    verdict, an empty table gives an empty result, other columns don't matter.
    """
    stats = statistics(docs.select("doc_id", "text")).drop("text")
    rules = order_rules(docs.select("text"), default_rules())
    by_stats = {r.name: r for r in stat_rules()}
    why = verdict([by_stats[r.name] for r in rules])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), why.isNull().alias("kept"),
    )
