from collections import Counter

from conftest_llm import WORD, collected
from strikeflow.llm import quality as Q


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    n, chars, symbols = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text)
    base = n < 10 or 100 * len(covered) > 20 * n
    rejects = base or 100 * symbols > Q.MAX_SYMBOLS_PER_100_WORDS * n or 100 * dup > Q.MAX_DUP_LINE_PERCENT * len(lines)
    rejects = rejects or not Q.MIN_MEAN_WORD * n <= chars <= Q.MAX_MEAN_WORD * n
    return n, chars, symbols, dup, len(covered), base, not rejects


def test_odd_rows(odd):
    rows = [(r.doc_id, *brute(r.text)) for r in odd.collect()]
    got = Q.quality_report(odd)
    assert sorted(rows, key=repr) == collected(got, *got.columns)


def test_filter_keeps_what_the_report_keeps(odd):
    kept = Q.quality_filter(odd, sample_rows=20)
    assert kept.columns == odd.columns
    assert collected(kept, "doc_id", "text") == sorted(((r.doc_id, r.text) for r in odd.collect() if brute(r.text)[-1]), key=repr)


def test_verdict_does_not_depend_on_the_order(odd):
    rules = Q.default_rules()
    a = odd.where(Q.verdict(rules).isNull())
    b = odd.where(Q.verdict(rules[::-1]).isNull())
    assert collected(a, "doc_id", "text") == collected(b, "doc_id", "text")


def test_cheap_selective_rules_come_first(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.lit("some words").alias("text"), "id")
    never = Q.Rule("never", F.lit(False))
    most = Q.Rule("most", F.col("id") % 10 != 0)
    assert Q.order_rules(df, [never, most], sample_rows=3000)[0] is most


def test_empty(empty):
    assert Q.quality_report(empty).count() == 0
    assert Q.quality_filter(empty).columns == empty.columns


def test_no_python_in_the_plan(odd):
    plan = Q.quality_report(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_order_and_the_reasons_are_repeatable(odd):
    first = [r.name for r in Q.order_rules(odd, Q.default_rules(), sample_rows=20)]
    for _ in range(3):
        assert [r.name for r in Q.order_rules(odd, Q.default_rules(), sample_rows=20)] == first
    rows = [collected(Q.cascade(odd, sample_rows=20), "doc_id", "rejected_by") for _ in range(2)]
    assert rows[0] == rows[1]


def test_the_shared_split_gives_the_same_verdict(odd):
    names = [r.name for r in Q.default_rules()]
    for order in (names, names[::-1]):
        by = {r.name: r for r in Q.default_rules()}
        both = odd.select(Q.shared_verdict(order).alias("a"), Q.verdict([by[n] for n in order]).alias("b"))
        assert both.where("not (a <=> b)").count() == 0
    assert names[0] in {r.a for r in odd.select(Q.shared_verdict(names).alias("a")).collect()}


def test_dear_rules_come_late(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.lit("some words").alias("text"), "id")
    dear = Q.Rule("dear", F.col("id") % 10 != 0, 100 + F.length("text"))
    cheap = Q.Rule("cheap", F.col("id") % 10 == 0)
    assert [r.name for r in Q.order_rules(df, [dear, cheap], sample_rows=3000)] == ["cheap", "dear"]
