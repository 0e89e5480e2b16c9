from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import replies as R
from siltstone.functions import text as X
from siltstone.operators import events as V
from siltstone.operators.documents import balanced_assignment, parse_markdown
from siltstone.sources.sinks import cleaned


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(make(F.col("t"))).collect()]


def test_verdicts(spark):
    got = one(spark, R.typed_verdict, '<think>{"relevant": false}</think> so: {"relevant": true, "confidence": 7, "reason": "a {b}"} end', '{"confidence": 0.4}', "none", None, '{"relevant": false, "confidence": -1}')
    assert got[0] == (True, 1.0, "a {b}") and got[1] is got[2] is got[3] is None and got[4][:2] == (False, 0.0)


def test_lists_and_tags(spark):
    assert one(spark, R.listed, 'x ["a  b", "a b", ""]', "- one\n2. two\n\n* one", None) == [["a b"], ["one", "two"], None]
    got = one(spark, lambda c: R.tags(c, F.lit(3)), '[2, {"detail": 2, "strength": "full"}, {"detail": 3, "strength": "full"}, 4, "x"]', "no list", None)
    assert [tuple(t) for t in got[0]] == [(2, "partial"), (3, "full")] and not got[1] and not got[2]


def test_search_wording(spark):
    assert one(spark, R.plain_query, 'NOT deep* "nets" OR AND trees?') == ["not deep nets or and trees"]
    words = lambda c: R.fielded_queries(F.filter(F.split(c, " "), lambda w: w != ""))
    assert one(spark, words, "", "a", "a b", "a b c", "a b c d") == [
        [], ["TITLE-ABS-KEY(a)"], ["TITLE-ABS-KEY(a AND b)", "TITLE-ABS-KEY(a OR b)"],
        ["TITLE-ABS-KEY(a AND b) AND TITLE-ABS-KEY(c)", "TITLE-ABS-KEY(a AND b)"], ["TITLE-ABS-KEY(a AND b) AND TITLE-ABS-KEY(c OR d)"],
    ]
    assert one(spark, R.like_escaped, r"50%_\x") == [r"50\%\_\\x"]
    assert one(spark, R.usable_anchor, "large language models", "a [b]", "one two three four five six seven", "‘x’ – “y”") == ["large language models", "", "", "'x' - y"]


def test_quantities(spark):
    got = one(spark, R.quantities, "It rose from 10 to 20% over 1,250 items, 3k users, 1.5 million rows and two raters; T5 and ResNet-50 aside.", "none", None)
    assert [tuple(x) for x in got[0]] == [(10, "%"), (20, "%"), (1250, ""), (3000, ""), (1500000, ""), (2, "")] and not got[1] and got[2] is None


def test_wording(spark):
    assert one(spark, R.claim_wording, "Claim: The cost  rises [3, 12].", "BERT wins.", None) == ["the cost rises", "BERT wins", None]
    assert one(spark, R.without_attribution, "One recent study reports that costs rise fast", "Two papers find that so", "Costs rise") == ["Costs rise fast", "Two papers find that so", "Costs rise"]
    assert one(spark, R.stem_set, "Trade‐offs of rankings and summarisations") == [["offs", "rank", "summaris", "trade", "trade-off"]]
    assert one(spark, R.name_list, "Ada Lovelace 1*, Alan M. Turing and Ludwig van Beethoven", "We compare two methods", "Plato", None) == [True, False, False, False]
    assert one(spark, R.retry_wait, "all keys are rate limited for 124s", "gave up after 300s", None) == [124.0, None, None]
    assert one(spark, R.compatible, "ﬁne “x” １２ a…", None) == ['fine "x" 12 a...', None]
    assert one(spark, X.elision_pieces, "the first piece of the quote ... short [...] and the second piece of it", "short", None) == [["the first piece of the quote", "and the second piece of it"], [], None]


def test_closing_events(spark):
    e = spark.createDataFrame([(1, 1, "start"), (1, 2, "end"), (2, 1, "start"), (3, 1, "start"), (3, 2, "end"), (3, 3, "note")], "run int, seq int, event string")
    got = {(r.run, r.seq, r.event, r.stage) for r in V.with_closing(e, ["run"], "seq", "event", "done", "failed", "start", "end").where("made_up").collect()}
    assert got == {(1, 3, "failed", None), (2, 2, "failed", "start"), (3, 4, "failed", None)}
    assert V.with_closing(e.limit(0), ["run"], "seq", "event", "done", "failed", "start", "end").count() == 0


def test_rungs_and_steps(spark):
    e = spark.createDataFrame([(1, 1, "a", 0, 5.0), (1, 2, "b", 2_000_000, 200.0), (1, 3, "end", 9_000_000, 7.0), (1, 4, "c", 9_000_000, 1.0), (2, 5, "b", 0, 1.0), (3, 6, "x", 0, 300.0)], "k int, seq int, event string, at long, value double")
    st = {r.k: r for r in V.search_states(e, "k", "seq", "event", "at", "value", ("a", "b", "c"), "end").collect()}
    assert st[1].rungs == ["a", "b"] and st[1].rung == "b" and st[1].done and st[1].seconds == 9 and st[1].total == 7
    assert st[2].rungs == ["b"] and not st[2].done and st[2].seconds is None and 3 not in st
    ladder = {(r.k, r.rung): (r.state, r.found) for r in V.rung_states(e, "k", "seq", "event", "value", ("a", "b", "c"), "end", "x").collect()}
    assert ladder[1, "b"] == ("ran", True) and ladder[2, "b"] == ("running", False) and ladder[2, "a"] == ("did_not_run", False) and ladder[3, "x"] == ("ran", True) and len(ladder) == 10
    rows = {(r.k, r.step): r.status for r in V.step_rows(e, "k", "event", ("a", "b", "c"), "end").collect()}
    assert rows[2, "a"] == "done" and rows[2, "b"] == "active" and rows[2, "c"] == "waiting" and rows[1, "c"] == "done" and rows[3, "a"] == "waiting"


def test_nested_cleaning(spark):
    kind = T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("s", T.StringType()), T.StructField("x", T.DoubleType())]))), T.StructField("m", T.MapType(T.StringType(), T.StringType()))])
    got = cleaned(spark.createDataFrame([([("u\0v", float("nan")), None], {"k": "\0w"}), (None, None)], kind)).collect()
    assert got[0].a[0] == ("uv", None) and got[0].a[1] is None and got[0].m == {"k": "w"} and got[1] == (None, None)


def test_even_shares_and_headings(spark):
    pairs = spark.createDataFrame([("s", i, t, 1.0 - i / 10 if t == "a" else 0.1) for i in range(4) for t in ("a", "b")], "s string, i int, t string, score double")
    got = balanced_assignment(pairs, ["s"], "i", "t", "score").groupBy("t").count().collect()
    assert {r.t: r["count"] for r in got} == {"a": 2, "b": 2}
    doc = parse_markdown("# Title\n## One\n" + "text " * 20 + "\n####### no heading\n##nor this\n")
    assert doc["title"] == "Title" and [s["heading"] for s in doc["sections"]] == ["One"]
