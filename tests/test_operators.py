import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import keys as K
from siltstone.functions import text as X
from siltstone.operators import components, evalstats, evidence, events, joins, ranking, retrieval, vectors
from siltstone.plans import texts, views
from siltstone.sources import files, sinks


def rows(df, *by):
    return sorted([tuple(r) for r in df.collect()], key=lambda r: tuple(str(x) for x in r)) if not by else [tuple(r) for r in df.orderBy(*by).collect()]


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(5)
    pairs = [(f"n{a:04d}", f"n{b:04d}") for a, b in rng.integers(0, 900, (700, 2))]
    pairs += [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)] + [("hub", f"h{i}") for i in range(500)] + [("x", "x"), (None, "y"), ("z", None)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            parent[find(a)] = find(b)
    assert set(got) == set(parent)
    assert len({(find(n), c) for n, c in got.items()}) == len({find(n) for n in got}) == len(set(got.values()))
    assert all(find(c) == find(n) for n, c in got.items())
    assert components.connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_keys(spark):
    df = spark.createDataFrame([(" https://doi.example/10.99100/AbC.1. ", "ARXIV: 2101.00001v3"), ("10.99100%2Fx", "0000.00000"), ("10.", "n/a"), ("10.99100/", None), (None, "2101.00001 "), ("doi:", "")], "d string, a string")
    got = df.select(K.doi_key(F.col("d")), K.arxiv_key(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("10.99100/abc.1", "2101.00001"), ("10.99100/x", None), (None, None), (None, None), (None, "2101.00001"), (None, None)]
    titles = spark.createDataFrame([("A <i>Study</i>: of Maps &amp; More",), ("a study of maps more.",), ("Cut title...",), ("Café‐Maps",), ("",), (None,)], "t string")
    assert [r.k for r in K.with_title_key(titles, "t", "k").collect()] == ["astudyofmapsmore", "astudyofmapsmore", None, "cafemaps", None, None]


def test_evidence_literals(spark):
    assert [spark.createDataFrame([(x,) for x in v], "w double").agg(evidence.noisy_or(F.col("w"))).first()[0] for v in ([], [0.5], [0.5, 0.5], [2.0])] == pytest.approx([0, 0.5, 0.75, 0.95])
    best = evidence.best_per_document(spark.createDataFrame([("k", "D1", 0.3), ("k", "D1", 0.7), ("k", "D2", 0.5)], "k string, d string, w double"), ["k"], "d", "w")
    assert rows(best) == [("k", "D1", 0.7), ("k", "D2", 0.5)]
    levels = spark.createDataFrame([("q", "a", "full_text", 1), ("q", "a", "abstract", 2), ("q", "b", None, 1), ("q", "c", "web_snippet", 1)], "q string, s string, l string, o int")
    assert rows(evidence.weighted_sources(levels, ["q"], "s", "l", "o")) == [("q", 3, 2.0)]
    label = spark.createDataFrame([(0.5, 0.5, 2, 0), (0.5, 0.0, 2, 0), (0.5, 0.0, 1, 0), (0.0, 0.0, 0, 1), (0.0, 0.0, 0, 0)], "s double, c double, d int, p int")
    assert [r[0] for r in label.select(evidence.label_decision(F.col("s"), F.col("c"), F.col("d"), F.col("p"))).collect()] == ["contradicted", "supported", "partially_supported", "partially_supported", "unverified"]


def test_coverage_needs_two_sources(spark):
    aspects = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c"), ("q", "d")], "q string, t string")
    found = spark.createDataFrame([("q", "a", "yes", "s1"), ("q", "a", "yes", "s1"), ("q", "b", "yes", "s1"), ("q", "b", "yes", "s2"), ("q", "c", None, "s1")], "q string, t string, v string, s string")
    got = {r.t: r.state for r in evidence.aspect_states(aspects, found, ["q", "t"], "v", "s").collect()}
    assert got == {"a": "judged_insufficient", "b": "covered", "c": "unjudged", "d": "no_candidates"}


def test_numbering_follows_first_citation(spark):
    df = spark.createDataFrame([("r", "Gamma", 1), ("r", "Alpha", 2), ("r", "Gamma", 3)], "r string, d string, p int")
    assert {r.d: r.number for r in ranking.number_by_first_use(df, ["r"], "d", "p").collect()} == {"Gamma": 1, "Alpha": 2}


def test_caps_and_trims_with_ties(spark):
    df = spark.createDataFrame([(g, i, 1.0) for g in "ab" for i in range(5)], "g string, i int, s double")
    assert [r[:2] for r in rows(ranking.fair_trim(df, ["g"], [F.desc("s"), F.col("i"), F.col("g")], 4).select("g", "i"))] == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    docs = spark.createDataFrame([("s", "d1", 1), ("s", "d1", 2), ("s", "d1", 3), ("s", "d2", 4)], "s string, d string, i int")
    assert sorted(r.i for r in ranking.diverse_cap(docs, "s", "d", ["i"], 3).collect()) == [1, 2, 4]


def test_mirror_pairs(spark):
    df = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("a", "c", 3)], "x string, y string, r int")
    assert sorted(r.r for r in ranking.mirror_pairs(df, "x", "y", ["r"]).collect()) == [1, 3]


def test_as_of_takes_the_last_at_or_before(spark):
    t = lambda m: dt.datetime(2025, 1, 1, 0, m)
    left = spark.createDataFrame([("k", 1, t(5)), ("k", 2, t(1)), ("j", 3, t(9)), (None, 4, t(9))], "k string, i int, at timestamp")
    right = spark.createDataFrame([("k", t(2), 1.0), ("k", t(5), 2.0), ("k", t(6), 3.0)], "k string, at timestamp, v double")
    assert rows(joins.as_of(left, right, ["k"], "at", "at", ["v"]).select("i", "v")) == [(1, 2.0), (2, None), (3, None), (4, None)]


def test_overlaps_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = ([(int(k), int(s), int(s + w)) for k, s, w in zip(rng.integers(0, 3, 40), rng.integers(0, 500, 40), rng.integers(0, 200, 40))] for _ in range(2))
    schema = "k int, started long, ended long"
    got = sorted((r.k, r.a_started, r.a_ended, r.b_started, r.b_ended, r.overlap) for r in joins.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], 60).collect())
    want = sorted((k, s, e, u, v, min(e, v) - max(s, u)) for k, s, e in a for j, u, v in b if j == k and max(s, u) < min(e, v))
    assert got == want


def test_identity_is_not_transitive(spark):
    df = spark.createDataFrame([(1, "d1", "t1"), (2, "d2", "t2"), (3, "d1", "t2"), (4, None, "t2"), (5, None, None)], "i int, d string, t string")
    assert {r.i: r.matched for r in joins.identity_first_match(df, "i", ["d", "t"]).collect()} == {1: None, 2: None, 3: 1, 4: 2, 5: None}


def test_division_and_validation(spark):
    d = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "p int, c int")
    assert rows(joins.divided_by(d, d, spark.createDataFrame([(10,), (20,)], "c int"), "p", "c")) == [(2, 1)]
    a, b = spark.createDataFrame([(1,), (2,)], "i int"), spark.createDataFrame([(2,), (3,)], "i int")
    assert rows(joins.compare_ids(a, b, "i")) == [(1, "missing"), (3, "unknown")]


def test_cosine_and_greedy_clusters(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "i long, v array<float>")
    got = {(r.query, r.place): r.neighbour for r in vectors.cosine_top_k(df.where("i % 10 = 0"), df.repartition(5), "i", "v", 3).collect()}
    f32 = v.astype(np.float32).astype(np.float64)
    for q in range(0, 60, 10):
        s = np.round(f32 @ f32[q], 6)
        order = [int(j) for j in np.lexsort((np.arange(60), -s)) if j != q][:3]
        assert [got[q, p] for p in (1, 2, 3)] == order
    axis = lambda i, j=None: [1.0 if k == i else 0.35 if k == j else 0.0 for k in range(4)]
    items = spark.createDataFrame([("s", 1, axis(0)), ("s", 2, axis(0)), ("s", 3, axis(1)), ("s", 4, axis(0, 3))], "s string, i long, v array<double>")
    assert {r.i: r.representative for r in vectors.greedy_clusters(items, ["s"], "i", "v", 0.84).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_statistics(spark):
    rng = np.random.default_rng(4)
    data = [("g", float(rng.integers(0, 6)), bool(rng.random() < 0.4)) for _ in range(200)]
    got = evalstats.auc(spark.createDataFrame(data, "k string, s double, y boolean"), ["k"], "s", F.col("y")).first()
    pos, neg = [s for _, s, y in data if y], [s for _, s, y in data if not y]
    assert got.auc == pytest.approx(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))
    one = spark.createDataFrame([(True, False)] * 5 + [(False, True)], "a boolean, b boolean")
    r = evalstats.mcnemar(one, F.col("a"), F.col("b")).first()
    assert (r.only_a, r.only_b) == (5, 1) and r.p_value == pytest.approx(2 * (1 + 6) / 64)
    assert evalstats.mcnemar(one.limit(0), F.col("a"), F.col("b")).first() is not None
    low, high = evalstats.wilson(F.col("h"), F.col("n"))
    w = spark.createDataFrame([(0, 0), (5, 10)], "h int, n int").select(low, high).collect()
    assert tuple(w[0]) == (0, 0) and tuple(w[1]) == pytest.approx((0.2366, 0.7634), abs=1e-4)
    boot = evalstats.bootstrap_mean(spark.range(500).select("id", (F.col("id") % 10).cast("double").alias("v")), "v", "id", 100).first()
    assert boot.low < 4.5 < boot.high and boot.high - boot.low < 1.2


def test_event_reducers(spark):
    e = spark.createDataFrame([(1, 1, "a"), (1, 2, "error"), (2, 1, "purchase"), (2, 2, "error"), (3, 1, "a")], "u int, i int, t string")
    assert {r.u: r.state for r in events.run_state(e, ["u"], ["i"], "t", ["purchase"], ["error"]).collect()} == {1: "failed", 2: "completed", 3: "running"}
    p = events.exact_quantile(spark.createDataFrame([(1, float(i)) for i in range(21)], "k int, x double"), ["k"], "x", 0.95, "p95").first()["p95"]
    assert p == 19.0


def test_text_functions(spark):
    df = spark.createDataFrame([("studies",), ("classes",), ("boxes",), ("maps",), ("corpus",), ("bus",), ("analysis",)], "w string")
    assert [r[0] for r in df.select(X.plural_stem(F.col("w"))).collect()] == ["study", "class", "box", "map", "corpus", "bus", "analysis"]
    t = spark.createDataFrame([("a b c d e",), ("",), (None,)], "t string").select(X.word_chunks(F.col("t"), 2).alias("c")).collect()
    assert [c.text for c in t[0].c] == ["a b", "c d", "e"] and t[1].c == []
    q = spark.createDataFrame([("The re-\nsult – as shown [1, 3] – holds .",)], "t string").select(X.quote_norm(F.col("t"))).first()[0]
    assert q == "the result - as shown - holds."
    m = spark.createDataFrame([('Error 12 at https://x.example/a?b "boom" 3.5',)], "t string").select(X.mask(F.col("t"))).first()[0]
    assert m == "Error <n> at <url> <quoted> <n>"
    s = spark.createDataFrame([([1.0, 1.0],)], "l array<double>").select(X.softmax(F.col("l"))).first()[0]
    assert s == [0.5, 0.5]


def test_containment_and_shingles(spark):
    q = spark.createDataFrame([(1, "s", "the cat sat on"), (2, "s", "dog"), (3, "t", "the cat sat on"), (4, "s", "")], "i int, s string, n string")
    t = spark.createDataFrame([("k1", "s", "so the cat sat on a mat"), ("k2", "s", "a dog"), ("k3", "s", None)], "k string, s string, x string")
    assert rows(retrieval.containing(q, "i", "n", t, "k", "x", ["s"]).select("i", "k")) == [(1, "k1"), (2, "k2")]
    s = spark.createDataFrame([("a b c d e f",), ("a b",), ("",)], "t string").select(F.size(retrieval.shingle_set(F.col("t")))).collect()
    assert [r[0] for r in s] == [2, 1, -1] or [r[0] for r in s][:2] == [2, 1]


def brute_jaccard(left, right, least):
    pairs = ((x, y, set(a), set(b)) for x, a in left for y, b in right)
    return sorted((x, y, round(len(a & b) / len(a | b), 6)) for x, y, a, b in pairs if a | b and len(a & b) / len(a | b) >= least)


def test_jaccard_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(40)]
    weights = 1 / np.arange(1, 41)

    def side(n, start):
        return [(start + i, [str(w) for w in rng.choice(vocabulary, rng.integers(0, 9), p=weights / weights.sum())]) for i in range(n)]

    left, right = side(150, 0), side(150, 1000)
    a, b = spark.createDataFrame(left, "x long, a array<string>"), spark.createDataFrame(right, "y long, b array<string>")
    for least in ((3, 5), (4, 5), (1, 1)):
        assert rows(retrieval.jaccard_pairs(a, "x", "a", b, "y", "b", least), "x", "y") == brute_jaccard(left, right, least[0] / least[1])
    with pytest.raises(ValueError):
        retrieval.jaccard_pairs(a, "x", "a", b, "y", "b", (1, 2))


def test_title_jaccard_compares_all_pairs(spark, tmp_path):
    """Titles whose first words differ, against brute force (the SQL twin holds a join on the first five words)."""
    titles = [
        (1, "Toward reliable abstract alignment with claim centered memories"), (2, "reliable abstract alignment with claim centered memories"),
        (3, "A guide to quote tables"), (4, "Maps"), (5, None), (6, "—"),
    ]
    papers = [("p1", "Towards reliable abstract alignment with claim centered memories"), ("p2", "The guide to quote tables"), ("p3", "maps"), ("p4", ""), ("p5", None)]
    spark.createDataFrame(titles, "reference_id long, title string").write.parquet(f"{tmp_path}/report_references.parquet")
    spark.createDataFrame(papers, "id string, title string").write.parquet(f"{tmp_path}/parsed_papers.parquet")
    cut = lambda side: [(k, re.findall("[a-z0-9]+", t.lower())) for k, t in side if t is not None]
    want = brute_jaccard(cut(titles), cut(papers), 0.6)
    assert [w[:2] for w in want] == [(1, "p1"), (2, "p1"), (3, "p2"), (4, "p3")]
    assert rows(texts.title_jaccard(spark, str(tmp_path)), "reference_id", "id") == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_strings_equal_brute_force(spark):
    """Slips anywhere, the first letters included, over all lengths around the steps of the bound."""
    rng = np.random.default_rng(12)
    letters = list("abcd ")
    right = ["", "a"] + ["".join(rng.choice(letters, n)) for n in [*range(1, 130, 2), 28, 29, 30, 57, 58, 59, 60, 87, 88, 116, 120]]

    def slip(t):
        t = list(t)
        for _ in range(rng.integers(0, 6)):
            at = int(rng.integers(0, len(t) + 1))
            t[at : at + int(rng.integers(0, 2))] = [str(rng.choice(letters))] * int(rng.integers(0, 2))
        return "".join(t)

    left = sorted({slip(t) for t in right for _ in range(8)})
    right = sorted(set(right))
    want = sorted((x, y) for x in left for y in right if 30 * abs(len(x) - len(y)) <= max(len(x), len(y)) and 30 * edits(x, y) <= max(len(x), len(y)))
    a, b = spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(y,) for y in right], "b string")
    assert rows(retrieval.near_strings(a, "a", b, "b", 30), "a", "b") == want and len(want) > 150


def test_fuzzy_titles_with_slips_in_the_first_words(spark, tmp_path):
    """Against literals: the SQL twin holds a join on the first three words."""
    titles = [(1, "T0ken 1evel controllers for long claim memories in quote tables"), (2, "Token level controllers for long claim memories in quote table"), (3, "maps"), (3, "maps"), (4, None), (5, "h")]
    papers = [("p1", "Token level controllers for long claim memories in quote tables"), ("p2", "Token-level controllers for long claim memories in quote tables."), ("p3", "Maps!"), ("p4", None), ("p5", "Mops")]
    spark.createDataFrame(titles, "reference_id long, title string").write.parquet(f"{tmp_path}/report_references.parquet")
    spark.createDataFrame(papers, "id string, title string").write.parquet(f"{tmp_path}/retrieved_papers.parquet")
    first = "token level controllers for long claim memories in quote tables"
    assert rows(views.fuzzy_titles(spark, str(tmp_path)), "reference_id") == [(1, 1, first), (2, 1, first), (3, 2, "maps")]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "k int, v string, created string")
    new = spark.createDataFrame([(2, "B", "t1"), (3, "C", "t1")], "k int, v string, created string")
    assert rows(sinks.merged(old, new, ["k"], ("created",))) == [(1, "a", "t0"), (2, "B", "t0"), (3, "C", "t1")]
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("q1", 1), ("q2", 2)], "q string, x int")
    for df in (first, first.where("q = 'q1'").withColumn("x", F.lit(9)), first.where("q = 'q1'").withColumn("x", F.lit(9))):
        sinks.replace_partitions(df, path, ["q"])
    assert rows(spark.read.parquet(path).select("q", "x")) == [("q1", 9), ("q2", 2)]
    c = sinks.cleaned(spark.createDataFrame([("a\x00b", ["\x00"], float("nan")), (None, None, 1.0)], "s string, l array<string>, d double"))
    assert rows(c) == [(None, None, 1.0), ("ab", [""], None)]
    split = sinks.split_rows(spark.range(2000), "id", 7, {"train": 0.9, "validation": 0.05, "test": 0.05}).groupBy("split").count().collect()
    n = {r.split: r["count"] for r in split}
    assert n["train"] > 1700 and 60 < n["test"] < 150
    log = spark.createDataFrame([("k", 1, "x"), ("k", 3, "z"), ("k", 2, "y")], "k string, t int, d string")
    assert rows(sinks.counted(log, ["k"], "t", "d")) == [("k", 3, 1, 3, "z")]
    assert rows(sinks.markdown(spark.createDataFrame([("r", 2, "B", "two"), ("r", 1, "A", "one")], "r string, p int, h string, b string"), "r", "p", "h", "b"))[0][1] == "## A\n\none\n\n## B\n\ntwo"


def test_sources(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a", "v": 1}\n\nnot json\n{"id": "a", "v": 2}\n')
    j = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string, v int")
    assert rows(j) == [("a", 1), ("a", 2)] and rows(files.duplicate_keys(j, "id")) == [("a", 2)]
    (tmp_path / "l.csv").write_text("﻿row_id,label\n1,\"0,5\"\n2,\n3,x\n", encoding="utf-8")
    assert rows(files.read_label_csv(spark, str(tmp_path / "l.csv"), ["row_id", "label"]).select("row_id", "label", "file")) == [("1", 0.5, "l.csv"), ("2", None, "l.csv"), ("3", None, "l.csv")]
    (tmp_path / "r.log").write_text("2025-01-01 10:00:00 INFO app.run - start run\nnoise\n2025-01-01 10:00:01 WARNING app.x - slow 3\n2025-01-01 11:00:00 INFO app.run - start run\n")
    log = files.log_runs(files.read_log(spark, str(tmp_path / "r.log")), "start run")
    assert [(r.level, r.run) for r in log.orderBy("line_no").collect()] == [("INFO", 1), ("WARNING", 1), ("INFO", 2)]
    sse = spark.createDataFrame([('id: 1\ndata: {"stage": "a"}\n\n: ping\n\nid: 2\ndata: {"stage": "b"}',)], "t string")
    assert [(r.event_id, r.event.stage) for r in files.parse_sse(sse, "t", "stage string").orderBy("no").collect()] == [("1", "a"), ("2", "b")]
    atom = '<feed><entry><id>http://x/abs/1</id><title>A\n title</title><summary>Text</summary><author><name>N. One</name></author><author><name>M. Two</name></author><link title="pdf" href="http://x/pdf/1"/><published>2020</published></entry><entry><title>No text</title><summary></summary></entry></feed>'
    a = files.parse_atom(spark.createDataFrame([(atom,)], "x string"), "x").collect()
    assert len(a) == 1 and a[0].title == "A title" and a[0].authors == ["N. One", "M. Two"] and a[0].pdf_url == "http://x/pdf/1"
    body = '{"data": [{"title": "T", "venue": "", "externalIds": {"DOI": "10.1/x", "ArXiv": "1"}, "authors": [{"name": "N"}], "citationCount": 3}, {"title": null}]}'
    s = files.parse_scholar(spark.createDataFrame([(body,)], "b string"), "b").collect()
    assert len(s) == 1 and s[0].doi == "10.1/x" and s[0].is_preprint and s[0].authors == ["N"]
    i = spark.createDataFrame([({"b": [1], "a": [0, 2]},)], "m map<string,array<int>>").select(files.text_of_inverted_index(F.col("m"))).first()[0]
    assert i == "a b a"
    h = spark.createDataFrame([('<meta name="citation_pdf_url" content="http://x/1.pdf"><link type="application/pdf" href="/2.pdf">',)], "h string").select(files.pdf_links(F.col("h"))).first()[0]
    assert h == ["http://x/1.pdf", "/2.pdf"]


def test_provider_fallbacks_and_cached_parse(spark):
    a, b = spark.createDataFrame([("q1", "x")], "q string, u string"), spark.createDataFrame([("q1", "y"), ("q2", "z"), ("q2", "w")], "q string, u string")
    assert rows(files.first_provider([a, b], "q").select("q", "u")) == [("q1", "x"), ("q2", "w"), ("q2", "z")]
    assert rows(files.top_up(a, b, "q", "u", 2).select("q", "u")) == [("q1", "x"), ("q1", "y"), ("q2", "w"), ("q2", "z")]
    wanted = spark.createDataFrame([("w1", "2101.1", "d", "A long enough exact title"), ("w2", None, None, "short")], "id string, arxiv_k string, doi_k string, title string")
    parsed = spark.createDataFrame([("p1", None, "d", "t", 2, 900, 1), ("p2", "2101.1", None, "t", 2, 900, 1), ("p3", "2101.1", None, "t", 2, 900, 2), ("p4", "2101.1", None, "t", 1, 900, 9), ("w2", None, None, "short", 2, 900, 1)], "id string, arxiv_k string, doi_k string, title string, parser_version int, n_chars int, created_at int")
    assert rows(files.cached_parse(wanted, parsed, 2, 500)) == [("w1", "p3", 0)]
