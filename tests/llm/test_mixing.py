import pytest

from siltstone.llm import mixing


def test_exponents():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    for target in (0.4, 0.8, 1.05):
        assert mixing.entropy(mixing.tempered(shares, mixing.exponent_for_entropy(shares, target))) == pytest.approx(target, abs=1e-6)
    assert mixing.tempered(shares, 1.0) == pytest.approx(shares)


def test_largest_budget_meets_the_targets_and_a_larger_one_stays_within_the_limits():
    sources = [{"source": "a", "share": 0.5, "most": 2, "tokens": 1000}, {"source": "b", "share": 0.3, "most": 4, "tokens": 100}, {"source": "c", "share": 0.2, "most": 2, "tokens": 0}]
    plan = {p["source"]: p for p in mixing.plan_mixture(sources)}
    assert plan["a"]["weight"] == pytest.approx(0.625) and plan["b"]["quota"] == pytest.approx(400) and plan["c"]["quota"] == 0
    more = {p["source"]: p for p in mixing.plan_mixture(sources, budget=2000)}
    assert more["b"]["quota"] <= 400 and more["a"]["quota"] == pytest.approx(1600, rel=1e-3)


def run(spark, docs, targets, **kw):
    counted = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, tokens long, block int")
    wanted = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    uses, report = mixing.mix(counted, wanted, **kw)
    return uses.collect(), {r.source: r for r in report.collect()}


def test_shares_repeats_and_blocks(spark):
    docs = [(i, "big", 50 + i % 7) for i in range(4000)] + [(10_000 + i, "small", 20 + i % 5) for i in range(300)] + [(20_000, None, 5), (20_001, "unlisted", 5), (20_002, "big", None)]
    targets = [("big", 0.7, 2), ("small", 0.2, 3), ("absent", 0.1, 2)]
    uses, report = run(spark, docs, targets)
    assert report["big"].reached_share == pytest.approx(0.7 / 0.9, abs=0.005) and report["small"].reached_share == pytest.approx(0.2 / 0.9, abs=0.005)
    assert report["absent"].reached_share == 0 and report["small"].most_uses == 3 and report["big"].most_uses <= 2
    assert sum(r.tokens for r in uses if r.source == "small") == report["small"].used_tokens
    early = [r for r in uses if r.position < 0.25]
    share = sum(r.tokens for r in early if r.source == "small") / sum(r.tokens for r in early)
    assert share == pytest.approx(0.2 / 0.9, abs=0.02)
    assert len({(r.doc_id, r.epoch) for r in uses}) == len(uses)
    assert report["small"].corpus_share == 1 and 0 < report["big"].corpus_share < 1 and report["big"].exponent == 1
    orders = [[r.doc_id for r in sorted(uses, key=lambda r: r.position) if r.source == "small" and r.epoch == e] for e in (1, 2)]
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]


def test_a_long_document_at_the_budget_leaves_no_gap(spark):
    docs = [(i, "a", 900 if i % 5 == 0 else 10 + i % 3) for i in range(300)] + [(1000 + i, "b", 7) for i in range(100)]
    targets = [("a", 0.9, 1), ("b", 0.1, 1)]
    for seed in (1, 2, 3):
        _, report = run(spark, docs, targets, seed=seed)
        assert report["a"].reached_share == pytest.approx(0.9, abs=0.002) and report["a"].used_tokens <= report["a"].quota


def test_a_larger_budget_bisects_the_exponent(spark):
    docs = [(i, "a", 10) for i in range(1000)] + [(5000 + i, "b", 10) for i in range(50)]
    _, report = run(spark, docs, [("a", 0.5, 2), ("b", 0.5, 4)], budget=10_500)
    assert 0 < report["a"].exponent < 1 and report["b"].most_uses <= 4
    assert report["b"].used_tokens == pytest.approx(2000, abs=20) and report["a"].used_tokens == pytest.approx(8500, abs=20)


def test_same_on_any_partitioning(spark):
    docs = [(i, "s", 1 + i % 9) for i in range(500)]
    counted = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    wanted = spark.createDataFrame([("s", 1.0, 2)], "source string, target_share double, max_repeats int")
    one = {tuple(r) for r in mixing.mix(counted, wanted, budget=900)[0].collect()}
    assert one == {tuple(r) for r in mixing.mix(counted.repartition(7), wanted, budget=900)[0].collect()}


def test_empty(spark):
    uses, report = run(spark, [], [("a", 1.0, 2)])
    assert uses == [] and report["a"].reached_share == 0
    assert run(spark, [(1, "a", 3)], []) == ([], {})
