"""One key, source or group of copies holds a large part of all rows."""

import pytest

from siltstone.llm import consensus, linkage, lookalikes, mixing, packing, pairs


def test_copies_of_one_text_against_one_variant(spark):
    docs = [(i, "a common text") for i in range(2000)] + [(5000, "а common text"), (5001, "another one")]
    got = {(r.doc_a, r.doc_b) for r in lookalikes.lookalike_pairs(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    assert got == {(i, 5000) for i in range(2000)}


def test_one_reference_repeated_and_spelled_in_many_ways(spark):
    title = "sparse rankers for quote clustering in mining permits under privacy limits"
    refs = [(i, title, None, ["K. Fesil"], 2019) for i in range(1500)] + [(5000 + i, title, None, [f"K. Fesil{'x' * (i % 3)}", f"B. Name{i}"], 2019) for i in range(500)]
    papers = [("p1", title, None, None, ["Kora Fesil"], 2019)] + [(f"q{i}", f"Other title number {i} about things", None, None, ["B. Zalin"], 2000) for i in range(50)]
    matches, _ = linkage.link(
        spark.createDataFrame(refs, "reference_id long, ref_key string, title string, authors array<string>, year int"),
        spark.createDataFrame(papers, "id string, title string, doi string, arxiv_id string, authors array<string>, year int"),
    )
    got = matches.collect()
    assert len(got) == len({r.reference_id for r in got}) == 2000


def test_one_row_with_very_many_annotators(spark):
    votes = [(1, f"a{i}", 2 if i % 3 else 0) for i in range(1500)] + [(r, f"a{i}", 1) for r in range(2, 30) for i in range(3)]
    q, counts = consensus.fit(spark.createDataFrame(votes, "row_id long, annotator string, label int"), rounds=4)
    top = {r.row_id: max(range(3), key=lambda k: r[f"q{k}"]) for r in q.collect()}
    assert top[1] == 2 and all(top[r] == 1 for r in range(2, 30)) and counts.count() == 1500


def test_one_source_and_one_size(spark):
    docs = [(i, "hot" if i % 10 else "cold", 512) for i in range(3000)]
    counted = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    _, report = mixing.mix(counted, spark.createDataFrame([("hot", 0.5, 1), ("cold", 0.5, 4)], "source string, target_share double, max_repeats int"))
    assert {r.source: r.reached_share for r in report.collect()} == pytest.approx({"hot": 0.5, "cold": 0.5}, abs=0.01)
    items = counted.selectExpr("doc_id", "0 piece_no", "0 start", "tokens")
    assert packing.pack(items.repartition(50)).groupBy("container_id").count().where("count <> 4").count() <= 1


def test_one_answer_repeated(spark):
    rows = [(i, "I must decline to judge this item.", "Claim: a thing is so and not otherwise.") for i in range(3000)]
    got = pairs.find_defects(spark.createDataFrame(rows, "verdict_id long, raw_output string, prompt string"))
    assert {(r.defect, r["count"]) for r in got.groupBy("defect").count().collect()} == {("refusal", 3000)}
