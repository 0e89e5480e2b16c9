import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import consensus

LABELS = "vote_id long, row_id long, annotator string, label string, labeled_at timestamp, n double, q0 double"


def test_labels_as_people_write_them(spark):
    texts = ["1", " 1", "1.0", "YES", "Yes ", "0,5", ".5", "0.50", "Partial ", "0", "0.0", "No", "?", "", " ", None, "2", "maybe"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(consensus.read_label(F.col("t"))).collect()]
    assert got == [2] * 5 + [1] * 4 + [0] * 3 + [None] * 6


def test_digamma(spark):
    got = spark.createDataFrame([(0.1,), (1.0,), (2.5,), (100.0,)], "x double").select(consensus.digamma(F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx([-10.423754940411, -0.577215664902, 0.703156640645, 4.600161852738], abs=1e-7)


def simulate(n_items=400, seed=3):
    rng = random.Random(seed)
    skill = {"good1": 0.95, "good2": 0.9, "fair": 0.75, "lazy": None, "liar": 0.1, "few": 0.9}
    truth, rows = {}, []
    for i in range(n_items):
        t = rng.choices([0, 1, 2], [0.5, 0.2, 0.3])[0]
        truth[i] = t
        for name, p in skill.items():
            if name == "few" and i % 40:
                continue
            label = rng.randrange(3) if p is None else t if rng.random() < p else rng.choice([x for x in range(3) if x != t])
            rows.append((i, name, label))
    return truth, rows


def test_consensus_beats_the_majority_and_tells_annotators_apart(spark):
    truth, rows = simulate()
    q, counts = consensus.fit(spark.createDataFrame(rows, "row_id long, annotator string, label int"))
    got = {r.row_id: int(np.argmax([r.q0, r.q1, r.q2])) for r in q.collect()}
    votes = {}
    for i, _, label in rows:
        votes.setdefault(i, []).append(label)
    majority = {i: max(range(3), key=lambda k: (v.count(k), -k)) for i, v in votes.items()}
    right = lambda found: sum(found[i] == t for i, t in truth.items()) / len(truth)
    assert right(got) > 0.95 and right(got) > right(majority)
    rel = {r.annotator: r for r in consensus.reliability(counts).collect()}
    assert rel["good1"].reliability > rel["fair"].reliability > rel["lazy"].reliability > rel["liar"].reliability
    assert rel["few"].high - rel["few"].low > 2 * (rel["good2"].high - rel["good2"].low)
    assert all(0 <= r.low <= r.reliability <= r.high <= 1 for r in rel.values())


def test_latest_readable_label_counts_and_the_judge_votes_on_labelled_rows_only(spark):
    day = lambda n: dt.datetime(2025, 1, n)
    rows = [(1, 1, "a", "0", day(1)), (2, 1, "a", "1", day(3)), (3, 1, "a", "0", day(2)), (4, 1, "b", "?", day(1)), (5, 2, "a", None, day(1)), (6, 3, "a", "1", None), (7, 3, "a", "1", None), (8, None, "a", "1", day(1))]
    labels = spark.createDataFrame([(*r, 0.0, 0.0) for r in rows], LABELS)
    audit = spark.createDataFrame([(1, "yes"), (2, "no"), (3, None)], "row_id long, judge_final string")
    got = {(r.row_id, r.annotator): r.label for r in consensus.votes_of(labels, audit).collect()}
    assert got == {(1, "a"): 2, (1, consensus.JUDGE): 2, (3, "a"): 2}


def test_empty(spark):
    empty = spark.createDataFrame([], "row_id long, annotator string, label int")
    q, counts = consensus.fit(empty, rounds=2)
    assert q.count() == 0 and counts.count() == 0


def test_krippendorff_against_the_definition(spark):
    rows = [(1, "a", 0), (1, "b", 0), (1, "c", 1), (2, "a", 2), (2, "b", 2), (3, "a", 1), (3, "b", 0), (4, "a", 2)]
    got = consensus.krippendorff(spark.createDataFrame(rows, "row_id long, annotator string, label int")).first()
    units = [[0, 0, 1], [2, 2], [1, 0]]
    pooled = [x for u in units for x in u]
    d = lambda x, y: float(x != y)
    observed = sum(d(u[i], u[j]) / (len(u) - 1) for u in units for i in range(len(u)) for j in range(len(u)) if i != j) / len(pooled)
    expected = sum(d(pooled[i], pooled[j]) for i in range(len(pooled)) for j in range(len(pooled)) if i != j) / (len(pooled) * (len(pooled) - 1))
    assert got.alpha_nominal == pytest.approx(1 - observed / expected, abs=1e-6)
    same = spark.createDataFrame([(1, "a", 0), (1, "b", 0)], "row_id long, annotator string, label int")
    assert consensus.krippendorff(same).first().alpha_nominal is None
