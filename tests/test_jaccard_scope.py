import random

from siltstone.operators import retrieval


def test_sets_meet_within_their_scope_and_no_side_is_broadcast(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(9)]
    make = lambda n: [(i, rng.choice("xyz"), rng.sample(words, rng.randint(1, 7))) for i in range(n)]
    left, right = make(120), make(150)
    got = retrieval.jaccard_pairs(spark.createDataFrame(left, "i long, s string, a array<string>"), "i", "a", spark.createDataFrame(right, "j long, s string, b array<string>"), "j", "b", (11, 20), ("s",))
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j): round(share(a, b), 6) for i, s, a in left for j, t, b in right if s == t and share(a, b) >= 0.55}
    assert want and {(r.i, r.j): r.jaccard for r in got.collect()} == want
