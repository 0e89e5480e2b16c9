"""Consensus of several annotators' labels.

A mean-field variational model: every item has a true class, every annotator a confusion matrix with Dirichlet rows.
Annotators' expected log probabilities (digamma of the posterior counts) are joined to the votes and summed per item;
the items' class probabilities are joined back and summed per annotator. A round is two joins and two pre-aggregated
group-bys over the votes; the class prior is one row of counts over all items, added to every item's scores as such.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.session import forget, materialize
from siltstone.sources import table

CLASSES = ("0", "0.5", "1")
K = len(CLASSES)
ROUNDS, LOOK = 40, 2
#: The rounds end when no cell of a confusion matrix moved by more than this share of its annotator's votes.
SETTLED = 2e-5
DIAGONAL, OFF, CLASS_PRIOR = 3.0, 0.6, 2.0
PRIOR = "#prior"
JUDGE = "#judge"


def read_label(label: Column) -> Column:
    """Class index of a label as people write it; null for unreadable ones."""
    text = F.replace(F.lower(F.trim(F.regexp_replace(label, r"[\s ]+", " "))), F.lit(","), F.lit("."))
    number = text.try_cast("double")
    return (
        F.when(text.isin("yes", "y", "true") | (number == 1), 2)
        .when(text.isin("partial", "partly", "partially") | (number == 0.5), 1)
        .when(text.isin("no", "n", "false") | (number == 0), 0)
    )


def digamma(x: Column) -> Column:
    """Digamma of a positive column: six steps of the recurrence, then the asymptotic series (error under 1e-9)."""
    y = x + 6
    steps = reduce(lambda a, b: a + b, [1 / (x + i) for i in range(6)])
    z = 1 / (y * y)
    return F.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z / 252)) - steps


def votes_of(labels: DataFrame, audit: DataFrame | None) -> DataFrame:
    """One vote (row_id, annotator, label) per annotator and row: the readable label with the latest labeled_at.

    Equal times are settled by the larger vote_id. Rows without a readable label are out; the judge votes on the others.
    """
    read = labels.select("row_id", "annotator", "vote_id", "labeled_at", read_label(F.col("label")).alias("label"))
    read = read.where(F.col("label").isNotNull() & F.col("row_id").isNotNull() & F.col("annotator").isNotNull())
    last = Window.partitionBy("row_id", "annotator").orderBy(F.desc_nulls_last("labeled_at"), F.desc("vote_id"))
    votes = read.withColumn("_n", F.row_number().over(last)).where(F.col("_n") == 1).select("row_id", "annotator", "label")
    votes = materialize(votes, "votes")
    if audit is None:
        return votes
    rows = votes.select("row_id").distinct()
    judge = audit.select("row_id", F.lit(JUDGE).alias("annotator"), read_label(F.col("judge_final")).alias("label"))
    judge = judge.where(F.col("label").isNotNull()).groupBy("row_id", "annotator").agg(F.max("label").alias("label")).join(rows, "row_id", "left_semi")
    return materialize(votes.unionByName(judge), "votes")


def _probabilities(scored: DataFrame) -> DataFrame:
    """Softmax of the columns s0.. into q0.."""
    top = F.greatest(*[F.col(f"s{k}") for k in range(K)])
    soft = scored.withColumns({f"e{k}": F.exp(F.col(f"s{k}") - top) for k in range(K)})
    total = reduce(lambda a, b: a + b, [F.col(f"e{k}") for k in range(K)])
    return soft.select("row_id", *[(F.col(f"e{k}") / total).alias(f"q{k}") for k in range(K)])


def _counts(votes: DataFrame, q: DataFrame) -> DataFrame:
    """Expected votes n{k}{l} of each annotator: true class k, label l; and one row of the prior, its n{k}0 the expected
    number of items of class k."""
    joined = votes.join(q, "row_id")
    items = q.agg(*[F.coalesce(F.sum(f"q{k}"), F.lit(0.0)).alias(f"n{k}0") for k in range(K)]).withColumn("annotator", F.lit(PRIOR))
    items = items.select("annotator", *[F.col(f"n{k}0") if m == 0 else F.lit(0.0).alias(f"n{k}{m}") for k in range(K) for m in range(K)])
    return items.unionByName(_annotator_counts(joined))


def _annotator_counts(joined: DataFrame) -> DataFrame:
    return joined.groupBy("annotator").agg(*[F.sum(F.when(F.col("label") == m, F.col(f"q{k}")).otherwise(0.0)).alias(f"n{k}{m}") for k in range(K) for m in range(K)])


def _alpha(k: int, m: int) -> Column:
    return F.col(f"n{k}{m}") + (DIAGONAL if k == m else OFF)


def _expected_logs(counts: DataFrame) -> DataFrame:
    """Rows (annotator, label, t0..): expected log probability of the label under each true class.

    The digamma is one lambda over the array of an annotator's cells and row sums: one small expression, no shuffle.
    """
    is_prior = F.col("annotator") == PRIOR
    whole = reduce(lambda a, b: a + b, [F.col(f"n{k}0") + CLASS_PRIOR for k in range(K)])
    cells = [F.when(is_prior, F.col(f"n{k}0") + CLASS_PRIOR).otherwise(_alpha(k, m)) for k in range(K) for m in range(K)]
    sums = [F.when(is_prior, whole).otherwise(reduce(lambda a, b: a + b, [_alpha(k, j) for j in range(K)])) for k in range(K)]
    logs = counts.select("annotator", F.transform(F.array(*cells, *sums), digamma).alias("v"))
    rows = [F.struct(F.lit(m).alias("label"), *[(F.col("v")[k * K + m] - F.col("v")[K * K + k]).alias(f"t{k}") for k in range(K)]) for m in range(K)]
    return logs.select("annotator", F.explode(F.array(*rows)).alias("x")).select("annotator", "x.*")


def _largest_move(before: DataFrame, after: DataFrame) -> float:
    """Largest change of a cell between two tables of counts, as a share of its annotator's votes."""
    cells = [f"n{k}{m}" for k in range(K) for m in range(K)]
    old = before.select("annotator", *[F.col(c).alias(f"o{c}") for c in cells])
    total = reduce(lambda a, b: a + b, [F.col(c) for c in cells])
    moved = F.greatest(*[F.abs(F.col(c) - F.col(f"o{c}")) for c in cells]) / F.greatest(total, F.lit(1.0))
    return after.join(old, "annotator").agg(F.max(moved)).first()[0] or 0.0


def fit(votes: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Posterior class probabilities per row (row_id, q0..) and expected confusion counts per annotator.

    ``votes``: row_id, annotator, label (0..2). An empty table gives empty ones. Every round's counts, a row per
    annotator, are written, which cuts the lineage; every few rounds they are compared with the ones before, and one
    number of that reaches the driver. Where ``rounds`` end before the counts have settled, a warning says so.
    """
    share = [F.sum(F.when(F.col("label") == k, 1.0).otherwise(0.0)) + 0.2 for k in range(K)]
    size = F.count(F.lit(1)) + 0.2 * K
    q = votes.groupBy("row_id").agg(*[(share[k] / size).alias(f"q{k}") for k in range(K)])
    counts = None
    for i in range(rounds):
        before, counts = counts, materialize(_counts(votes, q), "counts")
        if before is not None and i % LOOK == LOOK - 1 and _largest_move(before, counts) < SETTLED:
            break
        logs = _expected_logs(counts)
        prior = logs.where((F.col("annotator") == PRIOR) & (F.col("label") == 0)).select(*[F.col(f"t{k}").alias(f"p{k}") for k in range(K)])
        scored = votes.join(logs.where(F.col("annotator") != PRIOR), ["annotator", "label"]).groupBy("row_id").agg(*[F.sum(f"t{k}").alias(f"s{k}") for k in range(K)])
        scored = scored.crossJoin(F.broadcast(prior)).select("row_id", *[(F.col(f"s{k}") + F.col(f"p{k}")).alias(f"s{k}") for k in range(K)])
        q = _probabilities(scored)
        if before is not None:  # what q is made of now are the newer counts
            forget(before)
    else:
        warnings.warn(f"the consensus had not settled after {rounds} rounds", stacklevel=2)
    return materialize(q, "posterior"), counts.where(F.col("annotator") != PRIOR)


def _best_class() -> Column:
    """Most probable class; equal ones go to the lower class."""
    return F.when((F.col("q0") >= F.col("q1")) & (F.col("q0") >= F.col("q2")), CLASSES[0]).when(F.col("q1") >= F.col("q2"), CLASSES[1]).otherwise(CLASSES[2])


def reliability(counts: DataFrame) -> DataFrame:
    """Per annotator: expected accuracy over classes as often as its items have them, with a 95 % posterior interval."""
    rows = [reduce(lambda a, b: a + b, [_alpha(k, m) for m in range(K)]) for k in range(K)]
    seen = [reduce(lambda a, b: a + b, [F.col(f"n{k}{m}") for m in range(K)]) for k in range(K)]
    total = reduce(lambda a, b: a + b, seen)
    weight = [seen[k] / total for k in range(K)]
    mean = reduce(lambda a, b: a + b, [weight[k] * _alpha(k, k) / rows[k] for k in range(K)])
    var = reduce(lambda a, b: a + b, [weight[k] * weight[k] * _alpha(k, k) * (rows[k] - _alpha(k, k)) / (rows[k] * rows[k] * (rows[k] + 1)) for k in range(K)])
    found = counts.select("annotator", F.round(total).cast("long").alias("n_votes"), mean.alias("m"), F.sqrt(var).alias("sd"))
    return found.select(
        "annotator", "n_votes", F.round("m", 4).alias("reliability"),
        F.round(F.greatest(F.lit(0.0), F.col("m") - 1.96 * F.col("sd")), 4).alias("low"),
        F.round(F.least(F.lit(1.0), F.col("m") + 1.96 * F.col("sd")), 4).alias("high"),
    )


def row_agreement(votes: DataFrame) -> DataFrame:
    """Per row: votes, share of agreeing pairs of votes (null below two votes), and counts per class."""
    c = votes.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("label") == k).cast("long")).alias(f"c{k}") for k in range(K)])
    same = reduce(lambda a, b: a + b, [F.col(f"c{k}") * (F.col(f"c{k}") - 1) for k in range(K)])
    return c.withColumn("agreement", F.when(F.col("n") > 1, same / (F.col("n") * (F.col("n") - 1))))


def krippendorff(votes: DataFrame) -> DataFrame:
    """One row: Krippendorff's alpha with nominal and with interval distances, over rows with two votes or more.

    From the coincidences of pairs within rows; null where nothing varies.
    """
    rows = row_agreement(votes).where(F.col("n") > 1)
    value = [0.0, 0.5, 1.0]
    observed = {}
    for name in ("nominal", "interval"):
        far = [[(0.0 if k == m else 1.0) if name == "nominal" else (value[k] - value[m]) ** 2 for m in range(K)] for k in range(K)]
        pairs = reduce(lambda a, b: a + b, [F.col(f"c{k}") * F.col(f"c{m}") * far[k][m] for k in range(K) for m in range(K)])
        observed[name] = F.sum(pairs / (F.col("n") - 1))
    total = rows.agg(F.sum("n").alias("n"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(K)], *[v.alias(name) for name, v in observed.items()])
    out = [F.col("n").alias("n_votes")]
    for name in observed:
        far = [[(0.0 if k == m else 1.0) if name == "nominal" else (value[k] - value[m]) ** 2 for m in range(K)] for k in range(K)]
        expected = reduce(lambda a, b: a + b, [F.col(f"c{k}") * F.col(f"c{m}") * far[k][m] for k in range(K) for m in range(K)]) / (F.col("n") - 1)
        out.append(F.round(F.when(expected > 0, 1 - F.col(name) / expected), 6).alias(f"alpha_{name}"))
    return total.select(*out)


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes_of(table(spark, sf_dir, "tag_audit_labels"), table(spark, sf_dir, "tag_audit"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, _ = fit(_votes(spark, sf_dir))
    return q.select("row_id", _best_class().alias("consensus"))


def p4_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: consensus, its probability, votes and agreement."""
    votes = _votes(spark, sf_dir)
    q, _ = fit(votes)
    rows = row_agreement(votes).select("row_id", F.col("n").alias("n_votes"), F.round("agreement", 6).alias("agreement"))
    return q.select("row_id", _best_class().alias("consensus"), F.round(F.greatest("q0", "q1", "q2"), 4).alias("probability")).join(rows, "row_id")


def p4_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability(fit(_votes(spark, sf_dir))[1])


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return krippendorff(_votes(spark, sf_dir))
