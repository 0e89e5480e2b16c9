"""Evaluation statistics as aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, keys: list[str], truth: Column, said: Column) -> DataFrame:
    """tp, fp, fn, tn and accuracy, precision, recall, f1, specificity, each 0 where undefined."""
    c = df.groupBy(*keys).agg(
        F.sum((truth & said).cast("long")).alias("tp"),
        F.sum((~truth & said).cast("long")).alias("fp"),
        F.sum((truth & ~said).cast("long")).alias("fn"),
        F.sum((~truth & ~said).cast("long")).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p, r = _safe(tp, tp + fp), _safe(tp, tp + fn)
    return c.select("*", _safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), p.alias("precision"), r.alias("recall"), _safe(2 * p * r, p + r).alias("f1"), _safe(tn, tn + fp).alias("specificity"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share; (0, 0) for no trials."""
    p = hits / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    centre, scale = p + z * z / (2 * n), 1 + z * z / n
    low, high = (centre - half) / scale, (centre + half) / scale
    return F.when(n > 0, F.greatest(low, F.lit(0.0))).otherwise(F.lit(0.0)), F.when(n > 0, F.least(high, F.lit(1.0))).otherwise(F.lit(0.0))


def auc(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve by ranks, ties half; null where a class is missing.

    Scores are grouped first, so that the running count is over distinct scores, not rows.
    """
    by_score = df.groupBy(*keys, score).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("n"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(w), F.lit(0))
    wins = by_score.withColumn("wins", F.col("p") * (below + F.col("n") / 2))
    total = wins.groupBy(*keys).agg(F.sum("wins").alias("w"), F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"))
    return total.select(*keys, "n_positive", "n_negative", F.when((F.col("n_positive") > 0) & (F.col("n_negative") > 0), F.col("w") / (F.col("n_positive") * F.col("n_negative"))).alias("auc"))


def average_precision(df: DataFrame, keys: list[str], order: list[Column], positive: Column) -> DataFrame:
    """Mean precision at the place of each positive row; null without any."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_n", F.row_number().over(w)).withColumn("_p", positive.cast("long"))
    ranked = ranked.withColumn("_hits", F.sum("_p").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.groupBy(*keys).agg(F.avg(F.when(F.col("_p") == 1, F.col("_hits") / F.col("_n"))).alias("average_precision"))


def ndcg(df: DataFrame, keys: list[str], order: list[Column], gain: str, k: int) -> DataFrame:
    """nDCG at k with linear gains; 0 where there is no gain."""
    w, ideal = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(F.desc(gain))
    ranked = df.withColumns({"_n": F.row_number().over(w), "_i": F.row_number().over(ideal)})
    share = lambda n: F.sum(F.when(n <= k, F.col(gain) / F.log2(n + 1)).otherwise(0.0))
    out = ranked.groupBy(*keys).agg(share(F.col("_n")).alias("d"), share(F.col("_i")).alias("i"))
    return out.select(*keys, _safe(F.col("d"), F.col("i")).alias("ndcg"))


def threshold_sweep(df: DataFrame, score: str, positive: Column, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 of score >= threshold for each threshold, in one pass."""
    spread = df.select(positive.alias("_t"), F.col(score).alias("_s"), F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return confusion(spread, ["threshold"], F.col("_t"), F.col("_s") >= F.col("threshold"))


def brier(df: DataFrame, keys: list[str], probability: Column, positive: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((probability - positive.cast("double")) ** 2).alias("brier"), F.count(F.lit(1)).alias("n"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labellings beyond chance, one row."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    n = pairs.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = pairs.groupBy(F.col(a).alias("label")).agg(F.sum("n").alias("na"))
    right = pairs.groupBy(F.col(b).alias("label")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "label").agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    return n.crossJoin(F.broadcast(chance)).select(
        F.col("total").alias("n"), (F.col("same") / F.col("total")).alias("agreement"),
        ((F.col("same") / F.col("total") - F.col("e") / F.col("total") / F.col("total")) / (1 - F.col("e") / F.col("total") / F.col("total"))).alias("kappa"),
    )


def mcnemar(df: DataFrame, a_right: Column, b_right: Column) -> DataFrame:
    """Discordant counts of two models and the exact two-sided p-value (binomial tail)."""
    import math

    counts = df.agg(F.count_if(a_right & ~b_right).alias("only_a"), F.count_if(~a_right & b_right).alias("only_b"))

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = []
            for x, y in zip(pdf["only_a"], pdf["only_b"]):
                n, k = int(x + y), int(min(x, y))
                logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
                values.append(min(1.0, 2 * math.fsum(math.exp(v) for v in logs)) if n else 1.0)
            yield pdf.assign(p_value=values)

    return counts.mapInPandas(tail, "only_a long, only_b long, p_value double")


def bootstrap_mean(df: DataFrame, value: str, key: str, draws: int = 200, seed: int = 7) -> DataFrame:
    """Percentile interval of a mean by the Poisson bootstrap: each row weighs a Poisson(1) number in every draw, taken
    from a hash of row, draw and seed, so that draws need one pass, no shuffle of rows and give the same on every run."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.col("draw")), 11) / F.lit(float(2**53))).alias("u")
    spread = df.select(key, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).select("draw", value, u)
    weight = F.lit(0)
    cumulative, mass = 0.0, 0.36787944117144233
    for i in range(8):
        cumulative += mass
        mass /= i + 1
        weight = weight + F.when(F.col("u") >= cumulative, 1).otherwise(0)
    means = spread.groupBy("draw").agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("mean"))
    return means.agg(F.round(F.percentile("mean", 0.025), 6).alias("low"), F.round(F.percentile("mean", 0.5), 6).alias("median"), F.round(F.percentile("mean", 0.975), 6).alias("high"))
