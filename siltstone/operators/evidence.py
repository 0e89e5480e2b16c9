"""Evidence aggregation: weighted sources, coverage states, noisy-or, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of a source by how much of it was read.
LEVEL_WEIGHTS = {"full_text": 1.0, "abstract": 0.5, "web_snippet": 0.5}
CLAMP = 0.95


def level_weight(level: Column) -> Column:
    """Weight of an evidence level; unknown and missing levels count full."""
    weight = F.lit(1.0)
    for name, value in LEVEL_WEIGHTS.items():
        weight = F.when(level == name, value).otherwise(weight)
    return weight


def weighted_sources(df: DataFrame, keys: list[str], source: str, level: str, order: str) -> DataFrame:
    """Per key: distinct sources and the sum of the weights of each source's last level."""
    last = df.groupBy(*keys, source).agg(F.max_by(level, order).alias("_level"))
    return last.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sources"), F.sum(level_weight(F.col("_level"))).alias("weighted_sources"))


def noisy_or(weight: Column) -> Column:
    """Aggregate 1 - product of (1 - weight), weights clamped to [0, 0.95]; 0 for no rows."""
    clamped = F.least(F.lit(CLAMP), F.greatest(F.lit(0.0), weight))
    return F.coalesce(1 - F.product(1 - clamped), F.lit(0.0))


def best_per_document(df: DataFrame, keys: list[str], doc: str, weight: str) -> DataFrame:
    """Highest weight of each document per key."""
    return df.groupBy(*keys, doc).agg(F.max(weight).alias(weight))


def label_decision(support: Column, contra: Column, documents: Column, partial: Column) -> Column:
    """Label of a claim from its supporting and contradicting scores; a tie contradicts."""
    return (
        F.when((contra > 0) & (contra >= support), "contradicted")
        .when((support > 0) & (documents >= 2), "supported")
        .when((support > 0) | (partial > 0), "partially_supported")
        .otherwise("unverified")
    )


def capped_confidence(label: Column, score: Column) -> Column:
    """Confidence of a label: 0.5 at most where unverified, 0.6 where partial."""
    return F.when(label == "unverified", F.least(score, F.lit(0.5))).when(label == "partially_supported", F.least(score, F.lit(0.6))).otherwise(score)


def aspect_states(aspects: DataFrame, findings: DataFrame, keys: list[str], verdict: str, source: str, least: int = 2) -> DataFrame:
    """State of every aspect, also of those without findings: covered (enough yes from enough sources), synthesis (yes
    or partial from enough sources), no_candidates, unjudged, judged_insufficient."""
    yes, partial = F.col(verdict) == "yes", F.col(verdict) == "partial"
    counted = findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(verdict).alias("n_judged"),
        F.sum(yes.cast("long")).alias("n_yes"),
        F.sum(partial.cast("long")).alias("n_partial"),
        F.count_distinct(F.when(yes, F.col(source))).alias("yes_sources"),
        F.count_distinct(F.when(yes | partial, F.col(source))).alias("some_sources"),
    )
    names = ["n", "n_judged", "n_yes", "n_partial", "yes_sources", "some_sources"]
    full = aspects.select(*keys).distinct().join(counted, keys, "left").fillna(0, names)
    state = (
        F.when((F.col("n_yes") >= least) & (F.col("yes_sources") >= least), "covered")
        .when((F.col("n_yes") + F.col("n_partial") >= least) & (F.col("some_sources") >= least), "synthesis")
        .when(F.col("n") == 0, "no_candidates")
        .when(F.col("n_judged") == 0, "unjudged")
        .otherwise("judged_insufficient")
    )
    return full.withColumn("state", state)
