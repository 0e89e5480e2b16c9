"""Mixing sources to target weights.

Weights come from temperature mixing: token shares are raised to an exponent that is found by bisection, for a target
entropy or for the repetition limits at a given budget. They are realised as budgeted block permutations: in every pass a
source's documents are ordered by a seeded hash of their own, in blocks; prefix sums over block totals and within blocks
say how far the budget reaches, and whole passes before it are repetitions. Nothing is sorted as a whole.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.tokens import TOKENIZER, token_counts
from siltstone.session import materialize
from siltstone.sources import table

SEED = 11
#: Tokens that a block of the permutation holds about; the number of blocks follows the corpus.
BLOCK_TOKENS, LEAST_BLOCKS = 50_000_000, 256
#: Sources of a target table; it is a configuration, and a larger one is refused before anything is collected.
MOST_SOURCES = 10_000
#: Documents past a source's budget that are looked at to fill what the last document left.
FILLERS = 1_000


def tempered(shares: dict[str, float], alpha: float, base: dict[str, float] | None = None) -> dict[str, float]:
    """Normalised shares ** alpha, or base ** (1 - alpha) * shares ** alpha where a base is given."""
    raw = {s: math.exp(alpha * math.log(p) + ((1 - alpha) * math.log(base[s]) if base else 0)) for s, p in shares.items() if p > 0}
    total = sum(raw.values())
    return {s: w / total for s, w in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def exponent_for_entropy(shares: dict[str, float], target: float, steps: int = 60) -> float:
    """Exponent at which the tempered shares have the target entropy: 0 mixes evenly, 1 keeps the shares."""
    low, high = 0.0, 16.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(tempered(shares, mid)) > target else (low, mid)
    return (low + high) / 2


def exponent_for_limit(targets: dict[str, float], natural: dict[str, float], most: dict[str, float], budget: float, steps: int = 60) -> float:
    """Largest exponent in [0, 1] between natural shares (0) and targets (1) at which no source needs more than ``most``."""

    def fits(alpha: float) -> bool:
        return all(w * budget <= most[s] * (1 + 1e-12) for s, w in tempered(targets, alpha, natural).items())

    if fits(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def _sources(counted: DataFrame, targets: DataFrame) -> list[dict]:
    """Tokens and targets of the sources in the target table; only these few rows reach the driver."""
    wanted = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")
    )
    sizes = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    rows = wanted.join(sizes, "source", "left").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the target table")
    return [{"source": r["source"], "share": r["target_share"], "most": r["max_repeats"] or 1, "tokens": r["tokens"] or 0} for r in sorted(rows, key=lambda r: r["source"])]


def plan_mixture(sources: list[dict], budget: float | None = None) -> list[dict]:
    """Weight, token quota and exponent per source. Without a budget, the largest one at which every target is met; with
    a larger one, the exponent between natural shares (0) and targets (1) is bisected for the repetition limits."""
    usable = [s for s in sources if s["tokens"] > 0]
    total = sum(s["share"] for s in usable)
    if not usable:
        return [s | {"weight": 0.0, "quota": 0.0, "exponent": 1.0} for s in sources]
    targets = {s["source"]: s["share"] / total for s in usable}
    most = {s["source"]: float(s["most"] * s["tokens"]) for s in usable}
    size = sum(s["tokens"] for s in usable)
    natural = {s["source"]: s["tokens"] / size for s in usable}
    if budget is None:
        budget = min(most[s] / targets[s] for s in targets)
    budget = min(budget, sum(most.values()))
    exponent = exponent_for_limit(targets, natural, most, budget)
    weights = tempered(targets, exponent, natural)
    return [s | {"weight": weights.get(s["source"], 0.0), "quota": min(weights.get(s["source"], 0.0) * budget, most.get(s["source"], 0.0)), "exponent": exponent} for s in sources]


def _fill(offers: DataFrame, gaps: DataFrame) -> DataFrame:
    """Of the documents past the one that crossed a source's budget, those that fill its gap: the next FILLERS of them in
    the pass's order that fit it, each taken if it still does. At most FILLERS rows of a source are seen by a task."""
    after = offers.join(F.broadcast(gaps), ["source", "epoch"]).where((F.col("upto") > F.col("rest")) & (F.col("tokens") <= F.col("gap")) & (F.col("tokens") > 0))
    order = Window.partitionBy("source", "epoch").orderBy("block", "key", "doc_id")
    few = after.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= FILLERS)

    names = offers.columns

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        gap, chosen = pdf["gap"].iloc[0], []
        for i, tokens in pdf.sort_values("_n")["tokens"].items():
            if tokens <= gap:
                gap -= tokens
                chosen.append(i)
        return pdf.loc[chosen, names]

    return few.groupBy("source", "epoch").applyInPandas(take, offers.schema)


def mix(counted: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(uses, report). ``uses``: one row per use of a document: doc_id, source, tokens, epoch, position in [0, 1]; by
    position, every stretch of the mixture has about the target shares. ``report``: per source of the target table its
    target, weight, quota, tokens used, reached share, share of its tokens used at all, documents, most uses of a
    document, and the exponent of the mixture.

    ``counted``: doc_id, source, tokens. Rows without source, or of sources without target, are left out; so are those
    of null size; sources without documents stay in the report with share 0, the others' targets scaled up. Documents
    of no tokens count as used in every pass. Repeated rows are documents of their own, in the order of their ids. Each
    pass has an order of its own; the last one ends where its budget does, and smaller documents past that fill the gap.
    """
    spark = counted.sparkSession
    planned = plan_mixture(_sources(counted, targets), budget)
    schema = "source string, target_share double, max_repeats int, size bigint, weight double, quota double, exponent double"
    plan = spark.createDataFrame([(p["source"], float(p["share"]), int(p["most"]), int(p["tokens"]), float(p["weight"]), float(p["quota"]), float(p["exponent"])) for p in planned], schema)
    blocks = max(LEAST_BLOCKS, max([p["tokens"] for p in planned], default=0) // BLOCK_TOKENS)
    passes = F.least(F.floor(F.coalesce(F.try_divide(F.col("quota"), F.col("size")), F.lit(0.0)) + 1e-9), F.col("max_repeats")).cast("int")
    plan = plan.withColumn("passes", passes)
    plan = plan.withColumn("rest", F.when(F.col("passes") < F.col("max_repeats"), F.col("quota") - F.col("passes") * F.col("size")).otherwise(0.0))
    docs = counted.where(F.col("tokens").isNotNull()).select("doc_id", "source", "tokens").join(F.broadcast(plan.select("source", "passes", "rest", "size", "max_repeats")), "source")
    last = F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0)
    docs = docs.where(last > 0).select("doc_id", "source", "tokens", "size", "passes", "rest", F.explode(F.sequence(F.lit(1), last)).alias("epoch"))
    key = F.xxhash64(F.lit(seed), F.col("epoch"), F.col("doc_id"))
    docs = docs.withColumn("key", key).withColumn("block", F.shiftrightunsigned("key", 40).cast("int") % blocks)
    sums = docs.groupBy("source", "epoch", "block").agg(F.sum("tokens").alias("in_block"))
    before = Window.partitionBy("source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "epoch", "block", F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "epoch", "block").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    docs = docs.withColumn("upto", F.sum("tokens").over(inside)).join(sums, ["source", "epoch", "block"])
    docs = materialize(docs.withColumn("upto", F.col("upto") + F.col("before")).drop("before"), "offers")
    whole = F.col("epoch") <= F.col("passes")
    kept = docs.where(whole | (F.col("upto") <= F.col("rest")))
    part = docs.where(~whole)
    reached = part.groupBy("source", "epoch").agg((F.max("rest") - F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0))).alias("gap"))
    used = kept.unionByName(_fill(part, reached.where(F.col("gap") > 0)))
    position = F.coalesce(F.try_divide((F.col("epoch") - 1) * F.col("size") + F.col("upto") - F.col("tokens"), F.col("size") * F.col("passes") + F.col("rest")), F.lit(0.0))
    spread = used.select("doc_id", "source", "tokens", "epoch", F.least(F.lit(1.0), position).alias("position"))
    per_doc = used.groupBy("source", "doc_id").agg(F.sum("tokens").alias("used"), F.max("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"))
    per_source = per_doc.groupBy("source").agg(F.sum("used").alias("used_tokens"), F.sum("tokens").alias("seen_tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").cast("int").alias("most_uses"))
    report = plan.join(per_source, "source", "left").fillna(0, ["used_tokens", "seen_tokens", "documents", "most_uses"])
    everything = Window.partitionBy()
    share = F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(everything))
    report = report.select(
        "source", "target_share", F.round("weight", 6).alias("weight"), F.round("quota").cast("long").alias("quota"), "used_tokens",
        F.round(F.coalesce(share, F.lit(0.0)), 6).alias("reached_share"), F.round(F.coalesce(F.try_divide(F.col("seen_tokens"), F.col("size")), F.lit(0.0)), 6).alias("corpus_share"),
        "documents", "most_uses", "max_repeats", F.round("exponent", 6).alias("exponent"),
    )
    return spread, report


def _counted(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return materialize(token_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", tokenizer), "counted")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


def _whole_budget(counted: DataFrame, targets: DataFrame) -> float:
    """As many tokens as the listed sources have."""
    return float(sum(s["tokens"] for s in _sources(counted, targets)))


def p7_tempered_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture as large as the listed sources, at the exponent that the repetition limits allow for it."""
    counted, targets = _counted(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mix(counted, targets, _whole_budget(counted, targets))[0]


def p7_tempered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, targets = _counted(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mix(counted, targets, _whole_budget(counted, targets))[1]


def p7_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural token shares of the listed sources and their weights at the exponent that gives the targets' entropy."""
    found = [s for s in _sources(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets")) if s["tokens"] > 0]
    size, total = sum(s["tokens"] for s in found), sum(s["share"] for s in found)
    natural = {s["source"]: s["tokens"] / size for s in found}
    alpha = exponent_for_entropy(natural, entropy({s["source"]: s["share"] / total for s in found})) if found else 1.0
    weights = tempered(natural, alpha)
    rows = [(s, round(natural[s], 6), round(weights[s], 6), round(alpha, 6)) for s in natural]
    return spark.createDataFrame(rows, "source string, natural_share double, weight double, exponent double")
