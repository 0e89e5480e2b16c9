"""Window operators: newest rows, caps, quotas, numbering. All orders are total, so that results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _desc(order: list) -> list[Column]:
    return [o if isinstance(o, Column) else F.col(o) for o in order]


def newest_generation(df: DataFrame, keys: list[str], time: str, seconds: int) -> DataFrame:
    """Rows within ``seconds`` (inclusive) of the newest row of their group."""
    newest = df.groupBy(*keys).agg(F.max(time).alias("_newest"))
    back = F.col("_newest") - F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return df.join(newest, keys).where(F.col(time) >= back).drop("_newest")


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key in the given order; the rank filter runs before the shuffle too."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """First k rows per key in the given (total) order."""
    w = Window.partitionBy(*keys).orderBy(*_desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def dedup_keep_best_then_cap(df: DataFrame, identity: list[str], group: list[str], order: list, cap: int) -> DataFrame:
    """Best row per identity, then the first ``cap`` of them per group."""
    return top_k(top_k(df, identity, order, 1), group, order, cap)


def fair_trim(df: DataFrame, group: list[str], order: list, cap: int) -> DataFrame:
    """At most ``cap`` rows over all groups: every group's first row before any group's second one.

    Ranks within groups are windows over groups; the final cut is a distributed top-n, not one sorted partition.
    """
    w = Window.partitionBy(*group).orderBy(*_desc(order))
    ranked = df.withColumn("rank_in_group", F.row_number().over(w))
    return ranked.orderBy("rank_in_group", *_desc(order)).limit(cap)


def diverse_cap(df: DataFrame, section: str, doc: str, order: list, cap: int) -> DataFrame:
    """At most ``cap`` rows per section: the first of each document, then the second of each."""
    inner = Window.partitionBy(section, doc).orderBy(*_desc(order))
    ranked = df.withColumn("_inner", F.row_number().over(inner))
    outer = Window.partitionBy(section).orderBy("_inner", *_desc(order))
    return ranked.withColumn("_outer", F.row_number().over(outer)).where(F.col("_outer") <= cap).drop("_inner", "_outer")


def budget_in_order(df: DataFrame, keys: list[str], order: list, eligible: Column, budget: int) -> DataFrame:
    """Rows with ``judged``: true for the first ``budget`` eligible ones of each key in order."""
    w = Window.partitionBy(*keys).orderBy(*_desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(eligible.cast("long")).over(w)
    return df.withColumn("judged", eligible & (spent <= budget))


def number_by_first_use(df: DataFrame, scope: list[str], item: str, order: str) -> DataFrame:
    """Items of each scope numbered from 1 by the place of their first use: scope, item, first_place, number."""
    first = df.groupBy(*scope, item).agg(F.min(order).alias("first_place"))
    w = Window.partitionBy(*scope).orderBy("first_place", item)
    return first.withColumn("number", F.row_number().over(w).cast("long"))


def round_robin(df: DataFrame, scope: list[str], group: str, order: list, quota: int) -> DataFrame:
    """First ``quota`` rows per scope, taking one of each group in turn; ``turn`` is the place in that sequence."""
    inner = Window.partitionBy(*scope, group).orderBy(*_desc(order))
    ranked = df.withColumn("_round", F.row_number().over(inner))
    outer = Window.partitionBy(*scope).orderBy("_round", group)
    return ranked.withColumn("turn", F.row_number().over(outer).cast("long")).where(F.col("turn") <= quota).drop("_round")


def mid_rank_percentile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with ``percentile``: (average rank - 1) / (n - 1) within the key; 0.5 in groups of one."""
    by_value = Window.partitionBy(*keys).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    rank = F.rank().over(by_value) + (ties - 1) / 2
    return df.withColumn("percentile", F.when(n > 1, (rank - 1) / (n - 1)).otherwise(F.lit(0.5)))


def first_filled(df: DataFrame, keys: list[str], order: Column, fields: list[str]) -> DataFrame:
    """Per key and field the first non-empty value in order: gaps of the best copy are filled from the next ones."""
    aggregates = []
    for f in fields:
        filled = F.col(f).isNotNull()
        if dict(df.dtypes)[f] == "string":
            filled = filled & (F.trim(F.col(f)) != "")
        aggregates.append(F.min_by(F.when(filled, F.col(f)), F.when(filled, order)).alias(f))
    return df.groupBy(*keys).agg(*aggregates)


def tiers_by_rank(df: DataFrame, keys: list[str], order: list, tiers: int) -> DataFrame:
    """Rows with ``tier`` 1..n: equal thirds (or other parts) of each key's order."""
    w = Window.partitionBy(*keys).orderBy(*_desc(order))
    return df.withColumn("tier", F.ntile(tiers).over(w))


def group_in_sizes(df: DataFrame, keys: list[str], order: list, size: int) -> DataFrame:
    """Rows with ``job``: consecutive groups of ``size`` within each key, from 0."""
    w = Window.partitionBy(*keys).orderBy(*_desc(order))
    return df.withColumn("job", F.floor((F.row_number().over(w) - 1) / size))


def mirror_pairs(df: DataFrame, a: str, b: str, order: list) -> DataFrame:
    """One row per unordered pair: the first in order."""
    found = df.withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)})
    return top_k(found, ["_lo", "_hi"], order, 1).drop("_lo", "_hi")
