"""Joins beyond the plain ones: lookups by priority, division, validation, as-of, intervals, identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_known(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur in ``known`` (an IN list as a semi join)."""
    return df.join(known.select(*keys), keys, "left_semi")


def only_new(df: DataFrame, known: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows whose keys are not known, and of those that repeat a key the first in order."""
    fresh = df.join(known.select(*keys), keys, "left_anti")
    w = Window.partitionBy(*keys).orderBy(*order)
    return fresh.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def prefer_sources(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of lookups; where several hold a key, the earlier source's row wins. Sources must hold a key once."""
    ranked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)])
    w = Window.partitionBy(*keys).orderBy("source_rank")
    return ranked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def divided_by(parents: DataFrame, children: DataFrame, done: DataFrame, parent: str, child: str) -> DataFrame:
    """Parents all of whose children are done (and that have any), with the number of children."""
    marked = children.select(parent, child).distinct().join(done.select(child).distinct().withColumn("_done", F.lit(1)), child, "left")
    counted = marked.groupBy(parent).agg(F.count(F.lit(1)).alias("n_children"), F.count("_done").alias("n_done"))
    return parents.select(parent).distinct().join(counted.where(F.col("n_children") == F.col("n_done")).drop("n_done"), parent)


def compare_ids(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, with ``side`` missing (expected, not found) or unknown."""
    a = expected.select(key).distinct().withColumn("_a", F.lit(True))
    b = found.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull())
    return both.select(key, F.when(F.col("_b").isNull(), "missing").otherwise("unknown").alias("side"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Left rows with the values of the last right row at or before their time, per key.

    Both sides go through one window over the union, so no pair of rows is ever formed: a shuffle on the key, a sort,
    and a running last value. Keys may be as hot as a sort can spill; rows with a null key match nothing and stay out of
    the window.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    types = {f.name: f.dataType for f in right.schema.fields}
    unmatched = left.where(~known).select(*left.columns, *[F.lit(None).cast(types[v]).alias(v) for v in values])
    left, right = left.where(known), right.where(known)
    rows = left.withColumn("_side", F.lit(1)).withColumn("_time", F.col(left_time))
    feed = right.select(*keys, F.col(right_time).alias("_time"), F.struct(*values).alias("_values")).withColumn("_side", F.lit(0))
    both = rows.unionByName(feed, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_values", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    return seen.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values]).unionByName(unmatched)


def start_end_intervals(events: DataFrame, keys: list[str], time: str, is_start: Column, is_end: Column) -> DataFrame:
    """Intervals of every start to the next end of its key (null where none follows): keys, started, ended."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc("_end")).rowsBetween(Window.unboundedPreceding, -1)
    marked = events.where(is_start | is_end).withColumn("_end", is_end)
    closed = marked.withColumn("ended", F.last(F.when(F.col("_end"), F.col(time)), ignorenulls=True).over(w))
    return closed.where(~F.col("_end")).select(*keys, F.col(time).alias("started"), "ended")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], bucket_seconds: int) -> DataFrame:
    """Pairs of intervals (started, ended in seconds) of one key that overlap: joined on the key and on buckets of time,
    each pair kept in the bucket where the later one starts."""

    def spread(df: DataFrame, name: str) -> DataFrame:
        buckets = F.sequence(F.floor(F.col("started") / bucket_seconds), F.floor(F.col("ended") / bucket_seconds))
        return df.select(*keys, F.col("started").alias(f"{name}_started"), F.col("ended").alias(f"{name}_ended"), F.explode(buckets).alias("bucket"))

    pairs = spread(a.where("ended >= started"), "a").join(spread(b.where("ended >= started"), "b"), [*keys, "bucket"])
    start, end = F.greatest("a_started", "b_started"), F.least("a_ended", "b_ended")
    pairs = pairs.where((start < end) & (F.floor(start / bucket_seconds) == F.col("bucket")))
    return pairs.withColumn("overlap", end - start).drop("bucket")


def identity_first_match(df: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """Rows with ``matched``: the earliest row that shares a key, the keys tried in turn (not transitive); null where
    none does. Per key a pre-aggregated minimum joined back, so that null keys are not gathered and hot ones can be split."""
    out = df
    for i, k in enumerate(keys):
        first = df.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_m{i}"))
        out = out.join(first, k, "left")
    found = F.coalesce(*[F.when(F.col(f"_m{i}") < F.col(order), F.col(f"_m{i}")) for i in range(len(keys))])
    return out.withColumn("matched", found).drop(*[f"_m{i}" for i in range(len(keys))])
