"""Writes: aligned appends, merges by key, partition replacement, resumable output, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.functions.text import strip_nul


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the target's columns, types and order; missing ones null, further ones left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def merged(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with their keys; ``keep_old`` columns keep the old row's value."""
    fresh = aligned(new, old.schema)
    if keep_old:
        before = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep_old])
        fresh = fresh.join(before, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep_old}).select(*old.columns)
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(fresh)


def without_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write ``df`` so that each partition it has replaces the stored one; others stay. Repeating it changes nothing."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def not_written(df: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Rows still to be done: resume by key."""
    return df.join(written.select(key), key, "left_anti")


def counted(log: DataFrame, keys: list[str], time: str, detail: str) -> DataFrame:
    """Counters per key from a log of failures: count, first and last time, the last detail."""
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("fail_count"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.max_by(detail, F.struct(time, detail)).alias(detail))


def cleaned(df: DataFrame) -> DataFrame:
    """NUL characters out of every string and NaN and infinities null, at any depth of arrays, structs and map values."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return strip_nul(c)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, x: clean(x, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def split_rows(df: DataFrame, key: str, seed: int, shares: dict[str, float]) -> DataFrame:
    """Rows with ``split``, by a seeded hash of the key: the same on every run, whatever the partitions."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))
    low, out = 0.0, F.lit(list(shares)[-1])
    bounds = []
    for name, share in shares.items():
        low += share
        bounds.append((name, low))
    for name, bound in reversed(bounds[:-1]):
        out = F.when(u < bound, name).otherwise(out)
    return df.withColumn("split", out)


def audit_files(df: DataFrame, order: list[str], hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """A blind sheet and its key: rows numbered in order, the hidden columns in the key only.

    Numbers come from one global sort; an audit sheet is read by people and small by nature.
    """
    numbered = df.withColumn("sheet_row", F.row_number().over(Window.orderBy(*order)))
    return numbered.drop(*hidden), numbered.select("sheet_row", *hidden)


def markdown(df: DataFrame, scope: str, position: str, heading: str, body: str) -> DataFrame:
    """One markdown text per scope from its sections in order."""
    parts = df.groupBy(scope).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.concat(F.lit("## "), F.col(heading), F.lit("\n\n"), F.col(body)).alias("t")))).alias("x"))
    return parts.select(scope, F.array_join(F.transform("x", lambda s: s["t"]), "\n\n").alias("markdown"))
