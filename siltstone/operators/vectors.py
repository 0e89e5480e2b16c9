"""Vectors: cosine of unit vectors, top-k of a query set, assignment with a margin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of a query set sent to the workers at once; a larger set is cut into blocks, each against all rows.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, floor: float = -1.0, apart: str | None = None) -> DataFrame:
    """For every query the k rows of highest cosine (rounded to 6) at or over the floor, itself left out, and with
    ``apart`` those of the query's own value of that column too.

    Columns: query, neighbour, similarity, place. The query set is read in blocks of a fixed size; each block goes to
    the workers as one matrix, a batch of rows is one matrix product, and a worker keeps the best k of its batch, so
    that at most k rows per query and batch are shuffled. Ties go to the smaller key.
    """
    out = None
    group = F.col(apart).cast("string") if apart else F.lit(None).cast("string")
    stated = queries.select(F.col(key).alias("q"), F.col(vector).alias("v"), group.alias("g")).where(F.col("v").isNotNull()).orderBy("q")
    feed = rows.select(F.col(key).cast("long").alias("r"), F.col(vector).alias("v"), group.alias("g")).where(F.col("v").isNotNull())
    for ids, matrix, groups in _blocks(stated):
        found = feed.mapInPandas(_best(ids, matrix, groups, k, floor), "query long, neighbour long, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "query long, neighbour long, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return out.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def _blocks(stated: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    ids, vectors, groups = [], [], []
    for row in stated.toLocalIterator():
        ids.append(row["q"])
        vectors.append(row["v"])
        groups.append(row["g"])
        if len(ids) == BLOCK:
            yield np.array(ids), np.array(vectors, dtype=np.float64), groups
            ids, vectors, groups = [], [], []
    if ids:
        yield np.array(ids), np.array(vectors, dtype=np.float64), groups


def _best(ids: np.ndarray, matrix: np.ndarray, groups: list, k: int, floor: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            keys, own = pdf["r"].to_numpy(), pdf["g"].to_numpy()
            scores = np.round(np.stack(pdf["v"].to_numpy()).astype(np.float64) @ matrix.T, 6)
            parts = []
            for j, q in enumerate(ids):
                s = scores[:, j]
                mask = (s >= floor) & (keys != q)
                if groups[j] is not None:
                    mask &= own != groups[j]
                keep = np.flatnonzero(mask)
                keep = keep[np.lexsort((keys[keep], -s[keep]))][:k]
                parts.append(pd.DataFrame({"query": q, "neighbour": keys[keep], "similarity": s[keep]}))
            yield pd.concat(parts)

    return run


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of every label, as label and array of doubles: element-wise averages, pre-aggregated."""
    parts = df.select(label, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select(label, F.transform("p", lambda p: p["x"]).alias("centroid"))


def assign_with_margin(df: DataFrame, key: str, vector: str, targets: DataFrame, label: str, margin: float) -> DataFrame:
    """Best target of every row by dot product, and whether the second best is within the margin.

    ``targets`` (label, centroid) must be small: it is collected into one array, and refused above 100,000 entries.
    """
    if targets.limit(100_001).count() > 100_000:
        raise ValueError("too many targets for an assignment in one pass")
    packed = targets.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("t"), F.col("centroid").alias("c")))).alias("targets"))
    scored = df.crossJoin(F.broadcast(packed)).select(
        key, F.transform("targets", lambda t: F.struct(F.round(dot(F.col(vector), t["c"]), 6).alias("s"), (-t["t"]).alias("t"))).alias("scores")
    )
    ranked = scored.select(key, F.sort_array("scores", asc=False).alias("scores"))
    first, second = F.col("scores").getItem(0), F.get("scores", F.lit(1))
    return ranked.select(key, (-first["t"]).alias("assigned"), first["s"].alias("score"), F.coalesce(first["s"] - second["s"] <= margin, F.lit(False)).alias("near_tie"))


def greedy_clusters(df: DataFrame, scope: list[str], key: str, vector: str, threshold: float) -> DataFrame:
    """Greedy clustering in key order within each scope: an item joins the best representative at or over the threshold,
    or starts a cluster. The semantics are sequential, so a scope is one pass; scopes must be bounded by construction
    (findings of one question), and are read in key order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        vectors = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        reps: list[int] = []
        chosen = []
        for i in range(len(pdf)):
            scores = np.round(vectors[reps] @ vectors[i], 6) if reps else np.array([])
            if len(scores) and scores.max() >= threshold:
                chosen.append(reps[int(scores.argmax())])
            else:
                reps.append(i)
                chosen.append(i)
        keys = pdf[key].to_numpy()
        out = pdf[[*scope, key]].copy()
        out["representative"] = keys[chosen]
        return out

    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {fields[c]}" for c in [*scope, key]), f"representative {fields[key]}"])
    return df.select(*scope, key, vector).groupBy(*scope).applyInPandas(run, schema)
