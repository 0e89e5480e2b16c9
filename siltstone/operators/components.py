"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import forget, materialize


def _signature(links: DataFrame) -> tuple:
    """Count and two order-free checksums of a set of links; equal sets have equal signatures."""
    row = links.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("hi", "lo")).alias("x"),
        F.sum(F.hash("lo", "hi").cast("decimal(38,0)")).alias("s"),
    ).first()
    return tuple(row)


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct(F.col("hi").alias("n"), F.col("lo").alias("m")), F.struct(F.col("lo").alias("n"), F.col("hi").alias("m")))).alias("e")).select("e.*")


def _contract(links: DataFrame, max_rounds: int) -> DataFrame:
    """Links (hi, root) of every node that is not the smallest of its component, by alternating star contraction."""
    signature = _signature(links)
    for _ in range(max_rounds):
        if signature[0] == 0:
            return links
        low = _both_ways(links).groupBy("n").agg(F.min("m").alias("m0")).select("n", F.least("n", "m0").alias("root"))
        large = (
            links.select(F.col("lo").alias("n"), F.col("hi").alias("m"))
            .join(low, "n")
            .where(F.col("m") > F.col("root"))
            .select(F.col("m").alias("hi"), F.col("root").alias("lo"))
            .distinct()
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(least, "hi")
        pulled = small.select("hi", F.col("root").alias("lo")).unionAll(
            small.where(F.col("lo") != F.col("root")).select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
        )
        new = materialize(pulled.distinct(), "links")
        forget(links)
        links, before = new, signature
        signature = _signature(links)
        if signature == before:
            return links
    raise RuntimeError("components did not settle; raise max_rounds")


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 40) -> DataFrame:
    """``node`` and ``component`` of every node: a member of its component, the same one for all members.

    Nodes with one link only are set aside first: they follow their neighbour and connect nothing. What is left, mostly
    a small part, is settled by alternating star contraction: in a round each node links its larger neighbours to its
    smallest one, then the smaller ones likewise, so that the number of rounds grows with the logarithm of a
    component's size. Every round is a pre-aggregated minimum and a join, is written to the shared folder, and replaces
    the links of the round before; nothing is collected but a checksum. Nulls and self links are ignored; an empty edge
    table gives no rows.
    """
    links = (
        edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"))
        .where(F.col("hi").isNotNull() & F.col("lo").isNotNull() & (F.col("hi") != F.col("lo")))
        .distinct()
    )
    links = materialize(links, "links")
    single = _both_ways(links).groupBy("n").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") == 1).select("n")
    marked = links.join(single.withColumnRenamed("n", "hi").withColumn("hi_leaf", F.lit(True)), "hi", "left")
    marked = marked.join(single.withColumnRenamed("n", "lo").withColumn("lo_leaf", F.lit(True)), "lo", "left")
    marked = materialize(marked.select("hi", "lo", F.coalesce("hi_leaf", F.lit(False)).alias("hi_leaf"), F.coalesce("lo_leaf", F.lit(False)).alias("lo_leaf")), "marked")
    forget(links)
    core = _contract(materialize(marked.where(~F.col("hi_leaf") & ~F.col("lo_leaf")).select("hi", "lo"), "links"), max_rounds)
    inner = core.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(core.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
    leaf = F.when(F.col("hi_leaf"), F.col("hi")).otherwise(F.col("lo"))
    anchor = F.when(F.col("hi_leaf"), F.col("lo")).otherwise(F.col("hi"))
    hung = marked.where(F.col("hi_leaf") | F.col("lo_leaf")).select(leaf.alias("leaf"), anchor.alias("anchor"))
    found = hung.join(inner, F.col("anchor") == F.col("node"), "left").select("leaf", "anchor", F.coalesce("component", "anchor").alias("component"), F.col("node").isNull().alias("alone"))
    outer = found.select(
        F.explode(
            F.when(F.col("alone"), F.array(F.struct(F.col("leaf").alias("node"), "component"), F.struct(F.col("anchor").alias("node"), "component"))).otherwise(
                F.array(F.struct(F.col("leaf").alias("node"), "component"))
            )
        ).alias("x")
    ).select("x.*")
    return inner.unionAll(outer.distinct())
