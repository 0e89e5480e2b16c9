"""Filling fixed-capacity containers with items of varying length.

Bounded-space online packing: every partition keeps a fixed number of open windows, puts each item where it fits best,
and sends off the fullest window when none fits and all are open. What is still open at the end of a partition is packed
again with its neighbours' leftovers, level by level. Items are packed where they are read: only leftovers are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.tokens import TOKENIZER, token_counts
from siltstone.session import materialize
from siltstone.sources import table

CAPACITY, OPEN_WINDOWS, FAN_IN = 2048, 64, 32
#: A window filled to this share is sent off at once.
FULL = 0.995
ITEM = "doc_id bigint, piece_no int, start bigint, tokens bigint"
PLACED = f"container_id string, state string, {ITEM}"


class Packer:
    """Open windows of one stream: at most ``limit`` at a time, best fit, the fullest one leaves first."""

    def __init__(self, name: str, capacity: int, limit: int):
        self.name, self.capacity, self.limit = name, capacity, limit
        self.free: list[tuple[int, int]] = []  # (free space, window), sorted
        self.items: dict[int, list[tuple]] = {}
        self.made = 0

    def _leave(self, at: int) -> list[tuple]:
        _, window = self.free.pop(at)
        return [(f"{self.name}-{window}", "packed", *item) for item in self.items.pop(window)]

    def add(self, item: tuple) -> list[tuple]:
        """Place an item (.., tokens); rows of the window that leaves, if one does."""
        size, out = item[-1], []
        at = bisect_left(self.free, (size, -1))
        if at == len(self.free):
            if len(self.free) >= self.limit:
                out = self._leave(0)
            window, space = self.made, self.capacity
            self.made += 1
            self.items[window] = []
        else:
            space, window = self.free.pop(at)
        self.items[window].append(item)
        space -= size
        insort(self.free, (space, window))
        if space <= (1 - FULL) * self.capacity:
            out += self._leave(bisect_left(self.free, (space, window)))
        return out

    def rest(self, state: str) -> list[tuple]:
        return [(f"{self.name}-{w}", state, *item) for _, w in self.free for item in self.items[w]]


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def items_of(counted: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Items (doc_id, piece_no, start, tokens): a text within the capacity is one, a larger one full pieces and a rest."""
    last = F.greatest(F.ceil(F.col("tokens") / capacity).cast("int") - 1, F.lit(0))
    cut = counted.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    start = (F.col("piece_no") * F.lit(capacity)).cast("long")
    return cut.select("doc_id", "piece_no", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - start).alias("tokens"))


def _again(level: str, capacity: int, open_windows: int, last: bool):
    """Packer of a group's leftovers, largest first; at the last level no window stays open."""

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(f"{level}{key[0]}", capacity, len(pdf) + 1 if last else open_windows)
        out = []
        for item in pdf.sort_values(["tokens", "doc_id", "piece_no"], ascending=[False, True, True])[_columns(ITEM)].itertuples(index=False, name=None):
            out += packer.add(item)
        out += packer.rest("packed" if last else "open")
        return pd.DataFrame([(*row, key[0]) for row in out], columns=[*_columns(PLACED), "part"])

    return again


def pack(items: DataFrame, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Rows (container_id, doc_id, piece_no, start, tokens): every item in one container of at most ``capacity`` tokens.

    ``items``: doc_id, piece_no, start, tokens (0..capacity, checked). Repeated and equal items are placed each; items of
    size 0 go where there is room; null sizes are left out; empty tables give no rows; further columns are ignored.
    """
    names = _columns(ITEM)
    rows = items.where(F.col("tokens").isNotNull()).select(F.col("doc_id").cast("long"), F.col("piece_no").cast("int"), F.col("start").cast("long"), F.col("tokens").cast("long"))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(f"a{TaskContext.get().partitionId()}", capacity, open_windows)
        for pdf in batches:
            out = []
            for item in pdf[names].itertuples(index=False, name=None):
                if not 0 <= item[-1] <= capacity:
                    raise ValueError(f"item of {item[-1]} tokens, capacity {capacity}")
                out += packer.add(item)
            yield pd.DataFrame(out, columns=_columns(PLACED))
        yield pd.DataFrame(packer.rest("open"), columns=_columns(PLACED))

    placed = materialize(rows.mapInPandas(first, PLACED), "packed")
    done = [placed.where(F.col("state") == "packed")]
    left = placed.where(F.col("state") == "open").withColumn("part", F.regexp_extract("container_id", r"^a(\d+)-", 1).cast("long"))
    parts = rows.rdd.getNumPartitions()
    level = 0
    while True:
        level += 1
        parts = -(-parts // FAN_IN)
        last = parts <= 1

        grouped = left.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInPandas(_again("bcdefgh"[level - 1], capacity, open_windows, last), PLACED + ", part bigint")
        if last:
            done.append(grouped.drop("part"))
            break
        grouped = materialize(grouped, "packed")
        done.append(grouped.where(F.col("state") == "packed").drop("part"))
        left = grouped.where(F.col("state") == "open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("state")


def pack_texts(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    return pack(items_of(token_counts(docs.select("doc_id", "text"), "text", tokenizer), capacity), capacity)


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of the whole corpus with their items, fill and unused space."""
    placed = pack_texts(table(spark, sf_dir, "documents"))
    return placed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("tokens").alias("tokens")).withColumn("unused", CAPACITY - F.col("tokens"))


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: containers, the least number possible, items, tokens and the share of the space that is used."""
    c = p6_containers(spark, sf_dir)
    return c.agg(
        F.count(F.lit(1)).alias("containers"),
        F.ceil(F.sum("tokens") / CAPACITY).alias("least_containers"),
        F.sum("n_items").alias("items"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("tokens") / (F.count(F.lit(1)) * CAPACITY), 6).alias("used_share"),
    )
