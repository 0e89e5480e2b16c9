"""Reducers of ordered event streams, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dedup_last_arrival(df: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """One row per key: the one that arrived last."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(a) for a in arrival])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def monotone(df: DataFrame, keys: list[str], order: list[str], counter: str) -> DataFrame:
    """Rows with ``highest``: the running maximum of a cumulative counter."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("highest", F.max(counter).over(w))


def sessions(df: DataFrame, keys: list[str], time: str, gap_seconds: int) -> DataFrame:
    """Rows with ``session``: 0-based number of the session, a new one after each gap."""
    w = Window.partitionBy(*keys).orderBy(time)
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    new = F.when(gap > gap_seconds * 1_000_000, 1).otherwise(0)
    marked = df.withColumn("_new", new)
    return marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def stage_deltas(df: DataFrame, keys: list[str], stage: str, order: str, counter: str) -> DataFrame:
    """Per stage the counter's last value minus its first one, not under zero."""
    ends = df.groupBy(*keys, stage).agg(F.min_by(counter, order).alias("first"), F.max_by(counter, order).alias("last"))
    return ends.select(*keys, stage, F.greatest(F.col("last") - F.col("first"), F.lit(0.0)).alias("delta"))


def time_shares(df: DataFrame, keys: list[str], stage: str, seconds: str) -> DataFrame:
    """Seconds of each stage and its share of its key's total."""
    total = df.groupBy(*keys, stage).agg(F.sum(seconds).alias("seconds"))
    whole = F.sum("seconds").over(Window.partitionBy(*keys))
    return total.withColumn("share", F.when(whole > 0, F.col("seconds") / whole).otherwise(F.lit(0.0)))


def run_state(df: DataFrame, keys: list[str], order: list[str], event: str, closing: list[str], failing: list[str]) -> DataFrame:
    """State of each run by its last event: completed, failed or running; a closed run stays closed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_i", F.row_number().over(w))
    out = ranked.groupBy(*keys).agg(
        F.max_by(event, "_i").alias("last_event"),
        F.max(F.when(F.col(event).isin(*closing), F.col("_i"))).alias("closed_at"),
        F.max(F.when(F.col(event).isin(*failing), F.col("_i"))).alias("failed_at"),
        F.count(F.lit(1)).alias("n_events"),
    )
    state = F.when(F.col("closed_at").isNotNull(), "completed").when(F.col("failed_at").isNotNull(), "failed").otherwise("running")
    return out.select(*keys, "last_event", state.alias("state"), "n_events")


def snapshot_difference(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Increase of a value between two snapshots, keys without change left out."""
    a = before.select(*keys, F.col(value).alias("_a"))
    b = after.select(*keys, F.col(value).alias("_b"))
    both = a.join(b, keys, "full_outer").select(*keys, (F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))).alias("delta"))
    return both.where(F.col("delta") != 0)


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """Per key the element at int(q * (n - 1)) of its sorted values, without interpolation, as ``name``. Values are counted
    before they are shuffled, and the window runs over distinct ones."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy(*keys)
    upto = everything.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.select(*keys, value, F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(everything).alias("_all"))
    return ranked.where(F.col("_upto") > F.floor(q * (F.col("_all") - 1))).groupBy(*keys).agg(F.min(value).alias(name))


def with_closing(df: DataFrame, keys: list[str], seq: str, event: str, done: str, failed: str, started: str, finished: str) -> DataFrame:
    """Events with ``made_up`` and ``stage``: a run whose last event closes it not gets a failing one after it, which names
    the stage that had started and not finished (null where none had). Runs are told apart by aggregates, not sorts."""
    ends = df.groupBy(*keys).agg(
        F.max_by(event, seq).alias("_last"), F.max(seq).alias("_seq"),
        F.when(F.bool_or(F.col(event) == started) & ~F.bool_or(F.col(event) == finished), F.lit(started)).alias("stage"),
    )
    extra = ends.where(~F.col("_last").isin(done, failed)).select(*keys, (F.col("_seq") + 1).alias(seq), F.lit(failed).alias(event), F.lit(True).alias("made_up"), "stage")
    return df.select(*keys, seq, event, F.lit(False).alias("made_up"), F.lit(None).cast("string").alias("stage")).unionByName(extra)


def search_states(df: DataFrame, key: str, seq: str, event: str, micros: str, value: str, rungs: tuple[str, ...], closing: str) -> DataFrame:
    """State of each key's search: ``rungs`` in the order they were first seen before the closing event, ``rung`` it was
    last on, largest stated ``total``, ``done``, and ``seconds`` from its first to its last event (null with one)."""
    mine = df.where(F.col(event).isin(*rungs, closing))
    closed = mine.where(F.col(event) == closing).groupBy(key).agg(F.min(seq).alias("_closed"))
    whole = mine.groupBy(key).agg(
        F.max(F.when(F.col(event) == closing, F.col(value))).alias("total"),
        F.when(F.count(F.lit(1)) >= 2, F.floor((F.max(micros) - F.min(micros)) / 1_000_000)).alias("seconds"),
    )
    open_ = mine.join(closed, key, "left").where((F.col(event) != closing) & (F.col("_closed").isNull() | (F.col(seq) < F.col("_closed"))))
    seen = open_.groupBy(key, event).agg(F.min(seq).alias("_first"), F.max(seq).alias("_last"))
    path = seen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_first", F.col(event).alias("e")))).alias("_p"), F.max_by(event, "_last").alias("rung"))
    out = whole.join(closed, key, "left").join(path, key, "left")
    names = F.coalesce(F.transform("_p", lambda x: x["e"]), F.array().cast("array<string>"))
    return out.select(key, names.alias("rungs"), "rung", "total", F.col("_closed").isNotNull().alias("done"), "seconds")


def rung_states(df: DataFrame, key: str, seq: str, event: str, value: str, rungs: tuple[str, ...], closing: str, failing: str, least: float = 100.0) -> DataFrame:
    """Every key by every known rung, and by any other kind that ran: ``state`` ran, running, not_needed (closed without
    it) or did_not_run, and ``found``, whether its best value is over ``least``."""
    per_key = df.groupBy(key).agg(F.bool_or(F.col(event) == closing).alias("_done"), F.max_by(event, F.when(F.col(event).isin(*rungs), F.col(seq))).alias("_now"))
    ran = df.where(F.col(event).isin(*rungs, failing)).groupBy(key, F.col(event).alias("rung")).agg(F.max(value).alias("_best"))
    known = per_key.select(key, F.explode(F.array(*[F.lit(r) for r in rungs])).alias("rung"))
    grid = known.unionByName(ran.select(key, "rung")).distinct()
    out = grid.join(ran.withColumn("_ran", F.lit(True)), [key, "rung"], "left").join(per_key, key)
    state = (
        F.when(F.col("_ran").isNull() & F.col("_done"), "not_needed").when(F.col("_ran").isNull(), "did_not_run")
        .when(~F.col("_done") & (F.col("_now") == F.col("rung")), "running").otherwise("ran")
    )
    return out.select(key, "rung", state.alias("state"), F.coalesce(F.col("_best") > least, F.lit(False)).alias("found"))


def step_rows(df: DataFrame, key: str, event: str, steps: tuple[str, ...], closing: str) -> DataFrame:
    """Every key by every step: done below the highest step reached and everywhere once closed, active at it, else waiting."""
    rank = F.array_position(F.array(*[F.lit(x) for x in steps]), F.col(event))
    per_key = df.groupBy(key).agg(F.max(rank).alias("_rank"), F.bool_or(F.col(event) == closing).alias("_closed"))
    rows = per_key.select("*", F.posexplode(F.array(*[F.lit(x) for x in steps])).alias("_i", "step"))
    at = F.col("_i") + 1
    return rows.select(key, "step", F.when(F.col("_closed") | (at < F.col("_rank")), "done").when(at == F.col("_rank"), "active").otherwise("waiting").alias("status"))
