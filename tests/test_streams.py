import datetime as dt

from pyspark.sql import functions as F

from siltstone.streaming import runs

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def write(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(e, dt.datetime(2025, 1, day, hour), u, t) for e, day, hour, u, t in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))


BATCHES = [[(1, 1, 1, 7, "view"), (2, 1, 2, 7, "error"), (3, 1, 3, 8, "view")], [(2, 1, 2, 7, "error"), (4, 2, 1, 7, "purchase"), (5, 2, 2, 8, "error")], [(6, 3, 1, 7, "error"), (7, 3, 2, 9, "view")]]


def test_batches_of_a_folder_are_deduplicated_and_states_never_revert(spark, tmp_path):
    write(spark, tmp_path, BATCHES)
    stream = lambda: runs.event_stream(spark, str(tmp_path))
    distinct = runs.run_to_table(runs.distinct_events(stream(), ["event_id"]).select("event_id"), "append")
    assert sorted(r.event_id for r in distinct.collect()) == [1, 2, 3, 4, 5, 6, 7]
    states = runs.run_to_table(runs.run_states(stream().select("user_id", "event_type", "ts")), "update", ["user_id"])
    assert sorted((r.user_id, r.state, r.n_events) for r in states.collect()) == [(7, "completed", 5), (8, "failed", 2), (9, "running", 1)]
    days = runs.run_to_table(runs.day_counts(stream()), "complete").groupBy(F.to_date("w.start").alias("d")).agg(F.sum("n").alias("n"))
    assert sorted((r.d.day, r.n) for r in days.collect()) == [(1, 4), (2, 2), (3, 2)]


def test_empty_folder(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "events.parquet"))
    assert runs.run_to_table(runs.day_counts(runs.event_stream(spark, str(tmp_path))), "complete").count() == 0
