"""Queries over run events: replay, states of a second search and of fact checks, ladders and summaries, with SQL twins.

Stored events stand for a run's: a user is a sub-question, views, clicks and signups are the rungs it searched on, a
purchase is its closing report (its value the total), an error a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import events as V
from siltstone.sources import table

T = table
RUNGS = ("view", "click", "signup")


def _events(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


def replayed_runs(s: SparkSession, d: str) -> DataFrame:
    """Stored events of every run and day, with a closing one made up where the run was cut off; the last three of each
    are what a client that has seen the others still needs."""
    e = T(s, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "event_type")
    closed = V.with_closing(e, ["user_id", "day"], "event_id", "event_type", "purchase", "error", started="view", finished="click")
    g = closed.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), F.max_by("event_type", "event_id").alias("last"), F.max("event_id").alias("last_seq"), F.bool_or("made_up").alias("made_up"))
    return g


def search_states(s: SparkSession, d: str) -> DataFrame:
    """Second search of each sub-question from its events: rungs in order, the one it is on, totals (largest seen), whether
    it is done, and its span in whole seconds (null with one event)."""
    return V.search_states(_events(s, d), "user_id", "event_id", "event_type", "at", "value", RUNGS, "purchase").withColumn("rungs", F.array_join("rungs", " "))


def rung_ladder(s: SparkSession, d: str) -> DataFrame:
    """Every sub-question by every known rung and any other that ran: ran, running, not_needed (done before it) or
    did_not_run, and whether it found something."""
    return V.rung_states(_events(s, d), "user_id", "event_id", "event_type", "value", RUNGS, "purchase", failing="error")


def fact_rows(s: SparkSession, d: str) -> DataFrame:
    """Steps of each sub-question's check by the highest rank reached: done before it, active at it (done if closed),
    waiting after it."""
    return V.step_rows(_events(s, d), "user_id", "event_type", RUNGS, "purchase")


def fact_progress(s: SparkSession, d: str) -> DataFrame:
    """Per day: the last step, the sub-question it belongs to, and counters of results and failures."""
    e = T(s, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "event_type", "user_id")
    step = F.when(F.col("event_type").isin(*RUNGS), F.col("event_id"))
    return e.groupBy("day").agg(
        F.max_by("event_type", step).alias("last_step"), F.max_by("user_id", step).alias("current"),
        F.count_if(F.col("event_type") == "purchase").alias("results"), F.count_if(F.col("event_type") == "error").alias("failures"),
    )


def report_lane(s: SparkSession, d: str) -> DataFrame:
    """Report stage of each run with its first and last event; runs that never entered it have no row."""
    e = _events(s, d).where("event_type in ('signup', 'purchase')")
    g = e.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "signup", F.col("at"))).alias("started"), F.max(F.when(F.col("event_type") == "purchase", F.col("at"))).alias("ended"))
    return g.where("started is not null").select("user_id", "started", F.when(F.col("ended") >= F.col("started"), F.col("ended")).alias("ended"))


def notes_in_place(s: SparkSession, d: str) -> DataFrame:
    """One note per code and sub-question: the latest value at the first one's place."""
    e = _events(s, d).groupBy("event_type", "user_id").agg(F.max_by("value", "event_id").alias("value"), F.min("event_id").alias("first"))
    return e.select("event_type", "user_id", "value", "first")


def event_times(s: SparkSession, d: str) -> DataFrame:
    """Event time of an entry: the time it states, where that can be read, else when it was sent."""
    e = T(s, d, "events").select("event_id", "ts", F.when(F.col("event_id") % 3 == 0, F.date_format(F.col("ts") - F.expr("INTERVAL 1 MINUTE"), "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.lit("soon")).alias("said"))
    at = F.coalesce(F.try_to_timestamp("said", F.lit("yyyy-MM-dd HH:mm:ss")), F.date_trunc("second", F.col("ts").cast("timestamp")))
    return e.select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


def yes_before_after(s: SparkSession, d: str) -> DataFrame:
    """Yes verdicts of each run before (first attempts) and after (later ones), over the rows that have both; runs without
    such a row give none."""
    v = T(s, d, "judge_verdicts").groupBy("row_id").agg(
        F.count_if(F.col("attempt") == 1).alias("a"), F.count_if(F.col("attempt") > 1).alias("b"),
        F.count_if((F.col("attempt") == 1) & (F.col("verdict_final") == "yes")).alias("before"), F.count_if((F.col("attempt") > 1) & (F.col("verdict_final") == "yes")).alias("after"),
    ).where("a > 0 and b > 0")
    j = v.join(T(s, d, "tag_audit").select("row_id", "query_id", "aspect_text"), "row_id")
    return j.groupBy("query_id").agg(F.sum("before").alias("before"), F.sum("after").alias("after"), F.count_distinct("aspect_text").alias("aspects"))


def rung_funnels(s: SparkSession, d: str) -> DataFrame:
    """Details of each source's search per run: queries used, and its funnel found -> kept -> parsed as one line."""
    p = T(s, d, "retrieved_papers").select("query_id", "source", "id", "judge_relevant", "query_variant_matched")
    known = T(s, d, "parsed_papers").select(F.col("retrieved_paper_id").alias("id"), F.lit(1).alias("parsed")).distinct()
    j = p.join(known, "id", "left")
    n = j.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("found"), F.count_if("judge_relevant").alias("kept"), F.count("parsed").alias("parsed"))
    q = p.select("query_id", "source", F.explode("query_variant_matched").alias("q")).groupBy("query_id", "source").agg(F.count_distinct("q").alias("queries"))
    line = F.concat_ws(" -> ", F.concat(F.col("found").cast("string"), F.lit(" found")), F.concat(F.col("kept").cast("string"), F.lit(" kept")), F.when(F.col("parsed") > 0, F.concat(F.col("parsed").cast("string"), F.lit(" parsed"))))
    return n.join(q, ["query_id", "source"], "left").select("query_id", "source", F.coalesce("queries", F.lit(0)).alias("queries"), line.alias("funnel"))


def added_sources(s: SparkSession, d: str) -> DataFrame:
    """Papers a later search added to a sub-question: those that came more than a day after its first one and were not
    there, by their title, before."""
    p = T(s, d, "retrieved_papers").where("title is not null").select("sub_question_id", "id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), F.lower(F.trim("title")).alias("t"))
    first = p.groupBy("sub_question_id").agg(F.min("at").alias("start"))
    seen = p.groupBy("sub_question_id", "t").agg(F.min_by("id", F.struct("at", "id")).alias("id"), F.min("at").alias("at"))
    return seen.join(first, "sub_question_id").where(F.col("at") - F.col("start") > 86_400_000_000).groupBy("sub_question_id").agg(F.count(F.lit(1)).alias("added"), F.min("id").alias("first_id"))


def second_search_summary(s: SparkSession, d: str) -> DataFrame:
    """One row: sub-questions searched again, those done, rungs run, totals, and seconds (null where none has any)."""
    st = V.search_states(_events(s, d), "user_id", "event_id", "event_type", "at", "value", RUNGS, "purchase")
    return st.agg(F.count(F.lit(1)).alias("needed"), F.count_if("done").alias("finished"), F.sum(F.size("rungs")).alias("rungs"), F.sum("seconds").alias("seconds"), F.round(F.max("total"), 4).alias("most"))


def usage_of_purpose(s: SparkSession, d: str) -> DataFrame:
    """Share of each kind of event whose total was overridden by the closing one: the larger of the running maximum and
    the last stated total."""
    e = _events(s, d)
    g = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "purchase", F.col("value"))).alias("running"), F.max_by(F.when(F.col("event_type") == "purchase", F.col("value")), F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("stated"))
    return g.select("user_id", F.coalesce("stated", "running").alias("total"), F.col("stated").isNotNull().alias("final"))


_R = ", ".join(f"'{r}'" for r in RUNGS)
_E = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t FROM events)"
_STATES = f"""WITH e AS {_E}, c AS (SELECT user_id, min(event_id) FILTER (WHERE event_type = 'purchase') AS c FROM e GROUP BY user_id),
f AS (SELECT user_id, event_type, min(event_id) AS f FROM e JOIN c USING (user_id) WHERE event_type IN ({_R}) AND (c IS NULL OR event_id < c) GROUP BY ALL),
g AS (SELECT user_id, string_agg(event_type, ' ' ORDER BY f) AS rungs, count(*) AS n_rungs FROM f GROUP BY user_id),
l AS (SELECT user_id, arg_max(event_type, event_id) AS rung FROM e JOIN c USING (user_id) WHERE event_type IN ({_R}) AND (c IS NULL OR event_id < c) GROUP BY user_id)
SELECT user_id, coalesce(rungs, '') AS rungs, coalesce(n_rungs, 0) AS n_rungs, rung, total, c IS NOT NULL AS done, seconds FROM (SELECT user_id, max(value) FILTER (WHERE event_type = 'purchase') AS total, CASE WHEN count(*) >= 2 THEN (max(t) - min(t)) // 1000000 END AS seconds FROM e WHERE event_type IN ({_R}, 'purchase') GROUP BY user_id) LEFT JOIN c USING (user_id) LEFT JOIN g USING (user_id) LEFT JOIN l USING (user_id)"""

QUERIES = {
    "replayed_runs": (replayed_runs, "WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, event_type FROM events), l AS (SELECT user_id, day, arg_max(event_type, event_id) AS t, max(event_id) AS q, count(*) AS n FROM e GROUP BY ALL) SELECT user_id, day, CASE WHEN t IN ('purchase', 'error') THEN n ELSE n + 1 END AS n, CASE WHEN t IN ('purchase', 'error') THEN t ELSE 'error' END AS last, CASE WHEN t IN ('purchase', 'error') THEN q ELSE q + 1 END AS last_seq, t NOT IN ('purchase', 'error') AS made_up FROM l"),
    "search_states": (search_states, f"SELECT user_id, rungs, rung, total, done, seconds FROM ({_STATES})"),
    "rung_ladder": (rung_ladder, f"WITH c AS (SELECT user_id, min(event_id) FILTER (WHERE event_type = 'purchase') AS c FROM events GROUP BY user_id), k AS (SELECT user_id, unnest([{_R}]) AS rung FROM c), x AS (SELECT user_id, event_type AS rung, min(event_id) AS a, max(value) AS best FROM events WHERE event_type IN ({_R}, 'error') GROUP BY ALL), l AS (SELECT user_id, arg_max(event_type, event_id) AS cur FROM events WHERE event_type IN ({_R}) GROUP BY user_id) SELECT user_id, rung, CASE WHEN a IS NULL AND c IS NOT NULL THEN 'not_needed' WHEN a IS NULL THEN 'did_not_run' WHEN c IS NULL AND cur = rung THEN 'running' ELSE 'ran' END AS state, coalesce(best > 100, false) AS found FROM (SELECT * FROM k UNION SELECT user_id, rung FROM x) JOIN c USING (user_id) LEFT JOIN x USING (user_id, rung) LEFT JOIN l USING (user_id)"),
    "fact_rows": (fact_rows, f"WITH m AS (SELECT user_id, max(list_position([{_R}], event_type)) AS m, bool_or(event_type = 'purchase') AS closed FROM events GROUP BY user_id) SELECT user_id, unnest([{_R}]) AS step, unnest([CASE WHEN closed OR 1 < m THEN 'done' WHEN 1 = m THEN 'active' ELSE 'waiting' END, CASE WHEN closed OR 2 < m THEN 'done' WHEN 2 = m THEN 'active' ELSE 'waiting' END, CASE WHEN closed OR 3 < m THEN 'done' WHEN 3 = m THEN 'active' ELSE 'waiting' END]) AS status FROM (SELECT user_id, closed, coalesce(m, 0) AS m FROM m)"),
    "fact_progress": (fact_progress, f"SELECT strftime(ts, '%Y-%m-%d') AS day, arg_max(event_type, event_id) FILTER (WHERE event_type IN ({_R})) AS last_step, arg_max(user_id, event_id) FILTER (WHERE event_type IN ({_R})) AS current, count(*) FILTER (WHERE event_type = 'purchase') AS results, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1"),
    "report_lane": (report_lane, f"SELECT user_id, started, CASE WHEN ended >= started THEN ended END AS ended FROM (SELECT user_id, min(t) FILTER (WHERE event_type = 'signup') AS started, max(t) FILTER (WHERE event_type = 'purchase') AS ended FROM {_E} GROUP BY user_id) WHERE started IS NOT NULL"),
    "notes_in_place": (notes_in_place, "SELECT event_type, user_id, arg_max(value, event_id) AS value, min(event_id) AS \"first\" FROM events GROUP BY ALL"),
    "event_times": (event_times, "SELECT event_id, strftime(CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 1 MINUTE ELSE ts END, '%Y-%m-%d %H:%M:%S') AS at FROM events"),
    "yes_before_after": (yes_before_after, "WITH v AS (SELECT row_id, count(*) FILTER (WHERE attempt = 1 AND verdict_final = 'yes') AS x, count(*) FILTER (WHERE attempt > 1 AND verdict_final = 'yes') AS y FROM judge_verdicts GROUP BY row_id HAVING count(*) FILTER (WHERE attempt = 1) > 0 AND count(*) FILTER (WHERE attempt > 1) > 0) SELECT query_id, CAST(sum(x) AS BIGINT) AS before, CAST(sum(y) AS BIGINT) AS after, count(DISTINCT aspect_text) AS aspects FROM v JOIN tag_audit USING (row_id) GROUP BY query_id"),
    "rung_funnels": (rung_funnels, "WITH n AS (SELECT query_id, source, count(*) AS f, count(*) FILTER (WHERE judge_relevant) AS k, count(*) FILTER (WHERE id IN (SELECT retrieved_paper_id FROM parsed_papers)) AS p FROM retrieved_papers GROUP BY ALL), q AS (SELECT query_id, source, count(DISTINCT q) AS queries FROM (SELECT query_id, source, unnest(query_variant_matched) AS q FROM retrieved_papers) GROUP BY ALL) SELECT n.query_id, n.source, coalesce(queries, 0) AS queries, concat_ws(' -> ', f || ' found', k || ' kept', CASE WHEN p > 0 THEN p || ' parsed' END) AS funnel FROM n LEFT JOIN q ON n.query_id IS NOT DISTINCT FROM q.query_id AND n.source = q.source"),
    "added_sources": (added_sources, "WITH p AS (SELECT sub_question_id, id, epoch_us(created_at) AS t, lower(trim(title, ' ')) AS k FROM retrieved_papers WHERE title IS NOT NULL), f AS (SELECT *, min(t) OVER (PARTITION BY sub_question_id) AS s, row_number() OVER (PARTITION BY sub_question_id, k ORDER BY t, id) AS n FROM p) SELECT sub_question_id, count(*) AS added, min(id) AS first_id FROM f WHERE n = 1 AND t - s > 86400000000 GROUP BY sub_question_id"),
    "second_search_summary": (second_search_summary, f"SELECT count(*) AS needed, count(*) FILTER (WHERE done) AS finished, CAST(sum(n_rungs) AS BIGINT) AS rungs, CAST(sum(seconds) AS BIGINT) AS seconds, round(max(total), 4) AS most FROM ({_STATES})"),
    "usage_of_purpose": (usage_of_purpose, "SELECT user_id, coalesce(b, a) AS total, b IS NOT NULL AS final FROM (SELECT user_id, max(value) FILTER (WHERE event_type <> 'purchase') AS a, arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS b FROM events GROUP BY user_id)"),
}
