"""Queries over evidence, events and evaluation, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import evalstats as E
from siltstone.operators import events as V
from siltstone.operators import evidence as W
from siltstone.operators.ranking import top_k
from siltstone.sources import table

T = table


def weighted_distinct_sources(s: SparkSession, d: str) -> DataFrame:
    x = T(s, d, "documents").where("sub_question_id is not null and paper_id is not null").select("sub_question_id", "paper_id", "evidence_level", "doc_id")
    return W.weighted_sources(x, ["sub_question_id"], "paper_id", "evidence_level", "doc_id")


def coverage_by_aspect(s: SparkSession, d: str) -> DataFrame:
    """State of every detail question, those without any audit row included."""
    aspects = T(s, d, "sub_questions").select(F.col("id").alias("sub_question_id"), F.explode("detail_questions").alias("aspect_text"))
    found = T(s, d, "tag_audit").select("sub_question_id", "aspect_text", "judge_final", "source_id")
    out = W.aspect_states(aspects, found, ["sub_question_id", "aspect_text"], "judge_final", "source_id")
    return out.select("sub_question_id", "aspect_text", "n", "n_yes", "n_partial", "yes_sources", "state")


def coverage_sufficient(s: SparkSession, d: str) -> DataFrame:
    """Per sub-question: aspects by state and whether all are covered or synthesised."""
    c = coverage_by_aspect(s, d)
    good = F.col("state").isin("covered", "synthesis")
    return c.groupBy("sub_question_id").agg(F.count(F.lit(1)).alias("aspects"), F.sum(good.cast("long")).alias("good"), F.bool_and(good).alias("sufficient"))


def verdict_histogram(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "tag_audit").groupBy("sub_question_id", "strength").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum((F.col("judge_final") == v).cast("long")).alias(f"n_{v}") for v in ("yes", "partial", "no")],
    )
    return a.select("*", F.round((F.col("n_yes") + 0.5 * F.col("n_partial")) / F.col("n"), 6).alias("lenient_share"))


def best_finding_per_source(s: SparkSession, d: str) -> DataFrame:
    """Best yes or partial finding of each aspect and source: yes first, then similarity."""
    a = T(s, d, "tag_audit").where("judge_final in ('yes', 'partial') and source_id is not null").select("aspect_text", "source_id", "row_id", "judge_final", "similarity")
    return top_k(a, ["aspect_text", "source_id"], [F.desc(F.col("judge_final") == "yes"), F.desc_nulls_last("similarity"), F.col("row_id")], 1).select("aspect_text", "source_id", "row_id")


def noisy_or_labels(s: SparkSession, d: str) -> DataFrame:
    """Claims per aspect: support and contradiction by noisy-or over each document's best similarity, label and confidence."""
    a = T(s, d, "tag_audit").where("source_id is not null and similarity is not null and judge_final is not null").select("aspect_text", "source_id", "judge_final", "similarity")
    best = a.groupBy("aspect_text", "source_id", "judge_final").agg(F.max("similarity").alias("w"))
    g = best.groupBy("aspect_text").agg(
        W.noisy_or(F.when(F.col("judge_final") == "yes", F.col("w")).otherwise(0.0)).alias("support"),
        W.noisy_or(F.when(F.col("judge_final") == "no", F.col("w")).otherwise(0.0)).alias("contra"),
        F.count_distinct(F.when(F.col("judge_final") == "yes", F.col("source_id"))).alias("documents"),
        F.sum((F.col("judge_final") == "partial").cast("long")).alias("partial"),
    )
    label = W.label_decision(F.col("support"), F.col("contra"), F.col("documents"), F.col("partial"))
    g = g.withColumn("label", label)
    return g.select("aspect_text", F.round("support", 6).alias("support"), F.round("contra", 6).alias("contra"), "documents", "label", F.round(W.capped_confidence(F.col("label"), F.greatest("support", "contra")), 6).alias("confidence"))


def label_counts(s: SparkSession, d: str) -> DataFrame:
    """Labels in total and the share that asks for another plan."""
    n = noisy_or_labels(s, d)
    bad = F.sum(F.col("label").isin("unverified", "contradicted").cast("long"))
    return n.agg(F.count(F.lit(1)).alias("claims"), bad.alias("bad"), (bad > 0.9 * F.count(F.lit(1))).alias("needs_replan"))


def composite_items(s: SparkSession, d: str) -> DataFrame:
    """Up to six claims of an aspect, numbered and joined in order of similarity."""
    a = T(s, d, "tag_audit").where("claim is not null").select("aspect_text", "row_id", "claim", "similarity")
    w = top_k(a, ["aspect_text"], [F.desc_nulls_last("similarity"), F.col("row_id")], 6)
    g = w.groupBy("aspect_text").agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("similarity", F.lit(-1.0))).alias("s"), "row_id", "claim"))).alias("c"))
    return g.select("aspect_text", F.array_join(F.transform("c", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["claim"])), "\n").alias("item"))


def best_level_per_source(s: SparkSession, d: str) -> DataFrame:
    x = T(s, d, "documents").where("paper_id is not null").select("paper_id", "evidence_level")
    rank = F.when(F.col("evidence_level") == "full_text", 3).when(F.col("evidence_level") == "abstract", 2).when(F.col("evidence_level") == "web_snippet", 1).otherwise(0)
    g = x.groupBy("paper_id").agg(F.max(rank).alias("r"))
    return g.select("paper_id", F.when(F.col("r") == 3, "full_text").when(F.col("r") == 2, "abstract").when(F.col("r") == 1, "web_snippet").alias("level"))


def seq_dedup_last_wins(s: SparkSession, d: str) -> DataFrame:
    """One label per row and annotator: the one received last."""
    v = T(s, d, "tag_audit_labels").select("row_id", "annotator", "vote_id", "label", "received_at")
    return V.dedup_last_arrival(v, ["row_id", "annotator"], ["received_at", "vote_id"]).select("row_id", "annotator", "vote_id")


def monotone_counters(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").select("user_id", "event_id", "value")
    return V.monotone(e, ["user_id"], ["event_id"], "value").select("event_id", "highest")


def sessions(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").select("user_id", "event_id", "ts")
    n = V.sessions(e, ["user_id"], "ts", 6 * 3600)
    return n.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"))


def stage_usage_delta(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").select("user_id", "event_type", "event_id", "value")
    return V.stage_deltas(e, ["user_id"], "event_type", "event_id", "value").select("user_id", "event_type", F.round("delta", 6).alias("delta"))


def time_shares(s: SparkSession, d: str) -> DataFrame:
    v = T(s, d, "judge_verdicts").where("latency_s is not null").select("model", "attempt", F.round(F.col("latency_s") * 1000).cast("long").alias("ms"))
    t = V.time_shares(v, ["model"], "attempt", "ms")
    return t.select("model", "attempt", F.col("seconds").alias("ms"), F.round("share", 6).alias("share"))


def run_states(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").select("user_id", "event_id", "event_type")
    return V.run_state(e, ["user_id"], ["event_id"], "event_type", ["purchase"], ["error"])


def snapshot_difference(s: SparkSession, d: str) -> DataFrame:
    """Growth of each user's total from the first half of the month to the second."""
    e = T(s, d, "events").select("user_id", "ts", "value")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    before = e.where(F.col("ts") < half).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    after = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return V.snapshot_difference(before, after, ["user_id"], "n").withColumn("delta", F.col("delta").cast("long"))


def latency_stats(s: SparkSession, d: str) -> DataFrame:
    v = T(s, d, "judge_verdicts").where("latency_s is not null")
    g = v.groupBy("model").agg(F.round(F.avg("latency_s"), 6).alias("mean"), F.round(F.median("latency_s"), 6).alias("median"), F.max("latency_s").alias("max"))
    return g.join(V.exact_quantile(v, ["model"], "latency_s", 0.95, "p95"), "model")


def windows_per_day(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def confusion_prf(s: SparkSession, d: str) -> DataFrame:
    """Parsed verdicts against the audit's final label, per model: confusion and derived measures."""
    v = T(s, d, "judge_verdicts").select("row_id", "model", "verdict_final").where("verdict_final in ('yes', 'no', 'partial')")
    j = v.join(T(s, d, "tag_audit").select("row_id", "judge_final").where("judge_final is not null"), "row_id")
    c = E.confusion(j, ["model"], F.col("judge_final") == "yes", F.col("verdict_final") == "yes")
    return c.select("model", "tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("accuracy", "precision", "recall", "f1", "specificity")])


def wilson_intervals(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "tag_audit").groupBy("kind", "strength").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("judge_final") == "yes").cast("long")).alias("hits"))
    low, high = E.wilson(F.col("hits"), F.col("n"))
    return a.select("kind", "strength", "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def auc_by_question(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").where("judge_relevant is not null and relevance_score is not null").select("sub_question_id", "relevance_score", "judge_relevant")
    return E.auc(p, ["sub_question_id"], "relevance_score", F.col("judge_relevant")).select("sub_question_id", "n_positive", "n_negative", F.round("auc", 6).alias("auc"))


def average_precision(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").where("judge_relevant is not null and relevance_score is not null").select("sub_question_id", "id", "relevance_score", "judge_relevant")
    return E.average_precision(p, ["sub_question_id"], [F.desc("relevance_score"), F.col("id")], F.col("judge_relevant")).select("sub_question_id", F.round("average_precision", 6).alias("average_precision"))


def ndcg_at_10(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").where("judge_relevant is not null and relevance_score is not null").select("sub_question_id", "id", "relevance_score", F.col("judge_relevant").cast("double").alias("gain"))
    return E.ndcg(p, ["sub_question_id"], [F.desc("relevance_score"), F.col("id")], "gain", 10).select("sub_question_id", F.round("ndcg", 6).alias("ndcg"))


def threshold_sweep(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").where("judge_relevant is not null and relevance_score is not null")
    out = E.threshold_sweep(p, "relevance_score", F.col("judge_relevant"), [x / 100 for x in range(50, 100, 5)])
    return out.select("threshold", "tp", "fp", "fn", "tn", F.round("f1", 6).alias("f1"), F.round("accuracy", 6).alias("accuracy"))


def brier_by_source(s: SparkSession, d: str) -> DataFrame:
    """Brier score of the probability of relevance from verdict and confidence against the audit, per source."""
    p = T(s, d, "retrieved_papers").where("judge_relevant is not null and judge_confidence is not null and relevance_score is not null")
    prob = F.when(F.col("judge_relevant"), F.col("judge_confidence")).otherwise(1 - F.col("judge_confidence"))
    return E.brier(p, ["source"], prob, F.col("relevance_score") >= 0.6).select("source", F.round("brier", 6).alias("brier"), "n")


def annotator_kappa(s: SparkSession, d: str) -> DataFrame:
    """Agreement of the judge and the parsed verdicts beyond chance."""
    v = T(s, d, "judge_verdicts").where("verdict_final in ('yes', 'no', 'partial')").select("row_id", "verdict_final")
    j = v.join(T(s, d, "tag_audit").select("row_id", "judge_final"), "row_id")
    return E.cohen_kappa(j, "judge_final", "verdict_final").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


def mcnemar_models(s: SparkSession, d: str) -> DataFrame:
    """Relevance by score and by confidence against each other: discordant counts and exact p-value."""
    p = T(s, d, "retrieved_papers").where("judge_relevant is not null and relevance_score is not null and combined_score is not null")
    a, b = (F.col("relevance_score") >= 0.6) == F.col("judge_relevant"), (F.col("combined_score") >= 0.6) == F.col("judge_relevant")
    return E.mcnemar(p, a, b).select("only_a", "only_b", F.round("p_value", 9).alias("p_value"))


def bootstrap_interval(s: SparkSession, d: str) -> DataFrame:
    """Seeded bootstrap interval of the mean relevance (no SQL twin)."""
    return E.bootstrap_mean(T(s, d, "retrieved_papers").where("relevance_score is not null").select("id", "relevance_score"), "relevance_score", "id", 100)


def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    """Audit sample: per kind and verdict the 5 rows of smallest seeded hash, two per source at most."""
    a = T(s, d, "tag_audit").where("source_id is not null").select("row_id", "kind", "judge_final", "source_id", F.md5(F.concat(F.lit("11:"), F.col("row_id").cast("string")).cast("binary")).alias("h"))
    few = top_k(a, ["source_id"], [F.col("h")], 2)
    return top_k(few, ["kind", "judge_final"], [F.col("h")], 5).select("row_id", "kind", "judge_final")


def accuracy_by_bucket(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").where("judge_relevant is not null and relevance_score is not null")
    b = F.floor(F.col("relevance_score") * 10).cast("long")
    return p.groupBy(b.alias("bucket"), "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(((F.col("relevance_score") >= 0.6) == F.col("judge_relevant")).cast("double")), 6).alias("accuracy"))


_REL = "FROM retrieved_papers WHERE judge_relevant IS NOT NULL AND relevance_score IS NOT NULL"
_ASPECT = """SELECT sub_question_id, aspect_text, n, n_yes, n_partial, yes_sources, CASE WHEN n_yes >= 2 AND yes_sources >= 2 THEN 'covered' WHEN n_yes + n_partial >= 2 AND some_sources >= 2 THEN 'synthesis' WHEN n = 0 THEN 'no_candidates' WHEN n_judged = 0 THEN 'unjudged' ELSE 'judged_insufficient' END AS state
FROM (SELECT a.sub_question_id, a.aspect_text, count(f.row_id) AS n, count(f.judge_final) AS n_judged, count(*) FILTER (WHERE judge_final = 'yes') AS n_yes, count(*) FILTER (WHERE judge_final = 'partial') AS n_partial, count(DISTINCT CASE WHEN judge_final = 'yes' THEN source_id END) AS yes_sources, count(DISTINCT CASE WHEN judge_final IN ('yes', 'partial') THEN source_id END) AS some_sources
FROM (SELECT DISTINCT id AS sub_question_id, unnest(detail_questions) AS aspect_text FROM sub_questions) a LEFT JOIN tag_audit f USING (sub_question_id, aspect_text) GROUP BY ALL)"""
_NOISY = """SELECT *, CASE WHEN contra > 0 AND contra >= support THEN 'contradicted' WHEN support > 0 AND documents >= 2 THEN 'supported' WHEN support > 0 OR partial > 0 THEN 'partially_supported' ELSE 'unverified' END AS label
FROM (SELECT aspect_text, 1 - product(1 - least(0.95, CASE WHEN judge_final = 'yes' THEN w ELSE 0 END)) AS support, 1 - product(1 - least(0.95, CASE WHEN judge_final = 'no' THEN w ELSE 0 END)) AS contra, count(DISTINCT CASE WHEN judge_final = 'yes' THEN source_id END) AS documents, count(*) FILTER (WHERE judge_final = 'partial') AS partial
FROM (SELECT aspect_text, source_id, judge_final, max(similarity) AS w FROM tag_audit WHERE source_id IS NOT NULL AND similarity IS NOT NULL AND judge_final IS NOT NULL GROUP BY ALL) GROUP BY aspect_text)"""
_PRF = "CAST(count(*) FILTER (WHERE t AND s) AS BIGINT) AS tp, count(*) FILTER (WHERE NOT t AND s) AS fp, count(*) FILTER (WHERE t AND NOT s) AS fn, count(*) FILTER (WHERE NOT t AND NOT s) AS tn"

QUERIES = {
    "weighted_distinct_sources": (weighted_distinct_sources, "SELECT sub_question_id, count(*) AS n_sources, sum(CASE l WHEN 'abstract' THEN 0.5 WHEN 'web_snippet' THEN 0.5 ELSE 1.0 END)::DOUBLE AS weighted_sources FROM (SELECT sub_question_id, paper_id, arg_max_null(evidence_level, doc_id) AS l FROM documents WHERE sub_question_id IS NOT NULL AND paper_id IS NOT NULL GROUP BY ALL) GROUP BY sub_question_id"),
    "coverage_by_aspect": (coverage_by_aspect, _ASPECT),
    "coverage_sufficient": (coverage_sufficient, f"SELECT sub_question_id, count(*) AS aspects, count(*) FILTER (WHERE state IN ('covered', 'synthesis')) AS good, bool_and(state IN ('covered', 'synthesis')) AS sufficient FROM ({_ASPECT}) GROUP BY sub_question_id"),
    "verdict_histogram": (verdict_histogram, "SELECT *, round((n_yes + 0.5 * n_partial) / n, 6) AS lenient_share FROM (SELECT sub_question_id, strength, count(*) AS n, count(*) FILTER (WHERE judge_final = 'yes') AS n_yes, count(*) FILTER (WHERE judge_final = 'partial') AS n_partial, count(*) FILTER (WHERE judge_final = 'no') AS n_no FROM tag_audit GROUP BY ALL)"),
    "best_finding_per_source": (best_finding_per_source, "SELECT aspect_text, source_id, row_id FROM tag_audit WHERE judge_final IN ('yes', 'partial') AND source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY aspect_text, source_id ORDER BY judge_final = 'yes' DESC, similarity DESC NULLS LAST, row_id) = 1"),
    "noisy_or_labels": (noisy_or_labels, f"SELECT aspect_text, round(support, 6) AS support, round(contra, 6) AS contra, documents, label, round(CASE label WHEN 'unverified' THEN least(greatest(support, contra), 0.5) WHEN 'partially_supported' THEN least(greatest(support, contra), 0.6) ELSE greatest(support, contra) END, 6) AS confidence FROM ({_NOISY})"),
    "label_counts": (label_counts, f"SELECT count(*) AS claims, count(*) FILTER (WHERE label IN ('unverified', 'contradicted')) AS bad, count(*) FILTER (WHERE label IN ('unverified', 'contradicted')) > 0.9 * count(*) AS needs_replan FROM ({_NOISY})"),
    "composite_items": (composite_items, "SELECT aspect_text, string_agg(i || '. ' || claim, chr(10) ORDER BY i) AS item FROM (SELECT aspect_text, claim, row_number() OVER (PARTITION BY aspect_text ORDER BY similarity DESC NULLS LAST, row_id) AS i FROM tag_audit WHERE claim IS NOT NULL) WHERE i <= 6 GROUP BY aspect_text"),
    "best_level_per_source": (best_level_per_source, "SELECT paper_id, CASE max(CASE evidence_level WHEN 'full_text' THEN 3 WHEN 'abstract' THEN 2 WHEN 'web_snippet' THEN 1 ELSE 0 END) WHEN 3 THEN 'full_text' WHEN 2 THEN 'abstract' WHEN 1 THEN 'web_snippet' END AS level FROM documents WHERE paper_id IS NOT NULL GROUP BY paper_id"),
    "seq_dedup_last_wins": (seq_dedup_last_wins, "SELECT row_id, annotator, vote_id FROM tag_audit_labels QUALIFY row_number() OVER (PARTITION BY row_id, annotator ORDER BY received_at DESC, vote_id DESC) = 1"),
    "monotone_counters": (monotone_counters, "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS highest FROM events"),
    "sessions": (sessions, "WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 21600000000 THEN 1 ELSE 0 END AS n FROM events), s AS (SELECT user_id, event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS events, min(event_id) AS first_event FROM s GROUP BY ALL"),
    "stage_usage_delta": (stage_usage_delta, "SELECT user_id, event_type, round(greatest(arg_max(value, event_id) - arg_min(value, event_id), 0), 6) AS delta FROM events GROUP BY ALL"),
    "time_shares": (time_shares, "SELECT model, attempt, ms, round(ms / sum(ms) OVER (PARTITION BY model), 6) AS share FROM (SELECT model, attempt, CAST(sum(CAST(round(latency_s * 1000) AS BIGINT)) AS BIGINT) AS ms FROM judge_verdicts WHERE latency_s IS NOT NULL GROUP BY ALL)"),
    "run_states": (run_states, "SELECT user_id, arg_max(event_type, event_id) AS last_event, CASE WHEN bool_or(event_type = 'purchase') THEN 'completed' WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'running' END AS state, count(*) AS n_events FROM events GROUP BY user_id"),
    "snapshot_difference": (snapshot_difference, "SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS delta FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') <> 0"),
    "latency_stats": (latency_stats, "SELECT model, round(avg(latency_s), 6) AS mean, round(median(latency_s), 6) AS median, list_sort(list(latency_s))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95, max(latency_s) AS max FROM judge_verdicts WHERE latency_s IS NOT NULL GROUP BY model"),
    "windows_per_day": (windows_per_day, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "confusion_prf": (confusion_prf, f"SELECT model, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS specificity FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM (SELECT model, {_PRF} FROM (SELECT model, judge_final = 'yes' AS t, verdict_final = 'yes' AS s FROM judge_verdicts JOIN tag_audit USING (row_id) WHERE verdict_final IN ('yes', 'no', 'partial') AND judge_final IS NOT NULL) GROUP BY model))"),
    "wilson_intervals": (wilson_intervals, "SELECT kind, strength, n, hits, round(greatest((c - h) / s, 0), 6) AS low, round(least((c + h) / s, 1), 6) AS high FROM (SELECT *, p + 1.96 * 1.96 / (2 * n) AS c, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) AS h, 1 + 1.96 * 1.96 / n AS s FROM (SELECT kind, strength, count(*) AS n, count(*) FILTER (WHERE judge_final = 'yes') AS hits, count(*) FILTER (WHERE judge_final = 'yes') / count(*) AS p FROM tag_audit GROUP BY ALL))"),
    "auc_by_question": (auc_by_question, f"WITH r AS (SELECT sub_question_id, judge_relevant AS y, rank() OVER w + (count(*) OVER (PARTITION BY sub_question_id, relevance_score) - 1) / 2.0 AS r {_REL} WINDOW w AS (PARTITION BY sub_question_id ORDER BY relevance_score)) SELECT sub_question_id, count(*) FILTER (WHERE y) AS n_positive, count(*) FILTER (WHERE NOT y) AS n_negative, round(CASE WHEN count(*) FILTER (WHERE y) > 0 AND count(*) FILTER (WHERE NOT y) > 0 THEN (sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)) END, 6) AS auc FROM r GROUP BY sub_question_id"),
    "average_precision": (average_precision, f"WITH r AS (SELECT sub_question_id, judge_relevant AS y, row_number() OVER w AS n, sum(CASE WHEN judge_relevant THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS h {_REL} WINDOW w AS (PARTITION BY sub_question_id ORDER BY relevance_score DESC, id)) SELECT sub_question_id, round(avg(h / n) FILTER (WHERE y), 6) AS average_precision FROM r GROUP BY sub_question_id"),
    "ndcg_at_10": (ndcg_at_10, f"WITH r AS (SELECT sub_question_id, CASE WHEN judge_relevant THEN 1.0 ELSE 0.0 END AS g, row_number() OVER (PARTITION BY sub_question_id ORDER BY relevance_score DESC, id) AS n, row_number() OVER (PARTITION BY sub_question_id ORDER BY judge_relevant DESC) AS i {_REL}), s AS (SELECT sub_question_id, sum(CASE WHEN n <= 10 THEN g / log2(n + 1) ELSE 0 END) AS d, sum(CASE WHEN i <= 10 THEN g / log2(i + 1) ELSE 0 END) AS b FROM r GROUP BY ALL) SELECT sub_question_id, round(CASE WHEN b > 0 THEN d / b ELSE 0 END, 6) AS ndcg FROM s"),
    "threshold_sweep": (threshold_sweep, f"SELECT threshold, tp, fp, fn, tn, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM (SELECT threshold, {_PRF} FROM (SELECT threshold, judge_relevant AS t, relevance_score >= threshold AS s FROM (SELECT x / 100.0::DOUBLE AS threshold FROM range(50, 100, 5) q(x)), (SELECT judge_relevant, relevance_score {_REL})) GROUP BY threshold)"),
    "brier_by_source": (brier_by_source, "SELECT source, round(avg(power(CASE WHEN judge_relevant THEN judge_confidence ELSE 1 - judge_confidence END - CASE WHEN relevance_score >= 0.6 THEN 1 ELSE 0 END, 2)), 6) AS brier, count(*) AS n FROM retrieved_papers WHERE judge_relevant IS NOT NULL AND judge_confidence IS NOT NULL AND relevance_score IS NOT NULL GROUP BY source"),
    "annotator_kappa": (annotator_kappa, "WITH j AS (SELECT judge_final AS a, verdict_final AS b FROM judge_verdicts JOIN tag_audit USING (row_id) WHERE verdict_final IN ('yes', 'no', 'partial') AND judge_final IS NOT NULL), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) / count(*) AS o FROM j), e AS (SELECT sum(x.n * y.n) AS e FROM (SELECT a, count(*) AS n FROM j GROUP BY a) x JOIN (SELECT b, count(*) AS n FROM j GROUP BY b) y ON x.a = y.b) SELECT n, round(o, 6) AS agreement, round((o - e / n / n) / (1 - e / n / n), 6) AS kappa FROM n, e"),
    "mcnemar_models": (mcnemar_models, "WITH j AS (SELECT (relevance_score >= 0.6) = judge_relevant AS a, (combined_score >= 0.6) = judge_relevant AS b FROM retrieved_papers WHERE judge_relevant IS NOT NULL AND relevance_score IS NOT NULL AND combined_score IS NOT NULL), n AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS x, count(*) FILTER (WHERE b AND NOT a) AS y FROM j), t AS (SELECT sum(exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2))) AS p FROM n, (SELECT unnest(range(0, (SELECT least(x, y) + 1 FROM n))) AS i)) SELECT x AS only_a, y AS only_b, round(least(1, 2 * p), 9) AS p_value FROM n, t"),
    "bootstrap_interval": (bootstrap_interval, None),
    "stratified_sample": (stratified_sample, "WITH a AS (SELECT row_id, kind, judge_final, source_id, md5('11:' || row_id) AS h FROM tag_audit WHERE source_id IS NOT NULL), f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY h) <= 2) SELECT row_id, kind, judge_final FROM f QUALIFY row_number() OVER (PARTITION BY kind, judge_final ORDER BY h) <= 5"),
    "accuracy_by_bucket": (accuracy_by_bucket, f"SELECT CAST(floor(relevance_score * 10) AS BIGINT) AS bucket, source, count(*) AS n, round(avg(CASE WHEN (relevance_score >= 0.6) = judge_relevant THEN 1.0 ELSE 0.0 END), 6) AS accuracy {_REL} GROUP BY ALL"),
}
