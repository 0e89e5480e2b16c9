"""Report, timeline and run-analytics queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as X
from siltstone.operators import retrieval, vectors
from siltstone.operators.ranking import top_k
from siltstone.sources import table

T = table


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def lane_status(s: SparkSession, d: str) -> DataFrame:
    """Status of each user's lane of each kind: completed where a purchase follows its last event, else failed where an
    error does, else running."""
    e = T(s, d, "events").select("user_id", "event_type", "event_id")
    last = e.where("event_type in ('view', 'click', 'signup')").groupBy("user_id", "event_type").agg(F.max("event_id").alias("at"))
    ends = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("p"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("x"))
    return last.join(ends, "user_id").select("user_id", "event_type", F.when(F.col("p") > F.col("at"), "completed").when(F.col("x") > F.col("at"), "failed").otherwise("running").alias("status"))


def eta_estimates(s: SparkSession, d: str) -> DataFrame:
    """Elapsed whole seconds times remaining over done, where half of a user's events count as done work."""
    e = T(s, d, "events").groupBy("user_id").agg(F.floor((F.max(_micros("ts")) - F.min(_micros("ts"))) / 1_000_000).alias("elapsed"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type").isin("purchase", "view")).alias("done"))
    return e.where("done > 0").select("user_id", F.floor(F.col("elapsed") * (F.col("n") - F.col("done")) / F.col("done")).alias("eta_s"))


def usage_by_purpose(s: SparkSession, d: str) -> DataFrame:
    """Total of the last carrier of each purpose, sorted: place of a type within its user."""
    e = T(s, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    return e.select("user_id", "event_type", "v", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("v"), "event_type")).cast("long").alias("place"))


def early_work(s: SparkSession, d: str) -> DataFrame:
    """Views before their user's first signup."""
    e = T(s, d, "events").select("user_id", "event_type", "event_id")
    first = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("boundary"))
    return e.where("event_type = 'view'").join(first, "user_id").where(F.col("event_id") < F.col("boundary")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def wait_intervals(s: SparkSession, d: str) -> DataFrame:
    """Seconds from a sub-question's last audited evidence to the first verdict after it."""
    a = T(s, d, "tag_audit").select("row_id", "sub_question_id").where("sub_question_id is not null")
    l = T(s, d, "tag_audit_labels").groupBy("row_id").agg(F.max(_micros("labeled_at")).alias("labelled"))
    v = T(s, d, "judge_verdicts").groupBy("row_id").agg(F.min(_micros("created_at")).alias("judged"))
    j = a.join(l, "row_id").join(v, "row_id").groupBy("sub_question_id").agg(F.max("labelled").alias("a"), F.max("judged").alias("b"))
    return j.select("sub_question_id", F.greatest(F.lit(0), F.col("b") - F.col("a")).alias("wait_us"))


def nth_matching(s: SparkSession, d: str) -> DataFrame:
    """The n-th error of a user beside the n-th purchase."""
    e = T(s, d, "events").select("user_id", "event_type", "event_id").where("event_type in ('error', 'purchase')")
    n = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")).cast("long"))
    a, b = (n.where(F.col("event_type") == t).select("user_id", "n", F.col("event_id").alias(t)) for t in ("error", "purchase"))
    return a.join(b, ["user_id", "n"])


def other_label_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Best neighbour of another label, for every vector whose id is divisible by 100."""
    e = T(s, d, "embeddings").select("vec_id", "embedding", "label")
    return vectors.cosine_top_k(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 1, apart="label").select("query", "neighbour", "similarity")


def fuzzy_titles(s: SparkSession, d: str) -> DataFrame:
    """References and papers whose titles differ in at most one letter in thirty, all pairs of them."""
    norm = F.trim(F.regexp_replace(F.lower("title"), r"[^a-z0-9]+", " "))
    r = T(s, d, "report_references").where("title is not null").select("reference_id", norm.alias("a"))
    p = T(s, d, "retrieved_papers").where("title is not null").select(norm.alias("b")).distinct()
    j = retrieval.near_strings(r.select("a").distinct(), "a", p, "b", 30)
    found = j.groupBy("a").agg(F.count(F.lit(1)).alias("titles"), F.min("b").alias("first_title"))
    return r.join(found, "a").groupBy("reference_id").agg(F.sum("titles").alias("titles"), F.min("first_title").alias("first_title"))


def near_misses(s: SparkSession, d: str) -> DataFrame:
    """Aspects with some but not enough support: near miss, known gap or neither."""
    a = T(s, d, "tag_audit").groupBy("sub_question_id", "aspect_text").agg(F.count_if(F.col("judge_final") == "yes").alias("yes"), F.count_if(F.col("judge_final") == "partial").alias("partial"), F.count(F.lit(1)).alias("n"))
    return a.select("sub_question_id", "aspect_text", F.when(F.col("yes") >= 2, "covered").when(F.col("yes") + F.col("partial") >= 1, "near_miss").otherwise("known_gap").alias("kind"), "n")


def run_totals(s: SparkSession, d: str) -> DataFrame:
    """Findings, quotes, distinct sources and verdicts of each run."""
    return T(s, d, "tag_audit").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count("quote").alias("quotes"), F.count_distinct("source_id").alias("sources"),
        *[F.count_if(F.col("judge_final") == v).alias(f"n_{v}") for v in ("yes", "partial", "no")],
    )


def payload_sums(s: SparkSession, d: str) -> DataFrame:
    """Payload maps of all events summed key by key."""
    m = T(s, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,double>")).alias("key", "v"))
    return m.groupBy("event_type", "key").agg(F.round(F.sum("v"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


def extras_per_aspect(s: SparkSession, d: str) -> DataFrame:
    """Best two findings of each aspect that are not tagged yes."""
    a = T(s, d, "tag_audit").where("judge_final is null or judge_final <> 'yes'").select("aspect_text", "row_id", "similarity")
    return top_k(a, ["aspect_text"], [F.desc_nulls_last("similarity"), F.col("row_id")], 2).select("aspect_text", "row_id")


def best_wording(s: SparkSession, d: str) -> DataFrame:
    """Of claims with the same content words in an aspect the most similar one."""
    a = T(s, d, "tag_audit").where("claim is not null").select("aspect_text", F.array_join(X.content_words(F.col("claim")), " ").alias("w"), "row_id", "similarity")
    return top_k(a, ["aspect_text", "w"], [F.desc_nulls_last("similarity"), F.col("row_id")], 1).select("aspect_text", "row_id")


def percent_figures(s: SparkSession, d: str) -> DataFrame:
    """First six distinct percent figures of each quote, in order."""
    q = T(s, d, "tag_audit").where("quote is not null").select("row_id", F.array_distinct(F.regexp_extract_all("quote", F.lit(r"([0-9]+(?:\.[0-9]+)?%)"), 1)).alias("f"))
    return q.where("size(f) > 0").select("row_id", F.array_join(F.slice("f", 1, 6), " ").alias("figures"))


def interleaved_topics(s: SparkSession, d: str) -> DataFrame:
    """Detail questions of a run: the first of every topic, then the second of every topic."""
    q = T(s, d, "sub_questions").select("query_id", "id", F.posexplode("detail_questions").alias("i", "q"))
    return q.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("i", "id")).cast("long").alias("place"), F.md5(F.col("q").cast("binary")).alias("question"))


def newest_sub_question(s: SparkSession, d: str) -> DataFrame:
    """Of each run the sub-question with the newest paper."""
    p = T(s, d, "retrieved_papers").groupBy("query_id", "sub_question_id").agg(F.max(_micros("created_at")).alias("at"))
    return top_k(p, ["query_id"], [F.desc("at"), F.col("sub_question_id")], 1).select("query_id", "sub_question_id")


def gantt_bars(s: SparkSession, d: str) -> DataFrame:
    """Bars of each user and day from the first to the last event, the last day's bar left open to the end of the stream."""
    e = T(s, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), _micros("ts").alias("at"))
    edge = e.agg(F.max("at").alias("edge"))
    bars = e.groupBy("user_id", "day").agg(F.min("at").alias("a"), F.max("at").alias("b")).withColumn("last", F.max("day").over(Window.partitionBy("user_id")))
    return bars.crossJoin(F.broadcast(edge)).select("user_id", "day", "a", F.when(F.col("day") == F.col("last"), F.col("edge")).otherwise(F.col("b")).alias("b"))


def critical_path(s: SparkSession, d: str) -> DataFrame:
    """Of each run the sub-question whose audit ended last."""
    a = T(s, d, "tag_audit").where("sub_question_id is not null").select("row_id", "query_id", "sub_question_id")
    l = T(s, d, "tag_audit_labels").groupBy("row_id").agg(F.max(_micros("received_at")).alias("at"))
    g = a.join(l, "row_id").groupBy("query_id", "sub_question_id").agg(F.max("at").alias("at"))
    return top_k(g, ["query_id"], [F.desc("at"), F.col("sub_question_id")], 1).select("query_id", "sub_question_id")


def selected_passages(s: SparkSession, d: str) -> DataFrame:
    """Five longest prose passages of each source, given back in document order."""
    c = T(s, d, "chunk_lookup").where(X.is_prose(F.col("text"))).select("source_id", "chunk_id", F.length("text").alias("n"))
    few = top_k(c, ["source_id"], [F.desc("n"), F.col("chunk_id")], 5)
    return few.select("source_id", "chunk_id", F.row_number().over(Window.partitionBy("source_id").orderBy("chunk_id")).cast("long").alias("place"))


def repaired_json(s: SparkSession, d: str) -> DataFrame:
    """Reasons out of answers whose closing brace is absent."""
    v = T(s, d, "judge_verdicts").select("verdict_id", F.trim("raw_output").alias("r")).where("r like '{%\"'")
    j = v.select("verdict_id", F.from_json(F.concat("r", F.lit("}")), "reason string").alias("j"))
    return j.where("j.reason is not null").select("verdict_id", F.md5(F.col("j.reason").cast("binary")).alias("reason"))


def citation_markers(s: SparkSession, d: str) -> DataFrame:
    """Numbers cited for each run's title keys, as one sorted marker."""
    r = T(s, d, "report_references").where("ref_number is not null").groupBy("query_id", "kind").agg(F.array_sort(F.collect_set("ref_number")).alias("n"))
    return r.select("query_id", "kind", F.concat(F.lit("["), F.array_join(F.transform("n", lambda x: x.cast("string")), ", "), F.lit("]")).alias("marker"))


def marked_sentences(s: SparkSession, d: str) -> DataFrame:
    """Claims with a marker before the final stop."""
    a = T(s, d, "tag_audit").where("claim is not null")
    return a.select("row_id", F.concat(F.regexp_replace("claim", r"[.]$", ""), F.lit(" ["), F.col("row_id").cast("string"), F.lit("].")).alias("sentence"))


def verdict_bars(s: SparkSession, d: str) -> DataFrame:
    """Verdict counts per sub-question, null where nothing was judged."""
    a = T(s, d, "tag_audit").groupBy("sub_question_id").agg(F.count("judge_final").alias("judged"), *[F.count_if(F.col("judge_final") == v).alias(f"n_{v}") for v in ("yes", "partial", "no")])
    return a.select("sub_question_id", *[F.when(F.col("judged") > 0, F.col(f"n_{v}")).alias(v) for v in ("yes", "partial", "no")])


def tag_precision(s: SparkSession, d: str) -> DataFrame:
    """Strict and lenient precision of tags per strength and kind."""
    a = T(s, d, "tag_audit").where("judge_final is not null").groupBy("kind", "strength").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("judge_final") == "yes").alias("y"), F.count_if(F.col("judge_final") == "partial").alias("p"))
    return a.select("kind", "strength", "n", F.round(F.col("y") / F.col("n"), 6).alias("strict"), F.round((F.col("y") + F.col("p")) / F.col("n"), 6).alias("lenient"))


def topic_detail_similarity(s: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of each topic's words and each of its detail questions'."""
    q = T(s, d, "sub_questions").select("id", X.content_words(F.col("main_topic")).alias("a"), F.posexplode("detail_questions").alias("no", "q"))
    return q.select("id", F.col("no").cast("long").alias("no"), F.round(X.jaccard(F.col("a"), X.content_words(F.col("q"))), 6).alias("jaccard"))


def corrupted_claims(s: SparkSession, d: str) -> DataFrame:
    """Claims with their first number changed, for checks of a verifier: number plus one."""
    a = T(s, d, "tag_audit").where("claim is not null").select("row_id", "claim", F.regexp_extract("claim", r"([0-9]+)", 1).alias("n")).where("n <> ''")
    at = F.instr("claim", F.col("n"))
    return a.select("row_id", F.concat(F.substring("claim", F.lit(1), at - 1), (F.col("n").cast("long") + 1).cast("string"), F.substring("claim", at + F.length("n"), F.length("claim"))).alias("corrupted"))


def evidence_split(s: SparkSession, d: str) -> DataFrame:
    """Supporting and opposing rows of each claim's aspect with their best quote."""
    a = T(s, d, "tag_audit").where("judge_final in ('yes', 'no')").select("aspect_text", F.when(F.col("judge_final") == "yes", "supports").otherwise("opposes").alias("relation"), "row_id", "similarity")
    best = a.groupBy("aspect_text", "relation").agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("best"))
    return best


def throughput(s: SparkSession, d: str) -> DataFrame:
    """Verdicts per model and attempt with total and mean latency in milliseconds."""
    v = T(s, d, "judge_verdicts").where("latency_s is not null")
    return v.groupBy("model", "attempt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("latency_s") * 1000).cast("long")).alias("total_ms"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _content(c: str) -> str:
    kept = f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: w NOT IN ({_STOP}))"
    return f"list_sort(list_distinct(list_transform({kept}, lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END)))"


_TITLE = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE judge_final = '{v}') AS n_{v}" for v in ("yes", "partial", "no"))

QUERIES = {
    "lane_status": (lane_status, "WITH l AS (SELECT user_id, event_type, max(event_id) AS a FROM events WHERE event_type IN ('view', 'click', 'signup') GROUP BY ALL), n AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'purchase') AS p, max(event_id) FILTER (WHERE event_type = 'error') AS x FROM events GROUP BY user_id) SELECT user_id, event_type, CASE WHEN p > a THEN 'completed' WHEN x > a THEN 'failed' ELSE 'running' END AS status FROM l JOIN n USING (user_id)"),
    "eta_estimates": (eta_estimates, "SELECT user_id, CAST(floor(e * (n - k) / k) AS BIGINT) AS eta_s FROM (SELECT user_id, (max(epoch_us(ts)) - min(epoch_us(ts))) // 1000000 AS e, count(*) AS n, count(*) FILTER (WHERE event_type IN ('purchase', 'view')) AS k FROM events GROUP BY user_id) WHERE k > 0"),
    "usage_by_purpose": (usage_by_purpose, "SELECT user_id, event_type, v, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) AS place FROM (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY ALL)"),
    "early_work": (early_work, "SELECT e.user_id, count(*) AS n FROM events e JOIN (SELECT user_id, min(event_id) AS b FROM events WHERE event_type = 'signup' GROUP BY user_id) f ON e.user_id = f.user_id AND e.event_type = 'view' AND e.event_id < b GROUP BY e.user_id"),
    "wait_intervals": (wait_intervals, "SELECT sub_question_id, greatest(0, max(b) - max(a)) AS wait_us FROM tag_audit JOIN (SELECT row_id, max(epoch_us(labeled_at)) AS a FROM tag_audit_labels GROUP BY row_id) USING (row_id) JOIN (SELECT row_id, min(epoch_us(created_at)) AS b FROM judge_verdicts GROUP BY row_id) USING (row_id) WHERE sub_question_id IS NOT NULL GROUP BY sub_question_id"),
    "nth_matching": (nth_matching, "WITH n AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_type IN ('error', 'purchase')) SELECT a.user_id, a.n, a.event_id AS error, b.event_id AS purchase FROM n a JOIN n b ON a.user_id = b.user_id AND a.n = b.n AND a.event_type = 'error' AND b.event_type = 'purchase'"),
    "other_label_neighbours": (other_label_neighbours, "SELECT query, neighbour, similarity FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label <> b.label WHERE a.vec_id % 100 = 0) QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) = 1"),
    "fuzzy_titles": (fuzzy_titles, f"WITH r AS (SELECT reference_id, {_TITLE} AS a FROM report_references WHERE title IS NOT NULL), x AS (SELECT DISTINCT a FROM r), p AS (SELECT DISTINCT {_TITLE} AS b FROM retrieved_papers WHERE title IS NOT NULL), m AS (SELECT a, count(*) AS n, min(b) AS f FROM x JOIN p ON 30 * abs(length(a) - length(b)) <= greatest(length(a), length(b)) WHERE 30 * levenshtein(a, b) <= greatest(length(a), length(b)) GROUP BY a) SELECT reference_id, CAST(sum(n) AS BIGINT) AS titles, min(f) AS first_title FROM r JOIN m USING (a) GROUP BY reference_id"),
    "near_misses": (near_misses, "SELECT sub_question_id, aspect_text, CASE WHEN y >= 2 THEN 'covered' WHEN y + p >= 1 THEN 'near_miss' ELSE 'known_gap' END AS kind, n FROM (SELECT sub_question_id, aspect_text, count(*) FILTER (WHERE judge_final = 'yes') AS y, count(*) FILTER (WHERE judge_final = 'partial') AS p, count(*) AS n FROM tag_audit GROUP BY ALL)"),
    "run_totals": (run_totals, f"SELECT query_id, count(*) AS findings, count(quote) AS quotes, count(DISTINCT source_id) AS sources, {_COUNTS} FROM tag_audit GROUP BY query_id"),
    "payload_sums": (payload_sums, "SELECT event_type, 'k' AS key, round(sum(CAST(json_extract(props, '$.k') AS DOUBLE)), 4) AS total, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY event_type"),
    "extras_per_aspect": (extras_per_aspect, "SELECT aspect_text, row_id FROM tag_audit WHERE judge_final IS NULL OR judge_final <> 'yes' QUALIFY row_number() OVER (PARTITION BY aspect_text ORDER BY similarity DESC NULLS LAST, row_id) <= 2"),
    "best_wording": (best_wording, f"SELECT aspect_text, row_id FROM (SELECT aspect_text, row_id, similarity, {_content('claim')} AS w FROM tag_audit WHERE claim IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY aspect_text, w ORDER BY similarity DESC NULLS LAST, row_id) = 1"),
    "percent_figures": (percent_figures, "SELECT row_id, array_to_string(f[1:6], ' ') AS figures FROM (SELECT row_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS f FROM (SELECT row_id, regexp_extract_all(quote, '[0-9]+(?:\\.[0-9]+)?%') AS w FROM tag_audit WHERE quote IS NOT NULL)) WHERE len(f) > 0"),
    "interleaved_topics": (interleaved_topics, "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY i, id) AS place, md5(q) AS question FROM (SELECT query_id, id, unnest(detail_questions) AS q, generate_subscripts(detail_questions, 1) AS i FROM sub_questions)"),
    "newest_sub_question": (newest_sub_question, "SELECT query_id, sub_question_id FROM (SELECT query_id, sub_question_id, max(created_at) AS t FROM retrieved_papers GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY t DESC, sub_question_id) = 1"),
    "gantt_bars": (gantt_bars, "SELECT user_id, day, a, CASE WHEN day = max(day) OVER (PARTITION BY user_id) THEN (SELECT max(epoch_us(ts)) FROM events) ELSE b END AS b FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY ALL)"),
    "critical_path": (critical_path, "SELECT query_id, sub_question_id FROM (SELECT query_id, sub_question_id, max(t) AS t FROM tag_audit JOIN (SELECT row_id, max(received_at) AS t FROM tag_audit_labels GROUP BY row_id) USING (row_id) WHERE sub_question_id IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY t DESC, sub_question_id) = 1"),
    "selected_passages": (selected_passages, "WITH f AS (SELECT source_id, chunk_id FROM chunk_lookup WHERE length(text) > 0 AND length(regexp_replace(text, '[^\\pL]', '', 'g')) >= 0.6 * length(text) AND length(text) - length(replace(text, '|', '')) <= 5 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY length(text) DESC, chunk_id) <= 5) SELECT source_id, chunk_id, row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) AS place FROM f"),
    "repaired_json": (repaired_json, "SELECT verdict_id, md5(json_extract_string(r || '}', '$.reason')) AS reason FROM (SELECT verdict_id, trim(raw_output, ' ') AS r FROM judge_verdicts) WHERE r LIKE '{%\"' AND json_valid(r || '}') AND json_extract_string(r || '}', '$.reason') IS NOT NULL"),
    "citation_markers": (citation_markers, "SELECT query_id, kind, '[' || array_to_string(list_sort(list(DISTINCT ref_number)), ', ') || ']' AS marker FROM report_references WHERE ref_number IS NOT NULL GROUP BY ALL"),
    "marked_sentences": (marked_sentences, "SELECT row_id, regexp_replace(claim, '[.]$', '') || ' [' || row_id || '].' AS sentence FROM tag_audit WHERE claim IS NOT NULL"),
    "verdict_bars": (verdict_bars, f"SELECT sub_question_id, CASE WHEN j > 0 THEN n_yes END AS yes, CASE WHEN j > 0 THEN n_partial END AS partial, CASE WHEN j > 0 THEN n_no END AS no FROM (SELECT sub_question_id, count(judge_final) AS j, {_COUNTS} FROM tag_audit GROUP BY sub_question_id)"),
    "tag_precision": (tag_precision, "SELECT kind, strength, n, round(y / n, 6) AS strict, round((y + p) / n, 6) AS lenient FROM (SELECT kind, strength, count(*) AS n, count(*) FILTER (WHERE judge_final = 'yes') AS y, count(*) FILTER (WHERE judge_final = 'partial') AS p FROM tag_audit WHERE judge_final IS NOT NULL GROUP BY ALL)"),
    "topic_detail_similarity": (topic_detail_similarity, f"SELECT id, no - 1 AS no, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS jaccard FROM (SELECT id, no, {_content('main_topic')} AS a, {_content('q')} AS b FROM (SELECT id, main_topic, unnest(detail_questions) AS q, generate_subscripts(detail_questions, 1) AS no FROM sub_questions))"),
    "corrupted_claims": (corrupted_claims, "SELECT row_id, substring(claim, 1, instr(claim, n) - 1) || (CAST(n AS BIGINT) + 1) || substring(claim, instr(claim, n) + length(n)) AS corrupted FROM (SELECT row_id, claim, regexp_extract(claim, '([0-9]+)', 1) AS n FROM tag_audit WHERE claim IS NOT NULL) WHERE n <> ''"),
    "evidence_split": (evidence_split, "SELECT aspect_text, CASE WHEN judge_final = 'yes' THEN 'supports' ELSE 'opposes' END AS relation, count(*) AS n, max(similarity) AS best FROM tag_audit WHERE judge_final IN ('yes', 'no') GROUP BY ALL"),
    "throughput": (throughput, "SELECT model, attempt, count(*) AS n, CAST(sum(CAST(round(latency_s * 1000) AS BIGINT)) AS BIGINT) AS total_ms FROM judge_verdicts WHERE latency_s IS NOT NULL GROUP BY ALL"),
}
