"""Queries over model replies and free wording, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import replies as R
from siltstone.functions import text as X
from siltstone.sources import table

T = table


def typed_verdicts(s: SparkSession, d: str) -> DataFrame:
    """Verdicts read back out of replies with a thinking block, other text around the object and confidences out of range."""
    p = T(s, d, "retrieved_papers").where("judge_relevant is not null").select("id", "judge_relevant", (F.col("judge_confidence") * 1.5 - 0.2).alias("c"), "judge_reason")
    obj = F.to_json(F.struct(F.col("judge_relevant").alias("relevant"), F.col("c").alias("confidence"), F.col("judge_reason").alias("reason")))
    reply = F.concat(F.lit("<think>{not} this\none</think> Verdict: "), obj, F.lit(" (end)"))
    v = p.select("id", R.typed_verdict(reply).alias("v"))
    return v.select("id", "v.relevant", F.round("v.confidence", 4).alias("confidence"))


def normal_plans(s: SparkSession, d: str) -> DataFrame:
    q = T(s, d, "sub_questions")
    return q.select("id", R.clean_spaces(F.col("main_topic")).alias("topic"), F.size(F.filter("detail_questions", lambda x: F.trim(x) != "")).cast("long").alias("details"))


def listed_queries(s: SparkSession, d: str) -> DataFrame:
    """Detail questions read back out of JSON arrays and out of bulleted lines."""
    q = T(s, d, "sub_questions")
    lines = F.array_join(F.transform("detail_questions", lambda x, i: F.concat(F.when(i % 2 == 0, F.lit("- ")).otherwise(F.concat((i + 1).cast("string"), F.lit(". "))), x)), "\n")
    reply = F.when(F.length("main_topic") % 2 == 0, F.concat(F.lit("Here: "), F.to_json("detail_questions"))).otherwise(lines)
    return q.select("id", F.posexplode(R.listed(reply)).alias("no", "query")).select("id", F.col("no").cast("long").alias("no"), "query")


def normal_tags(s: SparkSession, d: str) -> DataFrame:
    q = T(s, d, "sub_questions").select("id", F.size("detail_questions").alias("n"))
    reply = F.lit('[1, {"detail": 2, "strength": "full"}, {"detail": 1, "strength": "full"}, 9, {"detail": 3}, "x", 0]')
    return q.select("id", F.explode(R.tags(reply, F.col("n"))).alias("t")).select("id", F.col("t.detail").cast("long").alias("detail"), "t.strength")


def search_queries(s: SparkSession, d: str) -> DataFrame:
    """Cleaned, fielded and anchored search queries of each detail question."""
    q = T(s, d, "sub_questions").select("id", "main_topic", F.posexplode("detail_questions").alias("no", "q"))
    words = F.array_distinct(F.filter(X.words(F.col("q")), lambda w: ~w.isin(*X.STOP_WORDS) & (F.length(w) > 1)))
    plain = R.plain_query(F.concat(F.lit("NOT "), F.col("q"), F.lit(" AND *")))
    return q.select("id", F.col("no").cast("long").alias("no"), plain.alias("plain"), F.array_join(R.fielded_queries(words), " | ").alias("fielded"))


def anchored_queries(s: SparkSession, d: str) -> DataFrame:
    q = T(s, d, "sub_questions").select("id", "detail_questions", R.usable_anchor(F.col("main_topic")).alias("anchor"))
    return q.select("id", "anchor", F.posexplode(R.anchored(F.col("detail_questions"), F.col("anchor"))).alias("no", "query")).select("id", "anchor", F.col("no").cast("long").alias("no"), "query")


def standalone_questions(s: SparkSession, d: str) -> DataFrame:
    q = T(s, d, "sub_questions").select("id", "main_topic", F.posexplode("detail_questions").alias("no", "q"))
    return q.select("id", F.col("no").cast("long").alias("no"), R.standalone(F.col("q"), F.col("main_topic")).alias("question"))


def stem_sets(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "tag_audit").where("claim is not null").select("row_id", F.array_join(R.stem_set(F.col("claim")), " ").alias("stems"))


def claim_quantities(s: SparkSession, d: str) -> DataFrame:
    """Quantities of each quote: how many, their sum, and how many are percentages."""
    a = T(s, d, "tag_audit").where("quote is not null").select("row_id", F.explode(R.quantities(F.col("quote"))).alias("x"))
    return a.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x.value"), 3).alias("total"), F.count_if(F.col("x.unit") == "%").alias("percents"))


def claim_wordings(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "tag_audit").where("claim is not null")
    wording = R.claim_wording(F.concat(F.lit("Finding: "), F.col("claim"), F.lit(" [3, 12].")))
    opened = R.without_attribution(F.concat(F.lit("One recent study reports that "), F.col("claim")))
    return a.select("row_id", wording.alias("wording"), opened.alias("content"))


def labels(s: SparkSession, d: str) -> DataFrame:
    v = T(s, d, "judge_verdicts").groupBy("row_id").agg(F.sum(F.round(F.col("latency_s") * 1000).cast("long")).alias("ms"), F.sum(F.length("raw_output")).alias("chars"), F.count("error").alias("bad"), F.count(F.lit(1)).alias("n"))
    return v.select("row_id", R.duration_label(F.col("ms")).alias("took"), R.token_label(F.col("chars") * 40).alias("tokens"), R.percent_label(F.col("bad"), F.col("n")).alias("failed"))


def retry_waits(s: SparkSession, d: str) -> DataFrame:
    v = T(s, d, "judge_verdicts").select("verdict_id", F.when(F.col("attempt") > 1, F.concat(F.lit("all keys are rate limited for "), (F.col("verdict_id") % 90).cast("string"), F.lit("s"))).otherwise(F.lit("gave up after 300s of rate limits")).alias("e"))
    return v.select("verdict_id", R.retry_wait(F.col("e")).alias("wait"))


def author_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of names told from lines of text."""
    p = T(s, d, "parsed_papers").select("id", F.explode(F.array(F.struct(F.lit("authors").alias("kind"), F.array_join("authors", " 1*, ").alias("line")), F.struct(F.lit("title").alias("kind"), F.col("title").alias("line")))).alias("x"))
    return p.where("x.line is not null").select("id", "x.kind", R.name_list(F.col("x.line")).alias("names"))


def accessed_dates(s: SparkSession, d: str) -> DataFrame:
    r = T(s, d, "report_references").where("kind = 'web'")
    return r.select("reference_id", F.date_format("created_at", "yyyy-MM-dd").alias("accessed"))


def like_patterns(s: SparkSession, d: str) -> DataFrame:
    """Topics as literal patterns: each finds itself however many wildcards it holds."""
    q = T(s, d, "sub_questions").select("id", F.concat(F.lit("50%_"), F.col("main_topic")).alias("t"))
    return q.select("id", R.like_escaped(F.col("t")).alias("pattern"))


def compatible_texts(s: SparkSession, d: str) -> DataFrame:
    """Documents in compatibility form with plain marks (no SQL twin: SQL has no compatibility form)."""
    t = T(s, d, "documents").where("text is not null").select("doc_id", R.compatible(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5(F.col("t").cast("binary")).alias("md5"), F.length("t").cast("long").alias("n"))


def _words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' ')"
_STEM = "CASE " + " ".join(f"WHEN w LIKE '%{e}' AND length(w) >= {len(e) + 4} THEN left(w, length(w) - {len(e)})" for e in R.ENDINGS) + " ELSE w END"
_SPLIT = "SELECT id, main_topic, unnest(detail_questions) AS q, generate_subscripts(detail_questions, 1) - 1 AS no FROM sub_questions"
_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_FIELD = "CASE WHEN len(w) > 2 THEN 'TITLE-ABS-KEY(' || w[1] || ' AND ' || w[2] || ') AND TITLE-ABS-KEY(' || array_to_string(w[3:], ' OR ') || ')' WHEN len(w) > 0 THEN 'TITLE-ABS-KEY(' || array_to_string(w, ' AND ') || ')' ELSE '' END || CASE len(w) WHEN 3 THEN ' | TITLE-ABS-KEY(' || w[1] || ' AND ' || w[2] || ')' WHEN 2 THEN ' | TITLE-ABS-KEY(' || w[1] || ' OR ' || w[2] || ')' ELSE '' END"



QUERIES = {
    "typed_verdicts": (typed_verdicts, "SELECT id, judge_relevant AS relevant, round(least(1, greatest(0, coalesce(judge_confidence * 1.5 - 0.2, 0))), 4) AS confidence FROM retrieved_papers WHERE judge_relevant IS NOT NULL"),
    "normal_plans": (normal_plans, f"SELECT id, {_CLEAN.format('main_topic')} AS topic, len(list_filter(detail_questions, lambda x: trim(x, ' ') <> '')) AS details FROM sub_questions"),
    "listed_queries": (listed_queries, f"WITH l AS (SELECT id, list_transform(detail_questions, lambda x: {_CLEAN.format('x')}) AS q FROM sub_questions), k AS (SELECT id, {_DISTINCT.format('q')} AS q FROM l) SELECT id, unnest(q) AS query, generate_subscripts(q, 1) - 1 AS no FROM k"),
    "normal_tags": (normal_tags, "SELECT id, detail, strength FROM (SELECT id, len(detail_questions) AS n, unnest([{'detail': 1, 'strength': 'partial'}, {'detail': 2, 'strength': 'full'}, {'detail': 3, 'strength': 'partial'}], recursive := true) FROM sub_questions) WHERE detail <= n"),
    "search_queries": (search_queries, f"WITH q AS ({_SPLIT}), k AS (SELECT id, no, q, list_filter({_words('q')}, lambda w: w NOT IN ({_STOP}) AND length(w) > 1) AS a FROM q), f AS (SELECT id, no, q, {_DISTINCT.format('a')} AS w FROM k) SELECT id, no, {_CLEAN.format(chr(39) + 'not ' + chr(39) + ' || regexp_replace(q, ' + chr(39) + '[*?~]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ') || ' + chr(39) + ' and ' + chr(39))} AS plain, {_FIELD} AS fielded FROM f"),
    "anchored_queries": (anchored_queries, f"WITH a AS (SELECT id, detail_questions, {_CLEAN.format('main_topic')} AS t FROM sub_questions), b AS (SELECT id, detail_questions AS q, CASE WHEN length(t) <= 60 AND len(string_split(t, ' ')) <= 6 AND NOT regexp_matches(t, '[\\[\\]{{}}<>]') THEN t ELSE '' END AS anchor FROM a), c AS (SELECT id, anchor, list_transform(q, lambda x: CASE WHEN anchor = '' OR len(list_filter({_words('anchor')}, lambda w: NOT list_contains({_words('x')}, w))) = 0 THEN x ELSE x || ' ' || anchor END) AS q FROM b), e AS (SELECT id, anchor, {_DISTINCT.format('q')} AS q FROM c) SELECT id, anchor, unnest(q) AS query, generate_subscripts(q, 1) - 1 AS no FROM e"),
    "standalone_questions": (standalone_questions, f"WITH q AS (SELECT id, no, {_CLEAN.format('q')} AS a, {_CLEAN.format('main_topic')} AS t FROM ({_SPLIT})), b AS (SELECT *, regexp_replace(a, '[?. ]+$', '') AS c FROM q) SELECT id, no, CASE WHEN a LIKE '%?' AND len(string_split(a, ' ')) >= 6 THEN a ELSE upper(left(c, 1)) || substring(c, 2) || ' - in the context of the question: ' || t END AS question FROM b"),
    "stem_sets": (stem_sets, f"WITH w AS (SELECT row_id, unnest(list_transform(regexp_extract_all(regexp_replace(lower(claim), '[‐-―−]', '-', 'g'), '[a-z][a-z0-9-]+'), lambda w: regexp_replace(w, '^-+|-+$', '', 'g'))) AS w FROM tag_audit WHERE claim IS NOT NULL), p AS (SELECT row_id, unnest(CASE WHEN contains(w, '-') THEN list_concat([w], string_split(w, '-')) ELSE [w] END) AS w FROM w), k AS (SELECT DISTINCT row_id, {_STEM} AS w FROM p WHERE length(w) > 2 AND w NOT IN ({_STOP})) SELECT a.row_id, coalesce(string_agg(w, ' ' ORDER BY w), '') AS stems FROM tag_audit a LEFT JOIN k ON a.row_id = k.row_id WHERE claim IS NOT NULL GROUP BY a.row_id"),
    "claim_quantities": (claim_quantities, None),
    "claim_wordings": (claim_wordings, f"WITH a AS (SELECT row_id, regexp_replace({_CLEAN.format('claim')}, '[ .;:]+$', '') AS t, {_CLEAN.format('claim')} AS c FROM (SELECT row_id, regexp_replace(claim, '\\s*\\[\\s*[0-9]+(\\s*[,;–-]\\s*[0-9]+)*\\s*\\]', '', 'g') AS x, claim FROM tag_audit WHERE claim IS NOT NULL)), b AS (SELECT *, regexp_replace({_CLEAN.format('c')} , '\\s*\\[\\s*[0-9]+(\\s*[,;–-]\\s*[0-9]+)*\\s*\\]', '', 'g') AS e, regexp_extract(c, '^([A-Za-z]+)', 1) AS f FROM a), k AS (SELECT row_id, c, f, regexp_replace(e, '[ .;:]+$', '') AS w FROM b) SELECT row_id, CASE WHEN lower(f) IN ({_STOP}) AND NOT regexp_matches(f, '^[A-Z]{{2,}}') THEN lower(left(w, 1)) || substring(w, 2) ELSE w END AS wording, CASE WHEN len(string_split(c, ' ')) >= 3 THEN upper(left(c, 1)) || substring(c, 2) ELSE 'One recent study reports that ' || c END AS content FROM k"),
    "labels": (labels, "WITH v AS (SELECT row_id, CAST(sum(CAST(round(latency_s * 1000) AS BIGINT)) AS BIGINT) AS ms, CAST(sum(length(raw_output)) AS BIGINT) * 40 AS k, count(error) AS b, count(*) AS n FROM judge_verdicts GROUP BY row_id), s AS (SELECT *, CAST(round(ms / 1000) AS BIGINT) AS s FROM v) SELECT row_id, CASE WHEN ms >= 0 THEN CASE WHEN s < 60 THEN s || ' s' ELSE (s // 60) || ' min ' || (s % 60) || ' s' END END AS took, CASE WHEN k < 1000 THEN CAST(k AS VARCHAR) ELSE (k // 1000) || 'k' END AS tokens, CAST(floor(100 * b / n + 0.5) AS BIGINT) || '%' AS failed FROM s"),
    "retry_waits": (retry_waits, "SELECT verdict_id, CASE WHEN attempt > 1 THEN CAST(verdict_id % 90 AS DOUBLE) END AS wait FROM judge_verdicts"),
    "author_lines": (author_lines, None),
    "accessed_dates": (accessed_dates, "SELECT reference_id, strftime(created_at, '%Y-%m-%d') AS accessed FROM report_references WHERE kind = 'web'"),
    "like_patterns": (like_patterns, "SELECT id, replace(replace(replace('50%_' || main_topic, '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS pattern FROM sub_questions"),
    "compatible_texts": (compatible_texts, None),
}
