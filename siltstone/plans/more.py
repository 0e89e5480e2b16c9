"""Further queries: gates, lookups, text checks, rankings and evaluation, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as X
from siltstone.operators import documents as D
from siltstone.operators.ranking import top_k
from siltstone.sources import table
from siltstone.sources.sinks import split_rows

T = table


def judge_gate(s: SparkSession, d: str) -> DataFrame:
    """Papers kept by the judge; a missing verdict keeps a paper and says so."""
    p = T(s, d, "retrieved_papers").select("id", "judge_relevant", "judge_confidence")
    kept = F.col("judge_relevant").isNull() | (F.col("judge_relevant") & (F.col("judge_confidence") >= 0.6))
    return p.where(kept).select("id", F.when(F.col("judge_relevant").isNull(), "judgment_failed").otherwise("judged").alias("how"))


def min_citations(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "retrieved_papers").where("coalesce(citation_count, 0) >= 10").select("id", F.col("citation_count").cast("long").alias("citations"))


def web_snippets(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "documents").where("source = 'web' and length(text) >= 200").select("doc_id")


def candidate_abstracts(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "retrieved_papers").where("length(abstract) > 200").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("abstract")).cast("long").alias("longest"))


def id_shapes(s: SparkSession, d: str) -> DataFrame:
    """Ids that are and are not of the 8-4-4-4-12 form."""
    p = T(s, d, "retrieved_papers").select(F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$").alias("valid"))
    return p.groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


def accepted_full_text(s: SparkSession, d: str) -> DataFrame:
    """Papers with enough text in sections, and three sections or ten references."""
    p = T(s, d, "parsed_papers").select("id", "sections", "cited_references")
    n = F.aggregate(F.coalesce("sections", F.array().cast("array<struct<heading:string,text:string,level:int>>")), F.lit(0), lambda a, x: a + F.coalesce(F.length(x["text"]), F.lit(0)))
    out = p.select("id", n.cast("long").alias("n_chars"), F.coalesce(F.size("sections"), F.lit(0)).cast("long").alias("n_sections"), F.coalesce(F.size("cited_references"), F.lit(0)).cast("long").alias("n_refs"))
    return out.where("n_chars >= 15000 and (n_sections >= 3 or n_refs >= 10)")


def background_sections(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "parsed_papers").select("id", F.posexplode("sections").alias("no", "x"))
    return p.where(F.lower("x.heading").rlike("(background|introduction|related work|preliminar)")).select("id", F.col("no").cast("long").alias("no"))


def definitional_topics(s: SparkSession, d: str) -> DataFrame:
    q = T(s, d, "sub_questions").select("id", "main_topic")
    return q.where(F.lower(F.trim("main_topic")).rlike("^what (is|are) ")).select("id", F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim("main_topic")), "^what (is|are) ", ""), r"[? ]+$", "")).alias("topic"))


def log_filter(s: SparkSession, d: str) -> DataFrame:
    """Events of two kinds, over a value, whose payload holds a digit run, in one conjunctive filter."""
    e = T(s, d, "events").where((F.col("event_type").isin("error", "view")) & (F.col("value") > 20) & F.col("props").contains("9"))
    return e.select("event_id", "event_type")


def failed_answers(s: SparkSession, d: str) -> DataFrame:
    """Errors by whether another attempt may help."""
    v = T(s, d, "judge_verdicts").where("error is not null")
    lasting = F.col("error").rlike("JSON|reply|verdict")
    return v.groupBy(F.when(lasting, "lasting").when(F.col("error").rlike("timeout|429|slow"), "passing").otherwise("other").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("row_ids"))


def error_rate_fallback(s: SparkSession, d: str) -> DataFrame:
    """Models whose share of errors asks for the fallback."""
    v = T(s, d, "judge_verdicts").groupBy("model", "attempt").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("errors"))
    return v.select("model", "attempt", "n", "errors", (F.col("errors") > 0.3 * F.col("n")).alias("fallback"))


def gold_join(s: SparkSession, d: str) -> DataFrame:
    """Last attempt of each row joined to its audited label; rows without one drop out."""
    v = top_k(T(s, d, "judge_verdicts").select("row_id", "attempt", "verdict_id", "verdict_final"), ["row_id"], [F.desc("attempt"), F.desc("verdict_id")], 1)
    return v.join(T(s, d, "tag_audit").select("row_id", "judge_final"), "row_id").select("row_id", "verdict_final", "judge_final")


def cache_hits(s: SparkSession, d: str) -> DataFrame:
    """Prompts already answered earlier by the same model: hits and misses per model."""
    v = T(s, d, "judge_verdicts").select("model", F.sha2("prompt", 256).alias("k"), "verdict_id")
    first = F.min("verdict_id").over(Window.partitionBy("model", "k"))
    return v.select("model", (F.col("verdict_id") > first).alias("hit")).groupBy("model").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def majority_labels(s: SparkSession, d: str) -> DataFrame:
    """Most frequent reading of each row's labels; ties to the smaller one."""
    v = T(s, d, "tag_audit_labels").select("row_id", F.lower(F.trim("label")).alias("label")).where("label is not null and label <> ''")
    return top_k(v.groupBy("row_id", "label").agg(F.count(F.lit(1)).alias("n")), ["row_id"], [F.desc("n"), F.col("label")], 1)


def topic_lookup(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "tag_audit").select("row_id", "sub_question_id", "source_id")
    q = T(s, d, "sub_questions").select(F.col("id").alias("sub_question_id"), F.col("main_topic").alias("topic"))
    p = T(s, d, "retrieved_papers").select(F.col("id").alias("source_id"), "title")
    return a.join(q, "sub_question_id", "left").join(p, "source_id", "left").select("row_id", "topic", "title")


def parsed_flags(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").select("id", "source")
    known = T(s, d, "parsed_papers").select(F.col("retrieved_paper_id").alias("id")).distinct().withColumn("has_parse", F.lit(True))
    return p.join(known, "id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("has_parse").alias("parsed"))


def majority_section(s: SparkSession, d: str) -> DataFrame:
    """For each paper the sub-question that holds most of its audit rows; ties to the smaller id."""
    a = T(s, d, "tag_audit").where("source_id is not null and sub_question_id is not null").groupBy("source_id", "sub_question_id").agg(F.count(F.lit(1)).alias("n"))
    return top_k(a, ["source_id"], [F.desc("n"), F.col("sub_question_id")], 1)


def claims_by_text(s: SparkSession, d: str) -> DataFrame:
    """Claims that say the same apart from case and spacing, with their sources."""
    norm = F.trim(F.regexp_replace(F.lower("claim"), r"\s+", " "))
    a = T(s, d, "tag_audit").where("claim is not null").select(F.md5(norm.cast("binary")).alias("k"), "row_id", "source_id")
    return a.groupBy("k").agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("sources"))


def quotes_per_reference(s: SparkSession, d: str) -> DataFrame:
    """At most three distinct quotes per claim's source, best similarity first."""
    a = T(s, d, "tag_audit").where("quote is not null and source_id is not null").groupBy("source_id", "quote").agg(F.max("similarity").alias("sim"), F.min("row_id").alias("row_id"))
    return top_k(a, ["source_id"], [F.desc_nulls_last("sim"), F.col("row_id")], 3).select("source_id", "row_id")


def attempts_and_usable(s: SparkSession, d: str) -> DataFrame:
    v = T(s, d, "judge_verdicts").groupBy("row_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("verdict_final").isin("yes", "no", "partial")).alias("usable"), F.max("attempt").cast("long").alias("last_attempt"))
    return v.groupBy("attempts", "usable", "last_attempt").agg(F.count(F.lit(1)).alias("n"))


def bag_tally(s: SparkSession, d: str) -> DataFrame:
    """Fields of study by frequency, with their place."""
    p = T(s, d, "retrieved_papers").select(F.explode("fields_of_study").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    return p.select("f", "n", F.row_number().over(Window.orderBy(F.desc("n"), "f")).cast("long").alias("place"))


def anchor_grams(s: SparkSession, d: str) -> DataFrame:
    """Two-word endings shared by the topics of a run, with the share of topics that have them."""
    q = T(s, d, "sub_questions").select("query_id", X.words(F.col("main_topic")).alias("w")).where("size(w) >= 2")
    g = q.select("query_id", F.array_join(F.slice("w", -2, 2), " ").alias("ending"))
    n = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("topics"))
    return g.groupBy("query_id", "ending").agg(F.count(F.lit(1)).alias("n")).join(n, "query_id").select("query_id", "ending", F.round(F.col("n") / F.col("topics"), 6).alias("share"))


def last_with_value(s: SparkSession, d: str) -> DataFrame:
    """Per user and type the last event that carries a payload value over 50."""
    e = T(s, d, "events").select("user_id", "event_type", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k > 50")
    return e.groupBy("user_id", "event_type").agg(F.max_by("k", "event_id").alias("k"), F.max("event_id").alias("event_id"))


def parse_latest(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "parsed_papers").select("retrieved_paper_id", "id", "parser_version", "updated_at")
    return top_k(p, ["retrieved_paper_id"], [F.desc("parser_version"), F.desc("updated_at"), F.col("id")], 1).select("retrieved_paper_id", "id")


def first_spans(s: SparkSession, d: str) -> DataFrame:
    """First and last event of each user's first type, and the events in between."""
    e = T(s, d, "events").select("user_id", "event_id", "event_type")
    first = e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("event_type"))
    return e.join(first, ["user_id", "event_type"]).groupBy("user_id", "event_type").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"), F.count(F.lit(1)).alias("n"))


def worker_lanes(s: SparkSession, d: str) -> DataFrame:
    """Queue wait of each verdict behind the one before it of the same model, in whole seconds."""
    v = T(s, d, "judge_verdicts").where("latency_s is not null").select("model", "verdict_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), (F.col("latency_s") * 1_000_000).cast("long").alias("took"))
    w = Window.partitionBy("model").orderBy("at", "verdict_id")
    ended = F.lag(F.col("at") + F.col("took")).over(w)
    return v.select("verdict_id", F.floor(F.greatest(F.lit(0), ended - F.col("at")) / 1_000_000).alias("wait_s"))


def sentence_counts(s: SparkSession, d: str) -> DataFrame:
    c = T(s, d, "tag_audit").where("quote is not null").select("row_id", F.size(D.sentences(F.col("quote"))).cast("long").alias("n"))
    return c


def claim_numbers(s: SparkSession, d: str) -> DataFrame:
    """Numbers of a claim that its quote does not hold."""
    a = T(s, d, "tag_audit").where("claim is not null and quote is not null").select("row_id", F.array_sort(F.array_except(D.numbers(F.col("claim")), D.numbers(F.col("quote")))).alias("n"))
    return a.where("size(n) > 0").select("row_id", F.array_join("n", " ").alias("missing"))


def negation_mismatch(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "tag_audit").where("claim is not null and quote is not null")
    return a.where(D.has_negation(F.col("claim")) != D.has_negation(F.col("quote"))).select("row_id")


def claim_entities(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "tag_audit").where("claim is not null").select(F.explode(D.entities(F.col("claim"))).alias("e"))
    return a.groupBy("e").agg(F.count(F.lit(1)).alias("n"))


def token_estimates(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "documents").groupBy("source").agg(F.sum(F.ceil(F.length("text") / 4)).cast("long").alias("tokens"), F.count(F.lit(1)).alias("n"))


def duration_labels(s: SparkSession, d: str) -> DataFrame:
    v = T(s, d, "judge_verdicts").where("latency_s is not null").select("verdict_id", F.floor("latency_s").cast("long").alias("s"))
    return v.select("verdict_id", F.when(F.col("s") >= 60, F.concat(F.floor(F.col("s") / 60).cast("string"), F.lit("m "), (F.col("s") % 60).cast("string"), F.lit("s"))).otherwise(F.concat(F.col("s").cast("string"), F.lit("s"))).alias("label"))


def context_windows(s: SparkSession, d: str) -> DataFrame:
    """Stretch around the first 30 characters of the middle of each passage, 200 characters wide."""
    c = T(s, d, "chunk_lookup").where("length(text) >= 100").select("chunk_key", "text", F.substring("text", F.floor(F.length("text") / 2).cast("int"), F.lit(30)).alias("q"))
    return c.select("chunk_key", F.md5(D.context_window(F.col("text"), F.col("q"), 200).cast("binary")).alias("md5"))


def fuzzy_quotes(s: SparkSession, d: str) -> DataFrame:
    """Quotes against all passages of their source, by equality or partial similarity (no SQL twin). Every piece between
    ellipses must hold, the worst one's score is the quote's; quotes without passages or pieces have score 0."""
    q = T(s, d, "tag_audit").where("quote is not null").select("row_id", "source_id", F.posexplode_outer(X.elision_pieces(F.col("quote"))).alias("no", "q"))
    c = T(s, d, "chunk_lookup").select("source_id", X.quote_norm(F.col("text")).alias("t"))
    scored = D.verify_quotes(q.select("row_id", F.coalesce("no", F.lit(0)).alias("no"), "source_id", "q").join(c, "source_id", "left"), ["row_id", "no"], "q", "t")
    return scored.groupBy("row_id").agg(F.round(F.min("score"), 3).alias("score"), F.bool_and("verified").alias("verified"))


def markdown_sections(s: SparkSession, d: str) -> DataFrame:
    """Sections of the stored full texts read as markdown (no SQL twin)."""
    return D.markdown_sections(T(s, d, "parsed_papers").select("id", "full_text"), "id", "full_text")


def sequential_packing(s: SparkSession, d: str) -> DataFrame:
    """Passages of a source in order, in batches of 4,000 characters (no SQL twin)."""
    c = T(s, d, "chunk_lookup").select("source_id", "chunk_id", F.length("text").alias("n"))
    return D.pack_in_order(c, ["source_id"], ["chunk_id"], F.col("n"), 4000)


def distinct_claims(s: SparkSession, d: str) -> DataFrame:
    """Claims of an aspect, first kept, near ones (Jaccard 0.6) left out (no SQL twin)."""
    a = T(s, d, "tag_audit").where("claim is not null").select("sub_question_id", "row_id", X.content_words(F.col("claim")).alias("w")).where("sub_question_id is not null")
    return D.keep_first_distinct(a, ["sub_question_id"], "row_id", "w", 0.6).select("sub_question_id", "row_id")


def balanced_queries(s: SparkSession, d: str) -> DataFrame:
    """Claims assigned to the detail questions of their sub-question by the words they share, to each its even share at
    most (no SQL twin)."""
    a = T(s, d, "tag_audit").where("claim is not null and sub_question_id is not null").select("sub_question_id", "row_id", X.content_words(F.col("claim")).alias("w"))
    q = T(s, d, "sub_questions").select(F.col("id").alias("sub_question_id"), F.explode("detail_questions").alias("aspect_text")).withColumn("x", X.content_words(F.col("aspect_text")))
    p = a.join(q, "sub_question_id").select("sub_question_id", "row_id", "aspect_text", X.jaccard(F.col("w"), F.col("x")).alias("score"))
    return D.balanced_assignment(p, ["sub_question_id"], "row_id", "aspect_text", "score").select("sub_question_id", "row_id", "aspect_text")


def strength_bands(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "tag_audit").where("similarity is not null").select(F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.col("similarity"))).alias("c"), "strength")
    return a.groupBy(F.when(F.col("c") < 0.35, "low").when(F.col("c") < 0.7, "medium").otherwise("high").alias("band"), "strength").agg(F.count(F.lit(1)).alias("n"))


def graded_confusion(s: SparkSession, d: str) -> DataFrame:
    """Three by three: audited label against parsed verdict."""
    v = T(s, d, "judge_verdicts").where("verdict_final in ('yes', 'no', 'partial')").select("row_id", "verdict_final")
    j = v.join(T(s, d, "tag_audit").select("row_id", "judge_final"), "row_id")
    return j.groupBy("judge_final").pivot("verdict_final", ["yes", "partial", "no"]).agg(F.count(F.lit(1))).fillna(0, ["yes", "partial", "no"])


def macro_f1(s: SparkSession, d: str) -> DataFrame:
    """Three-way accuracy and macro F1 of the parsed verdicts."""
    v = T(s, d, "judge_verdicts").where("verdict_final in ('yes', 'no', 'partial')").select("row_id", "verdict_final")
    j = v.join(T(s, d, "tag_audit").where("judge_final is not null").select("row_id", "judge_final"), "row_id").select("judge_final", "verdict_final")
    c = j.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("judge_final") == k).alias("t"), (F.col("verdict_final") == k).alias("p")) for k in ("yes", "partial", "no")])).alias("x")).select("x.*")
    f = c.groupBy("k").agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(F.col("t")).alias("nt"), F.count_if(F.col("p")).alias("np"))
    score = F.when(F.col("nt") + F.col("np") > 0, 2 * F.col("tp") / (F.col("nt") + F.col("np"))).otherwise(0.0)
    return f.agg(F.round(F.avg(score), 6).alias("macro_f1"), F.round(F.sum("tp") / F.sum("nt"), 6).alias("accuracy"), F.sum("nt").alias("n"))


def best_threshold(s: SparkSession, d: str) -> DataFrame:
    """First threshold of best accuracy over the distinct scores of each source."""
    p = T(s, d, "retrieved_papers").where("judge_relevant is not null and relevance_score is not null")
    g = p.groupBy("source", "relevance_score").agg(F.count_if("judge_relevant").alias("p"), F.count_if(~F.col("judge_relevant")).alias("n"))
    up = Window.partitionBy("source").orderBy(F.desc("relevance_score")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("source").orderBy("relevance_score").rowsBetween(Window.unboundedPreceding, -1)
    right = F.sum("p").over(up) + F.coalesce(F.sum("n").over(down), F.lit(0))
    return top_k(g.withColumn("right", right), ["source"], [F.desc("right"), F.col("relevance_score")], 1).select("source", F.col("relevance_score").alias("threshold"), "right")


def fpr_at_tpr(s: SparkSession, d: str) -> DataFrame:
    """Smallest false positive rate at which 90 % of the relevant papers are kept, per source."""
    p = T(s, d, "retrieved_papers").where("judge_relevant is not null and relevance_score is not null")
    g = p.groupBy("source", "relevance_score").agg(F.count_if("judge_relevant").alias("p"), F.count_if(~F.col("judge_relevant")).alias("n"))
    up, everything = Window.partitionBy("source").orderBy(F.desc("relevance_score")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("source")
    r = g.select("source", F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"), F.sum("p").over(everything).alias("np"), F.sum("n").over(everything).alias("nn"))
    return r.where("np > 0 and nn > 0 and tp >= 0.9 * np").groupBy("source").agg(F.round(F.min(F.col("fp") / F.col("nn")), 6).alias("fpr"))


def recall_mrr(s: SparkSession, d: str) -> DataFrame:
    """Recall at 10, hit at 10 and reciprocal rank of the first relevant paper of each sub-question."""
    p = T(s, d, "retrieved_papers").where("judge_relevant is not null and relevance_score is not null").select("sub_question_id", "id", "judge_relevant", F.row_number().over(Window.partitionBy("sub_question_id").orderBy(F.desc("relevance_score"), "id")).alias("n"))
    g = p.groupBy("sub_question_id").agg(F.count_if("judge_relevant").alias("all"), F.count_if(F.col("judge_relevant") & (F.col("n") <= 10)).alias("top"), F.min(F.when(F.col("judge_relevant"), F.col("n"))).alias("first"))
    return g.where(F.col("all") > 0).select("sub_question_id", F.round(F.col("top") / F.col("all"), 6).alias("recall"), (F.col("top") > 0).alias("hit"), F.round(F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0), 6).alias("rr"))


def cascade(s: SparkSession, d: str) -> DataFrame:
    """Clear cases by score, the judge in the middle: share sent to the judge and agreement with it, per source."""
    p = T(s, d, "retrieved_papers").where("judge_relevant is not null and relevance_score is not null")
    easy = (F.col("relevance_score") >= 0.75) | (F.col("relevance_score") < 0.45)
    said = F.when(F.col("relevance_score") >= 0.75, True).when(F.col("relevance_score") < 0.45, False).otherwise(F.col("judge_relevant"))
    return p.groupBy("source").agg(F.round(F.avg((~easy).cast("double")), 6).alias("asked"), F.round(F.avg((said == F.col("judge_relevant")).cast("double")), 6).alias("agreement"))


def folds(s: SparkSession, d: str) -> DataFrame:
    """Five folds by id hash: threshold of best accuracy on four, accuracy on the fifth, from counts per fold and score."""
    p = T(s, d, "retrieved_papers").where("judge_relevant is not null and relevance_score is not null")
    h = F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 6), 16, 10).cast("long") % 5
    g = p.groupBy(h.alias("fold"), F.floor(F.col("relevance_score") * 20).cast("long").alias("b")).agg(F.count_if("judge_relevant").alias("p"), F.count_if(~F.col("judge_relevant")).alias("n"))
    cuts = g.select("b").distinct().withColumnRenamed("b", "cut")
    scored = g.crossJoin(F.broadcast(cuts)).groupBy("fold", "cut").agg(F.sum(F.when(F.col("b") >= F.col("cut"), F.col("p")).otherwise(F.col("n"))).alias("right"), F.sum(F.col("p") + F.col("n")).alias("rows"))
    rest = scored.withColumn("train", F.sum("right").over(Window.partitionBy("cut")) - F.col("right"))
    return top_k(rest, ["fold"], [F.desc("train"), F.col("cut")], 1).select("fold", "cut", F.round(F.col("right") / F.col("rows"), 6).alias("accuracy"))


def model_agreement(s: SparkSession, d: str) -> DataFrame:
    """Against the first attempt: same label, lost and gained yes verdicts of the later ones."""
    v = T(s, d, "judge_verdicts").where("verdict_final in ('yes', 'no', 'partial')").groupBy("row_id", "attempt").agg(F.min("verdict_final").alias("f"))
    a, b = v.where("attempt = 1").select("row_id", F.col("f").alias("a")), v.where("attempt > 1").select("row_id", "attempt", F.col("f").alias("b"))
    return a.join(b, "row_id").groupBy("attempt").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if((F.col("a") == "yes") & (F.col("b") != "yes")).alias("lost"), F.count_if((F.col("a") != "yes") & (F.col("b") == "yes")).alias("gained"))


def seeded_split(s: SparkSession, d: str) -> DataFrame:
    """Train, validation and test rows by a seeded hash."""
    return split_rows(T(s, d, "sub_questions").select("id"), "id", 7, {"train": 0.9, "validation": 0.05, "test": 0.05})


_REL = "FROM retrieved_papers WHERE judge_relevant IS NOT NULL AND relevance_score IS NOT NULL"
_SCORES = f"(SELECT source, relevance_score AS x, count(*) FILTER (WHERE judge_relevant) AS p, count(*) FILTER (WHERE NOT judge_relevant) AS n {_REL} GROUP BY ALL)"
_NUM = "list_transform(regexp_extract_all({0}, '([0-9][0-9,]*(?:\\.[0-9]+)?%?)', 1), lambda v: regexp_replace(replace(v, ',', ''), '\\.$', ''))"
_NEG = "regexp_matches(lower({0}), '(^|[^a-z])(no|not|never|none|neither|nor|without|cannot|fails? to)([^a-z]|$)|n''t([^a-z]|$)')"

QUERIES = {
    "judge_gate": (judge_gate, "SELECT id, CASE WHEN judge_relevant IS NULL THEN 'judgment_failed' ELSE 'judged' END AS how FROM retrieved_papers WHERE judge_relevant IS NULL OR (judge_relevant AND judge_confidence >= 0.6)"),
    "min_citations": (min_citations, "SELECT id, CAST(citation_count AS BIGINT) AS citations FROM retrieved_papers WHERE coalesce(citation_count, 0) >= 10"),
    "web_snippets": (web_snippets, "SELECT doc_id FROM documents WHERE source = 'web' AND length(text) >= 200"),
    "candidate_abstracts": (candidate_abstracts, "SELECT source, count(*) AS n, max(length(abstract)) AS longest FROM retrieved_papers WHERE length(abstract) > 200 GROUP BY source"),
    "id_shapes": (id_shapes, "SELECT regexp_full_match(id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS valid, count(*) AS n FROM retrieved_papers GROUP BY 1"),
    "accepted_full_text": (accepted_full_text, "SELECT * FROM (SELECT id, CAST(coalesce(list_sum(list_transform(sections, lambda x: coalesce(length(x.text), 0))), 0) AS BIGINT) AS n_chars, coalesce(len(sections), 0) AS n_sections, coalesce(len(cited_references), 0) AS n_refs FROM parsed_papers) WHERE n_chars >= 15000 AND (n_sections >= 3 OR n_refs >= 10)"),
    "background_sections": (background_sections, "SELECT id, no - 1 AS no FROM (SELECT id, unnest(sections) AS x, generate_subscripts(sections, 1) AS no FROM parsed_papers) WHERE regexp_matches(lower(x.heading), '(background|introduction|related work|preliminar)')"),
    "definitional_topics": (definitional_topics, "SELECT id, trim(regexp_replace(regexp_replace(lower(trim(main_topic)), '^what (is|are) ', ''), '[? ]+$', '')) AS topic FROM sub_questions WHERE regexp_matches(lower(trim(main_topic)), '^what (is|are) ')"),
    "log_filter": (log_filter, "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'view') AND value > 20 AND contains(props, '9')"),
    "failed_answers": (failed_answers, "SELECT CASE WHEN regexp_matches(error, 'JSON|reply|verdict') THEN 'lasting' WHEN regexp_matches(error, 'timeout|429|slow') THEN 'passing' ELSE 'other' END AS kind, count(*) AS n, count(DISTINCT row_id) AS row_ids FROM judge_verdicts WHERE error IS NOT NULL GROUP BY 1"),
    "error_rate_fallback": (error_rate_fallback, "SELECT model, attempt, count(*) AS n, count(error) AS errors, count(error) > 0.3 * count(*) AS fallback FROM judge_verdicts GROUP BY ALL"),
    "gold_join": (gold_join, "SELECT row_id, verdict_final, judge_final FROM (SELECT * FROM judge_verdicts QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY attempt DESC, verdict_id DESC) = 1) JOIN tag_audit USING (row_id)"),
    "cache_hits": (cache_hits, "SELECT model, count(*) FILTER (WHERE verdict_id > f) AS hits, count(*) FILTER (WHERE verdict_id <= f) AS misses FROM (SELECT model, verdict_id, min(verdict_id) OVER (PARTITION BY model, prompt) AS f FROM judge_verdicts) GROUP BY model"),
    "majority_labels": (majority_labels, "SELECT row_id, label, n FROM (SELECT row_id, lower(trim(label)) AS label, count(*) AS n FROM tag_audit_labels WHERE label IS NOT NULL AND trim(label) <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, label) = 1"),
    "topic_lookup": (topic_lookup, "SELECT row_id, q.main_topic AS topic, p.title FROM tag_audit a LEFT JOIN sub_questions q ON a.sub_question_id = q.id LEFT JOIN retrieved_papers p ON a.source_id = p.id"),
    "parsed_flags": (parsed_flags, "SELECT source, count(*) AS n, count(*) FILTER (WHERE id IN (SELECT retrieved_paper_id FROM parsed_papers)) AS parsed FROM retrieved_papers GROUP BY source"),
    "majority_section": (majority_section, "SELECT source_id, sub_question_id, n FROM (SELECT source_id, sub_question_id, count(*) AS n FROM tag_audit WHERE source_id IS NOT NULL AND sub_question_id IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, sub_question_id) = 1"),
    "claims_by_text": (claims_by_text, "SELECT md5(trim(regexp_replace(lower(claim), '\\s+', ' ', 'g'))) AS k, min(row_id) AS first_row, count(*) AS n, count(DISTINCT source_id) AS sources FROM tag_audit WHERE claim IS NOT NULL GROUP BY 1"),
    "quotes_per_reference": (quotes_per_reference, "SELECT source_id, row_id FROM (SELECT source_id, quote, max(similarity) AS sim, min(row_id) AS row_id FROM tag_audit WHERE quote IS NOT NULL AND source_id IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY sim DESC NULLS LAST, row_id) <= 3"),
    "attempts_and_usable": (attempts_and_usable, "SELECT attempts, usable, last_attempt, count(*) AS n FROM (SELECT row_id, count(*) AS attempts, count(*) FILTER (WHERE verdict_final IN ('yes', 'no', 'partial')) AS usable, CAST(max(attempt) AS BIGINT) AS last_attempt FROM judge_verdicts GROUP BY row_id) GROUP BY ALL"),
    "bag_tally": (bag_tally, "SELECT f, n, row_number() OVER (ORDER BY n DESC, f) AS place FROM (SELECT f, count(*) AS n FROM (SELECT unnest(fields_of_study) AS f FROM retrieved_papers) GROUP BY f)"),
    "anchor_grams": (anchor_grams, "WITH q AS (SELECT query_id, regexp_extract_all(lower(main_topic), '[a-z0-9]+') AS w FROM sub_questions), g AS (SELECT query_id, array_to_string(w[len(w) - 1 : len(w)], ' ') AS ending FROM q WHERE len(w) >= 2), n AS (SELECT query_id, count(*) AS topics FROM g GROUP BY query_id) SELECT query_id, ending, round(count(*) / any_value(topics), 6) AS share FROM g JOIN n USING (query_id) GROUP BY ALL"),
    "last_with_value": (last_with_value, "SELECT user_id, event_type, arg_max(k, event_id) AS k, max(event_id) AS event_id FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE k > 50 GROUP BY user_id, event_type"),
    "parse_latest": (parse_latest, "SELECT retrieved_paper_id, id FROM parsed_papers QUALIFY row_number() OVER (PARTITION BY retrieved_paper_id ORDER BY parser_version DESC, updated_at DESC, id) = 1"),
    "first_spans": (first_spans, "SELECT e.user_id, e.event_type, min(event_id) AS a, max(event_id) AS b, count(*) AS n FROM events e JOIN (SELECT user_id, arg_min(event_type, event_id) AS t FROM events GROUP BY user_id) f ON e.user_id = f.user_id AND e.event_type = f.t GROUP BY ALL"),
    "worker_lanes": (worker_lanes, "SELECT verdict_id, CAST(floor(greatest(0, lag(t + k) OVER (PARTITION BY model ORDER BY t, verdict_id) - t) / 1000000) AS BIGINT) AS wait_s FROM (SELECT model, verdict_id, epoch_us(created_at) AS t, CAST(trunc(latency_s * 1000000) AS BIGINT) AS k FROM judge_verdicts WHERE latency_s IS NOT NULL)"),
    "sentence_counts": (sentence_counts, None),
    "claim_numbers": (claim_numbers, f"SELECT row_id, array_to_string(n, ' ') AS missing FROM (SELECT row_id, list_sort(list_distinct(list_filter({_NUM.format('claim')}, lambda v: NOT list_contains({_NUM.format('quote')}, v)))) AS n FROM tag_audit WHERE claim IS NOT NULL AND quote IS NOT NULL) WHERE len(n) > 0"),
    "negation_mismatch": (negation_mismatch, f"SELECT row_id FROM tag_audit WHERE claim IS NOT NULL AND quote IS NOT NULL AND {_NEG.format('claim')} <> {_NEG.format('quote')}"),
    "claim_entities": (claim_entities, "SELECT e, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(claim, '\\b([A-Za-z]*[A-Z][A-Z]+[A-Za-z0-9-]*|[A-Z][a-z]+-[0-9]+|[A-Za-z]+[0-9]+)\\b', 1))) AS e FROM tag_audit WHERE claim IS NOT NULL) GROUP BY e"),
    "token_estimates": (token_estimates, "SELECT source, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens, count(*) AS n FROM documents GROUP BY source"),
    "duration_labels": (duration_labels, "SELECT verdict_id, CASE WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS label FROM (SELECT verdict_id, CAST(floor(latency_s) AS BIGINT) AS s FROM judge_verdicts WHERE latency_s IS NOT NULL)"),
    "context_windows": (context_windows, "WITH c AS (SELECT chunk_key, text, substring(text, length(text) // 2, 30) AS q FROM chunk_lookup WHERE length(text) >= 100), a AS (SELECT *, instr(text, q) AS i, greatest(instr(text, q) - 100, 1) AS b FROM c) SELECT chunk_key, md5(substring(text, b, i - b + length(q) + 100)) AS md5 FROM a"),
    "fuzzy_quotes": (fuzzy_quotes, None),
    "markdown_sections": (markdown_sections, None),
    "sequential_packing": (sequential_packing, None),
    "distinct_claims": (distinct_claims, None),
    "balanced_queries": (balanced_queries, None),
    "strength_bands": (strength_bands, "SELECT CASE WHEN c < 0.35 THEN 'low' WHEN c < 0.7 THEN 'medium' ELSE 'high' END AS band, strength, count(*) AS n FROM (SELECT greatest(0, least(0.95, similarity)) AS c, strength FROM tag_audit WHERE similarity IS NOT NULL) GROUP BY ALL"),
    "graded_confusion": (graded_confusion, "SELECT judge_final, count(*) FILTER (WHERE verdict_final = 'yes') AS yes, count(*) FILTER (WHERE verdict_final = 'partial') AS partial, count(*) FILTER (WHERE verdict_final = 'no') AS no FROM judge_verdicts JOIN tag_audit USING (row_id) WHERE verdict_final IN ('yes', 'no', 'partial') GROUP BY judge_final"),
    "macro_f1": (macro_f1, "WITH j AS (SELECT judge_final AS t, verdict_final AS p FROM judge_verdicts JOIN tag_audit USING (row_id) WHERE verdict_final IN ('yes', 'no', 'partial') AND judge_final IS NOT NULL), f AS (SELECT k, count(*) FILTER (WHERE t = k AND p = k) AS tp, count(*) FILTER (WHERE t = k) AS nt, count(*) FILTER (WHERE p = k) AS np FROM j, (SELECT unnest(['yes', 'partial', 'no']) AS k) GROUP BY k) SELECT round(avg(CASE WHEN nt + np > 0 THEN 2 * tp / (nt + np) ELSE 0 END), 6) AS macro_f1, round(sum(tp) / sum(nt), 6) AS accuracy, CAST(sum(nt) AS BIGINT) AS n FROM f"),
    "best_threshold": (best_threshold, f"SELECT source, x AS threshold, CAST(r AS BIGINT) AS \"right\" FROM (SELECT source, x, sum(p) OVER (PARTITION BY source ORDER BY x DESC ROWS UNBOUNDED PRECEDING) + coalesce(sum(n) OVER (PARTITION BY source ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM {_SCORES}) QUALIFY row_number() OVER (PARTITION BY source ORDER BY r DESC, x) = 1"),
    "fpr_at_tpr": (fpr_at_tpr, f"SELECT source, round(min(fp / nn), 6) AS fpr FROM (SELECT source, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY source) AS np, sum(n) OVER (PARTITION BY source) AS nn FROM {_SCORES} WINDOW w AS (PARTITION BY source ORDER BY x DESC ROWS UNBOUNDED PRECEDING)) WHERE np > 0 AND nn > 0 AND tp >= 0.9 * np GROUP BY source"),
    "recall_mrr": (recall_mrr, f"WITH r AS (SELECT sub_question_id, judge_relevant AS y, row_number() OVER (PARTITION BY sub_question_id ORDER BY relevance_score DESC, id) AS n {_REL}), g AS (SELECT sub_question_id, count(*) FILTER (WHERE y) AS a, count(*) FILTER (WHERE y AND n <= 10) AS t, min(n) FILTER (WHERE y) AS f FROM r GROUP BY ALL) SELECT sub_question_id, round(t / a, 6) AS recall, t > 0 AS hit, round(CASE WHEN f <= 10 THEN 1 / f ELSE 0 END, 6) AS rr FROM g WHERE a > 0"),
    "cascade": (cascade, f"SELECT source, round(avg(CASE WHEN x >= 0.75 OR x < 0.45 THEN 0.0 ELSE 1.0 END), 6) AS asked, round(avg(CASE WHEN (CASE WHEN x >= 0.75 THEN true WHEN x < 0.45 THEN false ELSE y END) = y THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM (SELECT source, relevance_score AS x, judge_relevant AS y {_REL}) GROUP BY source"),
    "folds": (folds, f"WITH g AS (SELECT CAST('0x' || left(md5(id), 6) AS BIGINT) % 5 AS fold, CAST(floor(relevance_score * 20) AS BIGINT) AS b, count(*) FILTER (WHERE judge_relevant) AS p, count(*) FILTER (WHERE NOT judge_relevant) AS n {_REL} GROUP BY ALL), s AS (SELECT fold, cut, sum(CASE WHEN b >= cut THEN p ELSE n END) AS r, sum(p + n) AS k FROM g, (SELECT DISTINCT b AS cut FROM g) GROUP BY ALL), t AS (SELECT *, sum(r) OVER (PARTITION BY cut) - r AS train FROM s) SELECT fold, cut, round(r / k, 6) AS accuracy FROM t QUALIFY row_number() OVER (PARTITION BY fold ORDER BY train DESC, cut) = 1"),
    "model_agreement": (model_agreement, "WITH v AS (SELECT row_id, attempt, min(verdict_final) AS f FROM judge_verdicts WHERE verdict_final IN ('yes', 'no', 'partial') GROUP BY ALL) SELECT b.attempt, count(*) AS n, count(*) FILTER (WHERE a.f = b.f) AS same, count(*) FILTER (WHERE a.f = 'yes' AND b.f <> 'yes') AS lost, count(*) FILTER (WHERE a.f <> 'yes' AND b.f = 'yes') AS gained FROM v a JOIN v b ON a.row_id = b.row_id AND a.attempt = 1 AND b.attempt > 1 GROUP BY b.attempt"),
    "seeded_split": (seeded_split, "SELECT id, CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.95 THEN 'validation' ELSE 'test' END AS split FROM (SELECT id, CAST('0x' || left(md5('7:' || id), 12) AS BIGINT) / 281474976710656.0 AS u FROM sub_questions)"),
}
