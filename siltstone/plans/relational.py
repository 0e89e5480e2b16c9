"""Queries over joins, windows and aggregates, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.keys import doc_key
from siltstone.functions.text import author_list
from siltstone.operators import joins, ranking
from siltstone.sources import table

T = table


def newest_generation(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").select("event_id", "user_id", "ts")
    return ranking.newest_generation(e, ["user_id"], "ts", 86400).select("event_id", "user_id")


def latest_per_key(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return ranking.latest_per_key(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


def latest_n_runs(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select("o_orderkey", "o_custkey", "o_totalprice")


def topk_per_group(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").select("sub_question_id", "id", "combined_score").where("combined_score is not null")
    return ranking.top_k(p, ["sub_question_id"], [F.desc("combined_score"), F.col("id")], 20)


def topk_attempt_window(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").select("sub_question_id", "id", "combined_score", "citation_count").where("judge_relevant")
    w = Window.partitionBy("sub_question_id").orderBy(F.desc(F.coalesce("combined_score", F.lit(0.0))), F.desc(F.coalesce("citation_count", F.lit(0))), "id")
    n = p.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10")
    return n.select("sub_question_id", "id", "place", F.when(F.col("place") <= 5, "first").otherwise("reserve").alias("attempt"))


def dedup_keep_max_cap(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "tag_audit").select("aspect_text", "source_id", "claim", "similarity", "row_id")
    return ranking.dedup_keep_best_then_cap(a, ["aspect_text", "source_id", "claim"], ["aspect_text"], [F.desc_nulls_last("similarity"), F.col("row_id")], 6).select("aspect_text", "row_id")


def fair_trim_cap(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "tag_audit").select("row_id", "aspect_text", "similarity")
    return ranking.fair_trim(a, ["aspect_text"], [F.desc_nulls_last("similarity"), F.col("row_id")], 60).select("row_id", "aspect_text", F.col("rank_in_group").cast("long").alias("rank_in_group"))


def cap_per_source(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "documents").select("source", "doc_id", "n_chars")
    return ranking.top_k(a, ["source"], [F.desc("n_chars"), F.col("doc_id")], 3)


def cap_per_section_diverse(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "tag_audit").select("sub_question_id", "source_id", "row_id", "similarity").where("source_id is not null and sub_question_id is not null")
    return ranking.diverse_cap(a, "sub_question_id", "source_id", [F.desc_nulls_last("similarity"), F.col("row_id")], 8).select("sub_question_id", "row_id")


def budget_in_order(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").select("user_id", "event_id", "event_type")
    return ranking.budget_in_order(e, ["user_id"], ["event_id"], F.col("event_type") == "error", 5).select("event_id", "judged")


def first_citation_numbering(s: SparkSession, d: str) -> DataFrame:
    line = T(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return ranking.number_by_first_use(line, ["l_orderkey"], "l_suppkey", "l_linenumber").select("l_orderkey", "l_suppkey", "number")


def round_robin_interleave(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").select("sub_question_id", "source", "id", "relevance_score").where("source is not null")
    return ranking.round_robin(p, ["sub_question_id"], "source", [F.desc_nulls_last("relevance_score"), F.col("id")], 12).select("sub_question_id", "id", "turn")


def mid_rank_percentile(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").select("sub_question_id", "id", "citation_count").where("citation_count >= 0")
    return ranking.mid_rank_percentile(p, ["sub_question_id"], "citation_count").select("id", F.round("percentile", 6).alias("percentile"))


def tier_sampling(s: SparkSession, d: str) -> DataFrame:
    """Rank by score, cut into thirds, count and mean per third."""
    p = T(s, d, "retrieved_papers").select("sub_question_id", "id", "relevance_score").where("relevance_score is not null")
    t = ranking.tiers_by_rank(p, ["sub_question_id"], [F.desc("relevance_score"), F.col("id")], 3)
    return t.groupBy("sub_question_id", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("relevance_score").alias("lowest"), F.max("relevance_score").alias("highest"))


def merge_first_filled(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").select("title", "id", "doi", "arxiv_id", "venue", "year").where("title is not null")
    return ranking.first_filled(p, ["title"], F.col("id"), ["doi", "arxiv_id", "venue", "year"])


def merge_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Copies of one title merged: union of the matched queries, most citations, both or the one source, preprint only if all are."""
    p = T(s, d, "retrieved_papers").select("title", "source", "citation_count", "is_preprint", "venue", "query_variant_matched").where("title is not null")
    g = p.groupBy("title").agg(
        F.max("citation_count").cast("long").alias("citations"),
        F.when(F.count_distinct("source") > 1, "both").otherwise(F.max("source")).alias("source"),
        F.bool_and("is_preprint").alias("is_preprint"),
        F.count(F.lit(1)).alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("query_variant_matched")))).alias("queries"),
    )
    return g.select("title", "citations", "source", "is_preprint", "copies", F.array_join("queries", "|").alias("queries"))


def prefer_sources(s: SparkSession, d: str) -> DataFrame:
    """Title and kind of every cited id, papers before references."""
    papers = T(s, d, "retrieved_papers").groupBy("title").agg(F.min("id").alias("ref"), F.lit("paper").alias("kind"))
    refs = T(s, d, "report_references").where("title is not null").groupBy("title").agg(F.min(F.col("reference_id").cast("string")).alias("ref"), F.min("kind").alias("kind"))
    return joins.prefer_sources([papers.where("title is not null"), refs], ["title"]).select("title", "ref", "kind", F.col("source_rank").cast("long").alias("source_rank"))


def left_join_default(s: SparkSession, d: str) -> DataFrame:
    """Papers with their parsed text's size, whether it is a full text, and the reliability with its default."""
    parsed = T(s, d, "parsed_papers").select(F.col("retrieved_paper_id").alias("id"), F.length("full_text").alias("n"))
    p = T(s, d, "retrieved_papers").select("id", "reliability_score").join(parsed, "id", "left")
    return p.select("id", F.coalesce(F.col("n") >= 3000, F.lit(False)).alias("has_full_text"), F.when(F.coalesce("reliability_score", F.lit(0.0)) == 0, 0.3).otherwise(F.col("reliability_score")).alias("reliability"))


def polymorphic_join(s: SparkSession, d: str) -> DataFrame:
    """References joined to papers by title where they are papers, and left as they are where they are web pages."""
    refs = T(s, d, "report_references").select("reference_id", "kind", "title", "domain")
    years = T(s, d, "retrieved_papers").where("title is not null").groupBy("title").agg(F.max("year").cast("long").alias("paper_year"))
    on = (F.col("kind") == "paper") & (refs["title"] == years["title"])
    return refs.join(years, on, "left").select("reference_id", "kind", F.when(F.col("kind") == "web", F.col("domain")).alias("domain"), "paper_year")


def semi_kept(s: SparkSession, d: str) -> DataFrame:
    kept = T(s, d, "tag_audit").where("judge_final = 'yes'").select(F.col("source_id").alias("id"))
    return joins.keep_known(T(s, d, "retrieved_papers").select("id", "source", "year"), kept, ["id"])


def anti_new(s: SparkSession, d: str) -> DataFrame:
    """Papers that no audit row cites, one per title."""
    known = T(s, d, "tag_audit").join(T(s, d, "retrieved_papers").select(F.col("id").alias("source_id"), "title"), "source_id").select("title")
    p = T(s, d, "retrieved_papers").select("title", "id").where("title is not null")
    return joins.only_new(p, known, ["title"], [F.col("id")])


def relational_division(s: SparkSession, d: str) -> DataFrame:
    """Customers all of whose orders are finished."""
    o = T(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return joins.divided_by(o, o, o.where("o_orderstatus = 'F'"), "o_custkey", "o_orderkey")


def full_outer_validation(s: SparkSession, d: str) -> DataFrame:
    """Audit rows without a verdict, and verdicts of unknown rows."""
    return joins.compare_ids(T(s, d, "tag_audit").select("row_id"), T(s, d, "judge_verdicts").select("row_id"), "row_id")


def as_of_usage(s: SparkSession, d: str) -> DataFrame:
    """For every error the last purchase value of its user at or before it."""
    e = T(s, d, "events").select("user_id", "event_id", "ts", "value", "event_type")
    left = e.where("event_type = 'error'").select("user_id", "event_id", "ts")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return joins.as_of(left, right, ["user_id"], "ts", "ts", ["last_value"]).select("event_id", "last_value")


def stage_intervals(s: SparkSession, d: str) -> DataFrame:
    """Each signup with the seconds to the next purchase of its user."""
    e = T(s, d, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    i = joins.start_end_intervals(e, ["user_id"], "at", F.col("event_type") == "signup", F.col("event_type") == "purchase")
    return i.select("user_id", F.col("started").alias("started_us"), (F.col("ended") - F.col("started")).alias("took_us"))


def stage_overlap(s: SparkSession, d: str) -> DataFrame:
    """Seconds in which the stage from first to last view overlaps the one from first to last error, per user and day."""
    e = T(s, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"))
    spans = e.groupBy("user_id", "day", "event_type").agg(F.min("at").alias("started"), F.max("at").alias("ended"))
    a, b = (spans.where(F.col("event_type") == x).select("user_id", "day", "started", "ended") for x in ("view", "error"))
    o = joins.overlapping(a, b, ["user_id", "day"], 3600)
    return o.select("user_id", F.col("a_started").cast("long").alias("a_started"), F.col("overlap").cast("long").alias("overlap"))


def identity_first_match(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").select("id", F.nullif(F.lower(F.trim("doi")), F.lit("")).alias("doi_k"), F.nullif(F.lower(F.trim("title")), F.lit("")).alias("title_k"))
    return joins.identity_first_match(p, "id", ["doi_k", "title_k"]).select("id", "matched")


def claims_by_doc_key(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").select(doc_key(F.col("title"), F.col("id")).alias("doc_key"), "id")
    return p.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def usage_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    """Calls and value by user and type, by type, and in total."""
    e = T(s, d, "events").select("user_id", "event_type", "value")
    g = e.groupingSets([["user_id", "event_type"], ["event_type"], []], "user_id", "event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("user_id", "event_type", "calls", "total")


def usage_rollup(s: SparkSession, d: str) -> DataFrame:
    o = T(s, d, "orders").select(F.year("o_orderdate").cast("long").alias("y"), "o_orderstatus", "o_totalprice")
    return o.rollup("y", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def usage_share_of_total(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("v"))
    return e.select("event_type", "calls", F.round(100 * F.col("v") / F.sum("v").over(Window.partitionBy()), 6).alias("percent"))


def funnel_counts(s: SparkSession, d: str) -> DataFrame:
    parsed = T(s, d, "parsed_papers").select(F.col("retrieved_paper_id").alias("id"), F.col("full_text").isNotNull().alias("full"))
    p = T(s, d, "retrieved_papers").select("id", "sub_question_id", "judge_relevant", "pdf_url").join(parsed, "id", "left")
    return p.groupBy("sub_question_id").agg(
        F.count(F.lit(1)).alias("kept"),
        F.count("judge_relevant").alias("judged"),
        F.sum(F.coalesce("judge_relevant", F.lit(False)).cast("long")).alias("relevant"),
        F.count("pdf_url").alias("with_pdf"),
        F.count("full").alias("parsed"),
        F.sum(F.coalesce("full", F.lit(False)).cast("long")).alias("full_text"),
    )


def outcome_tally(s: SparkSession, d: str) -> DataFrame:
    """Verdict outcomes per model: rows, errors, share of errors, distinct prompts."""
    v = T(s, d, "judge_verdicts").select("model", "error", "prompt", "verdict_final")
    return v.groupBy("model", "verdict_final").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("errors"), F.round(F.count("error") / F.count(F.lit(1)), 6).alias("error_share"), F.count_distinct("prompt").alias("prompts"))


def relevant_per_question(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").where("judge_relevant is not null").groupBy("sub_question_id").agg(F.sum(F.col("judge_relevant").cast("long")).alias("relevant"), F.count(F.lit(1)).alias("judged"))
    return p.select("*", F.when(F.col("relevant") == 0, "none").when(F.col("relevant") == F.col("judged"), "all").otherwise("some").alias("kind"))


def first_last_times(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").groupBy("sub_question_id", "source").agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"), F.count(F.lit(1)).alias("n"))
    return p.select("sub_question_id", "source", F.unix_micros(F.col("a").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("b").cast("timestamp")).alias("last_us"), "n")


def pivot_by_source(s: SparkSession, d: str) -> DataFrame:
    """Documents of each level by language; unknown and further languages count as other, so that rows add up."""
    names = ["en", "de", "fr", "es", "ru", "zh"]
    lang = F.when(F.col("lang").isin(*names), F.col("lang")).otherwise("other")
    x = T(s, d, "documents").select("evidence_level", lang.alias("lang")).groupBy("evidence_level").pivot("lang", [*names, "other"]).agg(F.count(F.lit(1)))
    return x.fillna(0, [*names, "other"])


def union_of_searches(s: SparkSession, d: str) -> DataFrame:
    """Bag union of the papers' and the references' titles, then distinct with counts."""
    a = T(s, d, "retrieved_papers").select(F.lower("title").alias("t"))
    b = T(s, d, "report_references").select(F.lower("title").alias("t"))
    return a.unionByName(b).where("t is not null").groupBy("t").agg(F.count(F.lit(1)).alias("n"))


def ids_in_common(s: SparkSession, d: str) -> DataFrame:
    """Set algebra over cited ids: both, only audited, only in documents."""
    a = T(s, d, "tag_audit").select(F.col("source_id").alias("id")).where("source_id is not null").distinct()
    b = T(s, d, "documents").select(F.col("paper_id").alias("id")).where("paper_id is not null").distinct()
    both, only_a, only_b = a.intersect(b).withColumn("side", F.lit("both")), a.exceptAll(b).withColumn("side", F.lit("audit")), b.exceptAll(a).withColumn("side", F.lit("documents"))
    return both.unionByName(only_a).unionByName(only_b)


def sort_views(s: SparkSession, d: str) -> DataFrame:
    """Place of every audit row in the view order: worst verdict first, similarity down, then text."""
    a = T(s, d, "tag_audit").select("row_id", "sub_question_id", "judge_final", "similarity", "claim")
    rank = F.when(F.col("judge_final") == "no", 0).when(F.col("judge_final") == "partial", 1).otherwise(2)
    w = Window.partitionBy("sub_question_id").orderBy(rank, F.desc_nulls_last("similarity"), "row_id")
    return a.select("row_id", F.row_number().over(w).cast("long").alias("place"))


def reference_lines(s: SparkSession, d: str) -> DataFrame:
    r = T(s, d, "report_references").where("title is not null")
    text = F.concat_ws(". ", F.coalesce(author_list(F.col("authors")), F.lit("Unknown")), F.col("title"), F.coalesce(F.col("venue"), F.lit("n.v.")), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")))
    return r.select("reference_id", text.alias("line"))


def jobs_in_sizes(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "tag_audit").select("row_id", "sub_question_id", "similarity")
    j = ranking.group_in_sizes(a, ["sub_question_id"], [F.desc_nulls_last("similarity"), F.col("row_id")], 3)
    return j.groupBy("sub_question_id", "job").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))


def revenue_by_nation(s: SparkSession, d: str) -> DataFrame:
    """Star join: revenue of each nation's suppliers from their own customers."""
    n, r, c, o, x, su = (T(s, d, t) for t in ("nation", "region", "customer", "orders", "lineitem", "supplier"))
    j = x.join(o, x.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(su, (x.l_suppkey == su.s_suppkey) & (c.c_nationkey == su.s_nationkey)).join(n, su.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def pricing_summary(s: SparkSession, d: str) -> DataFrame:
    x = T(s, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


def unshipped_orders(s: SparkSession, d: str) -> DataFrame:
    """Customers without orders and orders without lines, as two anti joins in one result."""
    c = T(s, d, "customer").select(F.col("c_custkey").alias("k")).join(T(s, d, "orders").select(F.col("o_custkey").alias("k")), "k", "left_anti").withColumn("kind", F.lit("customer"))
    o = T(s, d, "orders").select(F.col("o_orderkey").alias("k")).join(T(s, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k", "left_anti").withColumn("kind", F.lit("order"))
    return c.unionByName(o)


_FIRST_FILLED = ", ".join(f"arg_min({c}, id) FILTER (WHERE {c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> '') AS {c}" for c in ("doi", "arxiv_id", "venue", "year"))

QUERIES = {
    "newest_generation": (newest_generation, "SELECT event_id, user_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) m FROM events) WHERE ts >= m - INTERVAL 86400 SECOND"),
    "latest_per_key": (latest_per_key, "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"),
    "latest_n_runs": (latest_n_runs, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20"),
    "topk_per_group": (topk_per_group, "SELECT sub_question_id, id, combined_score FROM retrieved_papers WHERE combined_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sub_question_id ORDER BY combined_score DESC, id) <= 20"),
    "topk_attempt_window": (topk_attempt_window, "SELECT sub_question_id, id, place, CASE WHEN place <= 5 THEN 'first' ELSE 'reserve' END AS attempt FROM (SELECT *, row_number() OVER (PARTITION BY sub_question_id ORDER BY coalesce(combined_score, 0) DESC, coalesce(citation_count, 0) DESC, id) AS place FROM retrieved_papers WHERE judge_relevant) WHERE place <= 10"),
    "dedup_keep_max_cap": (dedup_keep_max_cap, "WITH b AS (SELECT * FROM tag_audit QUALIFY row_number() OVER (PARTITION BY aspect_text, source_id, claim ORDER BY similarity DESC NULLS LAST, row_id) = 1) SELECT aspect_text, row_id FROM b QUALIFY row_number() OVER (PARTITION BY aspect_text ORDER BY similarity DESC NULLS LAST, row_id) <= 6"),
    "fair_trim_cap": (fair_trim_cap, "SELECT row_id, aspect_text, rank_in_group FROM (SELECT *, row_number() OVER (PARTITION BY aspect_text ORDER BY similarity DESC NULLS LAST, row_id) AS rank_in_group FROM tag_audit) ORDER BY rank_in_group, similarity DESC NULLS LAST, row_id LIMIT 60"),
    "cap_per_source": (cap_per_source, "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3"),
    "cap_per_section_diverse": (cap_per_section_diverse, "SELECT sub_question_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY sub_question_id, source_id ORDER BY similarity DESC NULLS LAST, row_id) AS i FROM tag_audit WHERE source_id IS NOT NULL AND sub_question_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY sub_question_id ORDER BY i, similarity DESC NULLS LAST, row_id) <= 8"),
    "budget_in_order": (budget_in_order, "SELECT event_id, event_type = 'error' AND sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) <= 5 AS judged FROM events"),
    "first_citation_numbering": (first_citation_numbering, "SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY f, l_suppkey) AS number FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) f FROM lineitem GROUP BY ALL)"),
    "round_robin_interleave": (round_robin_interleave, "SELECT sub_question_id, id, turn FROM (SELECT *, row_number() OVER (PARTITION BY sub_question_id ORDER BY r, source) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY sub_question_id, source ORDER BY relevance_score DESC NULLS LAST, id) AS r FROM retrieved_papers WHERE source IS NOT NULL)) WHERE turn <= 12"),
    "mid_rank_percentile": (mid_rank_percentile, "SELECT id, round(CASE WHEN n > 1 THEN (r + (t - 1) / 2.0 - 1) / (n - 1) ELSE 0.5 END, 6) AS percentile FROM (SELECT id, rank() OVER (PARTITION BY sub_question_id ORDER BY citation_count) r, count(*) OVER (PARTITION BY sub_question_id, citation_count) t, count(*) OVER (PARTITION BY sub_question_id) n FROM retrieved_papers WHERE citation_count >= 0)"),
    "tier_sampling": (tier_sampling, "SELECT sub_question_id, tier, count(*) AS n, min(relevance_score) AS lowest, max(relevance_score) AS highest FROM (SELECT *, CAST(ntile(3) OVER (PARTITION BY sub_question_id ORDER BY relevance_score DESC, id) AS INTEGER) AS tier FROM retrieved_papers WHERE relevance_score IS NOT NULL) GROUP BY ALL"),
    "merge_first_filled": (merge_first_filled, f"SELECT title, {_FIRST_FILLED} FROM retrieved_papers WHERE title IS NOT NULL GROUP BY title"),
    "merge_duplicates": (merge_duplicates, "SELECT title, CAST(max(citation_count) AS BIGINT) AS citations, CASE WHEN count(DISTINCT source) > 1 THEN 'both' ELSE max(source) END AS source, bool_and(is_preprint) AS is_preprint, count(*) AS copies, array_to_string(list_sort(list_distinct(flatten(list(query_variant_matched)))), '|') AS queries FROM retrieved_papers WHERE title IS NOT NULL GROUP BY title"),
    "prefer_sources": (prefer_sources, "WITH u AS (SELECT title, min(id) AS ref, 'paper' AS kind, CAST(0 AS BIGINT) AS source_rank FROM retrieved_papers WHERE title IS NOT NULL GROUP BY title UNION ALL SELECT title, min(CAST(reference_id AS VARCHAR)), min(kind), 1 FROM report_references WHERE title IS NOT NULL GROUP BY title) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY title ORDER BY source_rank) = 1"),
    "left_join_default": (left_join_default, "SELECT p.id, coalesce(length(q.full_text) >= 3000, false) AS has_full_text, CASE WHEN coalesce(reliability_score, 0) = 0 THEN 0.3 ELSE reliability_score END AS reliability FROM retrieved_papers p LEFT JOIN parsed_papers q ON p.id = q.retrieved_paper_id"),
    "polymorphic_join": (polymorphic_join, "SELECT reference_id, r.kind, CASE WHEN kind = 'web' THEN domain END AS domain, paper_year FROM report_references r LEFT JOIN (SELECT title, CAST(max(year) AS BIGINT) AS paper_year FROM retrieved_papers WHERE title IS NOT NULL GROUP BY title) y ON r.kind = 'paper' AND r.title = y.title"),
    "semi_kept": (semi_kept, "SELECT id, source, year FROM retrieved_papers WHERE id IN (SELECT source_id FROM tag_audit WHERE judge_final = 'yes')"),
    "anti_new": (anti_new, "SELECT title, min(id) AS id FROM retrieved_papers WHERE title IS NOT NULL AND title NOT IN (SELECT p.title FROM tag_audit a JOIN retrieved_papers p ON a.source_id = p.id WHERE p.title IS NOT NULL) GROUP BY title"),
    "relational_division": (relational_division, "SELECT o_custkey, count(*) AS n_children FROM orders GROUP BY o_custkey HAVING count(*) = sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)"),
    "full_outer_validation": (full_outer_validation, "SELECT coalesce(a.row_id, b.row_id) AS row_id, CASE WHEN b.row_id IS NULL THEN 'missing' ELSE 'unknown' END AS side FROM (SELECT DISTINCT row_id FROM tag_audit) a FULL JOIN (SELECT DISTINCT row_id FROM judge_verdicts) b ON a.row_id = b.row_id WHERE a.row_id IS NULL OR b.row_id IS NULL"),
    "as_of_usage": (as_of_usage, "SELECT e.event_id, p.last_value FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS last_value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts"),
    "stage_intervals": (stage_intervals, "SELECT user_id, a AS started_us, (SELECT min(epoch_us(p.ts)) FROM events p WHERE p.user_id = s.user_id AND p.event_type = 'purchase' AND epoch_us(p.ts) >= a) - a AS took_us FROM (SELECT user_id, epoch_us(ts) AS a FROM events WHERE event_type = 'signup') s"),
    "stage_overlap": (stage_overlap, "WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, min(epoch_us(ts) // 1000000) AS a, max(epoch_us(ts) // 1000000) AS b FROM events GROUP BY ALL) SELECT v.user_id, v.a AS a_started, least(v.b, e.b) - greatest(v.a, e.a) AS overlap FROM s v JOIN s e ON v.user_id = e.user_id AND v.day = e.day AND v.event_type = 'view' AND e.event_type = 'error' WHERE greatest(v.a, e.a) < least(v.b, e.b)"),
    "identity_first_match": (identity_first_match, "WITH k AS (SELECT id, nullif(lower(trim(doi)), '') d, nullif(lower(trim(title)), '') t FROM retrieved_papers), m AS (SELECT id, CASE WHEN d IS NOT NULL THEN min(id) OVER (PARTITION BY d) END AS a, CASE WHEN t IS NOT NULL THEN min(id) OVER (PARTITION BY t) END AS b FROM k) SELECT id, coalesce(CASE WHEN a < id THEN a END, CASE WHEN b < id THEN b END) AS matched FROM m"),
    "claims_by_doc_key": (claims_by_doc_key, "SELECT coalesce(nullif(trim(regexp_replace(regexp_replace(lower(string_split_regex(title, ' \\| | - | – ')[1]), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')), ''), id) AS doc_key, count(*) AS n, min(id) AS first_id FROM retrieved_papers GROUP BY 1"),
    "usage_grouping_sets": (usage_grouping_sets, "SELECT user_id, event_type, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((user_id, event_type), (event_type), ())"),
    "usage_rollup": (usage_rollup, "SELECT y, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, o_orderstatus, o_totalprice FROM orders) GROUP BY ROLLUP (y, o_orderstatus)"),
    "usage_share_of_total": (usage_share_of_total, "SELECT event_type, count(*) AS calls, round(100 * sum(value) / sum(sum(value)) OVER (), 6) AS percent FROM events GROUP BY event_type"),
    "funnel_counts": (funnel_counts, "SELECT sub_question_id, count(*) AS kept, count(judge_relevant) AS judged, CAST(sum(CASE WHEN judge_relevant THEN 1 ELSE 0 END) AS BIGINT) AS relevant, count(pdf_url) AS with_pdf, count(q.id) AS parsed, count(q.full_text) AS full_text FROM retrieved_papers p LEFT JOIN parsed_papers q ON p.id = q.retrieved_paper_id GROUP BY sub_question_id"),
    "outcome_tally": (outcome_tally, "SELECT model, verdict_final, count(*) AS n, count(error) AS errors, round(count(error) / count(*), 6) AS error_share, count(DISTINCT prompt) AS prompts FROM judge_verdicts GROUP BY ALL"),
    "relevant_per_question": (relevant_per_question, "SELECT sub_question_id, r AS relevant, n AS judged, CASE WHEN r = 0 THEN 'none' WHEN r = n THEN 'all' ELSE 'some' END AS kind FROM (SELECT sub_question_id, CAST(sum(CASE WHEN judge_relevant THEN 1 ELSE 0 END) AS BIGINT) r, count(*) n FROM retrieved_papers WHERE judge_relevant IS NOT NULL GROUP BY ALL)"),
    "first_last_times": (first_last_times, "SELECT sub_question_id, source, epoch_us(min(created_at)) AS first_us, epoch_us(max(created_at)) AS last_us, count(*) AS n FROM retrieved_papers GROUP BY ALL"),
    "pivot_by_source": (pivot_by_source, "SELECT evidence_level, " + ", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS {x}" for x in ("en", "de", "fr", "es", "ru", "zh")) + ", count(*) FILTER (WHERE lang IS NULL OR lang NOT IN ('en', 'de', 'fr', 'es', 'ru', 'zh')) AS other FROM documents GROUP BY evidence_level"),
    "union_of_searches": (union_of_searches, "SELECT t, count(*) AS n FROM (SELECT lower(title) AS t FROM retrieved_papers UNION ALL SELECT lower(title) FROM report_references) WHERE t IS NOT NULL GROUP BY t"),
    "ids_in_common": (ids_in_common, "WITH a AS (SELECT DISTINCT source_id AS id FROM tag_audit WHERE source_id IS NOT NULL), b AS (SELECT DISTINCT paper_id AS id FROM documents WHERE paper_id IS NOT NULL) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'documents' WHEN b.id IS NULL THEN 'audit' ELSE 'both' END AS side FROM a FULL JOIN b ON a.id = b.id"),
    "sort_views": (sort_views, "SELECT row_id, row_number() OVER (PARTITION BY sub_question_id ORDER BY CASE judge_final WHEN 'no' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, similarity DESC NULLS LAST, row_id) AS place FROM tag_audit"),
    "reference_lines": (reference_lines, "SELECT reference_id, concat_ws('. ', CASE WHEN len(authors) > 3 THEN authors[1] || ' et al.' WHEN len(authors) > 0 THEN array_to_string(authors, ', ') ELSE 'Unknown' END, title, coalesce(venue, 'n.v.'), coalesce(CAST(year AS VARCHAR), 'n.d.')) AS line FROM report_references WHERE title IS NOT NULL"),
    "jobs_in_sizes": (jobs_in_sizes, "SELECT sub_question_id, job, count(*) AS n, min(row_id) AS first_row FROM (SELECT *, (row_number() OVER (PARTITION BY sub_question_id ORDER BY similarity DESC NULLS LAST, row_id) - 1) // 3 AS job FROM tag_audit) GROUP BY ALL"),
    "revenue_by_nation": (revenue_by_nation, "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"),
    "pricing_summary": (pricing_summary, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"),
    "unshipped_orders": (unshipped_orders, "SELECT c_custkey AS k, 'customer' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) UNION ALL SELECT o_orderkey, 'order' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)"),
}
