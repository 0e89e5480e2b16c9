"""Queries over findings: loading, gates, support, conflicts, near matches, quotes and citations, with their SQL twins.

Answers of models (entailment, judges) are columns of stored tables here; similarity of texts is that of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as X
from siltstone.operators import retrieval
from siltstone.operators.evidence import level_weight
from siltstone.operators.ranking import top_k
from siltstone.sources import table

T = table


def _norm(c: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _full(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) != "", F.lit(False))


def loaded_claims(s: SparkSession, d: str) -> DataFrame:
    """Findings that may be checked: claim and quote there, not marked as ungrounded (unmarked ones pass), each statement
    of a source once, with weight = reliability x weight of what was read, and whether a judge found it supported."""
    a = T(s, d, "tag_audit").where(_full("claim") & _full("quote") & F.col("source_id").isNotNull())
    a = a.where(F.coalesce(F.col("judge_quote_supports_claim") != "no", F.lit(True)))
    g = a.groupBy("source_id", _norm("claim").alias("text")).agg(F.min("row_id").alias("row_id"), F.coalesce(F.bool_or(F.col("judge_quote_supports_claim") == "yes"), F.lit(False)).alias("judged_yes"))
    parsed = T(s, d, "parsed_papers").select(F.col("retrieved_paper_id").alias("source_id"), F.lit("full_text").alias("level")).distinct()
    p = T(s, d, "retrieved_papers").select(F.col("id").alias("source_id"), "reliability_score")
    j = g.join(p, "source_id").join(parsed, "source_id", "left").withColumn("level", F.coalesce("level", F.lit("abstract")))
    return j.select("row_id", "level", F.round(F.col("reliability_score") * level_weight(F.col("level")), 3).alias("weight"), "judged_yes")


def tag_floor(s: SparkSession, d: str) -> DataFrame:
    """Tags at or over 0.40 per aspect, and whether the best one reaches 0.6 (coverage by similarity alone)."""
    a = T(s, d, "tag_audit").where("similarity is not null").groupBy("sub_question_id", "aspect_text")
    return a.agg(F.count_if(F.col("similarity") >= 0.4).alias("tags"), (F.max("similarity") >= 0.6).alias("covered"))


def _support() -> tuple[Column, Column, Column]:
    """Entailment, contradiction and judged confidence of an audit row, as the stored answers give them."""
    entailed = F.coalesce("similarity", F.lit(0.0))
    against = F.when(F.col("judge_quote_supports_claim") == "no", 1 - entailed).otherwise(0.0)
    judged = F.when(F.col("judge_final") == "yes", 0.8).when(F.col("judge_final") == "partial", 0.6).otherwise(0.0)
    return entailed, against, judged


def recheck_set(s: SparkSession, d: str) -> DataFrame:
    """Rows that neither entailment nor contradiction decides (both under 0.5): those a judge is asked about."""
    entailed, against, _ = _support()
    return T(s, d, "tag_audit").where((entailed < 0.5) & (against < 0.5)).groupBy("sub_question_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))


def support_assembly(s: SparkSession, d: str) -> DataFrame:
    """Support of each row with its way and probability: an earlier judge (0.95), entailment, else a judge who is sure at
    0.7 or more; rows without any are left out."""
    entailed, against, judged = _support()
    earlier = (F.col("judge_quote_supports_claim") == "yes") & (F.col("judge_answers_aspect") == "yes")
    way = F.when(earlier, "earlier_judge").when(entailed >= 0.5, "entailment").when((against < 0.5) & (judged >= 0.7), "judge")
    prob = F.when(earlier, 0.95).when(entailed >= 0.5, entailed).otherwise(judged)
    return T(s, d, "tag_audit").select("row_id", way.alias("via"), prob.alias("prob")).where("via is not null")


def strong_claims(s: SparkSession, d: str) -> DataFrame:
    """Claims with a supporting row that was judged or whose source was read in full."""
    a = T(s, d, "tag_audit").where("judge_final in ('yes', 'partial') and claim is not null and source_id is not null")
    full = T(s, d, "parsed_papers").select(F.col("retrieved_paper_id").alias("source_id"), F.lit(True).alias("full")).distinct()
    j = a.join(full, "source_id", "left").select(F.md5(_norm("claim").cast("binary")).alias("k"), (F.coalesce("full", F.lit(False)) | (F.col("judge_final") == "yes")).alias("strong"))
    return j.groupBy("k").agg(F.bool_or("strong").alias("strong"), F.count(F.lit(1)).alias("evidence"))


def _claims(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "tag_audit").where("claim is not null and quote is not null and source_id is not null and sub_question_id is not null")


def conflict_candidates(s: SparkSession, d: str) -> DataFrame:
    """Quotes of other sources about the same thing as a claim (words alike by 0.55 or more, same sub-question), not of
    a source that supports the claim; the 80 most alike of a sub-question go on, of these the 40 that contradict most."""
    a = _claims(s, d)
    text = F.md5(_norm("claim").cast("binary"))
    c = a.where("judge_final = 'yes'").groupBy("sub_question_id", text.alias("claim_key")).agg(F.collect_set("source_id").alias("docs"), F.min("claim").alias("claim"))
    c = c.select(F.concat_ws(":", "sub_question_id", "claim_key").alias("c"), "sub_question_id", "claim_key", "docs", X.words(F.col("claim")).alias("cw"))
    q = a.select(F.col("row_id"), F.col("sub_question_id").alias("q_sub"), F.col("source_id"), text.alias("q_key"), "judge_final", "similarity", X.words(F.col("quote")).alias("qw"))
    near = retrieval.jaccard_pairs(c, "c", "cw", q.withColumnRenamed("q_sub", "sub_question_id"), "row_id", "qw", (11, 20), ("sub_question_id",))
    j = near.hint("merge").join(c.drop("cw").hint("merge"), "c").join(q.drop("qw").hint("merge"), "row_id")
    j = j.where((F.col("sub_question_id") == F.col("q_sub")) & (F.col("claim_key") != F.col("q_key")) & ~F.array_contains("docs", F.col("source_id")))
    first = top_k(j, ["sub_question_id"], [F.desc("jaccard"), F.col("claim_key"), F.col("row_id")], 80)
    against = first.withColumn("contradiction", F.when(F.col("judge_final") == "no", 1 - F.coalesce("similarity", F.lit(0.0))).otherwise(0.0)).where("contradiction >= 0.3")
    return top_k(against, ["sub_question_id"], [F.desc("contradiction"), F.col("claim_key"), F.col("row_id")], 40).select("sub_question_id", "claim_key", "row_id", "jaccard")


def conflict_acceptance(s: SparkSession, d: str) -> DataFrame:
    """Conflicts that both readings of a judge confirm on the same aspect with enough confidence: the last two verdicts of
    a row, both against the quote."""
    v = T(s, d, "judge_verdicts").where("verdict_final is not null").select("row_id", "attempt", "verdict_id", "verdict_final", "quote_supports_claim")
    two = top_k(v, ["row_id"], [F.desc("attempt"), F.desc("verdict_id")], 2)
    g = two.groupBy("row_id").agg(F.count(F.lit(1)).alias("readings"), F.bool_and((F.col("verdict_final") == "no") & F.coalesce(F.col("quote_supports_claim") == "no", F.lit(False))).alias("conflict"))
    return g.where("conflict").select("row_id", "readings")


def near_matches(s: SparkSession, d: str) -> DataFrame:
    """For a claim resting on one source: the most alike claim (0.7 or more) of other sources in its sub-question, best
    other source by weight; in row order the first 120 of a sub-question are within the budget."""
    a = _claims(s, d).select("row_id", "sub_question_id", "source_id", F.md5(_norm("claim").cast("binary")).alias("k"), "similarity", X.content_words(F.col("claim")).alias("w"))
    lone = a.groupBy("sub_question_id", "k").agg(F.count_distinct("source_id").alias("docs"), F.min("row_id").alias("row_id"), F.min("source_id").alias("own"), F.min_by("w", "row_id").alias("aw")).where("docs = 1")
    near = retrieval.jaccard_pairs(lone.select("row_id", "aw"), "row_id", "aw", a.select(F.col("row_id").alias("other"), F.col("w").alias("bw")), "other", "bw", (7, 10))
    j = near.join(lone.select("row_id", "sub_question_id", "k", "own"), "row_id").join(a.select(F.col("row_id").alias("other"), F.col("sub_question_id").alias("o_sub"), F.col("k").alias("o_k"), "source_id", "similarity"), "other")
    j = j.where((F.col("sub_question_id") == F.col("o_sub")) & (F.col("k") != F.col("o_k")) & (F.col("own") != F.col("source_id")))
    best = top_k(j, ["row_id"], [F.desc("jaccard"), F.desc_nulls_last("similarity"), F.col("other")], 1)
    asked = F.row_number().over(Window.partitionBy("sub_question_id").orderBy("row_id")) <= 120
    return best.select("row_id", "other", "jaccard", asked.alias("within_budget"))


def near_attach(s: SparkSession, d: str) -> DataFrame:
    """First yes among the verdicts of a row in order of their attempts; a yes counts only with a reason that names the
    shared point."""
    v = T(s, d, "judge_verdicts").where("verdict_final = 'yes' and length(trim(reason)) > 0")
    return v.groupBy("row_id").agg(F.min_by("verdict_id", F.struct("attempt", "verdict_id")).alias("verdict_id"))


def dispute_join(s: SparkSession, d: str) -> DataFrame:
    """Contradicting rows joined to the claims of the same wording; the disputed side is the supporting row of the same
    quote, else one of the same source, else the first one."""
    a = T(s, d, "tag_audit").where("claim is not null and judge_final is not null").select("row_id", _norm("claim").alias("k"), "quote", "source_id", "judge_final")
    no = a.where("judge_final = 'no'").select(F.col("row_id").alias("against"), "k", F.col("quote").alias("q"), F.col("source_id").alias("src"))
    yes = a.where("judge_final = 'yes'")
    way = F.when(F.col("quote") == F.col("q"), 0).when(F.col("source_id") == F.col("src"), 1).otherwise(2)
    best = top_k(no.join(yes, "k").withColumn("way", way), ["against"], [F.col("way"), F.col("row_id")], 1)
    return best.select("against", F.col("row_id").alias("claim_row"), F.col("way").cast("long").alias("way"))


def sentence_citations(s: SparkSession, d: str) -> DataFrame:
    """A sentence per aspect: its references, numbered by first citation in the sub-question, with at most three distinct
    quotes each; sentences without any quote are dropped."""
    a = T(s, d, "tag_audit").where("quote is not null and source_id is not null and sub_question_id is not null").select("sub_question_id", "aspect_text", "source_id", "row_id", "quote")
    first = a.groupBy("sub_question_id", "source_id").agg(F.min("row_id").alias("at"))
    number = first.select("sub_question_id", "source_id", F.row_number().over(Window.partitionBy("sub_question_id").orderBy("at")).cast("long").alias("ref"))
    quotes = a.groupBy("sub_question_id", "aspect_text", "source_id", "quote").agg(F.min("row_id").alias("row_id"))
    few = top_k(quotes, ["sub_question_id", "aspect_text", "source_id"], [F.col("row_id")], 3)
    g = few.join(number, ["sub_question_id", "source_id"]).groupBy("sub_question_id", "aspect_text", "ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row_id")), lambda x: x.cast("string")), " ").alias("quotes"))
    return g


def citation_precision(s: SparkSession, d: str) -> DataFrame:
    """Per strength: of the cited sources of each aspect the share that supports it, and of its supporting sources the
    share that is cited (tagged)."""
    a = T(s, d, "tag_audit").where("source_id is not null").select("strength", "aspect_text", "source_id", "kind", "judge_final")
    g = a.groupBy("strength", "aspect_text", "source_id").agg(F.bool_or(F.col("kind") == "tagged").alias("cited"), F.coalesce(F.bool_or(F.col("judge_final").isin("yes", "partial")), F.lit(False)).alias("good"))
    n = g.groupBy("strength", "aspect_text").agg(F.count_if("cited").alias("cited"), F.count_if("good").alias("good"), F.count_if(F.col("cited") & F.col("good")).alias("both"))
    return n.groupBy("strength").agg(F.round(F.avg(F.when(F.col("cited") > 0, F.col("both") / F.col("cited"))), 6).alias("precision"), F.round(F.avg(F.when(F.col("good") > 0, F.col("both") / F.col("good"))), 6).alias("recall"), F.count(F.lit(1)).alias("n"))


def quote_pieces(s: SparkSession, d: str) -> DataFrame:
    """Quotes as found in the passages of their source: a quote with elisions holds where every piece of 20 characters or
    more does, each in any passage; without passages or without such a piece it does not."""
    q = T(s, d, "tag_audit").where("quote is not null").select("row_id", "source_id", F.explode_outer(X.elision_pieces(F.col("quote"))).alias("piece"))
    q = q.withColumn("no", F.xxhash64("piece"))
    asked = q.where("piece is not null").select("source_id", F.struct("row_id", "no").alias("id"), "piece")
    c = T(s, d, "chunk_lookup").select("source_id", "chunk_key", X.quote_norm(F.col("text")).alias("t"))
    hit = retrieval.containing(asked, "id", "piece", c, "chunk_key", "t", ["source_id"]).select("id.row_id", "id.no").distinct().withColumn("hit", F.lit(True))
    j = q.join(hit, ["row_id", "no"], "left")
    return j.groupBy("row_id").agg(F.count("piece").alias("pieces"), (F.bool_and(F.coalesce("hit", F.lit(False)))).alias("verified"))


def question_passages(s: SparkSession, d: str) -> DataFrame:
    """Passages of a source for its sub-question: the five that share most words with the topic, and the best prose one
    of each detail question, nine at most, in document order."""
    prose = X.is_prose(F.col("text"))
    c = T(s, d, "chunk_lookup").where("sub_question_id is not null").select("sub_question_id", "source_id", "chunk_id", X.content_words(F.col("text")).alias("w"), prose.alias("prose"))
    q = T(s, d, "sub_questions").select(F.col("id").alias("sub_question_id"), X.content_words(F.col("main_topic")).alias("t"), F.transform("detail_questions", X.content_words).alias("dw"))
    j = c.join(q, "sub_question_id")
    key = ["sub_question_id", "source_id"]
    best = top_k(j.select(*key, "chunk_id", F.size(F.array_intersect("w", "t")).alias("n")), key, [F.desc("n"), F.col("chunk_id")], 5).select(*key, "chunk_id", F.lit(0).alias("via"), (5 - F.col("n")).alias("o"))
    per = j.where("prose").select(*key, "chunk_id", "w", F.posexplode("dw").alias("no", "x")).select(*key, "chunk_id", "no", F.size(F.array_intersect("w", "x")).alias("n")).where("n > 0")
    aimed = top_k(per, [*key, "no"], [F.desc("n"), F.col("chunk_id")], 1).select(*key, "chunk_id", F.lit(1).alias("via"), F.col("no").alias("o"))
    both = best.unionByName(aimed).groupBy(*key, "chunk_id").agg(F.min(F.struct("via", "o")).alias("r"))
    few = top_k(both, key, [F.col("r"), F.col("chunk_id")], 9)
    return few.select(*key, "chunk_id", F.row_number().over(Window.partitionBy(*key).orderBy("chunk_id")).cast("long").alias("place"))


def chunks_with_fallback(s: SparkSession, d: str) -> DataFrame:
    """300-word chunks of a paper: of its sections without references and the like, else of its full text, else of its
    abstract; papers with none of these give none."""
    p = T(s, d, "parsed_papers").select("id", "sections", "full_text", "abstract")
    skip = r"^[0-9. ]*(references|bibliography|acknowledg|appendix|funding|supplementary)"
    kept = F.filter("sections", lambda x: ~F.lower(F.coalesce(x["heading"], F.lit(""))).rlike(skip) & (F.length(F.trim(x["text"])) > 0))
    parts = F.flatten(F.transform(F.coalesce(kept, F.array().cast("array<struct<heading:string,text:string,level:int>>")), lambda x: X.word_chunks(x["text"], 300)))
    some = lambda c: X.word_chunks(F.coalesce(F.col(c), F.lit("")), 300)
    c = p.select("id", parts.alias("a"), some("full_text").alias("b"), some("abstract").alias("c"))
    use = F.when(F.size("a") > 0, "sections").when(F.size("b") > 0, "full_text").when(F.size("c") > 0, "abstract")
    n = F.when(F.size("a") > 0, F.size("a")).when(F.size("b") > 0, F.size("b")).otherwise(F.size("c"))
    return c.select("id", use.alias("level"), n.cast("long").alias("chunks")).where("level is not null")


def _tier() -> Column:
    return F.when(F.col("strength") == "full", 0).when(F.col("strength") == "partial", 1).otherwise(2)


def body_selection(s: SparkSession, d: str) -> DataFrame:
    """Ten sentences of a run: best tier first up to the limit, given back in report order and numbered anew."""
    a = T(s, d, "tag_audit").where("claim is not null").select("query_id", "row_id", _tier().alias("tier"))
    few = top_k(a, ["query_id"], [F.col("tier"), F.col("row_id")], 10)
    return few.select("query_id", "row_id", F.row_number().over(Window.partitionBy("query_id").orderBy("row_id")).cast("long").alias("place"))


def extractive_top(s: SparkSession, d: str) -> DataFrame:
    """Six sentences of a run: the best one of each section first, then the best of the rest, in report order."""
    a = T(s, d, "tag_audit").where("claim is not null").select("query_id", "sub_question_id", "row_id", _tier().alias("tier"))
    inner = F.row_number().over(Window.partitionBy("query_id", "sub_question_id").orderBy("tier", "row_id"))
    few = top_k(a.withColumn("later", (inner > 1).cast("int")), ["query_id"], [F.col("later"), F.col("tier"), F.col("row_id")], 6)
    return few.select("query_id", "row_id", F.row_number().over(Window.partitionBy("query_id").orderBy("row_id")).cast("long").alias("place"))


def sentence_ranks(s: SparkSession, d: str) -> DataFrame:
    """Place of each sentence for its question: tier, whether it names a figure, words shared with the topic."""
    a = T(s, d, "tag_audit").where("claim is not null").select("sub_question_id", "row_id", _tier().alias("tier"), F.col("claim").rlike("[0-9]").alias("figure"), X.content_words(F.col("claim")).alias("w"))
    q = T(s, d, "sub_questions").select(F.col("id").alias("sub_question_id"), X.content_words(F.col("main_topic")).alias("t"))
    j = a.join(q, "sub_question_id").withColumn("shared", F.size(F.array_intersect("w", "t")))
    return j.select("sub_question_id", "row_id", F.row_number().over(Window.partitionBy("sub_question_id").orderBy("tier", F.desc("figure"), F.desc("shared"), "row_id")).cast("long").alias("place"))


def supporting_sentences(s: SparkSession, d: str) -> DataFrame:
    """Two supporting rows of each aspect, no claim used by an aspect before: a claim goes to the first aspect (by its
    first row) of its sub-question that states it, then the two most alike of each aspect are kept."""
    a = T(s, d, "tag_audit").where("claim is not null and sub_question_id is not null and judge_final in ('yes', 'partial')").select("sub_question_id", "aspect_text", "row_id", _norm("claim").alias("k"), "similarity")
    once = top_k(a, ["sub_question_id", "k"], [F.col("row_id")], 1)
    return top_k(once, ["sub_question_id", "aspect_text"], [F.desc_nulls_last("similarity"), F.col("row_id")], 2).select("sub_question_id", "aspect_text", "row_id")


def label_disputes(s: SparkSession, d: str) -> DataFrame:
    """The 14 rows on which most annotators disagree with the audit (a report: a top-n over all rows)."""
    read = F.lower(F.trim("label"))
    word = F.when(read.isin("1", "yes"), "yes").when(read.isin("0.5", "partial"), "partial").when(read.isin("0", "no"), "no")
    v = T(s, d, "tag_audit_labels").select("row_id", "annotator", word.alias("w")).where("w is not null").distinct()
    j = v.join(T(s, d, "tag_audit").where("judge_final is not null").select("row_id", "judge_final"), "row_id").where("w <> judge_final")
    return j.groupBy("row_id").agg(F.count_distinct("annotator").alias("wrong")).orderBy(F.desc("wrong"), "row_id").limit(14)


def finding_classes(s: SparkSession, d: str) -> DataFrame:
    """Findings of each kind as covering (tagged in full), tagged or untagged, with how many the audit accepts."""
    kind = F.when((F.col("kind") == "tagged") & (F.col("strength") == "full"), "covering").when(F.col("kind") == "tagged", "tagged").otherwise("untagged")
    return T(s, d, "tag_audit").groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("judge_final") == "yes").alias("accepted"))


def proportional_sample(s: SparkSession, d: str) -> DataFrame:
    """Sixty audit rows by strata of kind and strength, each its share of all rows (half up), by seeded hash."""
    a = T(s, d, "tag_audit").select("row_id", "kind", "strength", F.md5(F.concat(F.lit("5:"), F.col("row_id").cast("string")).cast("binary")).alias("h"))
    n = a.groupBy("kind", "strength").agg(F.count(F.lit(1)).alias("n"))
    quota = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("kind", F.coalesce("strength", F.lit("")).alias("st"), F.floor(60 * F.col("n") / F.col("all") + 0.5).cast("long").alias("quota"))
    ranked = a.withColumn("st", F.coalesce("strength", F.lit(""))).withColumn("place", F.row_number().over(Window.partitionBy("kind", "st").orderBy("h")))
    return ranked.join(quota, ["kind", "st"]).where(F.col("place") <= F.col("quota")).select("row_id", "kind")


def tier_quotas(s: SparkSession, d: str) -> DataFrame:
    """Twelve papers of each sub-question over thirds of its ranking with quotas 0.42, 0.33, 0.25, by seeded hash; places
    a third cannot fill go to the rest by hash."""
    p = T(s, d, "retrieved_papers").where("relevance_score is not null").select("sub_question_id", "id", "relevance_score", F.md5(F.concat(F.lit("3:"), F.col("id")).cast("binary")).alias("h"))
    third = F.ntile(3).over(Window.partitionBy("sub_question_id").orderBy(F.desc("relevance_score"), "id"))
    r = p.withColumn("third", third)
    r = r.withColumn("n", F.row_number().over(Window.partitionBy("sub_question_id", "third").orderBy("h")))
    quota = F.when(F.col("third") == 1, 5).when(F.col("third") == 2, 4).otherwise(3)
    few = top_k(r.withColumn("late", (F.col("n") > quota).cast("int")), ["sub_question_id"], [F.col("late"), F.col("h"), F.col("id")], 12)
    return few.select("sub_question_id", "id", F.col("third").cast("long").alias("third"))


def mean_auc(s: SparkSession, d: str) -> DataFrame:
    """Mean over sub-questions of the area under the curve, those without both classes skipped."""
    from siltstone.plans.evidence import auc_by_question

    return auc_by_question(s, d).agg(F.round(F.avg("auc"), 5).alias("mean_auc"), F.count("auc").alias("questions"))


def negated_claims(s: SparkSession, d: str) -> DataFrame:
    """Corrupted copies of claims: the first verb negated, the first antonym put in, a hedge in front; what finds nothing
    to change gives no copy."""
    a = T(s, d, "tag_audit").where("claim is not null").select("row_id", "claim")
    negated = F.regexp_replace("claim", r"^(.*?)\b(is|are|was|were|does|do|can) (?!not\b)(.*)$", "$1$2 not $3")
    swaps = (("more", "less"), ("less", "more"), ("higher", "lower"), ("lower", "higher"), ("increase", "decrease"), ("better", "worse"))
    antonym = F.col("claim")
    for a_, b_ in reversed(swaps):
        antonym = F.when(F.col("claim").rlike(rf"\b{a_}\b"), F.regexp_replace("claim", rf"^(.*?)\b{a_}\b(.*)$", f"$1{b_}$2")).otherwise(antonym)
    hedged = F.concat(F.lit("It is possible that "), F.lower(F.substring("claim", 1, 1)), F.substring("claim", F.lit(2), F.length("claim")))
    both = F.array(*[F.struct(F.lit(n).alias("how"), c.alias("copy")) for n, c in (("negation", negated), ("antonym", antonym), ("hedge", hedged))])
    out = a.select("row_id", "claim", F.explode(both).alias("x")).where("x.copy <> claim")
    return out.select("row_id", "x.how", F.md5(F.col("x.copy").cast("binary")).alias("copy"))


def answer_strength(s: SparkSession, d: str) -> DataFrame:
    """Per run: claims by how many sources agree, and those with an objection: the figures of a strength line."""
    a = T(s, d, "tag_audit").where("claim is not null and source_id is not null").select("query_id", _norm("claim").alias("k"), "source_id", "judge_final")
    c = a.groupBy("query_id", "k").agg(F.count_distinct(F.when(F.col("judge_final") == "yes", F.col("source_id"))).alias("yes"), F.coalesce(F.bool_or(F.col("judge_final") == "no"), F.lit(False)).alias("contested"))
    return c.groupBy("query_id").agg(F.count_if(F.col("yes") >= 2).alias("agreed"), F.count_if(F.col("yes") == 1).alias("single"), F.count_if(F.col("yes") == 0).alias("unsupported"), F.count_if("contested").alias("contested"))


def final_checks(s: SparkSession, d: str) -> DataFrame:
    """What does not fit together in the stored tables: rows whose source, sub-question or audit row is unknown, and
    tags in full that the audit rejects."""
    a, p = T(s, d, "tag_audit"), T(s, d, "retrieved_papers").select(F.col("id").alias("source_id"))
    q = T(s, d, "sub_questions").select(F.col("id").alias("sub_question_id"))
    parts = [
        a.where("source_id is not null").join(p, "source_id", "left_anti").select(F.lit("unknown_source").alias("problem"), "row_id"),
        a.where("sub_question_id is not null").join(q, "sub_question_id", "left_anti").select(F.lit("unknown_question").alias("problem"), "row_id"),
        T(s, d, "tag_audit_labels").select("row_id").distinct().join(a.select("row_id"), "row_id", "left_anti").select(F.lit("unknown_row").alias("problem"), "row_id"),
        a.where("strength = 'full' and judge_final = 'no'").select(F.lit("tier_above_evidence").alias("problem"), "row_id"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))


def gap_sentences(s: SparkSession, d: str) -> DataFrame:
    """One sentence per sub-question on its aspects that are missing or weak, none where all are covered."""
    from siltstone.plans.evidence import coverage_by_aspect

    c = coverage_by_aspect(s, d)
    g = c.groupBy("sub_question_id").agg(F.count_if(F.col("state") == "no_candidates").alias("a"), F.count_if(F.col("state").isin("unjudged", "judged_insufficient")).alias("b"))
    part = lambda n, word: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(" "), F.lit(word)))
    text = F.array_join(F.array_compact(F.array(part("a", "without evidence"), part("b", "with too little evidence"))), ", ")
    return g.where("a + b > 0").select("sub_question_id", F.concat(F.lit("Aspects: "), text, F.lit(".")).alias("sentence"))


def answer_view(s: SparkSession, d: str) -> DataFrame:
    """Claims of a run shown in its body and those left for the rest of the page, with the share of each tier (null
    where a run has no claim)."""
    body = body_selection(s, d).select("row_id", F.lit(True).alias("shown"))
    a = T(s, d, "tag_audit").where("claim is not null").select("query_id", "row_id", _tier().alias("tier")).join(body, "row_id", "left")
    g = a.groupBy("query_id").agg(F.count("shown").alias("shown"), F.count_if(F.col("shown").isNull()).alias("others"), *[F.round(F.count_if(F.col("tier") == t) / F.count(F.lit(1)), 6).alias(f"share_{t}") for t in range(3)])
    return g


def overview_counts(s: SparkSession, d: str) -> DataFrame:
    """Counts of each run as rows of name and value, those that are there only."""
    from siltstone.plans.views import run_totals

    t = run_totals(s, d)
    names = ["findings", "quotes", "sources", "n_yes", "n_partial", "n_no"]
    return t.select("query_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("x")).select("query_id", "x.*").where("value > 0")


def stance_groups(s: SparkSession, d: str) -> DataFrame:
    """Verdicts in free wording grouped as support, opposition, mixed or unknown."""
    w = F.lower(F.trim(F.coalesce("verdict_final", F.lit(""))))
    stance = F.when(w.isin("yes", "supports", "supported", "agree"), "support").when(w.isin("no", "contradicts", "disagree", "refutes"), "oppose").when(w.isin("partial", "partially", "mixed"), "mixed").otherwise("unknown")
    return T(s, d, "judge_verdicts").groupBy(stance.alias("stance")).agg(F.count(F.lit(1)).alias("n"))


def sufficiency_notes(s: SparkSession, d: str) -> DataFrame:
    """Sub-questions that have sources enough (weight 3 or more) though not every aspect is covered strictly."""
    from siltstone.plans.evidence import coverage_by_aspect, weighted_distinct_sources

    c = coverage_by_aspect(s, d).groupBy("sub_question_id").agg(F.bool_and(F.col("state").isin("covered", "synthesis")).alias("good"), F.bool_and(F.col("state") == "covered").alias("strict"))
    w = weighted_distinct_sources(s, d)
    j = c.join(w, "sub_question_id", "left").withColumn("enough", F.coalesce("weighted_sources", F.lit(0.0)) >= 3)
    return j.select("sub_question_id", (F.col("good") & F.col("enough")).alias("sufficient"), (F.col("enough") & ~F.col("strict")).alias("note"))


_N = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def _content(c: str) -> str:
    kept = f"list_filter({_words(c)}, lambda w: w NOT IN ({_STOP}))"
    return f"list_sort(list_distinct(list_transform({kept}, lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END)))"


def _jac(a: str, b: str) -> str:
    return f"round(CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect(list_distinct({a}), list_distinct({b}))) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END, 6)"


_ENT = "coalesce(similarity, 0)"
_AGAINST = f"(CASE WHEN judge_quote_supports_claim = 'no' THEN 1 - {_ENT} ELSE 0 END)"
_JUDGED = "(CASE judge_final WHEN 'yes' THEN 0.8 WHEN 'partial' THEN 0.6 ELSE 0 END)"
_EARLIER = "coalesce(judge_quote_supports_claim = 'yes' AND judge_answers_aspect = 'yes', false)"
_TIER = "(CASE strength WHEN 'full' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END)"
_CLAIMS = "tag_audit WHERE claim IS NOT NULL AND quote IS NOT NULL AND source_id IS NOT NULL AND sub_question_id IS NOT NULL"
_BODY = f"(SELECT query_id, row_id FROM tag_audit WHERE claim IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_TIER}, row_id) <= 10)"
_QNORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(lower({0}), '(\\w)-[ ]*\\n[ ]*(\\w)', '\\1\\2', 'g'), chr(173), ''), '[‐‑‒–—−]', '-', 'g'), '\\[[0-9]+(?:[,;–-] ?[0-9]+)*\\]', '', 'g'), '\\s+', ' ', 'g'), ' ([.,;:!?)])', '\\1', 'g'), ' ')"
_SKIP = "'^[0-9. ]*(references|bibliography|acknowledg|appendix|funding|supplementary)'"
_NW = "len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"

QUERIES = {
    "loaded_claims": (loaded_claims, f"WITH g AS (SELECT source_id, {_N.format('claim')} AS t, min(row_id) AS row_id, coalesce(bool_or(judge_quote_supports_claim = 'yes'), false) AS judged_yes FROM tag_audit WHERE trim(claim, ' ') <> '' AND trim(quote, ' ') <> '' AND source_id IS NOT NULL AND coalesce(judge_quote_supports_claim <> 'no', true) GROUP BY ALL), j AS (SELECT g.*, reliability_score, CASE WHEN source_id IN (SELECT retrieved_paper_id FROM parsed_papers) THEN 'full_text' ELSE 'abstract' END AS level FROM g JOIN retrieved_papers p ON g.source_id = p.id) SELECT row_id, level, round(reliability_score * CASE level WHEN 'abstract' THEN 0.5 ELSE 1.0 END, 3) AS weight, judged_yes FROM j"),
    "tag_floor": (tag_floor, "SELECT sub_question_id, aspect_text, count(*) FILTER (WHERE similarity >= 0.4) AS tags, max(similarity) >= 0.6 AS covered FROM tag_audit WHERE similarity IS NOT NULL GROUP BY ALL"),
    "recheck_set": (recheck_set, f"SELECT sub_question_id, count(*) AS n, min(row_id) AS first_row FROM tag_audit WHERE {_ENT} < 0.5 AND {_AGAINST} < 0.5 GROUP BY ALL"),
    "support_assembly": (support_assembly, f"SELECT row_id, via, CAST(prob AS DOUBLE) AS prob FROM (SELECT row_id, CASE WHEN {_EARLIER} THEN 'earlier_judge' WHEN {_ENT} >= 0.5 THEN 'entailment' WHEN {_AGAINST} < 0.5 AND {_JUDGED} >= 0.7 THEN 'judge' END AS via, CASE WHEN {_EARLIER} THEN 0.95 WHEN {_ENT} >= 0.5 THEN {_ENT} ELSE {_JUDGED} END AS prob FROM tag_audit) WHERE via IS NOT NULL"),
    "strong_claims": (strong_claims, f"SELECT md5({_N.format('claim')}) AS k, bool_or(source_id IN (SELECT retrieved_paper_id FROM parsed_papers) OR judge_final = 'yes') AS strong, count(*) AS evidence FROM tag_audit WHERE judge_final IN ('yes', 'partial') AND claim IS NOT NULL AND source_id IS NOT NULL GROUP BY 1"),
    "conflict_candidates": (conflict_candidates, f"WITH a AS (SELECT *, md5({_N.format('claim')}) AS k FROM {_CLAIMS}), c AS (SELECT sub_question_id, k, list(DISTINCT source_id) AS docs, {_words('min(claim)')} AS cw FROM a WHERE judge_final = 'yes' GROUP BY ALL), j AS (SELECT c.sub_question_id, c.k AS claim_key, a.row_id, {_jac('cw', _words('a.quote'))} AS jaccard, CASE WHEN a.judge_final = 'no' THEN 1 - coalesce(a.similarity, 0) ELSE 0 END AS contradiction FROM c JOIN a ON c.sub_question_id = a.sub_question_id AND c.k <> a.k AND NOT list_contains(docs, a.source_id)), f AS (SELECT * FROM j WHERE jaccard >= 0.55 QUALIFY row_number() OVER (PARTITION BY sub_question_id ORDER BY jaccard DESC, claim_key, row_id) <= 80) SELECT sub_question_id, claim_key, row_id, jaccard FROM f WHERE contradiction >= 0.3 QUALIFY row_number() OVER (PARTITION BY sub_question_id ORDER BY contradiction DESC, claim_key, row_id) <= 40"),
    "conflict_acceptance": (conflict_acceptance, "WITH v AS (SELECT * FROM judge_verdicts WHERE verdict_final IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY attempt DESC, verdict_id DESC) <= 2) SELECT row_id, count(*) AS readings FROM v GROUP BY row_id HAVING bool_and(verdict_final = 'no' AND coalesce(quote_supports_claim = 'no', false))"),
    "near_claims": (near_matches, f"WITH a AS (SELECT row_id, sub_question_id, source_id, md5({_N.format('claim')}) AS k, similarity, {_content('claim')} AS w FROM {_CLAIMS}), l AS (SELECT sub_question_id, k, min(row_id) AS row_id, min(source_id) AS own, arg_min(w, row_id) AS w FROM a GROUP BY ALL HAVING count(DISTINCT source_id) = 1), j AS (SELECT l.row_id, l.sub_question_id, a.row_id AS other, {_jac('l.w', 'a.w')} AS jaccard, a.similarity FROM l JOIN a ON l.sub_question_id = a.sub_question_id AND l.k <> a.k AND l.own <> a.source_id), b AS (SELECT * FROM j WHERE jaccard >= 0.7 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY jaccard DESC, similarity DESC NULLS LAST, other) = 1) SELECT row_id, other, jaccard, row_number() OVER (PARTITION BY sub_question_id ORDER BY row_id) <= 120 AS within_budget FROM b"),
    "near_attach": (near_attach, "SELECT row_id, arg_min(verdict_id, attempt * 1000000000000 + verdict_id) AS verdict_id FROM judge_verdicts WHERE verdict_final = 'yes' AND length(trim(reason, ' ')) > 0 GROUP BY row_id"),
    "dispute_join": (dispute_join, f"WITH a AS (SELECT row_id, {_N.format('claim')} AS k, quote, source_id, judge_final FROM tag_audit WHERE claim IS NOT NULL AND judge_final IS NOT NULL) SELECT n.row_id AS against, y.row_id AS claim_row, CAST(CASE WHEN y.quote = n.quote THEN 0 WHEN y.source_id = n.source_id THEN 1 ELSE 2 END AS BIGINT) AS way FROM a n JOIN a y ON n.k = y.k AND n.judge_final = 'no' AND y.judge_final = 'yes' QUALIFY row_number() OVER (PARTITION BY n.row_id ORDER BY 3, y.row_id) = 1"),
    "sentence_citations": (sentence_citations, "WITH a AS (SELECT * FROM tag_audit WHERE quote IS NOT NULL AND source_id IS NOT NULL AND sub_question_id IS NOT NULL), n AS (SELECT sub_question_id, source_id, row_number() OVER (PARTITION BY sub_question_id ORDER BY f) AS ref FROM (SELECT sub_question_id, source_id, min(row_id) AS f FROM a GROUP BY ALL)), g AS (SELECT sub_question_id, aspect_text, source_id, quote, min(row_id) AS row_id FROM a GROUP BY ALL), q AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY sub_question_id, aspect_text, source_id ORDER BY row_id) <= 3) SELECT sub_question_id, aspect_text, ref, string_agg(CAST(row_id AS VARCHAR), ' ' ORDER BY row_id) AS quotes FROM q JOIN n USING (sub_question_id, source_id) GROUP BY ALL"),
    "citation_precision": (citation_precision, "WITH g AS (SELECT strength, aspect_text, source_id, bool_or(kind = 'tagged') AS c, coalesce(bool_or(judge_final IN ('yes', 'partial')), false) AS g FROM tag_audit WHERE source_id IS NOT NULL GROUP BY ALL), n AS (SELECT strength, aspect_text, count(*) FILTER (WHERE c) AS nc, count(*) FILTER (WHERE g) AS ng, count(*) FILTER (WHERE c AND g) AS nb FROM g GROUP BY ALL) SELECT strength, round(avg(CASE WHEN nc > 0 THEN nb / nc END), 6) AS precision, round(avg(CASE WHEN ng > 0 THEN nb / ng END), 6) AS recall, count(*) AS n FROM n GROUP BY strength"),
    "quote_pieces": (quote_pieces, f"WITH q AS (SELECT row_id, source_id, list_filter(list_transform(string_split_regex(quote, '\\[(?:\\.\\.\\.|…)\\]|\\.\\.\\.|…'), lambda x: {_QNORM.format('x')}), lambda x: length(x) >= 20) AS p FROM tag_audit WHERE quote IS NOT NULL), c AS (SELECT source_id, list({_QNORM.format('text')}) AS t FROM chunk_lookup WHERE text IS NOT NULL GROUP BY source_id) SELECT row_id, CAST(len(p) AS BIGINT) AS pieces, len(p) > 0 AND len(list_filter(p, lambda x: len(list_filter(coalesce(t, []), lambda y: contains(y, x))) > 0)) = len(p) AS verified FROM q LEFT JOIN c USING (source_id)"),
    "question_passages": (question_passages, f"WITH j AS (SELECT c.sub_question_id, source_id, chunk_id, {_content('text')} AS w, length(text) > 0 AND length(regexp_replace(text, '[^\\pL]', '', 'g')) >= 0.6 * length(text) AND length(text) - length(replace(text, '|', '')) <= 5 AS prose, {_content('main_topic')} AS t, detail_questions AS dq FROM chunk_lookup c JOIN sub_questions q ON c.sub_question_id = q.id), b AS (SELECT sub_question_id, source_id, chunk_id, 0 AS via, 5 - len(list_intersect(w, t)) AS o FROM j QUALIFY row_number() OVER (PARTITION BY sub_question_id, source_id ORDER BY len(list_intersect(w, t)) DESC, chunk_id) <= 5), x AS (SELECT sub_question_id, source_id, chunk_id, w, unnest(dq) AS dq, generate_subscripts(dq, 1) - 1 AS no FROM j WHERE prose), n AS (SELECT sub_question_id, source_id, chunk_id, no, len(list_intersect(w, {_content('dq')})) AS n FROM x), m AS (SELECT sub_question_id, source_id, chunk_id, 1 AS via, no AS o FROM n WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY sub_question_id, source_id, no ORDER BY n DESC, chunk_id) = 1), u AS (SELECT sub_question_id, source_id, chunk_id, min(via * 1000000 + o + 1000) AS r FROM (SELECT * FROM b UNION ALL SELECT * FROM m) GROUP BY ALL), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY sub_question_id, source_id ORDER BY r, chunk_id) <= 9) SELECT sub_question_id, source_id, chunk_id, row_number() OVER (PARTITION BY sub_question_id, source_id ORDER BY chunk_id) AS place FROM f"),
    "chunks_with_fallback": (chunks_with_fallback, f"WITH s AS (SELECT id, sum((n + 299) // 300) AS k FROM (SELECT id, {_NW.format('x.text')} AS n FROM (SELECT id, unnest(sections) AS x FROM parsed_papers) WHERE NOT regexp_matches(lower(coalesce(x.heading, '')), {_SKIP}) AND length(trim(x.text, ' ')) > 0) GROUP BY id), p AS (SELECT id, coalesce(k, 0) AS a, ({_NW.format('coalesce(full_text, chr(32))')} + 299) // 300 AS b, ({_NW.format('coalesce(abstract, chr(32))')} + 299) // 300 AS c FROM parsed_papers LEFT JOIN s USING (id)) SELECT id, CASE WHEN a > 0 THEN 'sections' WHEN b > 0 THEN 'full_text' ELSE 'abstract' END AS level, CAST(CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE c END AS BIGINT) AS chunks FROM p WHERE a + b + c > 0"),
    "body_selection": (body_selection, f"SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY row_id) AS place FROM {_BODY}"),
    "extractive_top": (extractive_top, f"WITH r AS (SELECT query_id, row_id, {_TIER} AS tier, row_number() OVER (PARTITION BY query_id, sub_question_id ORDER BY {_TIER}, row_id) > 1 AS later FROM tag_audit WHERE claim IS NOT NULL), f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY later, tier, row_id) <= 6) SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY row_id) AS place FROM f"),
    "sentence_ranks": (sentence_ranks, f"SELECT sub_question_id, row_id, row_number() OVER (PARTITION BY sub_question_id ORDER BY {_TIER}, regexp_matches(claim, '[0-9]') DESC, len(list_intersect({_content('claim')}, {_content('q.main_topic')})) DESC, row_id) AS place FROM tag_audit a JOIN sub_questions q ON a.sub_question_id = q.id WHERE claim IS NOT NULL"),
    "supporting_sentences": (supporting_sentences, f"WITH o AS (SELECT sub_question_id, aspect_text, row_id, similarity FROM tag_audit WHERE claim IS NOT NULL AND sub_question_id IS NOT NULL AND judge_final IN ('yes', 'partial') QUALIFY row_number() OVER (PARTITION BY sub_question_id, {_N.format('claim')} ORDER BY row_id) = 1) SELECT sub_question_id, aspect_text, row_id FROM o QUALIFY row_number() OVER (PARTITION BY sub_question_id, aspect_text ORDER BY similarity DESC NULLS LAST, row_id) <= 2"),
    "label_disputes": (label_disputes, "WITH v AS (SELECT DISTINCT row_id, annotator, CASE WHEN l IN ('1', 'yes') THEN 'yes' WHEN l IN ('0.5', 'partial') THEN 'partial' WHEN l IN ('0', 'no') THEN 'no' END AS w FROM (SELECT row_id, annotator, lower(trim(label, ' ')) AS l FROM tag_audit_labels)) SELECT row_id, count(DISTINCT annotator) AS wrong FROM v JOIN tag_audit USING (row_id) WHERE w IS NOT NULL AND judge_final IS NOT NULL AND w <> judge_final GROUP BY row_id ORDER BY wrong DESC, row_id LIMIT 14"),
    "finding_classes": (finding_classes, "SELECT CASE WHEN kind = 'tagged' AND strength = 'full' THEN 'covering' WHEN kind = 'tagged' THEN 'tagged' ELSE 'untagged' END AS class, count(*) AS n, count(*) FILTER (WHERE judge_final = 'yes') AS accepted FROM tag_audit GROUP BY 1"),
    "proportional_sample": (proportional_sample, "WITH a AS (SELECT row_id, kind, coalesce(strength, '') AS st, md5('5:' || row_id) AS h FROM tag_audit), q AS (SELECT kind, st, CAST(floor(60 * count(*) / (SELECT count(*) FROM a) + 0.5) AS BIGINT) AS quota FROM a GROUP BY ALL) SELECT row_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind, st ORDER BY h) AS place FROM a) JOIN q USING (kind, st) WHERE place <= quota"),
    "tier_quotas": (tier_quotas, "WITH p AS (SELECT sub_question_id, id, ntile(3) OVER (PARTITION BY sub_question_id ORDER BY relevance_score DESC, id) AS third, md5('3:' || id) AS h FROM retrieved_papers WHERE relevance_score IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY sub_question_id, third ORDER BY h) > CASE third WHEN 1 THEN 5 WHEN 2 THEN 4 ELSE 3 END AS late FROM p) SELECT sub_question_id, id, third FROM r QUALIFY row_number() OVER (PARTITION BY sub_question_id ORDER BY late, h, id) <= 12"),
    "negated_claims": (negated_claims, "WITH a AS (SELECT row_id, claim, regexp_extract(claim, '^(.*?)\\b(is|are|was|were|does|do|can) (.*)$', ['a', 'b', 'c']) AS m FROM tag_audit WHERE claim IS NOT NULL) SELECT row_id, how, md5(copy) AS copy FROM (SELECT row_id, claim, 'hedge' AS how, 'It is possible that ' || lower(substring(claim, 1, 1)) || substring(claim, 2) AS copy FROM a UNION ALL SELECT row_id, claim, 'antonym', CASE WHEN regexp_matches(claim, '\\bmore\\b') THEN regexp_replace(claim, '\\bmore\\b', 'less') WHEN regexp_matches(claim, '\\bless\\b') THEN regexp_replace(claim, '\\bless\\b', 'more') WHEN regexp_matches(claim, '\\bhigher\\b') THEN regexp_replace(claim, '\\bhigher\\b', 'lower') WHEN regexp_matches(claim, '\\blower\\b') THEN regexp_replace(claim, '\\blower\\b', 'higher') WHEN regexp_matches(claim, '\\bincrease\\b') THEN regexp_replace(claim, '\\bincrease\\b', 'decrease') WHEN regexp_matches(claim, '\\bbetter\\b') THEN regexp_replace(claim, '\\bbetter\\b', 'worse') ELSE claim END FROM a UNION ALL SELECT row_id, claim, 'negation', CASE WHEN m.b = '' THEN claim WHEN regexp_matches(claim, '\\b(is|are|was|were|does|do|can) not\\b') THEN NULL ELSE m.a || m.b || ' not ' || m.c END FROM a) WHERE copy <> claim"),
    "answer_strength": (answer_strength, f"WITH c AS (SELECT query_id, {_N.format('claim')} AS k, count(DISTINCT CASE WHEN judge_final = 'yes' THEN source_id END) AS y, coalesce(bool_or(judge_final = 'no'), false) AS x FROM tag_audit WHERE claim IS NOT NULL AND source_id IS NOT NULL GROUP BY ALL) SELECT query_id, count(*) FILTER (WHERE y >= 2) AS agreed, count(*) FILTER (WHERE y = 1) AS single, count(*) FILTER (WHERE y = 0) AS unsupported, count(*) FILTER (WHERE x) AS contested FROM c GROUP BY query_id"),
    "final_checks": (final_checks, "SELECT problem, count(*) AS n, min(row_id) AS first_row FROM (SELECT 'unknown_source' AS problem, row_id FROM tag_audit WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT id FROM retrieved_papers) UNION ALL SELECT 'unknown_question', row_id FROM tag_audit WHERE sub_question_id IS NOT NULL AND sub_question_id NOT IN (SELECT id FROM sub_questions) UNION ALL SELECT DISTINCT 'unknown_row', row_id FROM tag_audit_labels WHERE row_id NOT IN (SELECT row_id FROM tag_audit) UNION ALL SELECT 'tier_above_evidence', row_id FROM tag_audit WHERE strength = 'full' AND judge_final = 'no') GROUP BY problem"),
    "stance_groups": (stance_groups, "SELECT CASE WHEN w IN ('yes', 'supports', 'supported', 'agree') THEN 'support' WHEN w IN ('no', 'contradicts', 'disagree', 'refutes') THEN 'oppose' WHEN w IN ('partial', 'partially', 'mixed') THEN 'mixed' ELSE 'unknown' END AS stance, count(*) AS n FROM (SELECT lower(trim(coalesce(verdict_final, ''), ' ')) AS w FROM judge_verdicts) GROUP BY 1"),
    "answer_view": (answer_view, f"SELECT query_id, count(*) FILTER (WHERE row_id IN (SELECT row_id FROM {_BODY})) AS shown, count(*) FILTER (WHERE row_id NOT IN (SELECT row_id FROM {_BODY})) AS others, round(count(*) FILTER (WHERE {_TIER} = 0) / count(*), 6) AS share_0, round(count(*) FILTER (WHERE {_TIER} = 1) / count(*), 6) AS share_1, round(count(*) FILTER (WHERE {_TIER} = 2) / count(*), 6) AS share_2 FROM tag_audit WHERE claim IS NOT NULL GROUP BY query_id"),
    "overview_counts": (overview_counts, "SELECT query_id, name, value FROM (UNPIVOT (SELECT query_id, count(*) AS findings, count(quote) AS quotes, count(DISTINCT source_id) AS sources, count(*) FILTER (WHERE judge_final = 'yes') AS n_yes, count(*) FILTER (WHERE judge_final = 'partial') AS n_partial, count(*) FILTER (WHERE judge_final = 'no') AS n_no FROM tag_audit GROUP BY query_id) ON findings, quotes, sources, n_yes, n_partial, n_no INTO NAME name VALUE value) WHERE value > 0"),
}


def _later() -> dict:
    """Twins that are built over those of other modules."""
    from siltstone.plans import evidence as E

    auc, aspects, sources = E.QUERIES["auc_by_question"][1], E.QUERIES["coverage_by_aspect"][1], E.QUERIES["weighted_distinct_sources"][1]
    return {
        "mean_auc": (mean_auc, f"SELECT round(avg(auc), 5) AS mean_auc, count(auc) AS questions FROM ({auc})"),
        "gap_sentences": (gap_sentences, f"SELECT sub_question_id, 'Aspects: ' || concat_ws(', ', CASE WHEN a > 0 THEN a || ' without evidence' END, CASE WHEN b > 0 THEN b || ' with too little evidence' END) || '.' AS sentence FROM (SELECT sub_question_id, count(*) FILTER (WHERE state = 'no_candidates') AS a, count(*) FILTER (WHERE state IN ('unjudged', 'judged_insufficient')) AS b FROM ({aspects}) GROUP BY ALL) WHERE a + b > 0"),
        "sufficiency_notes": (sufficiency_notes, f"SELECT sub_question_id, g AND coalesce(weighted_sources, 0) >= 3 AS sufficient, coalesce(weighted_sources, 0) >= 3 AND NOT st AS note FROM (SELECT sub_question_id, bool_and(state IN ('covered', 'synthesis')) AS g, bool_and(state = 'covered') AS st FROM ({aspects}) GROUP BY ALL) LEFT JOIN ({sources}) USING (sub_question_id)"),
    }


QUERIES |= _later()
