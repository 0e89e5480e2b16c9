"""Queries over scalar functions, documents, retrieval and vectors, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions.keys import arxiv_key, doi_key
from siltstone.operators import retrieval, vectors
from siltstone.operators.ranking import top_k
from siltstone.sources import table

T = table


def identity_keys(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").select("id", "doi", "arxiv_id")
    return p.select("id", doi_key(F.col("doi")).alias("doi_k"), arxiv_key(F.col("arxiv_id")).alias("arxiv_k"))


def paper_key(s: SparkSession, d: str) -> DataFrame:
    """One key per paper: arXiv number, else lower-case DOI, else the title's letters and digits."""
    title = F.trim(F.regexp_replace(F.lower("title"), r"[^a-z0-9]+", " "))
    p = T(s, d, "retrieved_papers").select("id", "title", "doi", "arxiv_id")
    arxiv = F.nullif(F.regexp_extract("arxiv_id", r"([0-9]{4}\.[0-9]{5})", 1), F.lit(""))
    key = F.coalesce(arxiv, F.nullif(F.lower(F.trim("doi")), F.lit("")), F.concat(F.lit("title:"), title))
    return p.select("id", key.alias("paper_key"))


def claim_ids(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "tag_audit").select("row_id", "sub_question_id", "claim").where("claim is not null and sub_question_id is not null")
    return a.select("row_id", X.short_hash("c_", F.concat_ws("|", "sub_question_id", "claim")).alias("claim_id"))


def verdict_keys(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "tag_audit").where("claim is not null").select("row_id", F.substring(F.sha2("claim", 256), 1, 16).alias("claim_key"))
    return a


def content_word_sets(s: SparkSession, d: str) -> DataFrame:
    q = T(s, d, "sub_questions").select("id", F.array_join(X.content_words(F.col("main_topic")), " ").alias("content"))
    return q


def topics_distinct(s: SparkSession, d: str) -> DataFrame:
    """Topics with the same content words, with the first of them and their number of detail questions."""
    q = T(s, d, "sub_questions").select("id", F.array_join(X.content_words(F.col("main_topic")), " ").alias("content"), F.size("detail_questions").alias("n"))
    return q.groupBy("content").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("topics"), F.sum("n").alias("details"))


def or_queries(s: SparkSession, d: str) -> DataFrame:
    q = T(s, d, "sub_questions").select("id", F.explode("detail_questions").alias("question"))
    return q.select("id", X.or_query(F.col("question")).alias("query")).distinct()


def domains(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").select(X.domain_of(F.col("pdf_url")).alias("domain"))
    return p.where("domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def years(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "retrieved_papers").select(X.year_of(F.col("published_date")).cast("long").alias("y"))
    return p.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


def word_counts(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "documents").select("doc_id", X.word_count(F.col("text")).cast("long").alias("n_words"), F.length("text").cast("long").alias("n_chars"))


def prose_filter(s: SparkSession, d: str) -> DataFrame:
    c = T(s, d, "chunk_lookup").select("chunk_key", "text")
    return c.where(X.is_prose(F.col("text")) & (X.word_count(F.col("text")) >= 30)).select("chunk_key")


def chunk_300_words(s: SparkSession, d: str) -> DataFrame:
    c = T(s, d, "documents").where("text is not null").select("doc_id", F.explode(X.word_chunks(F.col("text"), 300)).alias("c"))
    return c.select("doc_id", F.col("c.chunk_id").cast("long").alias("chunk_id"), F.md5(F.col("c.text").cast("binary")).alias("md5"))


def char_windows(s: SparkSession, d: str) -> DataFrame:
    c = T(s, d, "chunk_lookup").select("chunk_key", F.explode(X.char_windows(F.col("text"), 700, 350)).alias("w"))
    return c.select("chunk_key", F.col("w.start").cast("long").alias("start"), F.length("w.text").cast("long").alias("n"), F.md5(F.col("w.text").cast("binary")).alias("md5"))


def section_chunks(s: SparkSession, d: str) -> DataFrame:
    """Sections in reading order without references and the like, with the size of their text."""
    p = T(s, d, "parsed_papers").select("id", F.posexplode("sections").alias("no", "x"))
    heading = F.lower(F.coalesce("x.heading", F.lit("")))
    skip = heading.rlike("^[0-9. ]*(references|bibliography|acknowledg|appendix|funding|supplementary)")
    return p.where(~skip & (F.length(F.trim("x.text")) > 0)).select("id", F.col("no").cast("long").alias("no"), F.col("x.heading").alias("heading"), F.length("x.text").cast("long").alias("n"))


def repeated_headings(s: SparkSession, d: str) -> DataFrame:
    """Headings that stand more than once in a paper: running headers."""
    p = T(s, d, "parsed_papers").select("id", F.explode("sections").alias("x")).where("length(trim(x.heading)) > 0")
    return p.groupBy("id", F.lower(F.trim("x.heading")).alias("heading")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeated_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines that stand twice or more in one document."""
    line = T(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("length(line) >= 20")
    return line.groupBy("doc_id", F.md5(F.col("line").cast("binary")).alias("line")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reference_items(s: SparkSession, d: str) -> DataFrame:
    """Cited references by year."""
    p = T(s, d, "parsed_papers").select("id", F.explode("cited_references").alias("r"))
    return p.groupBy(X.year_of(F.col("r")).cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("papers"))


def figures_per_paper(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "parsed_papers").select("id", F.explode("figures").alias("f"))
    return p.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("f.page").cast("long").alias("last_page"), F.min("f.label").alias("first_label"))


def exact_dup_groups(s: SparkSession, d: str) -> DataFrame:
    """Groups of documents with the same text: first id and size."""
    t = T(s, d, "documents").where("length(text) > 0").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return t.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1").select("first_doc", "n")


def grouped_messages(s: SparkSession, d: str) -> DataFrame:
    """Judge reasons grouped by their masked form."""
    v = T(s, d, "judge_verdicts").where("reason is not null").select(X.mask(F.col("reason")).alias("m"))
    return v.groupBy(F.md5(F.col("m").cast("binary")).alias("m")).agg(F.count(F.lit(1)).alias("n"))


def json_payload(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.max("k").alias("max_k"), F.count("k").alias("n"))


def verdict_json(s: SparkSession, d: str) -> DataFrame:
    """Verdict fields out of well-formed answers, with the final verdict derived from both parts."""
    v = T(s, d, "judge_verdicts").select("verdict_id", F.trim("raw_output").alias("raw")).where("raw like '{%}'")
    j = v.select("verdict_id", F.from_json("raw", "quote_supports_claim string, answers_aspect string, reason string").alias("j")).select("verdict_id", "j.*")
    both = (F.col("quote_supports_claim") == "yes") & (F.col("answers_aspect") == "yes")
    none = (F.col("quote_supports_claim") == "no") | (F.col("answers_aspect") == "no")
    known = F.col("quote_supports_claim").isin("yes", "no", "partial") & F.col("answers_aspect").isin("yes", "no", "partial")
    return j.where(known).select("verdict_id", F.when(none, "no").when(both, "yes").otherwise("partial").alias("final"))


def quote_checks(s: SparkSession, d: str) -> DataFrame:
    """Audit rows whose quote stands in a passage of their source."""
    q = T(s, d, "tag_audit").select("row_id", "source_id", X.quote_norm(F.col("quote")).alias("quote")).where("length(quote) >= 20")
    c = T(s, d, "chunk_lookup").select("source_id", "chunk_key", X.quote_norm(F.col("text")).alias("text"))
    return retrieval.containing(q, "row_id", "quote", c, "chunk_key", "text", ["source_id"]).select("row_id", "chunk_key")


def bm25_passages(s: SparkSession, d: str) -> DataFrame:
    """BM25 of every sub-question's topic over all passages, best 5 each."""
    c = T(s, d, "chunk_lookup").select("chunk_key", "text")
    q = T(s, d, "sub_questions").select("id", "main_topic")
    scores = retrieval.bm25(c, "chunk_key", "text", q, "id", "main_topic")
    return top_k(scores, ["id"], [F.desc("score"), F.col("chunk_key")], 5)


def word_weights(s: SparkSession, d: str) -> DataFrame:
    """Weight 1 - df / N of every word of the topics."""
    q = T(s, d, "sub_questions").select("id", F.explode(F.array_distinct(X.words(F.col("main_topic")))).alias("w"))
    n = T(s, d, "sub_questions").agg(F.count(F.lit(1)).alias("n"))
    return q.groupBy("w").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("w", "df", F.round(1 - F.col("df") / F.col("n"), 6).alias("weight"))


def section_relevance(s: SparkSession, d: str) -> DataFrame:
    """Section headings against their paper's title: shared words over the title's words, plus a bonus per shared word."""
    p = T(s, d, "parsed_papers").select("id", X.content_words(F.col("title")).alias("t"), F.posexplode("sections").alias("no", "x"))
    shared = F.size(F.array_intersect("t", X.content_words(F.coalesce(F.col("x.text"), F.lit("")))))
    return p.select("id", F.col("no").cast("long").alias("no"), F.round(F.when(F.size("t") > 0, shared / F.size("t")).otherwise(0.0) + 0.15 * shared, 6).alias("relevance"))


def title_jaccard(s: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of a reference's title words and those of the parsed papers, all pairs of 0.6 or more."""
    r = T(s, d, "report_references").where("title is not null").select("reference_id", X.words(F.col("title")).alias("a"))
    p = T(s, d, "parsed_papers").where("title is not null").select("id", X.words(F.col("title")).alias("b"))
    return retrieval.jaccard_pairs(r, "reference_id", "a", p, "id", "b", (3, 5))


def cosine_top_k(s: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 100, over all vectors."""
    e = T(s, d, "embeddings").select("vec_id", "embedding")
    return vectors.cosine_top_k(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10).select("query", "neighbour", "similarity", "place")


def cosine_floor_then_k(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "embeddings").select("vec_id", "embedding")
    return vectors.cosine_top_k(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 20, 0.25).select("query", "neighbour", "similarity")


def argmax_assignment(s: SparkSession, d: str) -> DataFrame:
    """Nearest label centroid of every vector, and near ties within 0.05."""
    e = T(s, d, "embeddings").select("vec_id", "embedding", "label")
    return vectors.assign_with_margin(e, "vec_id", "embedding", vectors.centroids(e, "label", "embedding"), "label", 0.05).select("vec_id", F.col("assigned").cast("long").alias("assigned"), "near_tie")


def greedy_clusters(s: SparkSession, d: str) -> DataFrame:
    """Greedy clusters at cosine 0.30 within each label (sequential by definition, no SQL twin)."""
    e = T(s, d, "embeddings").select("label", "vec_id", "embedding")
    return vectors.greedy_clusters(e, ["label"], "vec_id", "embedding", 0.30)


_W = "[w for w in regexp_extract_all(lower({0}), '[a-z0-9]+')]"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def _content(c: str) -> str:
    kept = f"list_filter({_words(c)}, lambda w: w NOT IN ({_STOP}))"
    return f"list_sort(list_distinct(list_transform({kept}, lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END)))"


_PARTS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"
_NORM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(lower({0}), '(\\w)-[ ]*\\n[ ]*(\\w)', '\\1\\2', 'g'), chr(173), ''), '[‐‑‒–—−]', '-', 'g'), '\\[[0-9]+(?:[,;–-] ?[0-9]+)*\\]', '', 'g'), '\\s+', ' ', 'g'), ' ([.,;:!?)])', '\\1', 'g')"

QUERIES = {
    "identity_keys": (identity_keys, None),
    "paper_key": (paper_key, "SELECT id, coalesce(nullif(regexp_extract(arxiv_id, '([0-9]{4}\\.[0-9]{5})', 1), ''), nullif(lower(trim(doi)), ''), 'title:' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))) AS paper_key FROM retrieved_papers"),
    "claim_ids": (claim_ids, "SELECT row_id, 'c_' || left(sha1(trim(regexp_replace(lower(concat_ws('|', sub_question_id, claim)), '\\s+', ' ', 'g'))), 10) AS claim_id FROM tag_audit WHERE claim IS NOT NULL AND sub_question_id IS NOT NULL"),
    "verdict_keys": (verdict_keys, "SELECT row_id, left(sha256(claim), 16) AS claim_key FROM tag_audit WHERE claim IS NOT NULL"),
    "content_word_sets": (content_word_sets, f"SELECT id, array_to_string({_content('main_topic')}, ' ') AS content FROM sub_questions"),
    "topics_distinct": (topics_distinct, f"SELECT content, min(id) AS first_id, count(*) AS topics, CAST(sum(n) AS BIGINT) AS details FROM (SELECT id, array_to_string({_content('main_topic')}, ' ') AS content, len(detail_questions) AS n FROM sub_questions) GROUP BY content"),
    "or_queries": (or_queries, f"SELECT DISTINCT id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' OR ') AS query FROM (SELECT id, list_filter({_words('q')}, lambda w: w NOT IN ({_STOP})) AS w FROM (SELECT id, unnest(detail_questions) AS q FROM sub_questions))"),
    "domains": (domains, "SELECT domain, count(*) AS n FROM (SELECT nullif(regexp_replace(lower(regexp_extract(pdf_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '^www\\.', ''), '') AS domain FROM retrieved_papers) WHERE domain IS NOT NULL GROUP BY domain"),
    "years": (years, "SELECT CAST(nullif(regexp_extract(published_date, '(?:^|[^0-9])((?:18|19|20)[0-9]{2})(?:[^0-9]|$)', 1), '') AS BIGINT) AS y, count(*) AS n FROM retrieved_papers GROUP BY 1"),
    "word_counts": (word_counts, f"SELECT doc_id, len({_PARTS}) AS n_words, length(text) AS n_chars FROM documents"),
    "prose_filter": (prose_filter, f"SELECT chunk_key FROM chunk_lookup WHERE length(text) > 0 AND length(regexp_replace(text, '[^\\pL]', '', 'g')) >= 0.6 * length(text) AND length(text) - length(replace(text, '|', '')) <= 5 AND len({_PARTS}) >= 30"),
    "chunk_300_words": (chunk_300_words, f"WITH w AS (SELECT doc_id, {_PARTS} AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, i AS chunk_id, md5(array_to_string(p[i * 300 + 1 : i * 300 + 300], ' ')) AS md5 FROM (SELECT doc_id, p, unnest(range((len(p) + 299) // 300)) AS i FROM w WHERE len(p) > 0)"),
    "char_windows": (char_windows, "SELECT chunk_key, i * 350 AS start, length(substring(text, i * 350 + 1, 700)) AS n, md5(substring(text, i * 350 + 1, 700)) AS md5 FROM (SELECT chunk_key, text, unnest(range(1 + greatest(0, CAST(ceil((length(text) - 700) / 350) AS BIGINT)))) AS i FROM chunk_lookup WHERE length(text) > 0)"),
    "section_chunks": (section_chunks, "SELECT id, no - 1 AS no, x.heading AS heading, length(x.text) AS n FROM (SELECT id, unnest(sections) AS x, generate_subscripts(sections, 1) AS no FROM parsed_papers) WHERE NOT regexp_matches(lower(coalesce(x.heading, '')), '^[0-9. ]*(references|bibliography|acknowledg|appendix|funding|supplementary)') AND length(trim(x.text, ' ')) > 0"),
    "repeated_headings": (repeated_headings, "SELECT id, lower(trim(x.heading, ' ')) AS heading, count(*) AS n FROM (SELECT id, unnest(sections) AS x FROM parsed_papers) WHERE length(trim(x.heading, ' ')) > 0 GROUP BY ALL HAVING count(*) > 1"),
    "repeated_lines": (repeated_lines, "SELECT doc_id, md5(line) AS line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 20 GROUP BY ALL HAVING count(*) > 1"),
    "reference_items": (reference_items, "SELECT CAST(nullif(regexp_extract(r, '(?:^|[^0-9])((?:18|19|20)[0-9]{2})(?:[^0-9]|$)', 1), '') AS BIGINT) AS y, count(*) AS n, count(DISTINCT id) AS papers FROM (SELECT id, unnest(cited_references) AS r FROM parsed_papers) GROUP BY 1"),
    "figures_per_paper": (figures_per_paper, "SELECT id, count(*) AS n, CAST(max(f.page) AS BIGINT) AS last_page, min(f.label) AS first_label FROM (SELECT id, unnest(figures) AS f FROM parsed_papers) GROUP BY id"),
    "exact_dup_groups": (exact_dup_groups, "SELECT min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY text HAVING count(*) > 1"),
    "grouped_messages": (grouped_messages, "SELECT md5(m) AS m, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(reason, 'https?://[^ ]+', '<url>', 'g'), '\"[^\"]*\"', '<quoted>', 'g'), '[0-9a-f]{8}-[0-9a-f-]{15,}', '<id>', 'g'), '[0-9]+(\\.[0-9]+)?', '<n>', 'g') AS m FROM judge_verdicts WHERE reason IS NOT NULL) GROUP BY 1"),
    "json_payload": (json_payload, "SELECT event_type, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k, count(k) AS n FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type"),
    "verdict_json": (verdict_json, "WITH j AS (SELECT verdict_id, json_extract_string(r, '$.quote_supports_claim') AS q, json_extract_string(r, '$.answers_aspect') AS a FROM (SELECT verdict_id, trim(raw_output, ' ') AS r FROM judge_verdicts WHERE trim(raw_output, ' ') LIKE '{%}') WHERE json_valid(r)) SELECT verdict_id, CASE WHEN q = 'no' OR a = 'no' THEN 'no' WHEN q = 'yes' AND a = 'yes' THEN 'yes' ELSE 'partial' END AS final FROM j WHERE q IN ('yes', 'no', 'partial') AND a IN ('yes', 'no', 'partial')"),
    "quote_checks": (quote_checks, f"WITH q AS (SELECT row_id, source_id, trim({_NORM.format('quote')}, ' ') AS quote FROM tag_audit), c AS (SELECT source_id, chunk_key, trim({_NORM.format('text')}, ' ') AS text FROM chunk_lookup) SELECT DISTINCT row_id, chunk_key FROM q JOIN c ON q.source_id = c.source_id AND length(quote) >= 20 AND contains(c.text, q.quote)"),
    "bm25_passages": (bm25_passages, f"WITH d AS (SELECT chunk_key, {_words('text')} AS w FROM chunk_lookup), n AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d), q AS (SELECT DISTINCT id, unnest({_words('main_topic')}) AS t FROM sub_questions), t AS (SELECT chunk_key, l, t, count(*) AS tf FROM (SELECT chunk_key, len(w) AS l, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL), f AS (SELECT t, count(*) AS df FROM t GROUP BY t), s AS (SELECT id, chunk_key, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / n.m))), 6) AS score FROM q JOIN t USING (t) JOIN f USING (t), n GROUP BY ALL) SELECT id, chunk_key, score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_key) <= 5"),
    "word_weights": (word_weights, f"WITH q AS (SELECT DISTINCT id, unnest({_words('main_topic')}) AS w FROM sub_questions) SELECT w, count(*) AS df, round(1 - count(*) / (SELECT count(*) FROM sub_questions), 6) AS weight FROM q GROUP BY w"),
    "section_relevance": (section_relevance, f"SELECT id, no - 1 AS no, round(CASE WHEN len(t) > 0 THEN sh / len(t) ELSE 0 END + 0.15 * sh, 6) AS relevance FROM (SELECT id, no, t, len(list_intersect(t, {_content('coalesce(x.text, chr(32))')})) AS sh FROM (SELECT id, {_content('title')} AS t, unnest(sections) AS x, generate_subscripts(sections, 1) AS no FROM parsed_papers))"),
    "title_jaccard": (title_jaccard, f"WITH r AS (SELECT reference_id, list_distinct({_words('title')}) AS a FROM report_references WHERE title IS NOT NULL), p AS (SELECT id, list_distinct({_words('title')}) AS b FROM parsed_papers WHERE title IS NOT NULL), c AS (SELECT reference_id, id, len(a) AS la, len(b) AS lb, count(*) AS k FROM (SELECT reference_id, a, unnest(a) AS w FROM r) JOIN (SELECT id, b, unnest(b) AS w FROM p) USING (w) GROUP BY ALL) SELECT reference_id, id, round(k / (la + lb - k), 6) AS jaccard FROM c WHERE round(k / (la + lb - k), 6) >= 0.6"),
    "cosine_top_k": (cosine_top_k, "SELECT query, neighbour, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS place FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) QUALIFY place <= 10"),
    "cosine_floor_then_k": (cosine_floor_then_k, "SELECT query, neighbour, similarity FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE similarity >= 0.25 QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) <= 20"),
    "argmax_assignment": (argmax_assignment, "WITH c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label), s AS (SELECT vec_id, c.label, round(list_dot_product(embedding::DOUBLE[], c.c), 6) AS s FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS n, lead(s) OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS s2 FROM s) SELECT vec_id, CAST(label AS BIGINT) AS assigned, coalesce(s - s2 <= 0.05, false) AS near_tie FROM r WHERE n = 1"),
    "greedy_clusters": (greedy_clusters, None),
}
