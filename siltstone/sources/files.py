"""Readers of logs, label files and provider answers, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with a declared schema; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts: a data-quality check that stays distributed."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def read_label_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV label files (UTF-8, a leading byte-order mark allowed) with the file's name; ``label`` as a number or null."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    clean = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    named = clean.select(*[F.col(c) for c in columns], F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    return named.withColumn("label", F.replace("label", F.lit(","), F.lit(".")).try_cast("double"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as (file, line_no, at, level, logger, message); other lines are dropped. Lines keep their order in a file."""
    lines = spark.read.text(path).withColumns({"line_no": F.monotonically_increasing_id(), "file": F.input_file_name()})
    pattern = r"^(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)[,.]?\d* +\[?(DEBUG|INFO|WARNING|ERROR|CRITICAL)\]? +([\w.]+)[ :-]+(.*)$"
    parts = lines.where(F.col("value").rlike(pattern))
    return parts.select("file", "line_no", *[F.regexp_extract("value", pattern, i).alias(c) for i, c in enumerate(("at", "level", "logger", "message"), 1)])


def log_runs(log: DataFrame, start_marker: str) -> DataFrame:
    """Log lines with ``run``: 1-based number, within their file, of the run they belong to, opened by a marker line; 0
    before the first."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("run", F.sum(F.col("message").contains(start_marker).cast("int")).over(w).cast("int"))


def parse_sse(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Events of server-sent text: blocks at blank lines, the data line parsed as JSON; blocks without one are dropped."""
    blocks = df.select(F.posexplode(F.split(text, r"\n\s*\n")).alias("no", "block"))
    data = blocks.select("no", F.regexp_extract("block", r"(?m)^id: ?(\S+)", 1).alias("event_id"), F.regexp_extract("block", r"(?m)^data: ?(.*)$", 1).alias("data"))
    return data.where("data <> ''").select("no", F.nullif("event_id", F.lit("")).alias("event_id"), F.from_json("data", schema).alias("event"))


def parse_atom(df: DataFrame, xml: str) -> DataFrame:
    """Entries of Atom answers: title, summary, authors, id, published, pdf link; entries without title or summary drop."""
    def every(path: str) -> Column:
        return F.expr(f"xpath({xml}, '{path}')")

    entries = df.select(F.explode(F.split(F.regexp_replace(xml, r"(?s)^.*?(?=<entry>)|</feed>.*$", ""), r"(?=<entry>)")).alias(xml)).where(F.col(xml).startswith("<entry>"))
    read = entries.select(
        F.trim(F.regexp_replace(F.expr(f"xpath_string({xml}, 'entry/title')"), r"\s+", " ")).alias("title"),
        F.trim(F.regexp_replace(F.expr(f"xpath_string({xml}, 'entry/summary')"), r"\s+", " ")).alias("abstract"),
        every("entry/author/name/text()").alias("authors"),
        F.expr(f"xpath_string({xml}, 'entry/id')").alias("url"),
        F.expr(f"xpath_string({xml}, 'entry/published')").alias("published"),
        F.element_at(every('entry/link[@title="pdf"]/@href'), 1).alias("pdf_url"),
    )
    return read.where("title <> '' and abstract <> ''")


SCHOLAR = "array<struct<title:string,abstract:string,year:int,venue:string,citationCount:int,influentialCitationCount:int,externalIds:map<string,string>,openAccessPdf:struct<url:string>,tldr:struct<text:string>,authors:array<struct<name:string>>>>"


def parse_scholar(df: DataFrame, body: str) -> DataFrame:
    """Papers of a scholarly JSON answer (field ``data``): ids out of a map, pdf and summary out of structs; a paper
    without venue counts as a preprint."""
    rows = df.select(F.explode(F.from_json(F.get_json_object(body, "$.data"), SCHOLAR)).alias("p")).select("p.*").where("title is not null")
    return rows.select(
        "title", "abstract", "year", F.nullif("venue", F.lit("")).alias("venue"), F.col("citationCount").alias("citation_count"),
        F.col("influentialCitationCount").alias("influential_citation_count"), F.col("externalIds")["DOI"].alias("doi"), F.col("externalIds")["ArXiv"].alias("arxiv_id"),
        F.col("openAccessPdf.url").alias("pdf_url"), F.col("tldr.text").alias("tldr"), F.transform("authors", lambda a: a["name"]).alias("authors"),
        F.nullif("venue", F.lit("")).isNull().alias("is_preprint"),
    )


def text_of_inverted_index(index: Column) -> Column:
    """Text of an inverted index (map of word to positions)."""
    words = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " ")


def pdf_links(html: Column) -> Column:
    """Distinct addresses of PDF files named in a page's meta tags and links, in order."""
    meta = F.regexp_extract_all(html, F.lit(r'(?i)<meta[^>]+name="citation_pdf_url"[^>]+content="([^"]+)"'), 1)
    link = F.regexp_extract_all(html, F.lit(r'(?i)<link[^>]+type="application/pdf"[^>]+href="([^"]+)"'), 1)
    return F.array_distinct(F.concat(meta, link))


def looks_like_pdf(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.lit("%PDF-").cast("binary")


def first_provider(providers: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first provider that has any for a key, all of them."""
    ranked = None
    for i, p in enumerate(providers):
        p = p.withColumn("provider_rank", F.lit(i))
        ranked = p if ranked is None else ranked.unionByName(p, allowMissingColumns=True)
    best = ranked.groupBy(key).agg(F.min("provider_rank").alias("provider_rank"))
    return ranked.join(best, [key, "provider_rank"], "left_semi")


def top_up(strict: DataFrame, relaxed: DataFrame, scope: str, key: str, least: int) -> DataFrame:
    """Strict rows, and the relaxed ones with new keys in scopes whose strict total is under ``least``."""
    counts = strict.groupBy(scope).agg(F.count(F.lit(1)).alias("_n"))
    few = relaxed.join(counts, scope, "left").where(F.coalesce("_n", F.lit(0)) < least).drop("_n")
    return strict.unionByName(few.join(strict.select(scope, key), [scope, key], "left_anti"), allowMissingColumns=True)


def cached_parse(wanted: DataFrame, parsed: DataFrame, min_version: int, min_chars: int) -> DataFrame:
    """For every wanted paper the newest usable parse of another row, by arXiv number, else DOI, else exact title of 20
    characters or more. Columns of both: id, arxiv_k, doi_k, title; parsed also parser_version, n_chars, created_at."""
    usable = parsed.where((F.col("parser_version") >= min_version) & (F.col("n_chars") >= min_chars)).withColumnRenamed("id", "parsed_id")
    found = None
    for rank, key in enumerate(("arxiv_k", "doi_k", "title")):
        left = wanted.where(F.col(key).isNotNull()).select("id", key)
        if key == "title":
            left = left.where(F.length("title") >= 20)
        hit = left.join(usable.select(key, "parsed_id", "created_at"), key).where(F.col("id") != F.col("parsed_id")).select("id", "parsed_id", "created_at", F.lit(rank).alias("by"))
        found = hit if found is None else found.unionByName(hit)
    w = Window.partitionBy("id").orderBy("by", F.desc("created_at"), "parsed_id")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "created_at")


WORKS = "array<struct<title:string,doi:string,ids:map<string,string>,publication_year:int,cited_by_count:int,abstract_inverted_index:map<string,array<int>>,best_oa_location:struct<pdf_url:string>,open_access:struct<oa_url:string>,primary_location:struct<landing_page_url:string,pdf_url:string,source:struct<display_name:string,type:string>>,topics:array<struct<field:struct<display_name:string>>>,authorships:array<struct<author:struct<display_name:string>>>>>"


def parse_works(df: DataFrame, body: str) -> DataFrame:
    """Works of an open catalogue's JSON answer (field ``results``): bare DOI, arXiv number out of three fields, the best
    pdf address, no venue for repositories, the first three distinct fields, the abstract from its inverted index."""
    w = df.select(F.explode(F.from_json(F.get_json_object(body, "$.results"), WORKS)).alias("w")).select("w.*").where("title is not null")
    pattern = r"(?i)arxiv[.:/](?:abs/|pdf/)?(\d{4}\.\d{4,5})"
    places = F.concat_ws(" ", F.col("doi"), F.col("primary_location.landing_page_url"), F.col("primary_location.pdf_url"))
    source = F.col("primary_location.source")
    fields = F.array_compact(F.transform("topics", lambda t: t["field"]["display_name"]))
    return w.select(
        "title", F.lower(F.regexp_replace("doi", r"^https?://[^/]+/", "")).alias("doi"), F.nullif(F.regexp_extract(places, pattern, 1), F.lit("")).alias("arxiv_id"),
        F.coalesce(F.col("best_oa_location.pdf_url"), F.col("open_access.oa_url"), F.col("primary_location.pdf_url")).alias("pdf_url"),
        F.when(source["type"] != "repository", source["display_name"]).alias("venue"), F.col("publication_year").alias("year"), F.col("cited_by_count").alias("citation_count"),
        F.slice(F.array_distinct(fields), 1, 3).alias("fields_of_study"), text_of_inverted_index(F.col("abstract_inverted_index")).alias("abstract"),
        F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"),
    )


ARTICLES = "array<struct<title:string,abstract:string,doi:string,publication_title:string,publication_year:string,citing_paper_count:string,pdf_url:string,authors:struct<authors:array<struct<full_name:string>>>>>"


def parse_articles(df: DataFrame, body: str) -> DataFrame:
    """Articles of a publisher's JSON answer (field ``articles``); numbers that are none become null."""
    a = df.select(F.explode(F.from_json(F.get_json_object(body, "$.articles"), ARTICLES)).alias("a")).select("a.*").where("title is not null")
    return a.select(
        "title", "abstract", "doi", F.col("publication_title").alias("venue"), F.col("publication_year").try_cast("int").alias("year"),
        F.col("citing_paper_count").try_cast("int").alias("citation_count"), "pdf_url", F.transform("authors.authors", lambda x: x["full_name"]).alias("authors"),
    )


def parse_entries(df: DataFrame, body: str) -> DataFrame:
    """Entries of an index's JSON answer (``search-results.entry``): abstract without label and copyright tail, year from
    the date, counts that are no numbers null."""
    schema = "array<map<string,string>>"
    e = df.select(F.explode(F.from_json(F.get_json_object(body, "$['search-results'].entry"), schema)).alias("e"))
    text = F.regexp_replace(F.regexp_replace(F.col("e")["dc:description"], r"(?i)^\s*abstract\s*[:.]?\s*", ""), r"(?i)\s*(©|\(c\)|copyright)\s.*$", "")
    rows = e.select(
        F.col("e")["dc:title"].alias("title"), text.alias("abstract"), F.col("e")["prism:doi"].alias("doi"), F.col("e")["prism:publicationName"].alias("venue"),
        F.substring(F.col("e")["prism:coverDate"], 1, 4).try_cast("int").alias("year"), F.col("e")["citedby-count"].try_cast("int").alias("citation_count"), F.col("e")["dc:creator"].alias("first_author"),
    )
    return rows.where("title is not null")


def parse_figures(df: DataFrame, body: str) -> DataFrame:
    """Figures of an extractor's JSON answer, with fall-backs for label and path."""
    schema = "array<struct<figLabel:string,name:string,figType:string,caption:string,renderURL:string,image_path:string,page:int>>"
    f = df.select(F.posexplode(F.from_json(F.col(body), schema)).alias("no", "f"))
    label = F.coalesce(F.concat_ws(" ", F.coalesce(F.col("f.figType"), F.lit("Figure")), F.coalesce(F.col("f.name"), (F.col("no") + 1).cast("string"))))
    return f.select("no", F.coalesce(F.col("f.figLabel"), label).alias("label"), F.col("f.caption").alias("caption"), F.coalesce(F.col("f.renderURL"), F.col("f.image_path")).alias("image_path"), F.col("f.page").alias("page"))


def candidate_urls(arxiv_id: Column, pdf_url: Column, doi: Column, arxiv_base: str, doi_base: str) -> Column:
    """Addresses to try for a paper's file, the surest first."""
    bare = F.regexp_replace(arxiv_id, r"v\d+$", "")
    return F.array_distinct(F.array_compact(F.array(F.concat(F.lit(arxiv_base), bare), pdf_url, F.concat(F.lit(doi_base), doi))))


def recent_failures(stored: DataFrame, in_memory: DataFrame, key: str, now: str, max_days: int, min_version: int) -> DataFrame:
    """Failures that still hold: seen within ``max_days`` of ``now`` by a fetcher of ``min_version`` or later; a row in
    memory wins over the stored one of its key."""
    both = in_memory.withColumn("_rank", F.lit(0)).unionByName(stored.withColumn("_rank", F.lit(1)))
    w = Window.partitionBy(key).orderBy("_rank", F.desc("last_seen"))
    kept = both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")
    edge = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(max_days)} DAYS")
    return kept.where((F.col("last_seen") >= edge) & (F.col("fetcher_version") >= min_version))
