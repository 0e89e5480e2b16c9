"""Best representative of each duplicate group.

Rows are tied by identity keys (connected components of the key graph), and one value per field survives: candidates
are ranked by completeness, trust and recency in a window with a full tie-break, and the first one is kept. The rank
filter is pushed below the shuffle by Spark (window group limit), so that of a hot group each map task sends one row
per field, however many rows the group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.keys import arxiv_key, doi_key, ends_in_ellipsis, strip_markup, with_title_key
from siltstone.operators.components import connected_components
from siltstone.session import materialize
from siltstone.sources import table

PREPRINT_PREFIX = "10.98550/"

# What a provider writes in place of an abstract, and what it adds around one.
_NO_ABSTRACT = r"(?i)^\W*(no abstract|abstract (is )?(not available|unavailable|withheld|missing)|not available|unavailable|withheld|unknown|none|null|nan|n/?a|tba|missing)\b.{0,160}$"
_LEAD = r"(?i)^\s*(abstract|summary)\s*[:.\-–—]\s*"
_TAIL = r"(?i)\s*((©|\(c\)\s|copyright\s)[^.]{0,80}\d{4}.*|key ?words?\s*:.*|index terms\s*[:\-—].*|all rights reserved\W*)$"
TITLE_SLIPS = 6
_CUT = r"\s*(\.\.\.|…|\[\.\.\.\]|\[…\])\s*$"


def publication_keys(papers: DataFrame) -> DataFrame:
    """Rows with ``title_k``, ``doi_k``, ``arxiv_k`` and ``keys``, the array of their prefixed identity keys.

    A preprint DOI carries its arXiv number, which counts as an arXiv key. A row without any usable key gets the key
    of its own id, so that it stays a group of one.
    """
    keyed = with_title_key(papers, "title", "title_k")
    keyed = keyed.withColumns({"doi_k": doi_key(F.col("doi")), "arxiv_k": arxiv_key(F.col("arxiv_id"))})
    from_doi = F.when(F.col("doi_k").startswith(PREPRINT_PREFIX), arxiv_key(F.col("doi_k")))
    short = F.concat(F.lit("t:"), F.xxhash64("title_k").cast("string"), F.lit(":"), F.hash("title_k").cast("string"))
    parts = F.array_distinct(
        F.array_compact(
            F.array(
                F.concat(F.lit("d:"), F.col("doi_k")),
                F.concat(F.lit("a:"), F.col("arxiv_k")),
                F.concat(F.lit("a:"), from_doi),
                F.when(F.col("title_k").isNotNull(), short),
            )
        )
    )
    keyed = keyed.withColumn("keys", parts)
    return keyed.withColumn("keys", F.when(F.size("keys") > 0, F.col("keys")).otherwise(F.array(F.concat(F.lit("r:"), F.col("id")))))


def assign_groups(keyed: DataFrame) -> DataFrame:
    """``keyed`` with the column ``component``: rows that share a key, directly or over other rows, get the same value.

    The graph has keys as nodes and one edge per distinct pair of keys of a row, so that copies of a row add nothing
    and a hot group is as small as its spellings are few; rows take the component of their first key.
    """
    first = F.col("keys").getItem(0)
    pairs = keyed.where(F.size("keys") > 1).select(first.alias("a"), F.explode(F.slice("keys", 2, 10)).alias("b"))
    labels = connected_components(pairs, "a", "b")
    found = keyed.withColumn("_k", first).join(labels, F.col("_k") == F.col("node"), "left")
    return found.withColumn("component", F.coalesce("component", "_k")).drop("_k", "node")


def publication_groups(papers: DataFrame) -> DataFrame:
    """``id`` and ``component`` of every row; id, title, doi and arxiv_id are read."""
    keyed = publication_keys(papers.where(F.col("id").isNotNull()).select("id", "title", "doi", "arxiv_id"))
    return assign_groups(materialize(keyed.select("id", "keys"), "keyed")).select("id", "component")


def with_abstract_core(df: DataFrame) -> DataFrame:
    """``df`` with ``core``, the abstract's own text: no tags, label, copyright or keyword tail, no ellipsis; null where
    there is none (missing, a placeholder, or the title over again, slips and a cut title aside). Each cleaning step runs only where its mark occurs."""
    found = df.withColumn("core", F.trim(strip_markup(F.col("abstract"))))
    odd = F.col("core").contains("  ") | F.col("core").contains("\n") | F.col("core").contains("\t")
    found = found.withColumn("core", F.when(odd, F.regexp_replace("core", r"\s+", " ")).otherwise(F.col("core")))
    low = F.lower("core")
    marks = low.contains("copyright") | low.contains("©") | low.contains("(c)") | low.contains("key") | low.contains("index terms") | low.contains("all rights")
    found = found.withColumn("core", F.regexp_replace("core", _LEAD, ""))
    found = found.withColumn("core", F.when(marks, F.regexp_replace(F.regexp_replace("core", _TAIL, ""), _TAIL, "")).otherwise(F.col("core")))
    found = found.withColumn("core", F.when(ends_in_ellipsis(F.col("core")), F.trim(F.regexp_replace("core", _CUT, ""))).otherwise(F.col("core")))
    short = F.length("core") <= 2 * F.length("title") + 20
    found = with_title_key(found.withColumn("_short", F.when(short, F.col("core"))), "_short", "_short_k")
    cut = F.col("_short").isNotNull() & ends_in_ellipsis(F.col("title"))
    found = found.withColumn("_cut", F.when(cut, F.regexp_replace("title", _CUT, "")))
    found = with_title_key(found, "_cut", "_cut_k").drop("_short", "_cut")
    near = F.levenshtein("_short_k", "title_k", TITLE_SLIPS) >= 0
    is_title = F.coalesce(near, F.lit(False)) | F.coalesce(F.col("_short_k").startswith(F.col("_cut_k")), F.lit(False))
    none = (F.col("core") == "") | F.col("core").rlike(_NO_ABSTRACT) | is_title
    return found.withColumn("core", F.when(~none, F.col("core"))).drop("_short_k", "_cut_k")


def best_values(papers: DataFrame) -> DataFrame:
    """Surviving value of each field of each publication with two rows or more.

    Input columns: id, title, doi, arxiv_id, citation_count, abstract, created_at; further ones are ignored. Output:
    ``group_key`` (smallest id of the group), ``field_name``, ``survivor``. Nulls, placeholders and empty texts are no
    values, a field without any real value gives no row, rows with a null id are ignored, ties go to the smallest id,
    an empty table gives no rows. Long abstracts are read whole.
    """
    rows = papers.where(F.col("id").isNotNull()).select("id", "title", "doi", "arxiv_id", F.col("citation_count").cast("long").alias("citations"), "abstract", "created_at")
    keyed = with_abstract_core(publication_keys(rows)).select(
        "id", "keys", "doi_k", "arxiv_k", "citations", "created_at",
        F.length("core").alias("core_len"),
        ((F.col("abstract") == F.col("core")) & ~ends_in_ellipsis(F.col("abstract"))).cast("int").alias("whole"),
    )
    grouped = assign_groups(materialize(keyed, "keyed"))
    sizes = grouped.groupBy("component").agg(F.min("id").alias("group_key"), F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
    seen = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(2**62)))
    published = (~F.col("doi_k").startswith(PREPRINT_PREFIX)).cast("long")
    zero = F.lit(0).cast("long")

    def candidate(name: str, value: Column, present: Column, first: Column, then: Column) -> Column:
        return F.when(present, F.struct(F.lit(name).alias("field_name"), value.alias("survivor"), first.cast("long").alias("first"), then.cast("long").alias("then")))

    offers = grouped.select(
        "component", "id",
        F.explode(F.array_compact(F.array(
            candidate("doi", F.col("doi_k"), F.col("doi_k").isNotNull(), published, seen),
            candidate("arxiv_id", F.col("arxiv_k"), F.col("arxiv_k").isNotNull(), zero, seen),
            candidate("citation_count", F.col("citations").cast("string"), F.col("citations") >= 0, seen, zero),
            candidate("abstract", F.col("id"), F.col("core_len") > 0, F.col("core_len"), F.col("whole")),
        ))).alias("c"),
    ).select("component", "id", "c.*")
    order = Window.partitionBy("component", "field_name").orderBy(F.desc("first"), F.desc("then"), "id", "survivor")
    best = offers.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1)
    return best.join(sizes, "component").select("group_key", "field_name", "survivor")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_values(table(spark, sf_dir, "retrieved_papers"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership: every row with its group and the group's size."""
    grouped = publication_groups(table(spark, sf_dir, "retrieved_papers").select("id", "title", "doi", "arxiv_id"))
    sizes = grouped.groupBy("component").agg(F.min("id").alias("group_key"), F.count(F.lit(1)).alias("n_rows"))
    return grouped.select("id", "component").join(sizes, "component").select("id", "group_key", "n_rows")
