"""Identity keys as column expressions: titles, DOIs, arXiv ids, names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Letters of the Latin blocks and wide forms with their plain ASCII letter, from the Unicode decompositions."""
    pairs: dict[str, str] = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            pairs[chr(code)] = plain.lower()
    pairs |= {"ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "đ": "d", "ı": "i"}
    return "".join(pairs), "".join(pairs.values())


_FOLD_FROM, _FOLD_TO = _fold_table()
_ELLIPSIS = r"(\.\.\.|…|\[\.{3}\]|\[…\])\s*$"


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def fold_ascii(text: Column) -> Column:
    """Lower case without accents; wide letters become plain ones, combining marks go. Plain texts take the short way."""
    folded = F.regexp_replace(F.translate(F.lower(text), _FOLD_FROM, _FOLD_TO), r"\p{M}+", "")
    return F.when(is_ascii(text), F.lower(text)).otherwise(folded)


def ends_in_ellipsis(text: Column) -> Column:
    """True where a text is cut with an ellipsis."""
    end = F.right(F.rtrim(text), F.lit(5))
    return F.coalesce((end.contains("...") | end.contains("…")) & end.rlike(_ELLIPSIS), F.lit(False))


def strip_markup(text: Column) -> Column:
    """Text without tags; the common entities become their characters."""
    plain = F.regexp_replace(text, r"</?[A-Za-z][^<>]{0,80}>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.when(text.contains("<") | text.contains("&"), plain).otherwise(text)


def with_title_key(df: DataFrame, title: str, into: str) -> DataFrame:
    """``df`` with the key of a title: letters and digits of a full title in one case; null for cut or empty titles.

    Step by step in columns of their own, so that no step is computed twice.
    """
    found = df.withColumn("_plain", strip_markup(F.col(title)))
    found = found.withColumn("_key", F.regexp_replace(fold_ascii(F.col("_plain")), r"[^\p{L}\p{N}]+", ""))
    key = F.when((F.col("_key") != "") & ~ends_in_ellipsis(F.col("_plain")), F.col("_key"))
    return found.withColumn(into, key).drop("_plain", "_key")


def doi_key(doi: Column) -> Column:
    """Bare lower-case DOI without prefix word, address or trailing mark; null where there is no usable one."""
    decoded = F.replace(F.replace(F.lower(doi), F.lit("%2f"), F.lit("/")), F.lit("%3a"), F.lit(":"))
    bare = F.regexp_extract(decoded, r"(10\.\d{4,9}/[^\s\"<>]*[^\s\"<>.,;:)\]}/])[.,;:)\]}/]*(?:$|[\s\"<>])", 1)
    return F.nullif(bare, F.lit(""))


def arxiv_key(arxiv_id: Column) -> Column:
    """Bare arXiv number without version; null for placeholders."""
    return F.nullif(F.regexp_extract(arxiv_id, r"(?<!\d)(?!0+\.0+(?:v|$|\D))(\d{4}\.\d{4,5})(?:v\d+)?(?!\d)", 1), F.lit(""))


def doc_key(title: Column, source_id: Column) -> Column:
    """Title before the first separator, lower-cased letters, digits and single spaces; the source id where empty."""
    head = F.split(title, r" \| | - | – ").getItem(0)
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(head), r"[^a-z0-9 ]", ""), r"\s+", " "))
    return F.coalesce(F.when(key != "", key), source_id)
