"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content.
STOP_WORDS = "a an and are as at be by for from has in is it its of on or that the to was were what which with how do does".split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: inside a lambda an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Lower-case ASCII words and numbers in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1)


def plural_stem(word: Column) -> Column:
    """Singular of a word by its ending: ies, sses, es after x/z/ch/sh, s (not ss, us, is)."""
    return (
        F.when(word.rlike("[a-z]{2,}ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("sses$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("(x|z|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .when((F.length(word) > 3) & word.rlike("s$") & ~word.rlike("(ss|us|is)$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def content_words(text: Column) -> Column:
    """Sorted distinct words without stop words, a plural s cut where the word is longer than three and not in ss."""
    kept = F.filter(words(text), lambda w: ~w.isin(*STOP_WORDS))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, 1, F.length(w) - 1)).otherwise(w))))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for empty texts."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def is_prose(text: Column, least_letters: float = 0.6, most_pipes: int = 5) -> Column:
    """True where letters make up most of a text and it holds few pipes (no table)."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (F.length(text) > 0) & (letters >= least_letters * F.length(text)) & (pipes <= most_pipes)


def domain_of(url: Column) -> Column:
    """Host of an address in lower case without www."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def year_of(text: Column) -> Column:
    """First year from 1800 to 2099 in a text."""
    return F.nullif(F.regexp_extract(text, r"(?:^|[^0-9])((?:18|19|20)[0-9]{2})(?:[^0-9]|$)", 1), F.lit("")).cast("int")


def quote_norm(text: Column) -> Column:
    """Quote for comparison: one case, hyphenation at line ends closed, dashes alike, citation marks and soft hyphens
    out, single spaces."""
    t = F.regexp_replace(F.lower(text), r"(\w)-[ ]*\n[ ]*(\w)", "$1$2")
    t = F.replace(t, F.lit("­"), F.lit(""))
    t = F.regexp_replace(t, r"[‐‑‒–—−]", "-")
    t = F.regexp_replace(t, r"\[[0-9]+(?:[,;–-] ?[0-9]+)*\]", "")
    t = F.regexp_replace(t, r"\s+", " ")
    return F.trim(F.regexp_replace(t, r" ([.,;:!?)])", "$1"))


def elision_pieces(quote: Column, least: int = 20) -> Column:
    """The pieces between the ellipses of a quote, each normalised, those of ``least`` characters or more."""
    parts = F.split(quote, r"\[(?:\.\.\.|…)\]|\.\.\.|…")
    return F.filter(F.transform(parts, quote_norm), lambda p: F.length(p) >= least)


def mask(text: Column) -> Column:
    """Text with addresses, hexadecimal ids, quoted parts and numbers masked, for grouping messages of one kind."""
    t = F.regexp_replace(text, r"https?://[^ ]+", "<url>")
    t = F.regexp_replace(t, r"\"[^\"]*\"", "<quoted>")
    t = F.regexp_replace(t, r"[0-9a-f]{8}-[0-9a-f-]{15,}", "<id>")
    return F.regexp_replace(t, r"[0-9]+(\.[0-9]+)?", "<n>")


def author_list(authors: Column) -> Column:
    """Names joined by commas, more than three as the first and et al."""
    return F.when(F.size(authors) > 3, F.concat(F.element_at(authors, 1), F.lit(" et al."))).when(F.size(authors) > 0, F.array_join(authors, ", "))


def short_hash(prefix: str, text: Column, length: int = 10) -> Column:
    """Prefix and the first hexadecimal digits of the SHA-1 of a normalised text."""
    norm = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.concat(F.lit(prefix), F.substring(F.sha1(norm), 1, length))


def word_chunks(text: Column, size: int = 300) -> Column:
    """Array of chunks (chunk_id, text) of ``size`` words each, without overlap."""

    def cut(parts: Column) -> Column:
        last = F.floor((F.size(parts) - 1) / size).cast("int")
        ids = F.when(F.size(parts) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(ids, lambda i: F.struct(i.alias("chunk_id"), F.array_join(F.slice(parts, i * size + 1, size), " ").alias("text")))

    return let(F.filter(F.split(text, r"\s+"), lambda w: w != ""), cut)


def char_windows(text: Column, size: int = 700, step: int = 350) -> Column:
    """Array of overlapping character windows (start, text); the last one reaches the end."""
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    ids = F.when(F.length(text) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(ids, lambda i: F.struct((i * step).alias("start"), F.substring(text, i * step + 1, F.lit(size)).alias("text")))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def softmax(logits: Column) -> Column:
    """Softmax of an array of numbers."""
    parts = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return let(total, lambda t: F.transform(parts, lambda x: x / t))


def strip_nul(text: Column) -> Column:
    """Text without NUL characters."""
    return F.replace(text, F.lit("\u0000"), F.lit(""))


def or_query(text: Column) -> Column:
    """Content words of a question joined by OR."""
    return F.array_join(F.array_distinct(F.filter(words(text), lambda w: ~w.isin(*STOP_WORDS))), " OR ")
