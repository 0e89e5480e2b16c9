"""Replies of models and free wording as column expressions: verdicts, plans, tags, search queries, numbers, labels."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siltstone.functions.text import STOP_WORDS, let

# Word endings that are cut where four letters stay, longest first.
ENDINGS = ("ations", "ation", "ings", "ing", "ies", "es", "ed", "s")
# Parts of names in lower case.
PARTICLES = ("van", "von", "de", "der", "da", "di", "del", "bin", "al", "le", "la")
# Number words.
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
# Marks read as others.
TYPOGRAPHY = {"‘": "'", "’": "'", "‛": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "…": "...", " ": " "}

VERDICT = "relevant boolean, confidence double, reason string"


def braces(reply: Column) -> Column:
    """First to last brace of a reply, its thinking block left out; null where there is none."""
    plain = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    return F.nullif(F.regexp_extract(plain, r"(?s)(\{.*\})", 1), F.lit(""))


def typed_verdict(reply: Column) -> Column:
    """Verdict struct of a reply, the confidence between 0 and 1 (0 where it is missing); null where the reply has no
    verdict."""
    found = F.from_json(braces(reply), VERDICT)
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(found["confidence"], F.lit(0.0))))
    return F.when(found["relevant"].isNotNull(), F.struct(found["relevant"].alias("relevant"), sure.alias("confidence"), found["reason"].alias("reason")))


def clean_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def listed(reply: Column) -> Column:
    """Entries of a list: a JSON array of strings, or one entry a line without bullets and numbers; empty ones dropped,
    repeated ones kept once."""
    array = F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), F.lit("")), "array<string>")
    lines = F.transform(F.split(reply, "\n"), lambda x: F.regexp_replace(x, r"^\s*(?:[-*•]|[0-9]+[.)])\s+", ""))
    return F.array_distinct(F.filter(F.transform(F.coalesce(array, lines), clean_spaces), lambda x: x != ""))


def tags(reply: Column, most: Column) -> Column:
    """(detail, strength) entries of a JSON array of numbers or objects: strength partial where none is given, numbers
    from 1 to ``most``, the first entry of a detail only."""
    items = F.from_json(reply, "array<string>")

    def one(x: Column) -> Column:
        obj = F.from_json(x, "detail int, strength string")
        return F.struct(F.coalesce(obj["detail"], x.try_cast("int")).alias("detail"), F.coalesce(obj["strength"], F.lit("partial")).alias("strength"))

    valid = F.filter(F.transform(items, one), lambda t: (t["detail"] >= 1) & (t["detail"] <= most))
    return let(valid, lambda v: F.filter(v, lambda t, i: ~F.exists(F.slice(v, F.lit(1), i), lambda u: u["detail"] == t["detail"])))


def plain_query(text: Column) -> Column:
    """Search words without wildcards and quotes, Boolean operators as plain words."""
    t = F.regexp_replace(text, r"[*?~\"\\]+", " ")
    for op in ("AND", "OR", "NOT"):
        t = F.regexp_replace(t, rf"\b{op}\b", op.lower())
    return clean_spaces(t)


def fielded_queries(words: Column) -> Column:
    """Strict and relaxed query of a word list: the first two words are required, the others optional; three words also
    give the first two alone, two words either of them; no words give none."""
    field = lambda parts, op: F.concat(F.lit("TITLE-ABS-KEY("), F.array_join(parts, f" {op} "), F.lit(")"))
    n = F.size(words)
    must, may = F.slice(words, 1, 2), F.slice(words, F.lit(3), F.greatest(n - 2, F.lit(0)))
    strict = F.when(n > 2, F.concat(field(must, "AND"), F.lit(" AND "), field(may, "OR"))).when(n > 0, field(must, "AND"))
    relaxed = F.when(n == 3, field(must, "AND")).when(n == 2, field(words, "OR"))
    return F.array_compact(F.array(strict, relaxed))


def like_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def stemmed(word: Column) -> Column:
    out = word
    for end in reversed(ENDINGS):
        out = F.when(word.endswith(end) & (F.length(word) >= len(end) + 4), F.substring(word, F.lit(1), F.length(word) - len(end))).otherwise(out)
    return out


def stem_set(text: Column) -> Column:
    """Sorted distinct stems of the content words of a text, hyphenated words as a whole and by their parts."""
    t = F.regexp_replace(F.lower(text), r"[‐-―−]", "-")
    words = F.transform(F.regexp_extract_all(t, F.lit(r"([a-z][a-z0-9-]+)"), 1), lambda w: F.regexp_replace(w, r"^-+|-+$", ""))
    parts = F.flatten(F.transform(words, lambda w: F.when(w.contains("-"), F.filter(F.concat(F.array(w), F.split(w, "-")), lambda p: p != "")).otherwise(F.array(w))))
    kept = F.filter(parts, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.array_sort(F.array_distinct(F.transform(kept, stemmed)))


def quantities(text: Column) -> Column:
    """Numbers of a text as value and unit, in order: thousands marks closed, k / M / B and million / billion multiplied,
    number words to twelve, percent in any spelling; both ends of a range take its unit; numbers inside names are none."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?i)\bper\s*cent\b|\bpercent\b", "%"), r"\s+%", "%")
    t = reduce(lambda c, x: F.regexp_replace(c, rf"(?i)\b{x[0]}\b", str(x[1])), NUMBER_WORDS.items(), t)
    t = F.regexp_replace(t, r"([0-9])\s*(?:-|–|to)\s*([0-9][0-9.,]*)(%|[kMB]\b| (?:thousand|million|billion)\b)", "$1$3 $2$3")
    pattern = r"(?<![A-Za-z0-9.,/-])([0-9][0-9,]*(?:\.[0-9]+)?(?:%|[kMB]\b| (?:thousand|million|billion)\b)?)(?![A-Za-z0-9])"
    found = F.regexp_extract_all(t, F.lit(pattern), 1)

    def value(raw: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(raw, r"^([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").cast("double")
        times = F.when(raw.rlike("k$|thousand$"), 1e3).when(raw.rlike("M$|million$"), 1e6).when(raw.rlike("B$|billion$"), 1e9).otherwise(1.0)
        return F.struct((number * times).alias("value"), F.when(raw.endswith("%"), "%").otherwise("").alias("unit"))

    return F.transform(found, value)


def claim_wording(text: Column) -> Column:
    """Claim for use inside a sentence: label, citation markers and end marks off, a common first word in lower case."""
    t = F.regexp_replace(clean_spaces(text), r"(?i)^(claim|finding)\s*:\s*", "")
    t = F.regexp_replace(t, r"\s*\[\s*[0-9]+(\s*[,;–-]\s*[0-9]+)*\s*\]", "")
    t = F.regexp_replace(t, r"[ .;:]+$", "")
    first = F.regexp_extract(t, r"^([A-Za-z]+)", 1)
    common = F.lower(first).isin(*STOP_WORDS) & ~first.rlike("^[A-Z]{2,}")
    return F.when(common, F.concat(F.lower(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))).otherwise(t)


def without_attribution(text: Column) -> Column:
    """Sentence without an opening that only says who says it, where three words or more are left."""
    t = clean_spaces(text)
    rest = F.regexp_replace(t, r"(?i)^(?:according to [^,]{3,60},|(?:one|two|several|a|an|the) (?:\w+ ){0,3}(?:study|studies|paper|papers|source|sources|report|reports) (?:reports?|finds?|found|states?|shows?|suggests?|notes?)(?: that|:|,)?)\s*", "")
    long = F.size(F.split(rest, " ")) >= 3
    return F.when((rest != t) & long, F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest)))).otherwise(t)


def standalone(aspect: Column, topic: Column) -> Column:
    """Aspect as a question that stands alone: long questions as they are, others with the question they belong to."""
    a, q = clean_spaces(aspect), clean_spaces(topic)
    alone = a.endswith("?") & (F.size(F.split(a, " ")) >= 6)
    bare = F.regexp_replace(a, r"[?. ]+$", "")
    return F.when(alone, a).otherwise(F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, F.lit(2), F.length(bare)), F.lit(" - in the context of the question: "), q))


def usable_anchor(text: Column, chars: int = 60, most_words: int = 6) -> Column:
    """Anchor phrase with plain quotes and dashes; empty where it is too long or holds brackets."""
    t = F.regexp_replace(F.regexp_replace(clean_spaces(text), "[‘’‛]", "'"), "[‐-―−]", "-")
    t = F.trim(F.regexp_replace(t, '[“”"]', ""))
    good = (F.length(t) <= chars) & (F.size(F.split(t, " ")) <= most_words) & ~t.rlike(r"[\[\]{}<>]")
    return F.when(good, t).otherwise("")


def anchored(queries: Column, anchor: Column) -> Column:
    """Queries with the anchor added unless they hold all its words; repeated ones kept once."""
    bag = lambda x: F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), 1)
    add = lambda q: F.when((anchor == "") | (F.size(F.array_except(bag(anchor), bag(q))) == 0), q).otherwise(F.concat(q, F.lit(" "), anchor))
    return F.array_distinct(F.transform(queries, add))


def duration_label(ms: Column) -> Column:
    s = F.round(ms / 1000).cast("long")
    return F.when(ms >= 0, F.when(s < 60, F.concat(s.cast("string"), F.lit(" s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(" min "), (s % 60).cast("string"), F.lit(" s"))))


def token_label(n: Column) -> Column:
    return F.when(n >= 0, F.when(n < 1000, n.cast("string")).otherwise(F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))))


def percent_label(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.concat(F.floor(100 * part / whole + 0.5).cast("string"), F.lit("%")))


def retry_wait(error: Column) -> Column:
    """Seconds a rate limit asks to wait; null for any other error."""
    return F.regexp_extract(error, r"rate limited for ([0-9]+)s", 1).try_cast("double")


def name_list(text: Column) -> Column:
    """True for a list of one to fifteen person names: marks aside, every part two to five capitalised words (or particles)."""
    t = F.regexp_replace(F.regexp_replace(text, r"[0-9*†‡§]+", " "), r"\band\b|&", ",")
    parts = F.filter(F.transform(F.split(t, ","), lambda p: F.trim(p)), lambda p: p != "")
    word = rf"(?:[A-Z][\p{{L}}'.-]*|{'|'.join(PARTICLES)})"
    return F.coalesce((F.size(parts) >= 1) & (F.size(parts) <= 15) & F.forall(parts, lambda p: p.rlike(rf"^{word}(?:\s+{word}){{1,4}}$")), F.lit(False))


def plain_text(text: str) -> str:
    """Compatibility form of a text with typographic marks as plain ones and single spaces."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", "".join(TYPOGRAPHY.get(c, c) for c in text))).strip()


@F.pandas_udf(StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """:func:`plain_text` of a column; Spark has no compatibility normalisation of its own."""
    return texts.map(lambda t: None if t is None else plain_text(t))
