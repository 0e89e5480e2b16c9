"""Document operators that need a pass over the text in Python: markdown structure, fuzzy quotes, ordered selection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import let

_NUMBERED = re.compile(r"^(\d+(?:\.\d+)*)\.?\s+([A-Z].{2,80})$")
MIN_SECTION, MIN_REFERENCE = 60, 25


def _marked(line: str) -> tuple[int, str] | None:
    """Level and words of a heading line that begins with one to six hashes and a space."""
    words = line.lstrip("#")
    level = len(line) - len(words)
    return (level, words.strip()) if 1 <= level <= 6 and words[:1].isspace() and words.strip() else None


def parse_markdown(text: str) -> dict:
    """Title, sections (heading, text, level), and reference lines of a converted document.

    Headings are marked by hashes or by numbers; sections under 60 characters fold into the one before; reference lines
    lose their bullet and need 25 characters.
    """
    title, sections, references = None, [], []
    heading, level, lines = "", 1, []

    def close() -> None:
        body = "\n".join(lines).strip()
        if re.match(r"(?i)^[\d. ]*(references|bibliography)$", heading):
            references.extend(r for line in body.split("\n") if len(r := re.sub(r"^\s*(?:[-*•]|\[?\d+[\].)])\s*", "", line).strip()) >= MIN_REFERENCE)
        elif body or heading:
            if sections and len(body) < MIN_SECTION and level > 1:
                sections[-1]["text"] = (sections[-1]["text"] + "\n" + (heading + "\n" + body).strip()).strip()
            else:
                sections.append({"heading": heading, "text": body, "level": level})

    for line in text.split("\n"):
        marked, numbered = _marked(line), _NUMBERED.match(line)
        if marked and title is None and marked[0] == 1:
            title = marked[1]
            continue
        if marked or numbered:
            close()
            heading = marked[1] if marked else numbered.group(2)
            level = marked[0] if marked else numbered.group(1).count(".") + 1
            lines = []
        else:
            lines.append(line)
    close()
    return {"title": title, "sections": [s for s in sections if s["text"] or s["heading"]], "references": references}


def markdown_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sections of markdown documents: key, no, heading, level, n_chars. Null texts give none."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, s["heading"], s["level"], len(s["text"])) for k, t in zip(pdf[key], pdf[text]) for i, s in enumerate(parse_markdown(t)["sections"])]
            yield pd.DataFrame(rows, columns=[key, "no", "heading", "level", "n_chars"])

    return df.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, no int, heading string, level int, n_chars int")


def indel_ratio(a: str, b: str) -> float:
    """Normalised similarity by insertions and deletions: 100 for equal strings."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return 200.0 * row[-1] / (len(a) + len(b))


def partial_ratio(needle: str, text: str, floor: float = 0.0) -> float:
    """Best similarity of the needle and a stretch of the text of its length; stretches without a shared word start are
    passed over, and the search ends at an exact hit."""
    if not needle:
        return 0.0
    if needle in text:
        return 100.0
    if len(needle) > len(text):
        return indel_ratio(needle, text)
    best = 0.0
    starts = {m.start() - n.start() for n in re.finditer(r"\w{4,}", needle) for m in re.finditer(re.escape(n.group(0)), text)}
    for s in sorted(x for x in starts if -len(needle) < x < len(text)):
        at = max(0, s)
        best = max(best, indel_ratio(needle, text[at : at + len(needle)]))
        if best >= 99.9:
            break
    return best if best >= floor else 0.0


def verify_quotes(pairs: DataFrame, keys: list[str], quote: str, text: str, least: float = 92.0) -> DataFrame:
    """Best score of each quote over its texts, and whether it holds: equal stretch, or similarity of 92 or more. Quotes
    under 20 characters fail, and so do those without a text, at score 0. ``pairs`` are already blocked (a quote with the
    passages of its source)."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keys].copy()
            out["score"] = [partial_ratio(q, t) if q and t and len(q) >= 20 else 0.0 for q, t in zip(pdf[quote], pdf[text])]
            yield out

    scored = pairs.select(*keys, quote, text).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "score double"]))
    return scored.groupBy(*keys).agg(F.max("score").alias("score")).withColumn("verified", F.col("score") >= least)


def context_window(text: Column, quote: Column, size: int) -> Column:
    """Stretch of ``size`` characters around a quote: half before, half after, clipped at the ends; null where absent."""
    at = F.instr(text, quote)
    begin = F.greatest(at - F.lit(size // 2), F.lit(1))
    return F.when((at > 0) & (F.length(quote) > 0), F.substring(text, begin, at - begin + F.length(quote) + F.lit(size // 2)))


def sentences(text: Column) -> Column:
    """Sentences of a text; full stops after common abbreviations and single letters end none."""
    guarded = F.regexp_replace(text, r"\b((?:Fig|Tab|Eq|Sec|No|vol|al|e\.g|i\.e|cf|vs|Dr|[A-Z]))\.", "$1\u0001")
    parts = F.split(guarded, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.replace(s, F.lit("\u0001"), F.lit("."))), lambda s: F.trim(s) != "")


def numbers(text: Column) -> Column:
    """Numbers of a text in order, thousands marks closed; percent signs kept."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?%?)"), 1)
    return F.transform(found, lambda n: F.regexp_replace(F.replace(n, F.lit(","), F.lit("")), r"\.$", ""))


def has_negation(text: Column) -> Column:
    return F.lower(text).rlike(r"(^|[^a-z])(no|not|never|none|neither|nor|without|cannot|fails? to)([^a-z]|$)|n't([^a-z]|$)")


def entities(text: Column) -> Column:
    """Names in a text: words with a capital inside or after a letter, acronyms, and words with digits; distinct, sorted."""
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z]*[A-Z][A-Z]+[A-Za-z0-9-]*|[A-Z][a-z]+-[0-9]+|[A-Za-z]+[0-9]+)\b"), 1)
    return F.array_sort(F.array_distinct(found))


def pack_in_order(df: DataFrame, scope: list[str], order: list, size: Column, cap: int) -> DataFrame:
    """Rows with ``batch``: items in order fill a batch until the next would exceed the cap; a larger item stands alone.

    The running fill is one pass over a scope's rows in order, held as two numbers.
    """
    items = df.withColumn("_size", size.cast("long"))
    keyed = items.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(*order, "_size"))).alias("_items"))

    def place(rows: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("fill"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            fits = (acc["fill"] == 0) | (acc["fill"] + x["_size"] <= cap)
            batch = F.when(fits, acc["batch"]).otherwise(acc["batch"] + 1)
            fill = F.when(fits, acc["fill"] + x["_size"]).otherwise(x["_size"])
            return F.struct(fill.alias("fill"), batch.alias("batch"), F.concat(acc["out"], F.array(batch)).alias("out"))

        return F.aggregate(rows, start, step)["out"]

    placed = keyed.select(*scope, F.explode(F.arrays_zip("_items", let(F.col("_items"), place).alias("batch"))).alias("x"))
    return placed.select(*scope, F.col("x._items.*"), F.col("x.batch").alias("batch")).drop("_size")


def keep_first_distinct(df: DataFrame, scope: list[str], order: str, words: str, threshold: float) -> DataFrame:
    """Rows of each scope, in order, whose word set is not near (Jaccard) any row kept before. The choice is sequential,
    so a scope is one pass; scopes are sections or candidate lists, small by construction."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[set] = []
        chosen = []
        for i, w in zip(pdf.sort_values(order).index, pdf.sort_values(order)[words]):
            mine = set(w)
            if not any(len(mine & k) >= threshold * len(mine | k) for k in kept if mine | k):
                kept.append(mine)
                chosen.append(i)
        return pdf.loc[chosen]

    return df.groupBy(*scope).applyInPandas(run, df.schema)


def balanced_assignment(pairs: DataFrame, scope: list[str], item: str, target: str, score: str, cap: int | None = None) -> DataFrame:
    """Greedy assignment of items to targets by falling score, each item once, each target ``cap`` items at most (its even
    share, rounded up, by default); ties by item and target. Sequential within a scope (one question's queries)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        most = cap if cap is not None else -(-pdf[item].nunique() // max(1, pdf[target].nunique()))
        load: dict = {}
        done: set = set()
        chosen = []
        for row in pdf.sort_values([score, item, target], ascending=[False, True, True]).itertuples():
            i, t = getattr(row, item), getattr(row, target)
            if i not in done and load.get(t, 0) < most:
                done.add(i)
                load[t] = load.get(t, 0) + 1
                chosen.append(row.Index)
        return pdf.loc[chosen]

    return pairs.groupBy(*scope).applyInPandas(run, pairs.schema)
