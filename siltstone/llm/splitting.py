"""Splitting items that are over a size limit at natural boundaries.

Of each long text the offsets of its tokens and of its boundaries (paragraph, line, sentence, clause, word) are taken
once, as sorted arrays: the place of an offset among the tokens is their prefix sum. A cut is a binary search for the last
boundary of the best kind under the limit, the next piece starts at a boundary within the overlap before the cut, and
where a stretch has no boundary at all it is cut hard and stepped back all the same, never inside a letter and its marks.
Sizes are code points, or tokens of a public tokenizer. Nothing is shuffled: pieces are made where the rows are read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.tokens import TOKENIZER, token_offsets
from siltstone.sources import table

LIMIT, OVERLAP = 2000, 150
#: A boundary of a better kind is taken if it leaves a piece of at least this share of the limit.
LEAST_FILL = {"paragraph": 0.5, "line": 0.6, "sentence": 0.3, "clause": 0.5, "word": 0.0}
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = {"al", "approx", "cf", "ch", "dr", "e.g", "ed", "eds", "eq", "etc", "ff", "fig", "figs", "i.e", "incl", "mr", "mrs", "ms", "no", "nos", "p", "pp", "prof", "resp", "sec", "st", "tab", "vol", "vs"}

_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
_LINE = re.compile(r"\n\s*")
_SENTENCE = re.compile(r"""[.!?…]+["'”’)\]]*\s+|[。！？]+["'”’）」]*\s*""")
_CLAUSE = re.compile(r"[,;:–—]\s+|[，；：、]")
_WORD = re.compile(r"\s+")
_LAST_WORD = re.compile(r"([\w.]+)$")


def boundaries(text: str) -> dict[str, list[int]]:
    """Sorted offsets at which a new piece may start, by kind from the best to the worst."""
    sentence = []
    for m in _SENTENCE.finditer(text):
        before = _LAST_WORD.search(text, max(0, m.start() - 12), m.start())
        word = before.group(1).lower() if before else ""
        single = len(word) == 1 and word.isalpha() and text[m.start()] == "."
        if text[m.start()] == "." and (word in ABBREVIATIONS or single):
            continue
        sentence.append(m.end())
    return {
        "paragraph": [m.end() for m in _PARAGRAPH.finditer(text)],
        "line": [m.end() for m in _LINE.finditer(text)],
        "sentence": sentence,
        "clause": [m.end() for m in _CLAUSE.finditer(text)],
        "word": [m.end() for m in _WORD.finditer(text)],
    }


def _whole_letter(text: str, at: int, least: int) -> int:
    """Last offset up to ``at``, but over ``least``, that parts no letter from its marks and no joined signs."""
    best = at
    while best > least and best < len(text) and (unicodedata.category(text[best])[0] == "M" or text[best] == "\u200d" or text[best - 1] == "\u200d"):
        best -= 1
    return best if best > least else at


def split_offsets(text: str, limit: int = LIMIT, overlap: int = OVERLAP, tokens: list[int] | None = None) -> list[tuple[int, int]]:
    """(start, stop) of the pieces of a text: each at most ``limit`` long, together the whole text, consecutive ones
    sharing at most ``overlap``, and something where the overlap is not 0. A text within the limit is one piece, an empty
    one none. Sizes count code points, or the tokens that begin at the sorted offsets ``tokens``."""
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap smaller than it")
    size = len(text)

    def reach(start: int) -> int:
        """Offset up to which ``limit`` units fit that begin at ``start`` or later."""
        if tokens is None:
            return start + limit
        i = bisect_left(tokens, start) + limit
        return max(start + 1, tokens[i]) if i < len(tokens) else size

    def back(stop: int) -> int:
        """Offset ``overlap`` units before ``stop``."""
        if tokens is None:
            return stop - overlap
        return tokens[max(0, bisect_left(tokens, stop) - overlap)] if overlap else stop

    if reach(0) >= size:
        return [(0, size)] if size else []
    marks = boundaries(text)
    pieces, start = [], 0
    while True:
        far = reach(start)
        if far >= size:
            pieces.append((start, size))
            return pieces
        stop, room = 0, far - start
        for kind, offsets in marks.items():
            i = bisect_right(offsets, far) - 1
            if i >= 0 and offsets[i] > start + int(room * LEAST_FILL[kind]) and back(offsets[i]) > start:
                stop = offsets[i]
                break
        if not stop:
            stop = _whole_letter(text, far, start + room // 2)
        pieces.append((start, stop))
        first = max(back(stop), start + 1)
        begin = _whole_letter(text, first, start) if first < stop else stop
        if begin < back(stop):  # the step back would share more than the overlap
            begin = first
        for kind in ("sentence", "clause", "word"):
            offsets = marks[kind]
            i = bisect_left(offsets, first)
            if i < len(offsets) and offsets[i] < stop and offsets[i] > start:
                begin = offsets[i]
                break
        start = begin


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, tokenizer: str | None = None) -> DataFrame:
    """Pieces of the items (item_kind, item_key, item_no, text) that are longer than ``limit``.

    Columns: the three keys, ``piece_no`` from 0, ``n_pieces``, ``start``, ``stop`` and, if asked for, ``piece``. Null,
    empty and shorter texts give no row here; keys may be null or repeat, each row is split by itself; further columns
    are ignored; texts of any length are read whole. With the path of a ``tokenizer``, sizes are its tokens, counted in
    the whole text.
    """
    columns = "item_kind string, item_key string, item_no int, piece_no int, n_pieces int, start int, stop int" + ", piece string" * with_text

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets = token_offsets(tokenizer) if tokenizer else None
        for pdf in batches:
            rows = []
            for kind, key, no, text in zip(pdf["item_kind"], pdf["item_key"], pdf["item_no"], pdf["text"]):
                spans = split_offsets(text, limit, overlap, offsets(text) if offsets else None)
                if len(spans) < 2:
                    continue
                no = None if pd.isna(no) else int(no)
                rows += [(kind, key, no, i, len(spans), a, b, *([text[a:b]] * with_text)) for i, (a, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])

    long = items.where(F.length("text") > limit).select("item_kind", "item_key", F.col("item_no").cast("int").alias("item_no"), "text")
    return long.mapInPandas(pieces, columns)


def stored_items(parsed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every text that may be over the limit: sections, full texts of papers without sections, chunks."""
    sections = parsed.select(F.col("id").alias("item_key"), F.posexplode("sections").alias("item_no", "s"))
    sections = sections.select(F.lit("section").alias("item_kind"), "item_key", "item_no", F.col("s.text").alias("text"))
    bare = parsed.where(F.col("sections").isNull() | (F.size("sections") == 0))
    whole = bare.select(F.lit("full_text").alias("item_kind"), F.col("id").alias("item_key"), F.lit(-1).alias("item_no"), F.col("full_text").alias("text"))
    passages = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_key").alias("item_key"), F.col("chunk_id").alias("item_no"), "text")
    return sections.unionByName(whole).unionByName(passages)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_items(table(spark, sf_dir, "parsed_papers"), table(spark, sf_dir, "chunk_lookup"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_items(_stored(spark, sf_dir), with_text=False)
    return pieces.where((F.col("piece_no") == 0) & (F.col("n_pieces") > 1)).select("item_kind", "item_key", "item_no")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(_stored(spark, sf_dir))


def p3_token_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts in pieces of at most 512 tokens that share up to 40. A token is a code point at least, so that texts
    of 512 code points or fewer need no look."""
    return split_items(_stored(spark, sf_dir), 512, 40, tokenizer=TOKENIZER)
