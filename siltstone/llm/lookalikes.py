"""One form for visually identical text.

Compatibility normalisation of what looks the same (wide letters, ligatures, unit signs; not raised or circled digits),
deletion of ignorable characters, one kind of space; then every token is a lattice: at each position the letters of all
scripts that have the stored letter's shape, accents apart. The spelling of the best path, found by Viterbi under
character n-gram scores of each script, is the token's form. Scores and priors depend on shapes alone, so that texts of
equal looks have equal lattices and get equal forms.

A text whose unmistakable letters all belong to one script is spelled in that script wherever it has the letters; n-gram
scores decide where it has not, in texts of several scripts, and in texts without any unmistakable letter.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import materialize
from siltstone.sources import table

# Letters of equal shape, Latin letter and its twins.
CYRILLIC_TWINS = {"A": "А", "B": "В", "C": "С", "E": "Е", "G": "Ԍ", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "Q": "Ԛ", "S": "Ѕ", "T": "Т", "V": "Ѵ", "W": "Ԝ", "X": "Х", "Y": "Ү", "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "l": "ӏ", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "v": "ѵ", "w": "ԝ", "x": "х", "y": "у"}
GREEK_TWINS = {"A": "Α", "B": "Β", "C": "Ϲ", "E": "Ε", "H": "Η", "I": "Ι", "J": "Ϳ", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ", "c": "ϲ", "j": "ϳ", "o": "ο", "v": "ν"}
ARMENIAN_TWINS = {"O": "Օ", "h": "հ", "o": "օ"}
# Ranges of characters that are not drawn.
IGNORABLE = [(0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
SCRIPTS = ("latin", "greek", "cyrillic", "armenian")
#: Log scores: of changing the script inside a token, of an unseen pair of letters, of a token (or changed letter) in
#: another script than the text's leading one, and of a letter outside the only script of the text.
SWITCH, UNSEEN, AWAY, FOREIGN = -9.0, -12.0, -14.0, -1000.0

_IGNORED = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE) + "]")
_MARKS = "̀-ͯ"
_TOKENS = re.compile(rf"(?:[^\W\d_][{_MARKS}]*)+")
_UNITS = re.compile(rf"([^\W\d_])([{_MARKS}]*)")
_TABLES = (GREEK_TWINS, CYRILLIC_TWINS, ARMENIAN_TWINS)
_CLASSES = {c: members for latin in {x for t in _TABLES for x in t} for members in [(latin, *(t.get(latin) for t in _TABLES))] for c in members if c}


def _same_look(char: str) -> str:
    """The plain characters a compatibility character looks like, or the character itself."""
    kind = unicodedata.decomposition(char)
    category = unicodedata.category(char)
    if category == "Zs":
        return " "
    if char in "‐‑":
        return "-"
    if not kind.startswith("<"):
        return char
    tag, *codes = kind.split()
    plain = "".join(chr(int(c, 16)) for c in codes)
    wide = tag in ("<wide>", "<narrow>") and category[0] in "LN"
    joined = tag == "<compat>" and category[0] == "L" and not plain.startswith(" ") and char not in "ſ"
    return plain if wide or joined else char


class _Looks(dict):
    """Translation table filled as characters come up."""

    def __missing__(self, code: int) -> str:
        self[code] = found = _same_look(chr(code))
        return found


def decomposed(text: str, looks: dict) -> str:
    """A text without ignorable characters, same-looking ones unified, accents apart from their letters; the letters
    are those stored."""
    plain = _IGNORED.sub("", text.replace("\r\n", "\n"))
    return unicodedata.normalize("NFD", plain.translate(looks)) if not plain.isascii() else plain


def script_of(char: str) -> int | None:
    """Index of the only script a letter can belong to by its shape; None for shared shapes and other scripts."""
    if char in _CLASSES:
        return None
    code = ord(char)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return 0
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return 1
    if 0x400 <= code < 0x530:
        return 2
    return 3 if 0x530 <= code < 0x590 else None


def readings(char: str) -> dict[int, str]:
    """A position of the lattice: the letters of this shape by script; -1 for a letter of no script listed here."""
    if char in _CLASSES:
        return {k: c for k, c in enumerate(_CLASSES[char]) if c}
    k = script_of(char)
    return {-1 if k is None else k: char}


def learn_bigrams(docs: DataFrame, text: str = "text") -> dict[tuple[int, str, str], int]:
    """Counts of letter bigrams per script over all texts, from the tokens that hold letters of one script only.

    Tokens are counted by Spark first (words repeat), only distinct ones reach Python, and a worker sends at most one row
    per bigram; the sums reach the driver, no more of them than pairs of letters in the alphabets, whatever the number of
    texts.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        looks, total = _Looks(), Counter()
        for pdf in batches:
            for token, n in zip(pdf["token"], pdf["n"]):
                for word in _TOKENS.findall(decomposed(token, looks)):
                    letters = [m[0] for m in _UNITS.findall(word)]
                    scripts = {script_of(c) for c in letters} - {None}
                    if len(scripts) != 1:
                        continue
                    k = next(iter(scripts))
                    own = ["^", *(readings(c).get(k) for c in letters), "$"]
                    for a, b in zip(own, own[1:]):
                        if a and b:
                            total[k, a, b] += int(n)
        yield pd.DataFrame([(*key, n) for key, n in total.items()], columns=["script", "a", "b", "n"])

    tokens = docs.where(F.col(text).isNotNull()).select(F.explode(F.split(text, r"[\s\p{Z}\p{P}\p{S}\p{N}]+")).alias("token"))
    tokens = tokens.where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counted = tokens.mapInPandas(count, "script int, a string, b string, n bigint")
    rows = counted.groupBy("script", "a", "b").agg(F.sum("n").alias("n")).collect()
    return {(r["script"], r["a"], r["b"]): r["n"] for r in rows}


def log_scores(counts: dict[tuple[int, str, str], int]) -> dict[tuple[int, str, str], float]:
    firsts: Counter = Counter()
    for (k, a, _), n in counts.items():
        firsts[k, a] += n
    return {(k, a, b): max(UNSEEN, math.log((n + 0.1) / (firsts[k, a] + 10))) for (k, a, b), n in counts.items()}


def best_path(token: str, scores: dict, start: tuple[float, ...], letter: tuple[float, ...] = (0.0,) * len(SCRIPTS)) -> str:
    """Best spelling of a decomposed token: at each position one letter of the same shape, accents kept.

    ``start`` is the price of beginning (or changing to) a script, ``letter`` of each letter in it. Equal scores go to
    the earlier script.
    """
    states: dict[int, tuple[float, str, str]] = {}
    for i, (char, marks) in enumerate(_UNITS.findall(token)):
        new: dict[int, tuple[float, str, str]] = {}
        for k, c in readings(char).items():
            own = letter[k] if k >= 0 else 0.0
            if not i:
                new[k] = ((start[k] + scores.get((k, "^", c), UNSEEN) if k >= 0 else 0.0) + own, c, c + marks)
                continue
            best = None
            for j, (score, last, path) in states.items():
                step = scores.get((k, last, c), UNSEEN) if j == k else SWITCH + (start[k] if k >= 0 else 0.0)
                if best is None or score + step + own > best[0] + 1e-12:
                    best = (score + step + own, c, path + c + marks)
            new[k] = best
        states = new
    ranked = sorted(states.items(), key=lambda x: (-round(x[1][0] + scores.get((x[0], x[1][1], "$"), UNSEEN), 9), x[0]))
    return ranked[0][1][2]


class Unifier:
    """Brings texts to one form; remembers the paths of tokens."""

    def __init__(self, scores: dict, most: int = 200_000):
        self.scores, self.most, self.looks, self.known = scores, most, _Looks(), {}

    def path(self, token: str, lead: int, pure: bool) -> str:
        """Best path of a token of a text whose leading script is ``lead``, the only one of its unmistakable letters if
        ``pure``. A token whose own unmistakable letters are of one script is led by that."""
        key = (token, lead, pure)
        if key not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            own = {script_of(c) for c in token if c.isalpha()} - {None}
            first = next(iter(own)) if len(own) == 1 else lead
            start = tuple(0.0 if k == first else AWAY for k in range(len(SCRIPTS)))
            letter = tuple(0.0 if k == first or not (pure or len(own) == 1) else FOREIGN for k in range(len(SCRIPTS)))
            self.known[key] = best_path(token, self.scores, start, letter)
        return self.known[key]

    def unify(self, text: str) -> str:
        plain = decomposed(text, self.looks)
        kinds = Counter({c: plain.count(c) for c in set(plain) if c.isalpha()})
        seen: Counter = Counter()
        for c, n in kinds.items():
            if (s := script_of(c)) is not None:
                seen[s] += n
        lead = max(range(len(SCRIPTS)), key=lambda k: (seen.get(k, 0), -k))
        pure = len(seen) == 1
        if pure:  # a token that the only script spells as it stands is its own best path: only the others are searched
            odd = "".join(c for c in kinds if c in _CLASSES and _CLASSES[c][lead] != c)
            if odd:
                search = re.compile(rf"(?:[^\W\d_][{_MARKS}]*)*[{odd}](?:[^\W\d_]|[{_MARKS}])*")
                plain = search.sub(lambda m: self.path(m.group(0), lead, True), plain)
        else:
            plain = _TOKENS.sub(lambda m: self.path(m.group(0), lead, False), plain)
        return unicodedata.normalize("NFC", plain)


def _key(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def unify_texts(docs: DataFrame, scores: dict, text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, ``form`` (a 128-bit key of the canonical text), ``raw`` (one of the text as stored), and the canonical
    text if asked for. Null texts are left out; empty ones are a text; ids may repeat; whole texts are read.

    A text of ASCII characters with a letter only Latin has is its own best path, line ends aside; it is keyed by Spark
    and never sent to Python.
    """
    columns = "doc_id bigint, form string, raw string" + ", canonical string" * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unifier = Unifier(scores)
        for pdf in batches:
            forms = [unifier.unify(t) for t in pdf[text]]
            out = {"doc_id": pdf["doc_id"], "form": [_key(f) for f in forms], "raw": [_key(t) for t in pdf[text]]}
            yield pd.DataFrame(out | ({"canonical": forms} if with_text else {}))

    some = docs.where(F.col(text).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias(text))
    only_latin = "".join(c for c in map(chr, range(65, 123)) if c.isalpha() and c not in _CLASSES)
    plain = (F.octet_length(text) == F.char_length(text)) & F.col(text).rlike(f"[{only_latin}]")
    searched = some.where(~plain).mapInPandas(run, columns)
    same = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    kept = some.where(plain).select("doc_id", F.md5(F.encode(same, "UTF-8")).alias("form"), F.md5(F.encode(text, "UTF-8")).alias("raw"), *([same.alias("canonical")] * with_text))
    return kept.unionByName(searched)


def lookalike_pairs(docs: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: texts of one form that differ in a character. Plain copies are no pair.

    Only forms with two different texts or more are joined, on the form; a hot form's side is split by Spark's skew
    join.
    """
    scores = log_scores(learn_bigrams(docs))
    keys = materialize(unify_texts(docs, scores, with_text=False), "forms")
    mixed = keys.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where(F.col("lo") != F.col("hi")).select("form")
    some = keys.join(mixed, "form", "left_semi")
    a, b = some.select("form", F.col("doc_id").alias("doc_a"), F.col("raw").alias("raw_a")), some.select("form", F.col("doc_id").alias("doc_b"), F.col("raw").alias("raw_b"))
    return a.join(b, "form").where((F.col("doc_a") < F.col("doc_b")) & (F.col("raw_a") != F.col("raw_b"))).select("doc_a", "doc_b")


def lookalike_classes(docs: DataFrame) -> DataFrame:
    """Membership instead of pairs: doc_id, ``class_id`` (smallest doc_id of its form), and the number of documents and
    of different texts of the class. One row per document with a text, however hot a form is."""
    keys = materialize(unify_texts(docs, log_scores(learn_bigrams(docs)), with_text=False), "forms")
    per_text = keys.groupBy("form", "raw").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    sizes = per_text.groupBy("form").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_texts"))
    return keys.join(sizes, "form").select("doc_id", "class_id", "n_docs", "n_texts")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its one form, and whether that changed it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = log_scores(learn_bigrams(docs))
    out = unify_texts(docs, scores)
    return out.select("doc_id", "canonical", (F.md5(F.encode("canonical", "UTF-8")) != F.col("raw")).alias("changed"))
