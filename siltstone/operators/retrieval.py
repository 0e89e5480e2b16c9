"""Lexical retrieval: BM25, passages that contain a quote, near-equal word sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import jaccard, let, words

K1, B = 1.5, 0.75


def bm25(docs: DataFrame, doc: str, text: str, queries: DataFrame, query: str, question: str) -> DataFrame:
    """BM25 score of every (query, document) that share a word. Only the words of the queries are counted and shuffled;
    document lengths and the corpus size come from all documents."""
    tokens = docs.select(doc, words(F.col(text)).alias("w")).withColumn("n", F.size("w"))
    corpus = tokens.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("mean"))
    asked = queries.select(query, F.explode(F.array_distinct(words(F.col(question)))).alias("t"))
    wanted = asked.select("t").distinct()
    tf = tokens.select(doc, "n", F.explode("w").alias("t")).join(wanted, "t", "left_semi").groupBy(doc, "n", "t").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(df, "t").crossJoin(F.broadcast(corpus))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return asked.join(scored.select(doc, "t", part.alias("part")), "t").groupBy(query, doc).agg(F.round(F.sum("part"), 6).alias("score"))


def containing(pieces: DataFrame, piece: str, needle: str, texts: DataFrame, key: str, text: str, scope: list[str]) -> DataFrame:
    """Pairs (piece, key) of one scope whose text contains the needle.

    Needles of five words or more meet the texts by their second to fourth word, which stand in a text as whole words
    wherever the needle does; only hashed keys are shuffled for that, and the texts of the pairs found are read after.
    Shorter needles meet all texts of their scope.
    """
    words_of = F.split(F.col(needle), " ")
    left = pieces.select(*scope, piece, needle, words_of.alias("_w")).where(F.length(needle) > 0)
    inner = F.xxhash64(F.array_join(F.slice("_w", 2, 3), " "))

    def runs(tokens: Column) -> Column:
        last = F.greatest(F.size(tokens) - 2, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, 3), " ")))

    grams = F.array_distinct(let(F.split(F.col(text), " "), runs))
    asked = left.where(F.size("_w") >= 5).select(*scope, piece, inner.alias("_k"))
    offered = texts.where(F.col(text).isNotNull()).select(*scope, key, F.explode(grams).alias("_k"))
    pairs = asked.join(offered, [*scope, "_k"]).select(*scope, piece, key)
    short = left.where(F.size("_w") < 5).select(*scope, piece).join(texts.select(*scope, key), scope)
    found = pairs.unionByName(short).distinct()
    whole = found.join(left.select(*scope, piece, needle), [*scope, piece]).join(texts.select(*scope, key, text), [*scope, key])
    return whole.where(F.col(text).contains(F.col(needle))).select(*scope, piece, key).distinct()


def jaccard_pairs(left: DataFrame, key: str, a: str, right: DataFrame, other: str, b: str, least: tuple[int, int], scope: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (key, other) with the ``jaccard`` similarity of their sets ``a`` and ``b``, all that reach the fraction
    ``least``, which is over a half; empty sets pair with none. With ``scope``, columns of both sides, only rows that are
    equal in these meet. No side is broadcast, as all of them grow with the tables.

    Sets of n values overlap in t = ceil(least * n) at least, so in one order of all values, rare ones first, m <= t of
    the values they share stand among the first n - t + m of either set: the sets meet by threes of those, small ones
    (t < 3, and what they may pair with) by twos; a set of one value has only itself as partner. Equal sets meet once;
    every pair is verified with the sets of its rows.
    """
    part, whole = least
    if not whole < 2 * part <= 2 * whole:
        raise ValueError("least must be over 1/2 and 1 at most")
    ways = ((left, key, a), (right, other, b))
    within = F.xxhash64(*scope) if scope else F.lit(0).cast("long")
    sides = [df.select(k, F.array_sort(F.array_distinct(v)).alias(v), within.alias(f"_w{v}")).where(F.size(v) > 0).withColumn(f"_h{v}", F.xxhash64(v, f"_w{v}")) for df, k, v in ways]
    sets = [side.select(F.col(v).alias("_s"), F.col(f"_h{v}").alias("_h"), F.col(f"_w{v}").alias("_in")).distinct() for side, v in zip(sides, (a, b))]
    counts = sets[0].unionByName(sets[1]).select(F.explode("_s").alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))

    def twos(head: Column) -> Column:
        later = lambda i: F.slice(head, i + 1, F.size(head))
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(head) - 1), lambda i: F.transform(later(i), lambda w: F.xxhash64(F.element_at(head, i), w))))

    def threes(head: Column) -> Column:
        def ending(i: Column) -> Column:
            first = lambda j: F.transform(F.sequence(F.lit(1), j - 1), lambda h: F.xxhash64(F.element_at(head, h), F.element_at(head, j), F.element_at(head, i)))
            return F.flatten(F.transform(F.sequence(F.lit(2), i - 1), first))

        return F.flatten(F.transform(F.sequence(F.lit(3), F.size(head)), ending))

    def offered(side: DataFrame, h: str) -> DataFrame:
        values = side.select("_s", "_h", "_in", F.explode("_s").alias("_w")).join(counts.hint("merge"), "_w")
        ordered = values.groupBy("_s", "_h", "_in").agg(F.array_sort(F.collect_list(F.struct("_n", "_w"))).alias("_o"))
        size, none = F.size("_s"), F.array().cast("array<bigint>")
        shared = F.floor((part * size + whole - 1) / whole)
        first = lambda m: F.slice(F.col("_o._w"), 1, (size - shared + m).cast("int"))
        few = F.when(size == 1, F.transform("_s", lambda w: F.xxhash64(w, w))).when(size <= 2 * whole // part * whole // part, let(first(2), twos)).otherwise(none)
        many = F.when(shared >= 3, let(first(3), threes)).otherwise(none)
        met = ordered.select("_in", F.col("_h").alias(h), size.alias(f"{h}n"), F.explode(F.concat(few, many)).alias("_k"))
        return met.withColumn("_k", F.xxhash64("_k", "_in")).drop("_in") if scope else met.drop("_in")

    x, y = offered(sets[0], f"_h{a}"), offered(sets[1], f"_h{b}")
    sizes = whole * F.least(f"_h{a}n", f"_h{b}n") >= part * F.greatest(f"_h{a}n", f"_h{b}n")
    pairs = x.join(y.hint("merge"), "_k").where(sizes).select(f"_h{a}", f"_h{b}").distinct()
    found = pairs.hint("merge").join(sides[0].hint("merge"), f"_h{a}").join(sides[1].hint("merge"), f"_h{b}").where(F.col(f"_w{a}") == F.col(f"_w{b}")).withColumn("jaccard", F.round(jaccard(F.col(a), F.col(b)), 6))
    return found.where(F.col("jaccard") >= part / whole).select(key, other, "jaccard")


def near_strings(left: DataFrame, a: str, right: DataFrame, b: str, letters: int) -> DataFrame:
    """Pairs of distinct strings (a, b) within one edit for every ``letters`` letters of the longer one, all of them.

    The partner of a string of n letters is at most n * letters / (letters - 1) long, so k = n // (letters - 1) bounds
    the edits. Each ``b`` is cut into k + 1 segments of fixed width from its start; of these one, the i-th, is whole
    with i edits before it, so ``a`` holds it shifted by at most i places. Strings under ``letters - 1`` meet whole.
    """
    step = letters - 1
    n, none = F.length(a), F.array().cast("array<bigint>")

    def width(k: Column) -> Column:
        return F.floor(k * step / (k + 1)).cast("int")

    def cut(k: Column) -> Column:
        places = F.transform(F.sequence(F.lit(0), k), lambda i: F.xxhash64(k, i, F.substring(b, i * width(k) + 1, width(k))))
        return F.when(k == 0, F.array(F.xxhash64(k, F.lit(0), F.col(b)))).otherwise(places)

    def asked(k: Column) -> Column:
        def around(i: Column) -> Column:
            at = F.sequence(F.greatest(i * width(k) - i, F.lit(0)), i * width(k) + i)
            return F.transform(at, lambda x: F.xxhash64(k, i, F.substring(a, x + 1, width(k))))

        return F.when(k == 0, F.array(F.xxhash64(k, F.lit(0), F.col(a)))).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), k), around)))

    lowest, highest = F.floor(F.ceil(n * step / letters) / step).cast("int"), F.floor(F.floor(n * letters / step) / step).cast("int")
    keys = F.flatten(F.transform(F.sequence(lowest, highest), lambda k: let(k, asked)))
    x = left.select(a, F.explode(F.array_distinct(F.coalesce(keys, none))).alias("_k"))
    y = right.select(b, F.explode(let(F.floor(F.length(b) / step).cast("int"), cut)).alias("_k"))
    longest = F.greatest(F.length(a), F.length(b))
    near = F.expr(f"levenshtein(`{a}`, `{b}`, cast(greatest(length(`{a}`), length(`{b}`)) div {letters} as int)) >= 0")
    close = letters * F.abs(F.length(a) - F.length(b)) <= longest
    return x.join(y, "_k").where(close).where(near).select(a, b).distinct()


def shingle_set(text: Column, size: int = 5) -> Column:
    """Distinct hashes of the word runs of a text; the whole text where it is shorter."""

    def runs(w: Column) -> Column:
        last = F.greatest(F.size(w) - (size - 1), F.lit(1))
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " "))))

    return F.array_distinct(let(words(text), runs))
