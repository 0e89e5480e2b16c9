import math

from siltstone.llm import packing
from siltstone.llm.tokens import TOKENIZER, encoder, token_counts


def frame(spark, sizes, extra=False):
    return spark.createDataFrame([(i, 0, 0, s, "x") for i, s in enumerate(sizes)], "doc_id long, piece_no int, start long, tokens long, container_id string")


def check(rows, sizes, capacity):
    assert sorted((r.doc_id, r.tokens) for r in rows) == sorted((i, s) for i, s in enumerate(sizes) if s is not None)
    fill = {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
    assert all(f <= capacity for f in fill.values())
    return fill


def test_items_are_placed_once_and_space_is_used(spark):
    sizes = [(i * 7919) % 700 + 1 for i in range(6000)]
    fill = check(packing.pack(frame(spark, sizes).repartition(40)).collect(), sizes, packing.CAPACITY)
    assert len(fill) <= 1.02 * math.ceil(sum(sizes) / packing.CAPACITY)


def test_awkward_sizes(spark):
    sizes = [2048, 2048, 1025, 1025, 1025, 0, 0, None, 1]
    fill = check(packing.pack(frame(spark, sizes)).collect(), sizes, packing.CAPACITY)
    assert len(fill) == 5
    assert packing.pack(frame(spark, [])).count() == 0


def test_only_larger_texts_are_split(spark):
    counted = spark.createDataFrame([(1, 0), (2, 2048), (3, 2049), (4, 5000)], "doc_id long, tokens long")
    got = sorted((r.doc_id, r.piece_no, r.start, r.tokens) for r in packing.items_of(counted).collect())
    assert got == [(1, 0, 0, 0), (2, 0, 0, 2048), (3, 0, 0, 2048), (3, 1, 2048, 1), (4, 0, 0, 2048), (4, 1, 2048, 2048), (4, 2, 4096, 904)]


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|> 中文 😀" * 5)], "doc_id long, text string")
    encode = encoder(TOKENIZER)
    got = {r.doc_id: r.tokens for r in token_counts(docs).collect()}
    assert got == {1: len(encode(["Hello world"])[0]), 2: 0, 4: len(encode(["<|endoftext|> 中文 😀" * 5])[0])} and got[1] == 2
    other = {r.doc_id: r.tokens for r in token_counts(docs, tokenizer="/opt/tokenizers/byte_bpe_50k.json").collect()}
    assert other == got


def test_corpus(spark, tiny):
    report = packing.p6_report(spark, tiny).first()
    assert report.used_share > 0.9 and report.containers >= report.least_containers
