"""Token counts by a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Batch encoder of a tokenizer file: ``.tiktoken`` ranks, ``.json`` or a sentencepiece ``.model``. No special tokens.

    A Python worker loads a file once, for all of its tasks.
    """
    loaded = sys.__dict__.setdefault("_siltstone_encoders", {})
    if path not in loaded:
        loaded[path] = _load(path)
    return loaded[path]


def _tiktoken(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _load(path: str) -> Callable[[list[str]], list[list[int]]]:
    if path.endswith(".tiktoken"):
        own = _tiktoken(path)
        return lambda texts: [own.encode_ordinary(t) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        fast = Tokenizer.from_file(path)
        fast.encode_special_tokens = True
        return lambda texts: [e.ids for e in fast.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: pieces.encode(texts, num_threads=1)


def token_offsets(path: str) -> Callable[[str], list[int]]:
    """Function from a text to the sorted code-point offsets at which its tokens begin, of a ``.tiktoken`` or ``.json``
    file. Tokens of less than a letter (bytes of it) begin where the letter does."""
    loaded = sys.__dict__.setdefault("_siltstone_offsets", {})
    if path not in loaded:
        if path.endswith(".tiktoken"):
            own = _tiktoken(path)
            loaded[path] = lambda text: own.decode_with_offsets(own.encode_ordinary(text))[1]
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            fast = Tokenizer.from_file(path)
            loaded[path] = lambda text: sorted(a for a, _ in fast.encode(text, add_special_tokens=False).offsets)
        else:
            raise ValueError("token offsets need a .tiktoken or .json tokenizer")
    return loaded[path]


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` without its text, with ``tokens``, the text's length in tokens. Null texts are left out, empty ones have
    none. Only the text and the other columns given are sent to Python; counting needs no shuffle."""
    keep = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "tokens bigint"])
    names = [f.name for f in keep]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for pdf in batches:
            out = pdf[names].copy()
            out["tokens"] = [len(ids) for ids in encode(list(pdf[text]))]
            yield out

    return docs.where(F.col(text).isNotNull()).mapInPandas(count, schema)
