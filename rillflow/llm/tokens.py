"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file is a parameter and is read by the executors from its path. Defined cases: a null text has null
tokens, an empty one 0; whole texts are counted, special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the public byte-level BPE vocabularies cut texts into pieces before merging; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs without a break of more characters are cut: the tokenizer's matcher recurses over runs of white space.
LONGEST_PIECE = 100_000


@cache
def encoding(vocabulary: str):  # noqa: ANN201
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_LONG = re.compile(r"\S{%d,}|\s{%d,}" % (LONGEST_PIECE, LONGEST_PIECE))


def encode(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """Token ids of a whole text; runs without a break longer than LONGEST_PIECE are encoded in parts of that length."""
    coder = encoding(vocabulary)
    if len(text) < LONGEST_PIECE or not _LONG.search(text):
        return coder.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for m in _LONG.finditer(text):
        ids += coder.encode_ordinary(text[at : m.start()])
        for i in range(m.start(), m.end(), LONGEST_PIECE):
            ids += coder.encode_ordinary(text[i : min(i + LONGEST_PIECE, m.end())])
        at = m.end()
    return ids + coder.encode_ordinary(text[at:])


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else len(encode(t, vocabulary)) for t in texts], dtype="Int64")

    # Else a filter on the count would be pushed below it and count again.
    return count.asNondeterministic()(text)
