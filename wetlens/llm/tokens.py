"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rank file of the tokenizer; every executor reads it at this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def tokenizer(path: str = VOCABULARY):
    """The tokenizer of a rank file, loaded once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text, whole; NULL for NULL."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer(path).encode_ordinary
        for b in batches:
            yield pd.Series([None if s is None else len(encode(s)) for s in b], dtype="Int64")

    return count(text)


def sized(documents: DataFrame, *keep: str, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, keep...) of the documents whose text is not NULL."""
    d = documents.filter("text is not null and doc_id is not null")
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, n_tokens(F.col("text"), path).alias("n_tokens"))
