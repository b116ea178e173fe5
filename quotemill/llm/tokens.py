"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie; a parameter of every function that needs them.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that the vocabulary's tokens are cut by, as its publisher states it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """The tokens of a text, whole and with strings of special tokens taken for ordinary text; 0 for null and empty ones."""
    path = os.path.join(folder, vocabulary)

    @F.pandas_udf(T.IntegerType())
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int32")

    return counts(text)


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, the columns of keep, and n_tokens: a narrow table, so that later steps never carry the texts."""
    return docs.select(F.col(key), *keep, count(F.col(text), folder, vocabulary).alias("n_tokens"))
