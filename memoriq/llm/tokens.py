"""Token counts by a public tokenizer whose rank file is a parameter."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank file of a byte-level BPE; set MEMORIQ_TOKENIZER or pass a path.
DEFAULT_RANKS = os.environ.get("MEMORIQ_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the public pre-tokenizer pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(path: str = DEFAULT_RANKS):
    """A vectorised UDF: text -> number of tokens (0 for null)."""
    held: list = []

    def count(texts: pd.Series) -> pd.Series:
        if not held:  # once per Python worker
            held.append(load_encoding(path))
        encode = held[0].encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, "long")


def with_token_counts(docs: DataFrame, text: str | Column = "text", out: str = "n_tokens", path: str = DEFAULT_RANKS) -> DataFrame:
    return docs.withColumn(out, token_count(path)(F.col(text) if isinstance(text, str) else text))
