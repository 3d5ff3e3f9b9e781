"""Token counts of texts with a public tokenizer's rank file."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern that splits a text before the merges of such rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str = RANKS):
    """The tokenizer of a rank file; once for each worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str | Column, path: str = RANKS) -> Column:
    """Number of tokens of a whole text; 0 for null and empty texts. Faulty UTF-8 is replaced first."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(F.make_valid_utf8(F.col(text) if isinstance(text, str) else text))
