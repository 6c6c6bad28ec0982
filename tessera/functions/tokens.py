"""Token counters over vocabulary files, for budgets in a model's own tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tiktoken_counter(path: str, pattern: str):
    """A column function counting the tokens of a rank file; one load per Python worker."""
    held: dict = {}

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        if not held:
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            held["coder"] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return texts.fillna("").map(lambda t: len(held["coder"].encode_ordinary(t)))

    return lambda text: count(F.col(text) if isinstance(text, str) else text)


def library_counter(path: str):
    """The same over a tokenizers .json."""
    held: dict = {}

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        if not held:
            from tokenizers import Tokenizer

            held["coder"] = Tokenizer.from_file(path)
        return pd.Series([len(e.ids) for e in held["coder"].encode_batch(texts.fillna("").tolist(), add_special_tokens=False)])

    return lambda text: count(F.col(text) if isinstance(text, str) else text)


def token_windows(ids: Column, size: int = 512, overlap: int = 64) -> Column:
    """Windows of ``size`` ids every ``size - overlap``; the last may be overlap only."""
    starts = F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.size(ids) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(ids, s + 1, size))
