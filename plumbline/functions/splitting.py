"""Splitting by a tokenizer's count, for which SQL has no expression."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def token_runs(text: str, count: Callable[[str], int], limit: int = 500, overlap: int = 35, reserve: int = 20) -> list[str]:
    """Runs of words of at most ``limit`` tokens, each starting ``overlap`` words before the last one's end.

    A run takes words while their single counts sum to limit - reserve, then gives up words while the
    count of the joined run exceeds the limit. A single word beyond the limit is a run of its own, for
    the token limit check to report.
    """
    words = text.split()
    sums = [0, *accumulate(count(w if i == 0 else f" {w}") for i, w in enumerate(words))]
    out, start = [], 0
    while start < len(words):
        end = max(start + 1, bisect_right(sums, sums[start] + limit - reserve) - 1)
        while end > start + 1 and count(" ".join(words[start:end])) > limit:
            end -= 1
        out.append(" ".join(words[start:end]))
        start = len(words) if end == len(words) else max(start + 1, end - overlap)
    return out


def split_tokens(text: Column, make_counter: Callable[[], Callable[[str], int]], limit: int = 500, overlap: int = 35, reserve: int = 20) -> Column:
    """token_runs of each text; ``make_counter`` is called once per batch, in the task. Null has no runs."""
    if limit < 1 or overlap < 0 or not 0 <= reserve < limit:
        raise ValueError("limit must be positive, overlap not negative, reserve below the limit")

    @F.pandas_udf(ArrayType(StringType()))
    def f(s: pd.Series) -> pd.Series:
        count = make_counter()
        return s.map(lambda t: [] if t is None else token_runs(t, count, limit, overlap, reserve))

    return f(text)
