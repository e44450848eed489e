"""How alike several runs over one recording are."""

from __future__ import annotations

import difflib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import plain
from .ranges import ordered


#: Letters of an anchor, and of a gap that is aligned letter by letter.
ANCHOR, GAP = 16, 1000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _once(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places of the runs of `n` letters that come once."""
    keys, factor = np.zeros(max(0, len(codes) - n + 1), np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for k in range(n):
        keys = keys * factor + codes[k : k + len(keys)]
    found, first, times = np.unique(keys, return_index=True, return_counts=True)
    return found[times == 1], first[times == 1]


def _rising(values: np.ndarray) -> list[int]:
    """Places of a longest rising subsequence."""
    tops: list[int] = []
    ends: list[int] = []
    came = [-1] * len(values)
    for k, x in enumerate(values.tolist()):
        at = bisect_left(tops, x)
        came[k] = ends[at - 1] if at else -1
        tops[at : at + 1], ends[at : at + 1] = [x], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = came[k]
    return out[::-1]


def matching(a: str, b: str) -> int:
    """Letters that an alignment of two texts matches, in time near their length.

    Runs of `ANCHOR` letters that come once in both are anchors; the longest sequence of them that
    rises in both texts stays, and only the gaps between are aligned: short ones letter by
    letter, long ones with anchors of half the length, and at last part by part.
    """
    return _matching(a, b, ANCHOR)


def _matching(a: str, b: str, n: int) -> int:
    if a == b or not a or not b:
        return min(len(a), len(b))
    if len(a) <= GAP and len(b) <= GAP:
        return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    if n < 4:
        parts = -(-max(len(a), len(b)) // GAP)
        cut = lambda x, k: x[len(x) * k // parts : len(x) * (k + 1) // parts]
        return sum(_matching(cut(a, k), cut(b, k), n) for k in range(parts))
    (x, i), (y, j) = _once(_codes(a), n), _once(_codes(b), n)
    _, left, right = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    i, j = i[left], j[right]
    order = np.argsort(i)
    i, j = i[order], j[order]
    total = done_a = done_b = 0
    for k in _rising(j):
        p, q = int(i[k]), int(j[k])
        if p >= done_a and q >= done_b:
            total += _matching(a[done_a:p], b[done_b:q], n // 2) + n
        elif p - q == done_a - done_b:  # goes on from the anchor before
            total += p + n - done_a
        else:
            continue
        done_a, done_b = p + n, q + n
    return total + _matching(a[done_a:], b[done_b:], n // 2)


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([round(2 * matching(x, y) / (len(x) + len(y)), 4) if x or y else 1.0 for x, y in zip(a, b)], dtype="float64")


def stability(sentences: DataFrame) -> DataFrame:
    """rec_id, run_a, run_b and whether two runs have as many sentences, the same (start, end,
    spk) one after the other and the same text without marks and signs, and the ratio of
    matching text.  `sentences`: rec_id, run, line_no, start, end, spk, text."""
    place = F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce(F.col("spk").cast("string"), F.lit("")))
    runs = sentences.groupBy("rec_id", "run").agg(
        F.count(F.lit(1)).alias("n"), F.md5(ordered(place, "line_no", separator=",")).alias("places"), ordered(plain(F.coalesce("text", F.lit(""))), "line_no").alias("whole")
    )
    a, b = (runs.select("rec_id", *[F.col(c).alias(f"{c}_{x}") for c in ("run", "n", "places", "whole")]) for x in "ab")
    both = a.join(b, "rec_id").filter("run_a < run_b")
    return both.select(
        "rec_id", "run_a", "run_b", (F.col("n_a") == F.col("n_b")).alias("same_count"), (F.col("places_a") == F.col("places_b")).alias("same_places"),
        (F.col("whole_a") == F.col("whole_b")).alias("same_text"), _ratio("whole_a", "whole_b").alias("text_ratio"),
    )
