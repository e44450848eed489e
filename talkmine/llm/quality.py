"""Quality by Bradley-Terry ranking: preference pairs, logistic loss, score quantile."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import texts
from .toxicity import HELD_OUT

#: Labelled documents that the ranking is fitted on at most, and its pairs.
TRAIN_DOCS = 16_000
PAIRS = 40_000
SCALE = 1.0
MARKS = "|!#$%&*,.;:?\"'()-_=<>/@+"
SENTENCE = re.compile(r"[.!?]+\s")
RIDGE = 1e-3


def features(text: str) -> list[float]:
    """Shape of a whole text: kinds of characters, words, lines and their repeats."""
    n = max(1, len(text))
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    tails = Counter(w[-2:] for w in words)
    symbols = raw[[ord(c) for c in "#$%&*"]].sum()
    upper, lower = raw[65:91].sum(), raw[97:123].sum()
    pairs = Counter(zip(words, words[1:]))
    sentences = len(SENTENCE.findall(text)) + 1
    own = [
        np.log1p(n),
        upper / max(1, upper + lower),
        sum(map(str.isupper, words)) / m,
        sum(map(str.istitle, words)) / m,
        symbols / n,
        raw[48:58].sum() / n,
        raw[128:].sum() / n,
        raw[[9, 10, 13, 32]].sum() / n,
        raw[10] / n,
        sizes.mean(),
        sizes.std(),
        (sizes > 12).sum() / m,
        (sizes <= 3).sum() / m,
        len(counts) / m,
        np.log(m / len(counts)) if counts else 0.0,
        max(counts.values(), default=0) / m,
        max(tails.values(), default=0) / m,
        1 - len(pairs) / max(1, len(words) - 1),
        1 - len(set(lines)) / max(1, len(lines)),
        len(lines) / m,
        np.log1p(m / sentences),
        *(raw[ord(c)] / n for c in MARKS),
    ]
    return [float(x) for x in own]


N_FEATURES = len(features(""))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(text: pd.Series) -> pd.Series:
    return text.map(features)


def widened(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standard scores, clipped, their squares, and marks of a presence."""
    z = np.clip((x - centre) / spread, -6, 6)
    return np.concatenate([z, z * z / 6, (x > 0).astype(float)], axis=1)


class Ranking:
    """Bradley-Terry scores and the threshold that the score quantile sets."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS):
        self.centre, self.spread, self.threshold = x.mean(0), np.maximum(x.std(0), 1e-6), 0.0
        wide = widened(x, self.centre, self.spread)
        self.w = np.zeros(wide.shape[1])
        better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
        if not len(better) or not len(worse):
            return
        rng = np.random.default_rng(5)
        d = wide[rng.choice(better, pairs)] - wide[rng.choice(worse, pairs)]
        for _ in range(25):  # Newton steps on the logistic loss of the differences
            p = 1 / (1 + np.exp(-np.clip(d @ self.w, -30, 30)))
            grad = d.T @ (p - 1) / pairs + RIDGE * self.w
            hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(self.w))
            step = np.linalg.solve(hess, grad)
            self.w -= step
            if np.abs(step).max() < 1e-7:
                break
        # the quantile of scores under which the labelled share of poor documents lies
        self.threshold = float(np.quantile(wide @ self.w, len(worse) / len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        s = widened(x, self.centre, self.spread) @ self.w - self.threshold
        return 1 / (1 + np.exp(-np.clip(SCALE * s, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, pairs: int = PAIRS) -> Ranking:
    """Fit on labelled rows outside the held-out third, at most `train_docs`, those of
    least hash; the driver gets their features.  No labels: all scores are 0.5."""
    marks = labels.filter("doc_id is not null and quality in (0, 1)").filter(f"not ({HELD_OUT})")
    marks = marks.groupBy("doc_id").agg(F.max("quality").cast("int").alias("good"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    train = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", _features("text").alias("x"), "good").toPandas()
    train = train.sort_values("doc_id")
    x = np.array(train["x"].tolist(), dtype=float).reshape(-1, N_FEATURES)
    return Ranking(x if len(x) else np.zeros((1, N_FEATURES)), train["good"].to_numpy() if len(x) else np.zeros(1), pairs)


def score(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, pairs: int = PAIRS) -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier good) of every row of `docs`.

    Null or empty text: the score of an empty document.  Null or repeated doc_id: scored
    like others.  No labels, or of one class only: 0.5.  Empty table: no rows.  Columns other
    than doc_id and text, whatever their names, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_docs, pairs))

    @F.pandas_udf(T.DoubleType())
    def ranked(text: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in text], dtype=float).reshape(-1, N_FEATURES)
        return pd.Series(shared.value.score(x))

    return texts(docs).select("doc_id", ranked("text").alias("score"))
