"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts.

The units are the letters of words.  Each class has its own counts of n-grams of letters
and backs off to one Kneser-Ney model of all texts, of shorter n-grams over continuation counts,
so a rare expression that neither class has often met is as likely in both.  Most words of a toxic document are those of any
other, so its likelihood of a word is `MIXTURE` times that of the toxic model and the rest
that of the ordinary one.  A document counts each of its words once, so that a
repeated line weighs no more than a line.  Its score compares the two log-likelihoods,
each divided by the number of words, and is calibrated on labelled rows kept out of the counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import stage, texts

#: Labelled documents of each class from which the calibration is drawn at most; the
#: counts of n-grams have no bound.
TRAIN_DOCS = 8_000
#: One in so many labelled documents may calibrate the score and is kept out of the counts.
CALIBRATION = 5
#: Letters of the classes' n-grams and of the shared ones; the models see words with marked
#: ends.  The shared model backs off once more, to continuation counts.
ORDER = 8
SHARED_ORDER = 6
#: Discounts of the classes' own counts and of the shared ones.
OWN_DISCOUNT = 1.0
SHARED_DISCOUNT = 0.75
#: Share of the words of a toxic document that its class model explains.
MIXTURE = 0.02
#: Words added to a document's length, so that a few words alone decide little.
SHRINK = 4
THRESHOLD = 0.7
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1"
WORDS = re.compile(r"[^\W\d_]+")
#: Words that a task keeps before it gives out their counts, or their n-grams.
COUNT_WORDS = 200_000
GRAM_WORDS = 100_000
#: Letters of a word, and words, that are counted in one matrix.
LONG_WORD = 40
MATRIX_WORDS = 40_000
#: Words, and texts, that are scored at once, and scores that a task keeps.
MATRIX_ROWS = 4_000
TEXTS_AT_ONCE = 256
MEMO_WORDS = 400_000
#: Keys of a join with more than one in so many rows do not go through its shuffle.
FREQUENT = 10_000
#: Labels are broadcast up to so many rows (16 bytes each), and joined beyond.
BROADCAST_LABELS = 4_000_000
#: The table of ratios is broadcast up to so many entries (12 bytes each); beyond, words meet
#: it in a join.
BROADCAST_ENTRIES = 8_000_000


def grams(word: str, order: int = ORDER) -> list[str]:
    s = "^" * (order - 1) + word + "$"
    return [s[k : k + order] for k in range(len(word) + 1)]


def words_of(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, max(ORDER, SHARED_ORDER), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def letters_of(strings: list[str]) -> np.ndarray:
    """A row of mixed letters for each string, as wide as the longest."""
    letters = np.array(strings).view(np.uint32).reshape(len(strings), -1).astype(np.uint64)
    letters = (letters + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    letters ^= letters >> np.uint64(29)
    letters *= np.uint64(0xBF58476D1CE4E5B9)
    return letters ^ (letters >> np.uint64(32))


def windows(letters: np.ndarray, order: int, width: int | None = None) -> np.ndarray:
    """Sums of multiples of the letters in each window of `order` columns; that of a context is
    the sum of its n-gram without the last letter's part."""
    width = letters.shape[1] - order + 1 if width is None else width
    keys = np.zeros((len(letters), width), np.uint64)
    for j in range(order):
        keys += letters[:, j : j + width] * _FACTORS[j]
    return keys


def string_keys(strings: list[str]) -> np.ndarray:
    """The keys of n-grams, or of contexts, of one length."""
    return windows(letters_of(strings), len(strings[0])).view(np.int64)[:, 0] if strings else np.zeros(0, np.int64)


@F.pandas_udf(T.LongType())
def gram_key(gram: pd.Series) -> pd.Series:
    return pd.Series(string_keys(gram.tolist()), dtype="int64")


def mixed(ratio: np.ndarray) -> np.ndarray:
    """Log-likelihood of words in toxic documents less that in ordinary ones, from the
    ratio of their models."""
    return np.log1p(MIXTURE * np.expm1(np.minimum(ratio, 50.0)))


class Ratios:
    """Logarithms of toxic over ordinary probability, by hash of an n-gram or a context.

    An n-gram that the classes have not met more than once takes the entry of its context,
    the ratio of the discounted masses, since the shared part cancels; without that, 0.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.memo: dict[str, float] = {}

    def __reduce__(self):
        return Ratios, (self.keys, self.values)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.values[at].astype(float)

    def _longer(self, words: list[str]) -> np.ndarray:
        out = []
        for w in words:
            own = grams(w)
            known, value = self._find(string_keys([g[:-1] for g in own]))
            seen, own_value = self._find(string_keys(own))
            out.append(math.fsum(np.where(known, np.where(seen, own_value, value), 0.0)))
        return np.array(out)

    def words(self, words: list[str]) -> np.ndarray:
        """Of each word; those of up to `LONG_WORD` letters in one matrix."""
        out = np.zeros(len(words))
        length = np.fromiter(map(len, words), np.int64, len(words))
        longer = np.flatnonzero(length > LONG_WORD)
        out[longer] = self._longer([words[k] for k in longer])
        order = np.flatnonzero(length <= LONG_WORD)
        order = order[np.argsort(length[order], kind="stable")]
        for at in range(0, len(order), MATRIX_ROWS):
            rows = order[at : at + MATRIX_ROWS]
            letters = letters_of(["^" * (ORDER - 1) + words[k] + "$" for k in rows])
            width = letters.shape[1] - ORDER + 1
            contexts = windows(letters, ORDER - 1, width=width)
            word, place = np.nonzero(np.arange(width) <= length[rows, None])
            known, value = self._find(contexts[word, place].view(np.int64))
            word, place, value = word[known], place[known], value[known]
            ends = letters[word, place + ORDER - 1] * _FACTORS[ORDER - 1]
            seen, own = self._find((contexts[word, place] + ends).view(np.int64))
            out[rows] = np.bincount(word, np.where(seen, own, value), len(rows))
        return mixed(out)

    def texts(self, texts: Iterable[str]) -> list[float]:
        """Per word, with `SHRINK` words more; the words of a few texts are held at once."""
        texts = list(texts)
        return [x for k in range(0, len(texts), TEXTS_AT_ONCE) for x in self._some(texts[k : k + TEXTS_AT_ONCE])]

    def _some(self, texts: list[str]) -> list[float]:
        memo, sets = self.memo, [words_of(t) for t in texts]
        new = list(set().union(*sets).difference(memo))
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = list(set().union(*sets))
        for k in range(0, len(new), MATRIX_WORDS):
            part = new[k : k + MATRIX_WORDS]
            memo.update(zip(part, self.words(part).tolist()))
        return [math.fsum(map(memo.__getitem__, words)) / (len(words) + SHRINK) for words in sets]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept of a one-feature logistic model with balanced classes."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    scale = max(float(np.std(x)), 1e-9)
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + ridge * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def counted(words: dict[str, int], order: int) -> tuple[list[str], np.ndarray]:
    """The n-grams of `words` and how often each comes, a word counting as often as told.

    Words of up to `LONG_WORD` letters stand in a matrix of letters; n-grams are brought
    together by sums of random multiples of their letters, 64 bits wide, so only one string is
    made for each.  Longer words are cut one by one.
    """
    longer = Counter()
    for w, n in words.items():
        if len(w) > LONG_WORD:
            for g in grams(w, order):
                longer[g] += n
    rest = sorted((w for w in words if len(w) <= LONG_WORD), key=len)
    found, counts = list(longer), [np.fromiter(longer.values(), np.int64, len(longer))]
    for at in range(0, len(rest), MATRIX_WORDS):
        own = rest[at : at + MATRIX_WORDS]
        padded = ["^" * (order - 1) + w + "$" for w in own]
        keys = windows(letters_of(padded), order)
        width = keys.shape[1]
        word, place = np.nonzero(np.arange(width) <= np.fromiter(map(len, own), np.int64, len(own))[:, None])
        _, first, which = np.unique(keys[word, place], return_index=True, return_inverse=True)
        times = np.fromiter((words[w] for w in own), np.int64, len(own))[word]
        found += [padded[w][p : p + order] for w, p in zip(word[first].tolist(), place[first].tolist())]
        counts.append(np.bincount(which, times, len(first)).astype(np.int64))
    return found, np.concatenate(counts)


def _by_class(column: str, parts: dict[str, tuple[list[str], np.ndarray]]) -> Iterator[pd.DataFrame]:
    """A frame for each of `parts`, whose counts stand in the column of its name beside zeros."""
    for name, (found, n) in parts.items():
        if found:
            none = np.zeros(len(found), np.int64)
            yield pd.DataFrame({column: found, **{c: n if c == name else none for c in parts}})


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, ordinary, toxic, other): the documents of each class, and of none, with a word."""

    def given(words: list[Counter]) -> Iterator[pd.DataFrame]:
        counts = [(list(own), np.fromiter(own.values(), np.int64, len(own))) for own in words]
        yield from _by_class("word", dict(zip(("ordinary", "toxic", "other"), counts)))

    words = [Counter(), Counter(), Counter()]
    for batch in batches:
        for text, kind in zip(batch["text"], batch["toxic"]):
            words[kind].update(words_of(text))
            if sum(map(len, words)) >= COUNT_WORDS:
                yield from given(words)
                words = [Counter(), Counter(), Counter()]
    yield from given(words)


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(gram, ordinary, toxic, every) of counted words: long n-grams by class, and short ones
    of all rows."""

    def given(words: pd.DataFrame) -> Iterator[pd.DataFrame]:
        words = words.assign(every=words["ordinary"] + words["toxic"] + words["other"])
        parts = {}
        for name, order in (("ordinary", ORDER), ("toxic", ORDER), ("every", SHARED_ORDER)):
            own = words[words[name] > 0]
            parts[name] = counted(dict(zip(own["word"].tolist(), own[name].tolist())), order)
        yield from _by_class("gram", parts)

    held = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= GRAM_WORDS:
            yield from given(pd.concat(held))
            held = []
    if held:
        yield from given(pd.concat(held))


def gram_counts(every: DataFrame) -> DataFrame:
    """(gram, ordinary, toxic, every) over rows of text and class.  Documents share most of
    their words, so words are summed before they are cut: each is cut once, whatever the rows."""
    words = every.mapInPandas(_count_words, "word string, ordinary long, toxic long, other long")
    words = words.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("ordinary", "toxic", "other")])
    parts = words.mapInPandas(_count_grams, "gram string, ordinary long, toxic long, every long")
    return parts.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("ordinary", "toxic", "every")])


def shared_model(counts: DataFrame) -> DataFrame:
    """(gram, p): the probability of a short n-gram's last letter in the Kneser-Ney model of
    all texts, whose lower order is the continuation counts.  Only joins and sums of Spark."""
    own = counts.filter(F.length("gram") == SHARED_ORDER).select("gram", F.col("every").alias("n"), F.expr("substring(gram, 2)").alias("end"))
    ends = stage(own.groupBy("end").agg(F.count(F.lit(1)).alias("c")), "endings")

    def with_context(df: DataFrame, column: str, order: int, **sums: Column) -> DataFrame:
        context = F.expr(f"substring({column}, 1, {order - 1})")
        return df.join(df.groupBy(context.alias("context")).agg(*[v.alias(k) for k, v in sums.items()]), F.col("context") == context).drop("context")

    lower = with_context(ends, "end", SHARED_ORDER - 1, all=F.sum("c")).select("end", (F.col("c") / F.col("all")).alias("lower"))
    rows = with_context(own, "gram", SHARED_ORDER, total=F.sum("n"), types=F.count(F.lit(1))).join(lower, "end")
    p = (F.greatest(F.col("n") - SHARED_DISCOUNT, F.lit(0.0)) + SHARED_DISCOUNT * F.col("types") * F.col("lower")) / F.col("total")
    return rows.select("gram", p.alias("p"))


def ratio_table(counts: DataFrame) -> DataFrame:
    """(key, value): the log ratio of each n-gram that a class has met more than once, and of
    each context of such ones, by key of the n-gram or context."""
    context = F.expr(f"substring(gram, 1, {ORDER - 1})")
    own = counts.filter(F.length("gram") == ORDER).withColumn("context", context)
    kept = lambda c: F.least(F.col(c), F.lit(OWN_DISCOUNT))
    sums = {f"{c}_{k}": x for c in ("ordinary", "toxic") for k, x in (("n", F.sum(c)), ("mass", F.sum(kept(c))))}
    contexts = own.groupBy("context").agg(F.max(F.greatest("ordinary", "toxic")).alias("most"), *[x.alias(k) for k, x in sums.items()])
    contexts = stage(contexts.filter(F.col("most") > OWN_DISCOUNT), "contexts")
    met = own.filter(F.greatest("ordinary", "toxic") > OWN_DISCOUNT)
    end = F.expr(f"substring(gram, {ORDER - SHARED_ORDER + 1})")
    met = met.select("gram", "ordinary", "toxic", "context", end.alias("end"))
    both = met.join(shared_model(counts).withColumnRenamed("gram", "end"), "end").join(contexts, "context")
    mass = lambda c: F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_mass") / F.col(f"{c}_n")).otherwise(1.0)
    part = lambda c: F.when(F.col(f"{c}_n") > 0, F.greatest(F.col(c) - OWN_DISCOUNT, F.lit(0.0)) / F.col(f"{c}_n")).otherwise(0.0)
    seen = F.log((part("toxic") + mass("toxic") * F.col("p")) / (part("ordinary") + mass("ordinary") * F.col("p")))
    # a class that has spent no mass on a context has met it once only
    unseen = F.log(mass("toxic") / mass("ordinary"))
    rows = both.select(gram_key("gram").alias("key"), seen.cast("float").alias("value"))
    return rows.unionByName(contexts.select(gram_key("context").alias("key"), unseen.cast("float").alias("value")))


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(rid, w) for rid, text in zip(batch["rid"], batch["text"]) for w in words_of(text)]
        yield pd.DataFrame(out, columns=["rid", "word"])


def _grams_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(w, g) for w in batch["word"] for g in grams(w)]
        yield pd.DataFrame(out, columns=["word", "gram"])


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on `key`, unique in `right`.  Keys that hold over one in `FREQUENT` rows of `left`
    are fewer than that many, so their rows of `right` are broadcast; the rest meet in a shuffle."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("spread__n"))
    often = F.broadcast(counts.filter(F.col("spread__n") > left.count() / FREQUENT).select(key))
    hot = left.join(often, key, "left_semi").join(F.broadcast(right.join(often, key, "left_semi")), key, "left")
    return hot.unionByName(left.join(often, key, "left_anti").join(right, key, "left"))


class Model:
    """A table of ratios and their calibration."""

    def __init__(self, spark: SparkSession, table: DataFrame):
        self.table, self.slope, self.intercept, self.shared = table, 1.0, 0.0, None
        if table.count() <= BROADCAST_ENTRIES:
            rows = table.toArrow()  # columns, so that the driver holds no row objects
            self.shared = spark.sparkContext.broadcast(Ratios(rows["key"].to_numpy(), rows["value"].to_numpy()))

    def raw(self, docs: DataFrame) -> DataFrame:
        """`docs` with column `toxicity__raw`, the difference of the two log-likelihoods per word."""
        if self.shared is not None:
            shared = self.shared

            @F.pandas_udf(T.DoubleType())
            def ratio(text: pd.Series) -> pd.Series:
                return pd.Series(shared.value.texts(text), dtype="float64")

            return docs.withColumn("toxicity__raw", ratio(F.coalesce("text", F.lit(""))))
        rows = stage(docs.withColumn("toxicity__rid", F.monotonically_increasing_id()), "rows")
        words = stage(rows.select(F.col("toxicity__rid").alias("rid"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(_words, "rid long, word string"), "words")
        parts = words.select("word").distinct().mapInPandas(_grams_of, "word string, gram string")
        parts = stage(parts.withColumns({"key": gram_key("gram"), "c_key": gram_key(F.expr(f"substring(gram, 1, {ORDER - 1})"))}), "parts")
        parts = spread_join(parts, self.table.select("key", F.col("value").alias("own")), "key")
        parts = spread_join(parts, self.table.select(F.col("key").alias("c_key"), F.col("value").alias("context")), "c_key")
        value = F.when(F.col("context").isNull(), 0.0).otherwise(F.coalesce("own", "context").cast("double"))
        ratio = parts.groupBy("word").agg(F.sum(value).alias("x"))
        each = ratio.select("word", F.log1p(MIXTURE * F.expm1(F.least("x", F.lit(50.0)))).alias("x"))
        sums = spread_join(words, stage(each, "each"), "word").groupBy(F.col("rid").alias("toxicity__rid")).agg((F.sum("x") / (F.count(F.lit(1)) + SHRINK)).alias("toxicity__raw"))
        return rows.join(sums, "toxicity__rid", "left").withColumn("toxicity__raw", F.coalesce("toxicity__raw", F.lit(0.0))).drop("toxicity__rid")

    def chance(self, raw: str = "toxicity__raw") -> Column:
        return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col(raw) * self.slope + self.intercept))))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Count on all labelled rows outside the held-out third, less one in `CALIBRATION`; the
    shared counts take the texts of all rows.  Those left out calibrate, of at most `train_docs`
    labelled rows of each class, those of least hash.  Counts and ratios are made by Spark.
    Rows without label or text teach no class; a doc_id with several labels has the greatest.
    """
    spark = docs.sparkSession
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").filter(f"not ({HELD_OUT})")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = None
    for kind in (0, 1):
        some = marks.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
        chosen = some if chosen is None else chosen.unionByName(some)
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(CALIBRATION))
    taught = stage(marks.filter(fold != 0), "taught")
    taught = F.broadcast(taught) if taught.count() <= BROADCAST_LABELS else taught
    every = texts(docs).join(taught, "doc_id", "left").select("text", F.coalesce("toxic", F.lit(2)).alias("toxic"))
    model = Model(spark, stage(ratio_table(stage(gram_counts(every), "grams")), "ratios"))
    own = texts(docs).join(F.broadcast(chosen.filter(fold == 0)), "doc_id").select("text", "toxic")
    own = model.raw(own).select("toxicity__raw", "toxic").toArrow().to_pandas().sort_values(["toxicity__raw", "toxic"])
    model.slope, model.intercept = fit_logistic(own["toxicity__raw"].to_numpy(), own["toxic"].to_numpy())
    return model


def score(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier toxic) of every row of `docs`.

    Null or empty text: the score of an empty document.  Null or repeated doc_id: scored
    like others.  No labels: scores of 0.5 or near.  Empty table: no rows.  Columns other than
    doc_id and text, whatever their names, are not read.
    """
    model = fit(docs, labels, train_docs)
    return model.raw(docs.select("doc_id", "text")).select("doc_id", model.chance().alias("score"))


def ordinary(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The documents that score under `threshold`, with their own columns.

    Rows are judged one by one, so repeated rows and rows without doc_id or text are kept or
    dropped as `score` has them.  Columns may have any names but those that begin with toxicity__.
    """
    model = fit(docs, labels, train_docs)
    return model.raw(docs).filter(model.chance() < threshold).select(*docs.columns)
