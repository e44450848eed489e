"""Values of the working forms and of the pipeline's stages on odd rows: nulls, empty texts,
repeats, ties, a very long text, columns of clashing names, and empty tables."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from talkmine.llm import exact_dedup, jaccard_join, mixing, toxicity

from .test_operators import SCHEMA, prose

CLASHING = ("word", "gram", "key", "size", "taken", "target", "keep_id", "group_size", "kept", "component_id", "n_shingles", "score", "order", "position", "positions", "start", "length", "rid", "h")
LONG = " ".join(f"w{k % 997}x{k}" for k in range(60_000))
ODD = [
    (1, "one two three four five six", "en", "a"), (2, "one  two three four five six", "en", None), (None, "one  two three four five six", None, "a"), (3, None, "en", "a"), (4, "", "en", "b"), (5, " \n\t", None, None),
    (6, "same row here", "en", "b"), (6, "same row here", "en", "b"), (6, "another text under that number", "en", "b"), (7, LONG, "en", "a"), (8, LONG + " ", "en", "a"), (None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, lang, s, len(t or "")) for d, t, lang, s in ODD] + [(100 + k, t, "en", "c", len(t)) for k, t in enumerate(prose(40, 5, ["vequza"]))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(100 + k, 1, int(k % 4 == 0)) for k in range(40)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return to


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def test_ordinary(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = Counter((r["doc_id"], r["score"] < toxicity.THRESHOLD) for r in toxicity.score(docs, labels).collect())
    made = toxicity.ordinary(docs, labels)
    assert made.columns == docs.columns and Counter(d for d, keep in scores.elements() if keep) == Counter(r["doc_id"] for r in made.collect())
    assert not rows_of(made) - rows_of(docs)
    kept = rows_of(made, "doc_id", "text")
    assert kept[3, None] == kept[4, ""] == kept[5, " \n\t"] and kept[6, "same row here"] in (0, 2)
    assert toxicity.ordinary(docs.limit(0), labels).collect() == [] and toxicity.ordinary(docs, labels.limit(0)).count() == docs.count()


def bare(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def best_of(group):
    """The longest text, then the least number (null last)."""
    return min(group, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))


def test_without_copies(docs):
    made, own = exact_dedup.without_copies(docs), list(rows_of(docs, "doc_id", "text").elements())
    groups = {}
    for x in own:
        groups.setdefault(bare(x[1]), []).append(x)
    assert rows_of(made, "doc_id", "text") == Counter(best_of(g) for g in groups.values())
    assert made.columns == docs.columns and not rows_of(made) - rows_of(docs)
    assert exact_dedup.without_copies(docs.limit(0)).collect() == []


def test_one_of_each(docs):
    made = rows_of(jaccard_join.one_of_each(docs, 5, 80), "doc_id", "text")
    assert made[1, ODD[0][1]] == 1 and made[2, ODD[1][1]] == 0 and made[None, ODD[2][1]] == 0  # one component
    assert made[7, LONG] == 1 and made[8, LONG + " "] == 0 and made[6, "same row here"] == 1 and made[6, "another text under that number"] == 1
    assert made[3, None] == 1 and made[4, ""] == 1 and made[5, " \n\t"] == 1 and made[None, None] == 1  # no words: linked with nothing
    assert jaccard_join.one_of_each(docs.limit(0), 5, 80).collect() == []


def test_mixed_documents(docs):
    made, own = mixing.mixed_documents(docs), rows_of(docs, "doc_id", "text")
    copies = rows_of(made, "doc_id", "text")
    expected = Counter()
    for r in mixing.mix(docs).collect():
        expected[r["doc_id"]] += len(r["positions"])
    by_id = Counter()
    for (d, _), n in copies.items():
        by_id[d] += n
    assert made.columns == docs.columns and by_id == +expected and not set(copies) - set(own)
    assert all(n <= 2 * own[k] or not bare(k[1]) for k, n in copies.items())
    assert mixing.mixed_documents(docs.limit(0)).collect() == []


def test_stages_on_odd_rows(spark, docs, folder):
    now = docs
    for name, apply in corpus_pipeline.STAGES:
        assert apply(spark, now.limit(0), folder).collect() == []
        after = apply(spark, now, folder)
        if name == "best-fit packing":
            made = after.toPandas().sort_values(["sequence_id", "offset"])
            assert (made.groupby("sequence_id")["length"].cumsum() - made["length"] == made["offset"]).all() and made.groupby("sequence_id")["length"].sum().max() <= 4096
            assert Counter(d if d == d else None for d in made[made["piece"] == 0]["doc_id"]) == Counter(r["doc_id"] for r in now.collect())
            break
        assert after.columns == docs.columns and not set(rows_of(after)) - set(rows_of(now))
        now = spark.createDataFrame(after.collect(), after.schema).repartition(2)
