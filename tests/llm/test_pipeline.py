"""The pipeline's stages on a small corpus: each decision takes effect, clean rows stay."""

import random

import corpus_pipeline
import pytest

from talkmine.llm.staging import stage

from .test_operators import SCHEMA, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(21)
    texts = prose(400, 22, ["vequza", "grobik"])
    clean = [t for k, t in enumerate(texts) if k % 4]
    texts += [clean[k] + " \n" for k in range(20)]  # 400-419: exact copies
    for k in range(20):  # 420-439: near copies
        words = " ".join(clean[j + k] for j in (40, 60, 80, 100)).split()
        texts.append(" ".join(words))
        words[rnd.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    to = tmp_path_factory.mktemp("tables")
    rows = [(k, t, "en", f"s{k % 5}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return str(to)


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, folder), "test")
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert name == "best-fit packing" or docs.columns == columns
    toxic = {k for k in range(400) if k % 4 == 0}
    assert len(set(kept["toxicity"]) & toxic) <= 3
    assert len(set(range(440)) - toxic - set(kept["toxicity"])) <= 3
    # the copy has more code points, so it stays and the first goes
    assert not any(k in kept["exact dedup"] for k in range(1, 20) if k % 4 and 400 + _place(k) in kept["exact dedup"])
    near = set(kept["n-gram Jaccard join"])
    assert all((420 + 2 * k in near) and (421 + 2 * k not in near) for k in range(20) if 420 + 2 * k in kept["exact dedup"])
    mixed = kept["mixing"]
    assert set(mixed) <= near and max(mixed.count(d) for d in set(mixed)) <= 2
    assert set(kept["best-fit packing"]) == set(mixed)


def _place(k):
    """Where document k stands among the clean ones."""
    return k - 1 - k // 4


def test_run(spark, folder):
    made = corpus_pipeline.run(spark, folder).toPandas()
    own = made.sort_values(["sequence_id", "offset"])
    assert (own.groupby("sequence_id")["length"].cumsum() - own["length"] == own["offset"]).all()
