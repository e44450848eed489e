"""Links of candidates: topics are compared tile by tile, and pairs carry no texts."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmine.config import Cluster
from talkmine.functions.text import bigram_codes, bigrams
from talkmine.operators import cluster

TEXTS = ["", "x", "-!", "一", "一龥一龥", "a b c", "Ab9 龦ab", "é-ab", "𠀀ab𠀀c", "abab" * 50, None]


def grams(text):
    kept = re.sub("[^一-龥a-zA-Z0-9]", "", text or "")
    return {kept[i : i + 2] for i in range(len(kept) - 1)} if len(kept) > 1 else set(kept)


def test_codes_are_the_sets_of_bigrams(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", bigrams(F.col("t")).alias("want"), bigram_codes("t").alias("made")).collect():
        codes = np.frombuffer(r["made"], np.uint32)
        assert set(r["want"]) == grams(r["t"]) == {(chr(c >> 16) if c >> 16 else "") + chr(c & 0xFFFF) for c in map(int, codes)}
        assert len(codes) == len(r["want"])


@pytest.mark.parametrize("tile,columns", [(1, 3), (3, 8192), (128, 5)])
def test_links_over_tiles(spark, monkeypatch, tile, columns):
    monkeypatch.setattr(cluster, "TILE", tile)
    rnd, cfg = random.Random(4), Cluster()
    words = ["alpha", "beta", "gamma", "一二三", "delta x", "", "é"]
    rows = [(rec, k, (s := rnd.randrange(900)), s + rnd.randrange(5, 180), rnd.choice(words), " ".join(rnd.choice(words) for _ in range(rnd.randrange(4)))) for rec in range(3) for k in range(17)]
    rows.append((0, 99, None, None, "alpha", ""))
    c = spark.createDataFrame(rows, "rec_id long, cand_no long, start long, end long, title string, reason string")
    assert "a_grams" not in cluster.pairs(cluster.ranked(c.withColumn("story_id", F.lit(None).cast("string"))), cfg).columns
    shared = cluster.shared_members([np.array([1, 2, 3, 9], np.uint32), np.array([], np.uint32), np.array([2, 3, 7], np.uint32)])
    assert shared.tolist() == [[4, 0, 2], [0, 0, 0], [2, 0, 3]]
    monkeypatch.setattr(cluster, "COLUMNS", columns)
    made = {(r["rec_id"], r["a"], r["b"]): r for r in cluster.links(c).collect()}
    want = {}
    for rec in range(3):
        own = sorted((x for x in rows if x[0] == rec), key=lambda x: (x[2] is None, x[2] or 0, x[1]))
        place = {x[1]: k for k, x in enumerate(own)}
        for x in own:
            for y in own:
                if x[1] < y[1]:
                    known = x[2] is not None and y[2] is not None
                    gap = max(0, y[2] - x[3], x[2] - y[3]) if known else None
                    both = min(x[3], y[3]) - max(x[2], y[2]) if known else 0
                    p, q = (grams(f"{z[4]} {z[5]}") for z in (x, y))
                    topic = len(p & q) / min(len(p), len(q)) if p and q else 0
                    over = both / min(x[3] - x[2], y[3] - y[2]) if both > 0 else 0
                    near = abs(place[x[1]] - place[y[1]]) == 1
                    score = 0.3 * (max(0, 1 - gap / 300) if known else 0) + 0.25 * over + 0.3 * topic + 0.15 * near
                    if round(score, 9) >= 0.42:
                        want[rec, x[1], y[1]] = (score, topic)
    assert set(made) == set(want)
    for k, (score, topic) in want.items():
        assert made[k]["score"] == pytest.approx(score, abs=6e-4) and made[k]["topic"] == pytest.approx(topic, abs=6e-4)


def test_components_make_the_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "rec_id long, a long, b long").mapInPandas(counted, "rec_id long, a long, b long")
    nodes = spark.createDataFrame([(1, k) for k in range(4)], "rec_id long, cand_no long")
    assert [r["cluster_no"] for r in cluster.components(nodes, edges).orderBy("cand_no").collect()] == [1, 1, 1, 2]
    assert made.value == 2
