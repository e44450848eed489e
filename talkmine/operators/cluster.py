"""Candidate clips that belong to one event: links, components, their spans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import UNKNOWN_STORY, Cluster
from ..functions.scores import overlap, thousandths, time_decay
from ..functions.text import bigram_codes
from .staging import stage

#: Candidates of a tile: neighbours by rank whose topics one task compares at a time.
TILE = 128
#: Columns of the matrix of a tile's topics.
COLUMNS = 8192


def ranked(candidates: DataFrame) -> DataFrame:
    """Times put in order, and `place`: the rank by start, unknown times last, ties by
    number.  Neighbours in rank are adjacent."""
    swapped = (F.col("end") < F.col("start"))
    start, end = F.when(swapped, F.col("end")).otherwise(F.col("start")), F.when(swapped, F.col("start")).otherwise(F.col("end"))
    fixed = candidates.withColumns({"start": start, "end": end})
    return fixed.withColumn("place", F.row_number().over(W.partitionBy("rec_id").orderBy(F.col("start").asc_nulls_last(), "cand_no")))


def _side(df: DataFrame, p: str) -> DataFrame:
    return df.select("rec_id", *[F.col(c).alias(f"{p}_{c}") for c in ("cand_no", "start", "end", "place", "story_id")])


def pairs(rows: DataFrame, cfg: Cluster) -> DataFrame:
    """Pairs that can reach the threshold: in reach of each other, adjacent, or of one story.

    A link of other pairs would need more than the topic weight.  Where that alone reaches
    the threshold, all pairs of a recording are made.  Each pair is made once: the three ways
    take pairs that the ones before don't, so no distinct is needed.
    """
    a, b = _side(rows, "a"), _side(rows, "b")
    if cfg.topic >= cfg.threshold:
        return a.join(b, "rec_id").filter("a_cand_no < b_cand_no")
    cell = cfg.window
    # the span of a, widened by the reach, meets the cells of b
    first = lambda c, d: F.floor((F.col(c) - d) / cell).cast("long")
    end_a, end_b = F.coalesce("a_end", "a_start"), F.coalesce("b_end", "b_start")
    left = a.filter("a_start is not null").withColumn("cell", F.explode(F.sequence(first("a_start", cell), F.floor((end_a + cell) / cell).cast("long"))))
    right = b.filter("b_start is not null").withColumn("cell", F.explode(F.sequence(first("b_start", 0), F.floor(end_b / cell).cast("long"))))
    once = F.col("cell") == F.greatest(first("a_start", cell), first("b_start", 0))
    near = left.join(right, ["rec_id", "cell"]).filter(once & (F.col("a_cand_no") < F.col("b_cand_no"))).drop("cell")
    within = (F.col("b_start") - F.coalesce("a_end", "a_start") < cfg.window) & (F.col("a_start") - F.coalesce("b_end", "b_start") < cfg.window)
    apart = ~F.coalesce(within, F.lit(False))
    near = near.filter(within)
    beside = a.withColumn("to", F.explode(F.array(F.col("a_place") - 1, F.col("a_place") + 1))).join(b.withColumn("to", F.col("b_place")), ["rec_id", "to"])
    beside = beside.filter("a_cand_no < b_cand_no").filter(apart).drop("to")
    told = a.filter((F.col("a_story_id").isNotNull()) & (F.col("a_story_id") != UNKNOWN_STORY))
    same = told.join(b, (told["rec_id"] == b["rec_id"]) & (F.col("a_story_id") == F.col("b_story_id")) & (F.col("a_cand_no") < F.col("b_cand_no"))).drop(b["rec_id"])
    same = same.filter(apart & (F.abs(F.col("a_place") - F.col("b_place")) != 1))
    return near.unionByName(beside).unionByName(same)


def shared_members(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of `sets` share, by products of 0/1 matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, member, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    met = n[member] > 1  # others are shared by none
    owner, member = owner[met], (np.cumsum(n > 1) - 1)[member[met]]
    out = np.zeros((len(sets), len(sets)))
    for low in range(0, int((n > 1).sum()), COLUMNS):
        own = (member >= low) & (member < low + COLUMNS)
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[owner[own], member[own] - low] = 1
        out += x @ x.T
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def _topic_of(pairs: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
    """`pairs` of two tiles with `topic`: the shared pairs of letters as a share of the smaller set."""
    if pairs.empty:
        return pairs.assign(topic=pd.Series(dtype="float64"))
    sets = [np.frombuffer(x, np.uint32) for x in grams["grams"]]
    at = pd.Index(grams["place"])
    a, b = at.get_indexer(pairs["a_place"]), at.get_indexer(pairs["b_place"])
    n = np.array([len(x) for x in sets])
    least = np.minimum(n[a], n[b])
    return pairs.assign(topic=np.where(least > 0, shared_members(sets)[a, b] / np.maximum(least, 1), 0.0))


def with_topic(pairs_: DataFrame, rows: DataFrame) -> DataFrame:
    """`pairs_` with `topic`.  `rows`: rec_id, place, grams.  Pairs go by tiles of ranks, and the
    texts of a tile once to each tile that a pair joins it with."""
    tile = lambda c: F.floor(F.col(c) / TILE).cast("long")
    on = ["rec_id", "a_tile", "b_tile"]
    pairs_ = stage(pairs_.withColumns({"a_tile": tile("a_place"), "b_tile": tile("b_place")}), "pairs")
    met = pairs_.select("rec_id", F.col("a_tile").alias("first"), F.col("b_tile").alias("second")).distinct().withColumn("tile", F.explode(F.array_distinct(F.array("first", "second"))))
    grams = rows.select("rec_id", "place", "grams", tile("place").alias("tile")).join(met, ["rec_id", "tile"]).select("rec_id", "first", "second", "place", "grams")
    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in pairs_.schema)
    return pairs_.groupBy(on).cogroup(grams.groupBy("rec_id", "first", "second")).applyInPandas(_topic_of, f"{schema}, topic double").drop("a_tile", "b_tile")


def links(candidates: DataFrame, cfg: Cluster = Cluster()) -> DataFrame:
    """rec_id, a, b, score and its parts, for pairs of score `threshold` or more.

    `candidates`: rec_id, cand_no, start, end, title, reason and, if stories count,
    story_id.  Without story_id no story speaks.  Only pairs that a full topic would lift to
    the threshold have their topics compared.
    """
    told = "story_id" in candidates.columns
    both = pairs(ranked(candidates if told else candidates.withColumn("story_id", F.lit(None).cast("string"))), cfg)
    gap = F.greatest(F.lit(0), F.greatest(F.col("b_start") - F.coalesce("a_end", "a_start"), F.col("a_start") - F.coalesce("b_end", "b_start")))
    unknown = F.col("a_start").isNull() | F.col("b_start").isNull()
    time = F.when(unknown, 0.0).otherwise(time_decay(gap, cfg.window))
    over = overlap(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    adjacent = F.abs(F.col("a_place") - F.col("b_place")) == 1
    known = F.coalesce((F.col("a_story_id") != UNKNOWN_STORY) & (F.col("b_story_id") != UNKNOWN_STORY), F.lit(False))
    same = known & F.coalesce(F.col("a_story_id") == F.col("b_story_id"), F.lit(False))
    story = F.when(same, cfg.same_story).when(known, cfg.cross_story).otherwise(0.0)
    parts = both.select("rec_id", "a_cand_no", "b_cand_no", "a_place", "b_place", time.alias("time"), over.alias("overlap"), adjacent.alias("adjacent"), same.alias("same_story"), story.alias("story"))
    total = lambda topic: cfg.time * F.col("time") + cfg.overlap * F.col("overlap") + cfg.topic * topic + F.when(F.col("adjacent"), cfg.adjacency).otherwise(0.0) + F.col("story")
    parts = parts.filter(F.round(total(F.lit(1.0)), 9) >= cfg.threshold)
    topic = F.concat_ws(" ", F.when(F.col("title") != "", F.col("title")), F.when(F.col("reason") != "", F.col("reason")))
    texts = ranked(candidates.select("rec_id", "cand_no", "start", "end", bigram_codes(topic).alias("grams")))
    scored = with_topic(parts, texts).withColumn("score", total(F.col("topic"))).filter(F.round("score", 9) >= cfg.threshold)
    shown = [thousandths(F.col(c)).alias(c) for c in ("score", "time", "overlap", "topic")]
    return scored.select("rec_id", F.col("a_cand_no").alias("a"), F.col("b_cand_no").alias("b"), *shown, "adjacent", "same_story")


def components(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """rec_id, cand_no, cluster_no: each candidate in one cluster, single ones too; clusters
    are numbered by their least member.

    Labels fall to the least neighbour's and then jump to the label of their label, so
    chains of n candidates take about log n rounds.  Rounds are staged.
    """
    nodes = candidates.select("rec_id", "cand_no").distinct()
    edges = stage(edges.select("rec_id", "a", "b"), "edges")  # before the union, which would make them twice
    both = edges.unionByName(edges.select("rec_id", F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stage(nodes.withColumn("label", F.col("cand_no")), "labels")
    while True:
        near = both.join(labels.select("rec_id", F.col("cand_no").alias("b"), "label"), ["rec_id", "b"]).groupBy("rec_id", F.col("a").alias("cand_no")).agg(F.min("label").alias("near"))
        least = labels.join(near, ["rec_id", "cand_no"], "left").select("rec_id", "cand_no", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        least = stage(least, "labels")
        jump = least.select("rec_id", F.col("cand_no").alias("label"), F.col("label").alias("jump"))
        nxt = stage(least.join(jump, ["rec_id", "label"]).select("rec_id", "cand_no", "was", F.col("jump").alias("label")), "labels")
        labels = nxt.drop("was")
        if nxt.filter("was <> label").isEmpty():
            break
    return labels.select("rec_id", "cand_no", F.dense_rank().over(W.partitionBy("rec_id").orderBy("label")).alias("cluster_no"))


def spans(candidates: DataFrame, clusters: DataFrame) -> DataFrame:
    """rec_id, cluster_no, start, end, n, members."""
    return ranked(candidates).join(clusters, ["rec_id", "cand_no"]).groupBy("rec_id", "cluster_no").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("cand_no")).alias("members")
    )


def cluster_stats(spans_: DataFrame) -> DataFrame:
    many = F.col("n") > 1
    return spans_.groupBy("rec_id").agg(F.count(F.lit(1)).alias("clusters"), F.count_if(many).alias("multi"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("in_multi"))
