"""Connected components of an edge table by contraction in tasks and alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: Edges that a task contracts at once.
EDGES_AT_ONCE = 1 << 18


def contracted(edges: np.ndarray) -> np.ndarray:
    """Each node of `edges` (rows of two) that is not the least it reaches in them, with that one."""
    nodes, at = np.unique(edges, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[below], nodes[root[below]]], axis=1)


def _contract(at_once: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch[["a", "b"]].to_numpy(np.int64))
            n += len(batch)
            if n >= at_once:
                yield pd.DataFrame(contracted(np.concatenate(held)), columns=["a", "b"])
                held, n = [], 0
        if held:
            yield pd.DataFrame(contracted(np.concatenate(held)), columns=["a", "b"])

    return run


def _round(edges: DataFrame) -> DataFrame:
    """Large stars connect each node's greater neighbours to its least one, small stars its
    smaller ones.  Edges (a, b) have a > b before and after."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other, and on a node that hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("up")))
    each = ends.groupBy("node").agg(F.min("up").alias("least"), F.max("up").alias("most"), F.max(F.col("up").isNull()).alias("holds"))
    return each.filter("least <> most or least is not null and holds").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); the root is the least node
    reachable.

    Tasks first contract the edges that they read, `EDGES_AT_ONCE` at a time.  Then large and
    small stars alternate with such contractions; in a logarithmic number of rounds every
    node hangs on its root.  Each round leaves edges of smaller ends.  Only minima are
    aggregated, so no neighbourhood is gathered; each round is staged, and a look whether all
    are stars spares a last round, as tasks and plans cost the driver memory.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    contract = lambda df: stage(stage(df, "edges").mapInPandas(_contract(EDGES_AT_ONCE), "a long, b long"), "edges")
    edges = contract(edges)
    while not _stars(edges):
        edges = contract(_round(edges))
    # tasks may have given one edge each
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
