"""Stretches of two people talking in turn."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import stage

# Fixed values of the search: spans and times in ms, shares, counts.
SHORTEST, LONGEST = 30_000, 90_000
SWITCHES = 2
LEAST_SHARE, LEAST_MS = 0.15, 4_000
OVERLAP = 0.40
TOP = 5
MUSIC = "<|BGM|>"

#: Time of a block of sentences, in ms.
BLOCK_MS = 1_800_000

_FOUND = "rec_id long, i long, j long, start_ms long, end_ms long, switches int, min_run_s double, voiced_ratio double, score double"


def _blocks(pool: DataFrame) -> DataFrame:
    """`pool` by block of time, with `pos` (place in the recording), and again, not `own`, in the
    block before where it begins within the longest window after that."""
    order = W.partitionBy("rec_id", "block").orderBy("start", "line_no")
    rows = pool.withColumn("block", F.floor(F.col("start") / BLOCK_MS).cast("long")).withColumn("place", F.row_number().over(order))
    before = rows.groupBy("rec_id", "block").agg(F.count(F.lit(1)).alias("n"))  # a row a block
    before = before.select("rec_id", "block", (F.sum("n").over(W.partitionBy("rec_id").orderBy("block")) - F.col("n")).alias("ahead"))
    rows = rows.join(before, ["rec_id", "block"]).withColumn("pos", F.col("ahead") + F.col("place"))
    reach = F.sequence(F.floor((F.col("start") - LONGEST) / BLOCK_MS).cast("long"), F.col("block"))
    return rows.select("rec_id", "block", "pos", "start", "end", "spk", "music", F.explode(reach).alias("dealt")).withColumn("own", F.col("block") == F.col("dealt"))


def _windows(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
    """All good windows that begin with a block's own sentences.  The second pointer moves on for
    all first ones at once; voiced time, switches and runs are running sums."""
    df = df.sort_values("pos")
    pos, start, end, music = (df[c].to_numpy() for c in ("pos", "start", "end", "music"))
    rounded = lambda x, n: [round(v, n) for v in x.tolist()]
    spk, first = pd.factorize(df["spk"])[0], np.flatnonzero(df["own"].to_numpy())
    voiced, other = np.zeros((2, len(first)), np.int64), np.full(len(first), -1)
    last, since, until = (x[first].copy() for x in (spk, start, start))
    switches, least = np.zeros(len(first), np.int64), np.full(len(first), np.iinfo(np.int64).max)
    alive, out = np.arange(len(first)), []
    for step in range(len(df)):
        alive = alive[first[alive] + step < len(df)]
        j = first[alive] + step
        on = (end[j] - start[first[alive]] <= LONGEST) & ~music[j]  # a longer window holds the music too
        second = (spk[j] != spk[first[alive]]) & (other[alive] < 0)
        other[alive[on & second]] = spk[j[on & second]]
        alive, j = alive[on], j[on]
        known = (spk[j] == spk[first[alive]]) | (spk[j] == other[alive])
        alive, j = alive[known], j[known]  # a third speaker stays in all longer windows
        if not len(alive):
            break
        voiced[(spk[j] != spk[first[alive]]).astype(int), alive] += end[j] - start[j]
        new = spk[j] != last[alive]
        a = alive[new]
        least[a], switches[a] = np.minimum(least[a], until[a] - since[a]), switches[a] + 1
        since[a], last[alive], until[alive] = start[j[new]], spk[j], end[j]
        span, both = end[j] - start[first[alive]], voiced[:, alive]
        total, little = both.sum(axis=0), both.min(axis=0)
        good = (span >= SHORTEST) & (other[alive] >= 0) & (switches[alive] >= SWITCHES) & (little >= LEAST_MS) & (little >= LEAST_SHARE * total)
        if good.any():
            a, span, total, j = alive[good], span[good], total[good], j[good]
            run = np.minimum(least[a], until[a] - since[a]) / 1000
            score = run + 2.0 * np.minimum(6, switches[a]) + 10.0 * total / span
            out.append(pd.DataFrame({
                "rec_id": key[0], "i": pos[first[a]], "j": pos[j], "start_ms": start[first[a]], "end_ms": end[j], "switches": switches[a].astype(np.int32),
                "min_run_s": rounded(run, 2), "voiced_ratio": rounded(total / span, 3), "score": rounded(score, 2),
            }))
    return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in _FOUND.split(", ")])


def speaker_windows(sentences: DataFrame) -> DataFrame:
    """The best windows of each recording, few of which overlap much: 30 to 90 s, two
    speakers who each talk enough, two switches or more, no music.

    Sentences are dealt by blocks of time, with those that a window may reach after; then, in as many
    rounds as windows are wanted, each recording's best one takes out what overlaps it.
    """
    pool = sentences.filter("spk is not null and end > start").withColumn("music", F.contains(F.coalesce("text", F.lit("")), F.lit(MUSIC)))
    found = _blocks(pool).groupBy("rec_id", "dealt").applyInPandas(_windows, _FOUND)
    names = [c.split()[0] for c in _FOUND.split(", ")][1:]
    off = F.abs(F.col("end_ms") - F.col("start_ms") - 60_000)
    left, kept = stage(found.withColumn("rank", F.struct((-F.col("score")).alias("score"), off.alias("off"), "i", "j")), "windows"), None
    for place in range(1, TOP + 1):
        best = stage(left.groupBy("rec_id").agg(F.min(F.struct("rank", *names)).alias("w")), "best")
        won = best.select("rec_id", *[F.col(f"w.{c}").alias(c) for c in names], F.lit(place).cast("long").alias("place"))
        kept = won if kept is None else kept.unionByName(won)
        both = F.least("end_ms", "w.end_ms") - F.greatest("start_ms", "w.start_ms")
        left = left.join(best, "rec_id").filter(both <= OVERLAP * (F.col("end_ms") - F.col("start_ms"))).drop("w")
    return kept


def projects(documents: DataFrame) -> DataFrame:
    """One row for each project document (key, content) whose id is its key: state, chapters,
    stories (told, else counted), recommended highlights; the last updated first."""
    parsed = documents.withColumn("p", F.try_parse_json("content"))
    text = lambda path: F.try_variant_get("p", path, "string")
    rows = lambda path: F.try_variant_get("p", path, "array<variant>")
    n = lambda a: F.coalesce(F.size(a), F.lit(0))
    chapters, picks = rows("$.analysis.structure.chapters"), rows("$.analysis.highlights")
    counted = F.coalesce(F.aggregate(chapters, F.lit(0), lambda a, c: a + n(F.try_variant_get(c, "$.stories", "array<variant>"))), F.lit(0))
    liked = F.filter(picks, lambda h: F.coalesce(F.try_variant_get(h, "$.recommended", "boolean"), F.lit(False)))
    some = lambda c: F.when(c.isNotNull(), F.size(c)).otherwise(0)
    out = parsed.filter(text("$.project_id") == F.col("key")).select(
        "key", F.coalesce(text("$.state"), F.lit("")).alias("state"), F.coalesce(text("$.updated_at"), F.lit("")).alias("updated_at"), some(chapters).alias("chapters"),
        F.coalesce(F.try_variant_get("p", "$.analysis.structure.stats.story_count", "int"), counted).alias("stories"), some(liked).alias("recommended"),
    )
    return out.orderBy(F.desc("updated_at"), "key")
