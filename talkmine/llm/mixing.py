"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import stage, texts

#: Weights that sources get in turn, the words of the mix as a share of all words,
#: and the most often that a source is taken.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: How the weight of a source changes over training time 0 to 1, by its weight:
#: (time, factor) knots with straight lines between them.
SCHEDULES = {
    5.0: ((0.0, 1.5), (1.0, 0.5)),
    2.0: ((0.0, 1.0), (1.0, 1.0)),
    1.0: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
}
FLAT = ((0.0, 1.0), (1.0, 1.0))
#: Parts at least into which the documents of a source are dealt for running sums, a power
#: of two; more documents have about the root of their number.
BUCKETS = 64
#: Tables of a row for each source are broadcast up to so many sources, and joined beyond.
BROADCAST_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, tuple[float, float]]:
    """(weight, target) of each source: `share` of all words by weight, at most
    `most` times the source's own, the excess dealt again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(order)}
    target, free, rest = {}, list(order), share * sum(sizes.values())
    while free:
        unit = rest / sum(weight[s] for s in free)
        above = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not above:
            target |= {s: unit * weight[s] for s in free}
            break
        for s in above:
            target[s] = most * sizes[s]
            rest -= target[s]
        free = [s for s in free if s not in target]
    return {s: (weight[s], max(0.0, target[s])) for s in order}


def integrated(knots) -> tuple[list[float], list[float], list[float]]:
    """Times, factors and integral up to each knot, scaled to an integral of 1."""
    times, factors = [float(t) for t, _ in knots], [float(v) for _, v in knots]
    sums = [0.0]
    for k in range(1, len(times)):
        sums.append(sums[-1] + (times[k] - times[k - 1]) * (factors[k] + factors[k - 1]) / 2)
    return times, [v / sums[-1] for v in factors], [s / sums[-1] for s in sums]


def inverted(share: Column) -> Column:
    """The time at which a source has met `share` of its demand: the segment of its
    integral that holds it, then the root of a quadratic."""
    k = F.least(F.greatest(F.size(F.filter("sums", lambda c: c <= share)), F.lit(1)), F.size("sums") - 1)
    at = lambda c, i: F.element_at(F.col(c), i.cast("int"))
    slope = (at("factors", k + 1) - at("factors", k)) / (at("times", k + 1) - at("times", k))
    left, a = share - at("sums", k), at("factors", k)
    root = F.sqrt(F.greatest(a * a + 2 * slope * left, F.lit(0.0)))
    return F.least(F.lit(1.0), at("times", k) + F.coalesce(F.try_divide(2 * left, a + root), F.lit(0.0)))


def order_of(seed: int = 1) -> Column:
    """The hash by which a source's documents are ordered."""
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")), F.lit(seed))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, schedules=SCHEDULES, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, positions, order of every row.

    A source's documents stand in the order of a seeded hash.  It takes whole passes
    over them while its target lasts, then documents of a further pass whose running
    sum stays within the rest, then the one other document whose size comes nearest to
    what is left, if that brings the sum nearer.  Copies stand at running token offsets;
    `positions` are the training times at which the integral of the source's schedule
    reaches them.

    Running sums are made within (source, hash bucket) and added up over buckets, whose
    number grows with the root of the rows.  Tables of a row for each source are broadcast, so
    a source that holds most rows is many tasks'.  The driver holds one row for each source.
    Null text: size 0.  Null source: a source of its own.  Null or repeated doc_id: rows
    like others.  Empty table: no rows.  Columns other than doc_id, text and source, whatever
    their names, are not read.
    """
    spark = docs.sparkSession
    size = F.regexp_count("text", F.lit(WORD)).cast("long")
    rows = texts(docs, "source").select("doc_id", "source", size.alias("size"), order_of(seed).alias("order"))
    rows = stage(rows.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    bits = max(BUCKETS, math.isqrt(rows.count())).bit_length() - 1
    rows = rows.withColumn("bucket", F.shiftrightunsigned("order", 64 - bits).cast("int"))
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    catalog = []
    for k, (s, (weight, target)) in enumerate(targets(sizes, weights, share, most).items()):
        passes = min(int(most), int(target // sizes[s])) if sizes[s] else 0
        catalog.append((k, s, sizes[s], target, passes, target - passes * sizes[s], *integrated(schedules.get(weight, FLAT))))
    schema = "source_no int, name string, source_size long, target double, passes int, rest double, times array<double>, factors array<double>, sums array<double>"
    sources = spark.createDataFrame(catalog, schema)
    small = F.broadcast if len(catalog) <= BROADCAST_SOURCES else lambda df: df
    sources = small(sources)
    rows = rows.join(sources.select("source_no", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    earlier = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("source_no", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = W.partitionBy("source_no", "bucket").orderBy("order", "doc_id", "rid").rowsBetween(W.unboundedPreceding, -1)
    run = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(base, ["source_no", "bucket"])
    run = run.withColumn("before", F.col("before") + F.col("base")).drop("base").join(sources.select("source_no", "passes", "rest"), "source_no")
    run = stage(run.withColumn("extra", F.col("before") + F.col("size") <= F.col("rest")), "runs")
    met = run.groupBy("source_no").agg(F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).alias("met"))
    met = small(stage(met, "met"))
    left = run.filter("not extra").join(met, "source_no").withColumn("off", F.abs(F.col("rest") - F.col("met") - F.col("size")))
    closing = left.filter(F.col("off") < F.col("rest") - F.col("met")).groupBy("source_no").agg(F.min(F.struct("off", "order", "doc_id", "rid", "size")).alias("c"))
    ends = sources.join(met, "source_no").join(closing, "source_no", "left").select(
        "source_no", "source_size", "target", "times", "factors", "sums", "met", F.col("c.rid").alias("closing_rid"),
        (F.col("passes") * F.col("source_size") + F.col("met") + F.coalesce("c.size", F.lit(0))).alias("all_taken"),
    )
    out = run.join(small(stage(ends, "ends")), "source_no").withColumn("closes", F.coalesce(F.col("rid") == F.col("closing_rid"), F.lit(False)))
    copies = F.col("passes") + F.when(F.col("extra") | F.col("closes"), 1).otherwise(0)
    offset = lambda p: p * F.col("source_size") + F.when(F.col("closes") & (p == F.col("passes")), F.col("met")).otherwise(F.col("before"))
    share_at = lambda p: F.coalesce(F.try_divide(offset(p) + F.col("size") / 2, F.col("all_taken")), F.lit(0.0))
    # two copies at most: no lambda, so that the expressions are compiled
    first, second = F.when(F.col("copies") >= 1, inverted(share_at(F.lit(0)))), F.when(F.col("copies") >= 2, inverted(share_at(F.lit(1))))
    times = F.array_compact(F.array(first, second)) if most <= 2 else F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda p: inverted(share_at(p)))
    times = F.when(F.col("copies") >= 1, times).otherwise(F.array().cast("array<double>"))
    return out.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), times.alias("positions"), "order"
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix with their own columns, a row for each copy, range-sorted
    by training position.

    Rows that repeat a doc_id and text are one document: it comes as often as all of them
    are taken, with the other columns of one of them.  Null text or source, null doc_id and
    the empty table: as in `mix`.  Columns may have any names but those that begin with mix__.
    """
    mixed = mix(docs, **how)
    own = mixed.filter("taken > 0 or size = 0").select(F.col("doc_id").alias("mix__id"), F.col("order").alias("mix__order"), F.explode("positions").alias("mix__position"))
    own = stage(own, "taken")
    rows = docs.withColumn("mix__own", order_of(**{k: v for k, v in how.items() if k == "seed"}))
    if not mixed.groupBy("doc_id", "order").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "mix__own"])
    both = rows.join(own, F.col("doc_id").eqNullSafe(F.col("mix__id")) & (F.col("mix__own") == F.col("mix__order")))
    return both.orderBy("mix__position", "mix__id").select(*docs.columns)
