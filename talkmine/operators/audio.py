"""Audio frames: features, loud or odd moments, pauses, and their texts."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import block_size, runs, with_halo
from .ranges import range_join

FRAME = 0.1


def features(frames: DataFrame) -> DataFrame:
    """rec_id, frame_idx, rms, zcr: root mean square, and the share of neighbours of
    opposite sign."""
    x = F.col("samples")
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    signs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.when(a * b < 0, 1).otherwise(0))
    turns = F.aggregate(signs, F.lit(0), lambda a, v: a + v)
    return frames.select("rec_id", "frame_idx", F.sqrt(squares / F.size(x)).alias("rms"), F.when(F.size(x) > 1, turns / (F.size(x) - 1)).otherwise(0.0).alias("zcr"))


def _median_before(feats: DataFrame, frames: int) -> DataFrame:
    """`feats` with `med`, the median of `rms` over up to so many frames before each."""
    window = W.partitionBy("rec_id", "block").orderBy("frame_idx").rangeBetween(-frames, -1)
    rows = with_halo(feats, frames, 0).withColumn("med", F.percentile("rms", 0.5).over(window))
    return rows.filter("own").drop("own", "block")


#: The greatest of parts, each under its own name.
_greatest = lambda x, name: (F.max(x), F.max(name))


def hotspots(feats: DataFrame, loud: float = 0.10, ratio: float = 2.5, high_zcr: float = 0.20, back: int = 20, shortest: int = 3, longest: int = 40) -> DataFrame:
    """Runs of `shortest` to `longest` frames that are loud and burst out of the median of
    the frames before, or are of high zero-crossing rate; their kind by the strongest frame."""
    rows = _median_before(feats, back).withColumn("med", F.coalesce("med", F.lit(0.0)))
    burst = (F.col("med") > 1e-4) & (F.col("rms") / F.col("med") > ratio)
    noisy = F.col("zcr") >= high_zcr
    flag = F.when(F.col("rms") < loud, 0).when(burst & noisy, 3).when(noisy, 2).when(burst, 1).otherwise(0)
    out = runs(rows.withColumn("flag", flag), F.col("flag") > 0, {
        "top": _greatest(F.struct("rms", (-F.col("frame_idx")).alias("i")), "top"), "total": (F.sum("rms"), F.sum("total")), "n": (F.count(F.lit(1)), F.sum("n")),
        "peak_zcr": _greatest("zcr", "peak_zcr"), "flag": _greatest("flag", "flag"),
    })
    length = F.col("last") - F.col("first") + 1
    kinds = F.get(F.array(F.lit("energy_burst"), F.lit("high_freq_burst"), F.lit("strong_anomaly")), F.col("flag") - 1)
    out = out.filter(length.between(shortest, longest))
    return out.select(
        "rec_id", "first", "last", (F.col("first") / 10).alias("start"), ((F.col("last") + 1) / 10).alias("end"), length.alias("frames"), (-F.col("top.i")).alias("peak_idx"),
        F.round("top.rms", 4).alias("peak_energy"), F.round(F.col("total") / F.col("n"), 4).alias("mean_energy"), F.round("peak_zcr", 4).alias("peak_zcr"), kinds.alias("kind"),
    )


def with_text(spots: DataFrame, segments: DataFrame) -> DataFrame:
    """Hotspots with the length of the texts that they overlap and a tag of it."""
    s = segments.select("rec_id", F.col("start").alias("s0"), F.col("end").alias("s1"), F.length("text").alias("n"))
    got = range_join(spots, s, ["rec_id"], ("start", "end"), ("s0", "s1"), 60).groupBy("rec_id", "first").agg(F.sum("n").alias("density"))
    density = F.coalesce("density", F.lit(0))
    tag = F.when(density <= 8, "文本弱").when(density <= 30, "文本中").otherwise("文本强")
    return spots.join(got, ["rec_id", "first"], "left").withColumns({"text_density": density, "text_tag": tag}).drop("density")


def hotspot_stats(tagged: DataFrame) -> DataFrame:
    weak = F.col("text_tag") == "文本弱"
    kind = lambda k: F.count_if(F.col("kind") == k)
    return tagged.groupBy("rec_id").agg(
        F.count(F.lit(1)).alias("total"), kind("strong_anomaly").alias("strong"), kind("high_freq_burst").alias("high_freq"), kind("energy_burst").alias("bursts"),
        F.count_if(weak).alias("text_weak"), F.count_if(weak & (F.col("kind") != "energy_burst")).alias("strong_text_weak"),
    )


def known_or_missed(tagged: DataFrame, events: DataFrame) -> DataFrame:
    """Strong hotspots of weak text, and whether their centre lies in an event."""
    rows = tagged.filter("text_tag = '文本弱' and kind <> 'energy_burst'").withColumn("centre", (F.col("start") + F.col("end")) / 2).withColumn("centre2", F.col("centre"))
    e = events.select("rec_id", F.col("start").alias("e0"), F.col("end").alias("e1"))
    hit = range_join(rows, e, ["rec_id"], ("centre", "centre2"), ("e0", "e1"), 60, closed=True).select("rec_id", "first").distinct().withColumn("known", F.lit(True))
    return rows.join(hit, ["rec_id", "first"], "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("centre2")


def review_list(missed: DataFrame, top: int = 25) -> DataFrame:
    """Missed hotspots, those of least text and most energy first."""
    w = W.partitionBy("rec_id").orderBy("text_density", F.desc("peak_energy"), "first")
    return missed.filter("not known").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def strong_list(spots: DataFrame, top: int = 30) -> DataFrame:
    """Strong hotspots, those of most energy first."""
    w = W.partitionBy("rec_id").orderBy(F.desc("peak_energy"), "first")
    return spots.filter("kind = 'strong_anomaly'").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def energy_bursts(feats: DataFrame, least: float = 0.02, ratio: float = 3.0, back: int = 20, gap: int = 5) -> DataFrame:
    """Bursts out of a whole look-back; hits less than `gap` frames after the last one ends
    are one."""
    hit = (F.col("frame_idx") >= back) & (F.col("med") > 0) & (F.col("rms") > least) & (F.col("rms") / F.col("med") > ratio)
    return runs(_median_before(feats, back), hit, {"peak": _greatest("rms", "peak")}, gap)


def pauses(feats: DataFrame, silence: float = 0.005, shortest: int = 15) -> DataFrame:
    """Runs of silent frames of `shortest` or more."""
    return runs(feats, F.col("rms") < silence, {}).filter(F.col("last") - F.col("first") + 1 >= shortest)


def pause_bursts(feats: DataFrame, silent: DataFrame, least: float = 0.02, ratio: float = 3.0, after: int = 20) -> DataFrame:
    """The loudest frame soon after a pause, if it stands out of the pause."""
    p = silent.select("rec_id", F.col("first").alias("p0"), F.col("last").alias("p1"), (F.col("first") - 3).alias("from"), (F.col("last") + 1 + after).alias("to"))
    f = feats.select("rec_id", "frame_idx", F.col("frame_idx").alias("f1"), "rms")
    near = range_join(p, f, ["rec_id"], ("from", "to"), ("frame_idx", "f1"), 600, closed=True)
    within = F.col("frame_idx").between(F.col("p1") + 1, F.col("p1") + after)
    inside = F.col("frame_idx").between(F.col("p0") - 3, F.col("p1") + 1)
    got = near.groupBy("rec_id", "p0", "p1").agg(
        F.max(F.when(within, F.col("rms"))).alias("peak"), F.max_by(F.when(within, F.col("frame_idx")), F.when(within, F.struct("rms", (-F.col("frame_idx")).alias("i")))).alias("peak_idx"),
        F.percentile(F.when(inside, F.col("rms")), 0.5).alias("med"),
    )
    return got.filter((F.col("peak") > least) & (F.col("peak") / F.greatest(F.col("med"), F.lit(1e-6)) > ratio)).drop("med")


def percentiles(x: np.ndarray, starts: np.ndarray, width: int, share: float) -> np.ndarray:
    """The percentile of each window of `x` from `starts`; places without a frame (NaN) do not count."""
    windows = np.lib.stride_tricks.sliding_window_view(x, width)[starts]
    out = np.percentile(windows, 100 * share, axis=1)
    for k in np.flatnonzero(np.isnan(out)):  # at the ends of a recording
        own = windows[k][~np.isnan(windows[k])]
        out[k] = np.percentile(own, 100 * share) if len(own) else np.nan
    return out


def baselines(feats: DataFrame, wanted: Mapping[str, tuple[int, float]], step: int = 5, block: int | None = None) -> DataFrame:
    """rec_id, frame_idx, rms and, for each name of `wanted` (frames of a window, share), the
    percentile of the window around anchors every `step` frames: straight lines between
    anchors, the last one's value after it.

    Order statistics slide over blocks of frames, so a frame moves once, and its block's
    neighbours see it again only within half a window.
    """
    size = block_size(block)
    halo = max(w // 2 for w, _ in wanted.values()) + step

    def slide(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        at, low = df["frame_idx"].to_numpy(), key[1] * size - halo
        x = np.full(size + 2 * halo, np.nan)
        x[at - low] = df["rms"].to_numpy()
        first, last = key[1] * size // step, min((key[1] + 1) * size - 1 + step, at.max()) // step
        anchors = np.arange(first, last + 1) * step
        own = df[df["own"]]
        i = own["frame_idx"].to_numpy()
        k = i // step - first
        out = {"rec_id": own["rec_id"], "frame_idx": i, "rms": own["rms"]}
        for name, (window, share) in wanted.items():
            v = percentiles(x, anchors - window // 2 - low, 2 * (window // 2), share) if len(own) else np.zeros(0)
            after = np.append(v[1:], np.nan)
            line = v[k] + (after[k] - v[k]) * ((i - (k + first) * step) / step)
            out[name] = np.where(np.isnan(after[k]), v[k], line)
        return pd.DataFrame(out)

    rows = with_halo(feats.select("rec_id", "frame_idx", "rms"), halo, halo, size)
    schema = "rec_id long, frame_idx long, rms double, " + ", ".join(f"{name} double" for name in wanted)
    return rows.groupBy("rec_id", "block").applyInPandas(slide, schema)


def baseline(feats: DataFrame, window: int, share: float, step: int = 5) -> DataFrame:
    """rec_id, frame_idx, base of one window of `baselines`."""
    return baselines(feats, {"base": (window, share)}, step).drop("rms")


def anomalies(feats: DataFrame, segments: DataFrame | None = None, ratio: float = 2.0, burst: float = 1.8, wide: int = 600, near: int = 80, shortest: int = 3, longest: int = 40) -> DataFrame:
    """Runs of frames above both the wide and the near baseline; `speech` tells whether one of
    `segments` covers the peak (null without them)."""
    rows = baselines(feats, {"base_wide": (wide, 0.85), "base_near": (near, 0.5)})
    floor = lambda c: F.greatest(F.col(c), F.lit(1e-4))
    above = (F.col("rms") > floor("base_wide") * ratio) & (F.col("rms") > floor("base_near") * burst)
    out = runs(rows, above, {"top": _greatest(F.struct("rms", (-F.col("frame_idx")).alias("i"), "base_wide"), "top")})
    length = F.col("last") - F.col("first") + 1
    out = out.filter(length.between(shortest, longest)).select("rec_id", "first", "last", (-F.col("top.i")).alias("peak_idx"), F.col("top.rms").alias("peak"), F.col("top.base_wide").alias("base_wide"))
    kind = F.when(length < 8, "short_pulse").when(F.round("peak", 4) > floor("base_wide") * 3.5, "sustained").otherwise("burst")
    out = out.select("rec_id", "first", "last", "peak_idx", F.round("peak", 4).alias("peak"), F.round(F.col("peak") / F.col("base_wide"), 2).alias("above"), kind.alias("kind"))
    if segments is None:
        return out.withColumn("speech", F.lit(None).cast("boolean"))
    frame = lambda c: F.floor(F.col(c) * 10).cast("long")
    spoken = segments.select("rec_id", frame("start").alias("s0"), (frame("end") - 1).alias("s1")).filter("s0 <= s1")
    peaks = out.select("rec_id", "first", "peak_idx", F.col("peak_idx").alias("peak_end"))
    hit = range_join(peaks, spoken, ["rec_id"], ("peak_idx", "peak_end"), ("s0", "s1"), 600, closed=True).select("rec_id", "first").distinct().withColumn("speech", F.lit(True))
    return out.join(hit, ["rec_id", "first"], "left").withColumn("speech", F.coalesce("speech", F.lit(False)))


def speech_marks(feats: DataFrame, segments: DataFrame) -> DataFrame:
    """Frames, and whether a segment covers them."""
    last = F.floor(F.col("end") * 10).cast("long") - 1
    first = F.floor(F.col("start") * 10).cast("long")
    covered = segments.filter(first <= last).select("rec_id", F.explode(F.sequence(first, last)).alias("frame_idx")).distinct().withColumn("speech", F.lit(True))
    return feats.select("rec_id", "frame_idx").join(covered, ["rec_id", "frame_idx"], "left").withColumn("speech", F.coalesce("speech", F.lit(False)))
