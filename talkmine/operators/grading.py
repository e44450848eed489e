"""Reviews to grades, recommended spans, ranks and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DIMENSION_LABEL, DIMENSIONS, QUALITY_LABEL, Selection
from ..functions.clock import clamp
from ..functions.scores import grade, rank, tier, weighted


def with_reviews(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """Events with their reviews, those without one too: sub-scores, final_score, grade,
    d_guarded and whether `reviewed`.

    A D of a reason other than low value is a C.  Without a review the first score counts
    ten times, without that guard.
    """
    r = reviews.withColumn("reviewed", F.lit(True)).withColumn("reviewed_score", weighted())
    joined = events.join(r, ["rec_id", "event_no"], "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))
    first = clamp(F.col("score"), 0, 10, 5) * 10
    final = F.when(F.col("reviewed"), F.col("reviewed_score")).otherwise(F.round(first, 1))
    fallback = clamp(F.col("score"), 1, 10, 5).cast("long")
    dims = {k: F.when(F.col("reviewed"), F.coalesce(F.col(k), F.lit(5))).otherwise(fallback) for k in DIMENSIONS}
    out = joined.withColumn("final_score", final).withColumns(dims).drop("reviewed_score")
    plain = grade(F.col("final_score"))
    excused = F.col("reviewed") & (F.coalesce("reject_kind", F.lit("")) != "") & (F.col("reject_kind") != "truly_low_value")
    out = out.withColumn("grade", F.when((plain == "D") & excused, "C").otherwise(plain))
    return out.withColumn("d_guarded", excused & (F.col("grade") == "C"))


def cap_flagged(graded: DataFrame) -> DataFrame:
    """Flagged events are B at most; lower grades stay."""
    flagged = F.coalesce("flagged", F.lit(False))
    return graded.withColumn("grade", F.when(flagged & F.col("grade").isin("S", "A"), "B").otherwise(F.col("grade")))


def with_reject_reason(graded: DataFrame) -> DataFrame:
    """Why a D is one: its risk, else the rule it meets, else the line it misses."""
    risk = F.when(F.coalesce("risk", F.lit("")) != "", F.col("risk")) if "risk" in graded.columns else F.lit(None).cast("string")
    why = F.coalesce(risk, F.when(F.coalesce("flagged", F.lit(False)), "命中「不值得剪」规则").otherwise("五维加权未达质量线"))
    return graded.withColumn("reject_reason", F.when(F.col("grade") == "D", why))


def keep_one(graded: DataFrame, cfg: Selection = Selection()) -> DataFrame:
    """Where no event reaches the C line but the best the lower one, the first best is C
    and marked."""
    w = W.partitionBy("rec_id")
    best = F.max("final_score").over(w)
    first = F.row_number().over(w.orderBy(F.desc("final_score"), "event_no")) == 1
    forced = (best < 50) & (best >= cfg.forced_keep) & first
    return graded.withColumn("forced_keep", forced).withColumn("grade", F.when(F.col("forced_keep"), "C").otherwise(F.col("grade"))).withColumn(
        "reject_reason", F.when(~F.col("forced_keep"), F.col("reject_reason"))
    )


def ranked(graded: DataFrame) -> DataFrame:
    w = W.partitionBy("rec_id").orderBy(F.desc("final_score"), "event_no")
    return graded.withColumn("place", F.row_number().over(w))


def recommend(graded: DataFrame, cfg: Selection = Selection()) -> DataFrame:
    """Add `recommended` and `recommend_tier`: S and A up to the target, B of the line or
    more up to it, and only without any of these a few C."""
    own = W.partitionBy("rec_id")
    kind = F.when(F.col("grade").isin("S", "A"), 0).when((F.col("grade") == "B") & (F.col("final_score") >= cfg.b_line), 1).when(F.col("grade") == "C", 2).otherwise(3)
    rows = graded.withColumn("kind__r", kind)
    place = F.row_number().over(W.partitionBy("rec_id", "kind__r").orderBy(F.desc("final_score"), "event_no"))
    count = lambda k: F.count_if(F.col("kind__r") == k).over(own)
    taken = F.least(count(0), F.lit(cfg.target))
    chosen = (
        F.when(F.col("kind__r") == 0, place <= cfg.target)
        .when(F.col("kind__r") == 1, place <= cfg.target - taken)
        .when(F.col("kind__r") == 2, (count(0) + count(1) == 0) & (place <= cfg.c_fallback))
        .otherwise(F.lit(False))
    )
    rows = rows.withColumn("recommended", chosen).drop("kind__r")
    return rows.withColumn("recommend_tier", F.when(F.col("recommended"), tier(F.col("grade"))).otherwise(""))


def select(graded: DataFrame, mode: str = "auto", count: int = 10, cfg: Selection = Selection()) -> DataFrame:
    """Add `picked`, `quality` and why an event isn't shown.  auto: the recommended; pool:
    S to C; top: the best `count`, which are all recommended."""
    own = W.partitionBy("rec_id")
    rows = recommend(graded, cfg).withColumn("n_recommended", F.count_if("recommended").over(own))
    order = F.row_number().over(own.orderBy(F.desc("final_score"), "event_no"))
    picked = {"auto": F.col("recommended"), "pool": F.col("grade").isin("S", "A", "B", "C"), "top": order <= max(1, count)}[mode]
    rows = rows.withColumn("picked", picked)
    if mode == "top":
        rows = rows.withColumn("recommended", F.col("picked")).withColumn("recommend_tier", F.when(F.col("picked"), tier(F.col("grade"))).otherwise(""))
    quality = F.lit(None).cast("string")
    if mode == "top":
        quality = F.when(F.col("picked"), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in QUALITY_LABEL.items() for x in kv]), "grade"), F.lit("备用素材")))
    why = (
        F.when(F.col("picked"), None)
        .when((F.col("grade") == "D") & F.col("reject_reason").isNotNull(), F.col("reject_reason"))
        .when(F.col("forced_keep"), "召回优先保留的候选，未进入本模式展示范围")
        .when(F.col("grade").isin("S", "A") & (F.col("n_recommended") >= cfg.target), "内容质量很高，但推荐数量已达目标")
        .otherwise("未进入本模式的展示范围")
    )
    return rows.withColumns({"quality": quality, "reject_reason": why}).drop("n_recommended")


def recommended_span(rows: DataFrame, cfg: Selection = Selection()) -> DataFrame:
    """Add rec_start, rec_end, rec_duration from r_start, r_end, r_duration (seconds or null),
    start, end and total: swapped if backwards, the event's own where they drift too far."""
    bound = lambda c, d: F.least(F.greatest(F.coalesce(F.col(c), F.col(d)).cast("double"), F.lit(0.0)), F.col("total").cast("double"))
    a, b = bound("r_start", "start"), bound("r_end", "end")
    first, last = F.least(a, b), F.greatest(a, b)
    drift = F.greatest(F.abs(first - F.col("start")), F.abs(last - F.col("end"))) > cfg.max_drift
    length = F.greatest(F.lit(0), F.coalesce(F.col("r_duration").cast("long"), F.round(last - first).cast("long")))
    return rows.withColumns({
        "rec_start": F.when(drift, F.col("start").cast("double")).otherwise(first), "rec_end": F.when(drift, F.col("end").cast("double")).otherwise(last),
        "rec_duration": length, "drifted": drift,
    })


def display_order(rows: DataFrame) -> DataFrame:
    """Audit order: by grade, then score."""
    return rows.withColumn("display_no", F.row_number().over(W.partitionBy("rec_id").orderBy(rank(F.col("grade")), F.desc("final_score"), "event_no")))


def readable(rows: DataFrame) -> DataFrame:
    """Sub-scores under their labels with weights."""
    return rows.withColumn("dims", F.create_map(*[x for k, w in DIMENSIONS.items() for x in (F.lit(f"{DIMENSION_LABEL[k]}（权重{w}%）"), F.coalesce(F.col(k), F.lit(0)).cast("int"))]))
