"""Replies of an outside model, read with tolerance: a broken reply gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DIMENSIONS, NEGATIVE_RULES, REJECT_KINDS
from ..functions.clock import clamp, to_seconds

#: Other names of a sub-score.
ALIASES = {"persona": ("persona", "personality", "personality_score", "persona_score")}


def _get(item: str, path: str) -> Column:
    return F.try_variant_get(F.col(item), f"$.{path}", "variant")


def _text(item: str, path: str, default: str = "", cut: int | None = None) -> Column:
    out = F.trim(F.coalesce(F.try_variant_get(F.col(item), f"$.{path}", "string"), F.lit(default)))
    return F.substr(out, F.lit(1), F.lit(cut)) if cut else out


def whole_number(value: Column) -> Column:
    """A whole number as strings of digits, numbers (cut towards zero) and truth values give
    one; null else.  A string of a fraction gives none."""
    kind = F.schema_of_variant(value)
    as_text = F.try_variant_get(value, "$", "string")
    digits = F.when(as_text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(as_text).try_cast("long"))
    return F.when(kind == "STRING", digits).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("long")).otherwise(
        F.try_variant_get(value, "$", "double").cast("long")
    )


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string").try_cast("double")


def _truth(item: str, path: str, default: bool = False) -> Column:
    """Truth of a value: false, 0, empty text and null are not true."""
    raw = F.try_variant_get(F.col(item), f"$.{path}", "string")
    return F.when(raw.isNull(), default).otherwise(~F.lower(raw).isin("false", "0", "", "0.0", "[]", "{}"))


def _items(replies: DataFrame, field: str, bare: bool = False) -> DataFrame:
    """A row for each object of the list `field`, with its place; `bare`: the reply may be
    the list itself."""
    parsed = replies.withColumn("data__r", F.try_parse_json("reply"))
    rows = F.try_variant_get("data__r", f"$.{field}", "array<variant>")
    if bare:
        rows = F.coalesce(rows, F.try_variant_get("data__r", "$", "array<variant>"))
    keep = [c for c in replies.columns if c != "reply"]
    each = parsed.select(*keep, F.posexplode(rows).alias("pos", "item"))
    return each.filter(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))


def candidates(replies: DataFrame) -> DataFrame:
    """rec_id, chunk_no, pos and the candidate's fields; without both times or a whole score
    it is dropped."""
    rows = _items(replies, "candidates")
    score = whole_number(F.coalesce(_get("item", "score"), F.parse_json(F.lit("0"))))
    out = rows.withColumn("raw_score", score).select(
        "rec_id", "chunk_no", "pos", _text("item", "start_time").alias("start_time"), _text("item", "end_time").alias("end_time"), _text("item", "title").alias("title"),
        _text("item", "highlight_type", "事件型").alias("highlight_type"), F.greatest(F.lit(1), F.least(F.lit(10), F.col("raw_score"))).alias("score"), "raw_score",
        _text("item", "reason", cut=150).alias("reason"), _text("item", "category", "其他").alias("category"), _text("item", "viral_probability", "中").alias("viral_probability"),
        _text("item", "editing_advice", cut=80).alias("editing_advice"), clamp(_number(_get("item", "confidence")), 0, 1, 0.5).alias("confidence"),
        _text("item", "event_context", cut=200).alias("event_context"), _text("item", "event_boundary_note", cut=200).alias("event_boundary_note"),
    )
    return out.filter("start_time <> '' and end_time <> '' and raw_score is not null").drop("raw_score")


def reviews(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviews, warnings): five sub-scores under `scores` or flat, by any of their names,
    5 and a warning where one is missing or no number."""
    rows = _items(replies, "results").withColumn("event_id", _text("item", "event_id"))
    lost = rows.filter("event_id = ''").select("rec_id", F.lit("no event_id").alias("warning"))
    kept = rows.filter("event_id <> ''")
    for key in DIMENSIONS:
        names = ALIASES.get(key, (key,))
        paths = [p for n in names for p in (f"scores.{n}", f"scores.{n}_score", n, f"{n}_score")]
        kept = kept.withColumn(f"raw__{key}", F.coalesce(*[_get("item", p) for p in paths]))
    dims = {k: F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(whole_number(F.col(f"raw__{k}")), F.lit(5)))) for k in DIMENSIONS}
    flags = F.try_variant_get("item", "$.negative_flags", "array<string>")
    flags = F.coalesce(flags, F.array_compact(F.array(F.try_variant_get("item", "$.negative_flags", "string"))))
    kind = _text("item", "reject_reason_kind")
    out = kept.select(
        "rec_id", "event_id", "pos", *[c.alias(k) for k, c in dims.items()],
        F.array_intersect(F.transform(flags, lambda f: F.trim(f)), F.array(*[F.lit(x) for x in NEGATIVE_RULES])).alias("negative_flags"),
        _text("item", "why_cut").alias("why_cut"), _text("item", "risk").alias("risk"),
        F.when(_get("item", "confidence").isNotNull(), clamp(_number(_get("item", "confidence")), 0, 1, 0.5)).alias("confidence"),
        _text("item", "recommended_start").alias("recommended_start"), _text("item", "recommended_end").alias("recommended_end"),
        whole_number(_get("item", "recommended_duration")).alias("recommended_duration"), _truth("item", "context_incomplete").alias("need_expand"),
        F.when(kind.isin(*REJECT_KINDS), kind).otherwise("").alias("reject_kind"),
    )
    told = F.array_compact(F.array(*[F.when(F.col(f"raw__{k}").isNull(), F.concat(F.lit(f"missing {k}: "), "event_id")).when(whole_number(F.col(f"raw__{k}")).isNull(), F.concat(F.lit(f"no number {k}: "), "event_id")) for k in DIMENSIONS]))
    warnings = kept.select("rec_id", F.explode(told).alias("warning")).unionByName(lost)
    return out, warnings


def judgements(replies: DataFrame) -> DataFrame:
    """One judgement for each cluster's reply that is an object."""
    rows = replies.withColumn("item", F.try_parse_json("reply")).filter(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))
    keep = [c for c in replies.columns if c != "reply"]
    structure = F.struct(*[_text("item", f"structure.{p}").alias(p) for p in ("setup", "development", "payoff")])
    return rows.select(
        *keep, _truth("item", "same_event", True).alias("same_event"), _text("item", "event_summary").alias("event_summary"), _text("item", "event_type").alias("event_type"),
        _text("item", "event_start").alias("event_start"), _text("item", "event_end").alias("event_end"), structure.alias("structure"), _text("item", "strongest_moment").alias("strongest_moment"),
        _text("item", "reason").alias("reason"), clamp(_number(_get("item", "confidence")), 0, 1, 0.5).alias("confidence"), _truth("item", "need_more_context").alias("need_more_context"),
        F.lower(_text("item", "expand_direction")).alias("expand_direction"),
    )


def miss_checks(replies: DataFrame, chunks: DataFrame, top: int = 3) -> DataFrame:
    """rec_id, chunk_no, reason: the first `top` risky chunks told, of those that exist."""
    rows = _items(replies, "checks").withColumn("chunk_no", whole_number(F.coalesce(_get("item", "chunk"), F.parse_json(F.lit("0")))))
    rows = rows.filter(_truth("item", "miss_risk")).filter("chunk_no is not null").withColumn("reason", _text("item", "reason"))
    first = rows.withColumn("place", F.row_number().over(W.partitionBy("rec_id").orderBy("pos"))).filter(F.col("place") <= top)
    n = chunks.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"))
    return first.join(n, "rec_id").filter("chunk_no between 1 and n").select("rec_id", "place", "chunk_no", "reason")


def highlights(replies: DataFrame) -> DataFrame:
    """Highlights of {"highlights": [..]} or a bare list, the best first."""
    rows = _items(replies, "highlights", bare=True).withColumn("raw_score", whole_number(_get("item", "score"))).filter("raw_score is not null")
    out = rows.select("rec_id", "pos", *[_text("item", c).alias(c) for c in ("start_time", "end_time", "reason", "suggested_title")], F.greatest(F.lit(1), F.least(F.lit(10), F.col("raw_score"))).alias("score"))
    return out.withColumn("place", F.row_number().over(W.partitionBy("rec_id").orderBy(F.desc("score"), "pos")))


def provider_turns(replies: DataFrame, lists: tuple[str, ...], names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Turns in seconds from a diarization reply: the first of `lists` that there is;
    `names`: paths of start, end, text and speaker.  Without a speaker a row is dropped; a
    number n is spk_n."""
    parsed = replies.withColumn("data__r", F.try_parse_json("reply"))
    found = F.coalesce(*[F.try_variant_get("data__r", p, "array<variant>") for p in lists])
    rows = parsed.select("rec_id", F.posexplode(found).alias("pos", "item"))
    first = lambda k: F.coalesce(*[F.try_variant_get("item", f"$.{p}", "string") for p in names[k]])
    raw = F.trim(first("speaker"))
    speaker = F.when(raw.rlike("^[0-9]+$"), F.concat(F.lit("spk_"), raw.cast("long").cast("string"))).otherwise(raw)
    seconds = lambda k: first(k).try_cast("double") / 1000
    out = rows.select("rec_id", "pos", seconds("start").alias("start"), seconds("end").alias("end"), F.coalesce(first("text"), F.lit("")).alias("text"), speaker.alias("speaker"))
    return out.filter("speaker <> '' and start is not null and end is not null")


def utterance_turns(replies: DataFrame) -> DataFrame:
    lists = ("$.result.utterances", "$.result[0].utterances", "$.result", "$.utterances")
    return provider_turns(replies, lists, {"start": ("start_time",), "end": ("end_time",), "text": ("text",), "speaker": ("additions.speaker", "speaker", "speaker_id", "additions.speaker_id")})


def sentence_turns(replies: DataFrame) -> DataFrame:
    lists = ("$.Result.Sentences", "$.Result", "$.Sentences")
    return provider_turns(replies, lists, {"start": ("BeginTime", "begin_time"), "end": ("EndTime", "end_time"), "text": ("Text", "text"), "speaker": ("SpeakerId", "speaker_id", "PersonId")})


def structure(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters, stories) with valid times from (rec_id, reply); a story's id is made unique
    by its chapter's."""
    def rows(field: str) -> DataFrame:
        each = _items(documents, field)
        start, end = to_seconds(_text("item", "start_time"), digits=True), to_seconds(_text("item", "end_time"), digits=True)
        return each.withColumns({"start": start, "end": end}).filter("start is not null and end is not null")

    title = F.coalesce(F.nullif(_text("item", "story_title"), F.lit("")), _text("item", "name"))
    chapters = rows("chapters").select("rec_id", _text("item", "chapter_id", "unknown").alias("chapter_id"), _text("item", "chapter_title").alias("title"), "start", "end")
    stories = rows("stories").withColumn("chapter_id", _text("item", "chapter_id", "unknown"))
    story_id = F.concat_ws("-", F.col("chapter_id"), _text("item", "story_id", "unknown"))
    return chapters, stories.select("rec_id", story_id.alias("story_id"), "chapter_id", title.alias("title"), "start", "end")
