"""Human labels: annotated texts, turn sheets, and turns by place in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The lines of annotated texts and of turn sheets.
BLOCK = r"^# 段([0-9]+) 模型判：.*?（([0-9.]+)s–([0-9.]+)s） —— 内容：(.*)$"
SENTENCE = r"^#\s*([0-9.]+)\s*[-–]\s*([0-9.]+)\s+spk-[0-9]+\s+(.*)$"
PERSON = r"h?uman_spk_([0-9]+)"
TOTAL = "总人数"
CUT = "A{3,}"
ROW = r"^([0-9]{1,3})\s+\[约([^\]]+)\]\s*说话人\s*=\s*(.*)$"
MORE = r"^([0-9?]+)\s*(.+)$"
TOKEN = r"^[_\s]*([0-9?]*)[_\s]*(.*)$"
UNSURE = "unsure"


def _lines(documents: DataFrame) -> DataFrame:
    return documents.select("rec_id", F.posexplode(F.split("content", "\r?\n")).alias("pos", "line"))


def _part(pattern: str, k: int, column: str = "line") -> Column:
    return F.regexp_extract(column, pattern, k)


def char_turns(anchors: DataFrame) -> DataFrame:
    """Parts of the contents between marks of three A or more; a part's times lie in its
    anchor's as its characters lie in the content, a mark counting three.

    `anchors`: rec_id, anchor_no, start, end (ms), content; other columns stay.
    """
    keep = [c for c in anchors.columns if c != "content"]
    parts = anchors.select(*keep, F.greatest(F.lit(1), F.length("content")).alias("n__c"), F.posexplode(F.split("content", CUT, -1)).alias("part_no", "part"))
    w = W.partitionBy("rec_id", "anchor_no").orderBy("part_no").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("part") + 3).over(w), F.lit(0))
    rows = parts.withColumn("at__c", at).filter(F.trim("part") != "")
    length = F.greatest(F.lit(1), F.col("end") - F.col("start"))
    time = lambda c: F.floor(F.col("start") + length * c / F.col("n__c")).cast("long")
    return rows.select(*keep, "part_no", F.trim("part").alias("text"), time(F.col("at__c")).alias("est_start"), time(F.col("at__c") + F.length("part")).alias("est_end"))


def annotated_turns(documents: DataFrame) -> DataFrame:
    """rec_id, anchor_no, kind, seg, people, text, est_start, est_end from annotated texts
    (rec_id, content).

    Blocks and sentences are two levels of one region: sentences count where one carries a
    mark, else blocks where one does, else both.  A line that names people belongs to the
    anchor before it, if that is a block (the last such line counts); sentences have the
    people of all blocks.
    """
    block, sentence = F.col("line").rlike(BLOCK), F.col("line").rlike(SENTENCE)
    number = lambda c: F.try_to_number(c, F.lit("999999999.999")).cast("double")
    kind = F.when(block, "block").when(sentence, "sentence")
    people = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower("line"), F.lit(PERSON), F.lit(1)), lambda x: x.cast("int"))))
    named = ~block & ~sentence & (F.col("line") != "") & ~F.startswith("line", F.lit("#")) & ~F.startswith("line", F.lit(TOTAL))
    rows = _lines(documents).select(
        "rec_id", "pos", kind.alias("kind"), F.when(block, _part(BLOCK, 1).cast("int")).alias("seg"),
        F.when(block, F.floor(_part(BLOCK, 2).try_cast("double") * 1000)).otherwise(F.floor(_part(SENTENCE, 1).try_cast("double"))).cast("long").alias("start"),
        F.when(block, F.floor(_part(BLOCK, 3).try_cast("double") * 1000)).otherwise(F.floor(_part(SENTENCE, 2).try_cast("double"))).cast("long").alias("end"),
        F.when(block, _part(BLOCK, 4)).otherwise(_part(SENTENCE, 3)).alias("content"), F.when(named, people).otherwise(F.array().cast("array<int>")).alias("people"),
    )
    w = W.partitionBy("rec_id").orderBy("pos")
    last = F.last(F.when(F.col("kind").isNotNull(), F.struct("kind", "seg")), ignorenulls=True).over(w)
    rows = rows.withColumn("last", last)
    told = rows.filter((F.size("people") > 0) & F.col("kind").isNull() & (F.col("last.kind") == "block")).groupBy("rec_id", F.col("last.seg").alias("seg")).agg(F.max_by("people", "pos").alias("people"))
    everyone = told.groupBy("rec_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("people")))).alias("everyone"))
    anchors = rows.filter("kind is not null").select("rec_id", F.row_number().over(w).alias("anchor_no"), "kind", "seg", "start", "end", "content")
    marked = anchors.groupBy("rec_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("content").rlike(CUT)).otherwise(False)).alias(f"{k}_marked") for k in ("sentence", "block")])
    level = F.when(F.col("sentence_marked"), "sentence").when(F.col("block_marked"), "block")
    chosen = anchors.join(marked.select("rec_id", level.alias("level")), "rec_id").filter("level is null or level = kind")
    turns = char_turns(chosen).join(told, ["rec_id", "seg"], "left").join(everyone, "rec_id", "left")
    whole = F.when(F.col("level") == "sentence", F.col("everyone"))
    own = F.coalesce("people", whole, F.array().cast("array<int>"))
    return turns.select("rec_id", "anchor_no", "part_no", "kind", "seg", own.alias("people"), "text", "est_start", "est_end")


def turn_sheets(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, missing) from filled turn sheets (rec_id, content).

    A line that continues a row takes the later part of its time, by the lengths of the two
    texts.  Each digit is a person (`human_spk_0N`, comma-joined), ? is unsure.  Rows without
    a speaker are missing, and a recording with such rows has no labels.
    """
    lines = _lines(documents).filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")) & ~F.startswith("line", F.lit(TOTAL)))
    is_row = F.col("line").rlike(ROW)
    lines = lines.filter(is_row | F.col("line").rlike(MORE)).withColumn("is_row", is_row)
    rest = _part(ROW, 3)
    spk = F.when(F.col("is_row"), F.regexp_extract(rest, TOKEN, 1)).otherwise(_part(MORE, 1))
    text = F.when(F.col("is_row"), F.trim(F.regexp_extract(rest, TOKEN, 2))).otherwise(F.trim(_part(MORE, 2)))
    span = F.split(F.replace(_part(ROW, 2), F.lit("s"), F.lit("")), "–")
    ms = lambda k: F.floor(F.trim(F.get(span, k)).try_cast("double") * 1000).cast("long")
    w = W.partitionBy("rec_id").orderBy("pos")
    rows = lines.select("rec_id", "pos", "is_row", spk.alias("spk"), text.alias("text"), F.when(F.col("is_row"), ms(0)).alias("a"), F.when(F.col("is_row"), ms(1)).alias("b"), F.when(F.col("is_row"), _part(ROW, 1).cast("int")).alias("row_no"))
    rows = rows.withColumn("group_no", F.sum(F.col("is_row").cast("int")).over(w)).filter("group_no > 0")
    # begins of a row and of those that continue it, one after the other
    item = F.array_sort(F.collect_list(F.struct("pos", "spk", "text", "is_row", F.length("text").alias("n"))))
    groups = rows.groupBy("rec_id", "group_no").agg(item.alias("items"), F.max("a").alias("a"), F.max("b").alias("b"), F.max("row_no").alias("row_no"))

    def begin(done: Column, x: Column) -> Column:
        at, n = F.element_at(done, -1)["at"], F.element_at(done, -1)["n"]
        cut = F.floor(at + (F.col("b") - at) * n / F.greatest(F.lit(1), n + x["n"])).cast("long")
        return F.array_append(done, F.struct(cut.alias("at"), x["n"].alias("n")))

    first = F.array(F.struct(F.col("a").alias("at"), F.get("items", F.lit(0))["n"].alias("n")))
    groups = groups.withColumn("begins", F.aggregate(F.slice("items", F.lit(2), F.size("items")), first, begin))
    each = groups.select("rec_id", "group_no", "row_no", "b", "begins", F.posexplode("items").alias("k", "x"))
    end = F.coalesce(F.get("begins", F.col("k") + 1)["at"], F.col("b"))
    people = F.array_join(F.transform(F.filter(F.split("x.spk", ""), lambda c: c != ""), lambda c: F.when(c == "?", UNSURE).otherwise(F.concat(F.lit("human_spk_"), F.lpad(c, 2, "0")))), ",")
    out = each.select("rec_id", F.col("x.pos").alias("pos"), F.when(F.col("k") == 0, F.col("row_no")).alias("row_no"), people.alias("speaker"), F.col("x.text").alias("text"), F.get("begins", F.col("k"))["at"].alias("est_start"), end.alias("est_end"), (F.col("k") > 0).alias("continued"))
    missing = out.filter("speaker = '' and not continued").select("rec_id", "row_no")
    labels = out.join(missing.select("rec_id").distinct(), "rec_id", "left_anti")
    place = F.row_number().over(W.partitionBy("rec_id").orderBy("pos"))
    return labels.select("rec_id", place.alias("label_no"), "speaker", "text", "est_start", "est_end", "continued"), missing
