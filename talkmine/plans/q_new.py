"""Queries of human labels, lexicons, run reports and the remaining sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audio, cluster, correction, events, lexicon, quality, runs, speakers, truth
from ..operators.ranges import ordered
from ..sources import files
from . import q_media, q_more, views
from .q_rest import _document


def _marked(spark, d):
    """Lines whose blanks are marks of a cut in every third, and times in ms."""
    s = views.segments(spark, d)
    text = F.trim(F.regexp_replace("text", r"[\r\n]+", " "))
    content = F.when(F.col("line_no") % 3 == 0, F.replace(text, F.lit(" "), F.lit("AAA"))).otherwise(text)
    return s.select("rec_id", F.col("line_no").alias("anchor_no"), (F.col("start") * 1000).alias("start"), (F.col("end") * 1000).alias("end"), content.alias("content"))


def wn_char_turns(spark, d):
    return truth.char_turns(_marked(spark, d)).select("rec_id", "anchor_no", "part_no", F.md5("text").alias("text_md5"), "est_start", "est_end")


def src_annotated_truth(spark, d):
    m = _marked(spark, d)
    n = F.col("anchor_no").cast("string")
    sec = lambda c: F.concat((F.col(c) / 1000).cast("long").cast("string"), F.lit(".0s"))
    block = F.concat(F.lit("# 段"), n, F.lit(" 模型判：x（"), sec("start"), F.lit("–"), sec("end"), F.lit("） —— 内容："), "content")
    line = F.when(F.col("anchor_no") % 2 == 0, F.concat(block, F.lit("\n0 9human_spk_02 uman_spk_"), F.col("anchor_no") % 7)).otherwise(F.concat(block, F.lit("\n总人数 3")))
    texts = m.withColumn("line", line).groupBy("rec_id").agg(ordered("line", "anchor_no", separator="\n").alias("content"))
    return truth.annotated_turns(texts).select("rec_id", F.col("seg").cast("long").alias("seg"), "part_no", F.concat_ws(",", F.col("people").cast("array<string>")).alias("people"), F.md5("text").alias("text_md5"), "est_start", "est_end")


def src_turn_sheet(spark, d):
    s = views.segments(spark, d)
    text = F.concat(F.lit("w"), F.col("line_no").cast("string"), F.repeat(F.lit("x"), (F.col("line_no") % 6).cast("int")))
    row = F.concat((F.col("line_no") % 1000).cast("string"), F.lit(" [约"), F.col("start").cast("string"), F.lit(".0s–"), F.col("end").cast("string"), F.lit(".0s] 说话人 =_"), F.when(F.col("line_no") % 5 == 0, "12").when(F.col("line_no") % 5 == 1, "?").otherwise("3"), F.lit("_ "), text)
    line = F.when(F.col("line_no") % 4 == 0, F.concat(row, F.lit("\n2 more"))).otherwise(row)
    texts = s.withColumn("line", F.concat(F.lit("# note\n"), line)).groupBy("rec_id").agg(ordered("line", "line_no", separator="\n").alias("content"))
    return truth.turn_sheets(texts)[0].select("rec_id", F.col("label_no").cast("long").alias("label_no"), "speaker", "text", "est_start", "est_end")


def snk_turns(spark, d):
    s = views.segments(spark, d).select("rec_id", (F.col("start") + 0.5).alias("start"), (F.col("end") + 0.25).alias("end"), "speaker", F.when(F.col("line_no") % 2 == 0, 0.5).alias("confidence"), F.when(F.col("line_no") % 3 == 0, "t").otherwise("").alias("text"))
    return files.turn_records(s)


def snk_hotspot_csv(spark, d):
    rows = files.hotspot_rows(audio.with_text(q_media._spots(spark, d), q_media._short_segments(spark, d)))
    return rows.select("rec_id", "start", "end", "dur", "kind", F.col("text_density").cast("long").alias("text_density"), "text_tag")


def snk_audio_doc(spark, d):
    u, e, t = _document(spark, d)
    meta = u.groupBy("rec_id").agg(F.when(F.max("rec_id") % 2 == 0, "1.0").otherwise("0.9").alias("version"), F.lit("milliseconds").alias("timebase"), F.max("end").alias("duration_ms"))
    faults = quality.document_faults(meta, u, e, t, speakers.speakers(u))
    made = files.audio_documents(meta, u.select("rec_id", "utterance_id", "start", "end", "spk"), e.select("rec_id", "event_id", "start", "end", "label"), t.select("rec_id", "turn_no", "start", "end", "spk"), faults)
    size = lambda name: F.size(F.from_json(F.get_json_object("document", f"$.{name}"), "array<string>")).cast("long")
    return made.select("rec_id", F.get_json_object("document", "$.version").alias("version"), size("utterances").alias("utterances"), size("speaker_turns").alias("turns"))


def fn_recognised(spark, d):
    s = views.segments(spark, d)
    total = s.groupBy("rec_id").agg(F.max("end").alias("total"))
    return s.join(total, "rec_id").select("rec_id", "line_no", F.round(quality.recognised(F.col("end"), F.col("total")), 6).alias("percent"))


def _raw(spark, d):
    p = views.table(spark, d, "part")
    no = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 4
    variants = F.when(kind == 0, F.concat(F.lit("（谐音："), "p_name", F.lit("、"), "p_brand", F.lit("s；打错字：B→V/P）"))).when(kind == 1, F.col("p_name")).when(kind == 2, F.concat("p_brand", F.lit("/b x2"))).otherwise("常被叫Brand one、12")
    return p.select(F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("--- "), no)).otherwise(F.concat(F.lit("**"), no, F.lit("** / "), "p_brand", F.lit(" / "), variants)).alias("value"))


def src_raw_lexicon(spark, d):
    return quality.raw_lexicon(_raw(spark, d), "person").select(F.col("entry_no").cast("long").alias("entry_no"), "canonical", "variants")


def cor_build_lexicon(spark, d):
    made = lexicon.build(quality.raw_lexicon(_raw(spark, d), "person"))
    return made.select("entry_no", "canonical", F.concat_ws("|", "aliases").alias("aliases"), "priority", F.concat_ws(",", "context_tags").alias("tags"), "is_pattern")


def cor_alias_index(spark, d):
    p = views.table(spark, d, "part")
    e = p.groupBy(F.col("p_brand").alias("canonical")).agg(F.collect_set(F.concat(F.lit("a"), F.col("p_partkey") % 50)).alias("aliases")).withColumn("is_pattern", F.endswith("canonical", F.lit("5")))
    made = correction.alias_index(e.withColumn("aliases", F.array_append("aliases", F.lit("Brand#11"))))
    return made.select("alias", "owners", "is_canonical")


def _decided(spark, d):
    docs = q_more.documents_of(spark, d)
    hits, named = correction.found(docs, q_more.lexicon_of(spark, d))
    profile = correction.document_profile(docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi"))
    return docs, correction.scored(hits, profile), named


def ag_doc_profile(spark, d):
    """How much each document speaks of each category or tag."""
    return correction.document_profile(q_more.documents_of(spark, d))


def cor_context(spark, d):
    """What of the sentence and the document speaks for each hit."""
    rows = _decided(spark, d)[1]
    return rows.select("doc_id", "start", "alias", "canonical", *[F.col(c).cast("long").alias(c) for c in ("n_strong", "n_weak", "n_tags")], *[F.round(c, 6).alias(c) for c in ("doc_strength", "context")])


def cor_fluency(spark, d):
    return _decided(spark, d)[1].select("doc_id", "start", "canonical", "left", "right", F.round("fluency", 6).alias("fluency"))


def cor_ambiguity(spark, d):
    return _decided(spark, d)[1].select("doc_id", "start", "alias", "canonical", "owners", "is_canonical", "priority", F.round("ambiguity", 6).alias("ambiguity"))


def cor_score(spark, d):
    """Each hit with the parts of its score: fluency, ambiguity, context, similarity."""
    rows = _decided(spark, d)[1]
    return rows.select("doc_id", "start", "canonical", *[F.round(c, 6).alias(c) for c in ("similarity", "context", "fluency", "ambiguity", "score")], "decision")


def cor_consistency(spark, d):
    _, rows, named = _decided(spark, d)
    return correction.consistent(rows, named).groupBy("canonical", "decision").agg(F.count(F.lit(1)).alias("hits"), F.count_if("lifted").alias("lifted"))


def cor_resolve(spark, d):
    _, rows, named = _decided(spark, d)
    return correction.resolved(correction.consistent(rows, named)).groupBy("doc_id", "start").agg(F.count_if(F.col("decision") != "keep").alias("open"), F.max("score").alias("score"))


def ag_correction_stats(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return correction.statistics(docs, correction.correct(docs, q_more.lexicon_of(spark, d))[1])


def ag_event_stats(spark, d):
    c = views.candidates(spark, d)
    made = cluster.components(c, cluster.links(c).filter("score >= 0.66"))
    n = F.col("cluster_no")
    judged = made.select("rec_id", "cluster_no").distinct().filter(n % 7 != 0).select("rec_id", "cluster_no", (n % 3 != 0).alias("same_event"), (n % 5 == 0).alias("expanded"))
    before = q_more._events(spark, d)
    return events.event_stats(made.groupBy("rec_id", "cluster_no").agg(F.count(F.lit(1)).alias("n")), judged, before, events.dedupe(before))


def set_run_stability(spark, d):
    s = views.sentences(spark, d).withColumn("run", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    s = s.filter("run <> 2 or line_no % 40 <> 0").withColumn("text", F.when((F.col("run") == 3) & (F.col("line_no") % 50 == 0), F.upper("text")).otherwise(F.col("text")))
    s = s.withColumn("spk", F.when((F.col("run") == 3) & (F.col("rec_id") % 2 == 0) & (F.col("line_no") == 1), "other").otherwise(F.col("spk")))
    return runs.stability(s.withColumn("group_no", F.floor((F.col("line_no") - 1) / 20)).withColumn("rec_id", F.concat_ws("-", "rec_id", "group_no")).drop("group_no"))


def set_cache_valid(spark, d):
    c = views.candidates(spark, d).groupBy("rec_id").agg(F.max("end").cast("double").alias("total"))
    stored = c.select("rec_id", F.when(F.col("rec_id") % 5 == 1, "b").otherwise("a").alias("name"), (F.col("total") + F.col("rec_id") % 4).alias("total"), (F.col("rec_id") % 3).alias("n_chapters"))
    return events.cache_valid(stored, c.withColumn("name", F.lit("a")))


QUERIES = {f.__name__: f for f in (
    fn_recognised, wn_char_turns, src_annotated_truth, src_turn_sheet, snk_turns, snk_hotspot_csv, snk_audio_doc, src_raw_lexicon, cor_build_lexicon, cor_alias_index, ag_doc_profile, cor_context, cor_fluency, cor_ambiguity, cor_score, cor_consistency,
    cor_resolve, ag_correction_stats, ag_event_stats, set_run_stability, set_cache_valid,
)}

_MARKED = """, m0 AS (SELECT rec_id, line_no AS anchor_no, start * 1000 AS start, "end" * 1000 AS e, trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) AS t FROM segments),
m AS (SELECT rec_id, anchor_no, start, e, CASE WHEN anchor_no % 3 = 0 THEN replace(t, ' ', 'AAA') ELSE t END AS content FROM m0),
p AS (SELECT *, unnest(string_split_regex(content, 'A{3,}')) AS part, unnest(range(len(string_split_regex(content, 'A{3,}')))) AS part_no FROM m),
r AS (SELECT *, coalesce(sum(length(part) + 3) OVER (PARTITION BY rec_id, anchor_no ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_, greatest(1, length(content)) AS n FROM p)"""
_EST = lambda c: f"CAST(floor(start + greatest(1, e - start) * ({c}) / n) AS BIGINT)"
ORACLE = {
    "fn_recognised": views.with_views("segments", body=""" SELECT rec_id, line_no, round(least("end" / max("end") OVER (PARTITION BY rec_id) * 100, 99.5), 6) AS percent FROM segments"""),
    "wn_char_turns": views.with_views("segments", body=_MARKED + f" SELECT rec_id, anchor_no, part_no, md5(trim(part)) AS text_md5, {_EST("at_")} AS est_start, {_EST("at_ + length(part)")} AS est_end FROM r WHERE trim(part) <> ''"),
    "src_annotated_truth": views.with_views("segments", body=_MARKED + f" SELECT rec_id, anchor_no AS seg, part_no, CASE WHEN anchor_no % 2 = 0 THEN CASE WHEN anchor_no % 7 < 2 THEN (anchor_no % 7) || ',2' WHEN anchor_no % 7 = 2 THEN '2' ELSE '2,' || (anchor_no % 7) END ELSE '' END AS people, md5(trim(part)) AS text_md5, {_EST("at_")} AS est_start, {_EST("at_ + length(part)")} AS est_end FROM r WHERE trim(part) <> ''"),
    "src_turn_sheet": views.with_views("segments", body=""", s AS (SELECT rec_id, line_no, start * 1000 AS a, "end" * 1000 AS b, 'w' || line_no || repeat('x', CAST(line_no % 6 AS INT)) AS t FROM segments),
c AS (SELECT *, CAST(floor(a + (b - a) * length(t) / (length(t) + 4)) AS BIGINT) AS cut FROM s),
l AS (SELECT rec_id, line_no, 0 AS k, CASE line_no % 5 WHEN 0 THEN 'human_spk_01,human_spk_02' WHEN 1 THEN 'unsure' ELSE 'human_spk_03' END AS speaker, t AS text, a AS est_start, CASE WHEN line_no % 4 = 0 THEN cut ELSE b END AS est_end FROM c
  UNION ALL SELECT rec_id, line_no, 1, 'human_spk_02', 'more', cut, b FROM c WHERE line_no % 4 = 0)
SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY line_no, k) AS label_no, speaker, text, est_start, est_end FROM l"""),
    "snk_turns": views.with_views("segments", body=""" SELECT rec_id, CAST(start + 0.5 AS DOUBLE) AS start, '{"start":' || CAST(start + 0.5 AS DOUBLE) || ',"end":' || CAST("end" + 0.25 AS DOUBLE) || ',"speaker":"' || speaker || '"' || CASE WHEN line_no % 2 = 0 THEN ',"confidence":0.5' ELSE '' END || CASE WHEN line_no % 3 = 0 THEN ',"text":"t"' ELSE '' END || '}' AS record FROM segments"""),
    "snk_hotspot_csv": q_media._TAGGED + """ SELECT rec_id, start, "end", round("end" - start, 3) AS dur, kind, text_density, text_tag FROM tagged""",
    "src_raw_lexicon": """ SELECT p_partkey AS entry_no, p_brand AS canonical, CASE p_partkey % 4 WHEN 0 THEN '（谐音：' || p_name || '、' || p_brand || 's；打错字：B→V/P）' WHEN 1 THEN p_name WHEN 2 THEN p_brand || '/b x2' ELSE '常被叫Brand one、12' END AS variants FROM part WHERE p_partkey % 9 <> 0""",
    "cor_alias_index": """WITH e AS (SELECT DISTINCT p_brand AS canonical, 'a' || (p_partkey % 50) AS alias FROM part UNION SELECT DISTINCT p_brand, 'Brand#11' FROM part)
SELECT alias, count(*) AS owners, alias IN (SELECT p_brand FROM part) AS is_canonical FROM e WHERE canonical NOT LIKE '%5' GROUP BY alias""",
    "set_cache_valid": views.with_views("candidates", body=" SELECT rec_id FROM (SELECT DISTINCT rec_id FROM candidates) WHERE rec_id % 5 <> 1 AND rec_id % 4 <= 2 AND rec_id % 3 > 0"),
}
