"""Queries of the remaining sources, sinks, views, evidence and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import REJECT_KINDS
from ..functions import clock, text
from ..operators import lists, quality, speakers, windows
from ..sources import files, replies
from . import q_events, views
from .q_media import _TOK, _tokens


def src_user_words(spark, d):
    lines = views.table(spark, d, "part").select(F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("# "), "p_name")).when(F.col("p_partkey") % 5 == 1, " ").otherwise(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("value"))
    return files.word_list(lines).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def src_dictionary(spark, d):
    p = views.table(spark, d, "part").groupBy("p_brand").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.when(F.col("p_partkey") % 7 == 0, "_").otherwise(""), F.lit("w"), "p_partkey"), F.concat(F.lit(" r"), F.col("p_partkey") % 10))))).alias("m"))
    return files.dictionary_entries(p.select(F.to_json(F.create_map("p_brand", "m")).alias("content")))


def src_judgements(spark, d):
    c = views.candidates(spark, d)
    n = F.col("cand_no")
    body = F.struct(F.when(n % 3 != 0, n % 2 == 0).alias("same_event"), F.concat(F.lit(" s "), n).alias("event_summary"), F.when(n % 4 == 0, "LEFT ").alias("expand_direction"), (n % 5).alias("confidence"))
    made = c.select("rec_id", F.col("cand_no").alias("cluster_no"), F.when(n % 11 == 0, "{bad").otherwise(F.to_json(body)).alias("reply"))
    return replies.judgements(made).select("rec_id", "cluster_no", "same_event", "event_summary", "expand_direction", "confidence")


def src_misschecks(spark, d):
    c = views.candidates(spark, d)
    item = F.struct("cand_no", (F.col("cand_no") % 7).cast("string").alias("chunk"), (F.col("cand_no") % 3 != 0).alias("miss_risk"), F.concat(F.lit("r"), "cand_no").alias("reason"))
    made = c.groupBy("rec_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("checks"))).alias("reply"))
    return replies.miss_checks(made, c.select("rec_id", "chunk_no").distinct())


def src_simple_highlights(spark, d):
    c = views.candidates(spark, d)
    item = F.struct("cand_no", clock.line_clock(F.col("start")).alias("start_time"), F.when(F.col("cand_no") % 6 != 0, F.col("score") * 2).alias("score"))
    own = F.array_sort(F.collect_list(item))
    made = c.groupBy("rec_id").agg(F.when(F.col("rec_id") % 2 == 0, F.to_json(F.struct(own.alias("highlights")))).otherwise(F.to_json(own)).alias("reply"))
    return replies.highlights(made).select("rec_id", "place", "start_time", "score")


def src_provider_b(spark, d):
    s = views.sentences(spark, d)
    item = F.struct(F.col("start").alias("BeginTime"), F.col("end").alias("EndTime"), F.lit("t").alias("Text"), F.when(F.col("line_no") % 4 != 0, F.col("line_no") % 3).alias("SpeakerId"))
    made = s.groupBy("rec_id").agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("Sentences")).alias("Result"))).alias("reply"))
    return replies.sentence_turns(made).select("rec_id", "start", "end", "speaker")


def src_probe_logs(spark, d):
    e = views.table(spark, d, "events")
    k = F.col("event_id") % 4
    log = F.concat(F.when(k != 3, "Input #0, mov\n").otherwise(""), F.lit("  Duration: 01:0"), F.col("event_id") % 10, F.lit(":05.50, start\n"), F.when(k != 1, "Stream #0:0(und): Video: h264\n").otherwise(""), F.when(k != 0, "Stream #0:1: Audio: aac\n").otherwise(""), F.when(k == 2, "moov atom not found").otherwise(""))
    return files.media_logs(e.select(F.col("event_id").alias("rec_id"), log.alias("log")))


def snk_legacy_lines(spark, d):
    s = views.sentences(spark, d)
    return files.transcript_text(s.select("rec_id", "line_no", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"), "text")).select("rec_id", "line_no", F.md5("line").alias("line_md5"))


def snk_requests(spark, d):
    """One request row for each batch of three events: their cards in order."""
    rows = q_events.wn_batches(spark, d).join(q_events._events(spark, d), ["rec_id", "event_no"])
    card = F.concat_ws(" ", F.col("event_no").cast("string"), clock.line_clock(F.col("start")), "title")
    from ..operators.ranges import ordered

    return rows.withColumn("card", card).groupBy("rec_id", "batch_no").agg(F.md5(ordered("card", "event_no", separator="\n")).alias("body_md5"), F.count(F.lit(1)).alias("events"))


def snk_results(spark, d):
    rows = q_events._quantity("auto")(spark, d).select("rec_id", "event_no", "picked")
    made = files.result_documents(rows)
    return made.select("rec_id", F.size(F.from_json(F.get_json_object("document", "$.highlights"), "array<string>")).alias("highlights"), F.size(F.from_json(F.get_json_object("document", "$.rejected"), "array<string>")).alias("rejected"))


def fn_clip_span(spark, d):
    c = views.candidates(spark, d)
    a, b = F.when(F.col("cand_no") % 3 != 0, F.col("start") + 1), F.when(F.col("cand_no") % 4 != 0, F.col("end") - 1)
    return lists.clip_spans(c, a, b).select("rec_id", "cand_no", "clip_start", "clip_end")


def fn_norm_rec_time(spark, d):
    c = views.candidates(spark, d)
    told = F.when(F.col("cand_no") % 3 == 0, clock.chunk_clock(F.col("start") * 2)).when(F.col("cand_no") % 3 == 1, "soon")
    s = clock.recommended(told, F.col("start"), F.lit(3600))
    return c.select("rec_id", "cand_no", s.alias("seconds"), clock.chunk_clock(s).alias("clock"))


def fn_norm_text(spark, d):
    s = views.segments(spark, d)
    t = F.concat(F.lit("<|en|> "), "text", F.lit("。"))
    return s.select("rec_id", "line_no", F.length(text.plain(t)).alias("n"), text.plain(t).rlike(r"[\s.,，。]").alias("left_over"))


def flt_view(spark, d):
    e = q_events._events(spark, d).select("rec_id", "event_no", "start", "score")
    rows = q_events._quantity("auto")(spark, d).select("rec_id", "event_no", "picked", "recommended").join(e, ["rec_id", "event_no"])
    return lists.views(rows).select("rec_id", "view", "place", "event_no")


def jn_story_lookup(spark, d):
    told = q_events.jn_candidate_story(spark, d)
    return lists.story_chapters(told, views.stories(spark, d)).select("rec_id", "cand_no", "story_id", "chapter_id")


def _document(spark, d):
    u = speakers.utterances(_tokens(spark, d))
    return u, speakers.audio_events(u), speakers.turns_by_gap(u.select("rec_id", "line_no", "start", "end", "spk"))


def jn_audio_evidence(spark, d):
    u, e, t = _document(spark, d)
    spans = views.candidates(spark, d).select("rec_id", F.col("cand_no").alias("event_no"), (F.col("start") * 333).alias("start"), (F.col("end") * 333).alias("end"))
    made = quality.audio_evidence(spans, u, e, t)
    return made.select("rec_id", "event_no", F.concat_ws(",", "speakers").alias("speakers"), "emotions", F.concat_ws(",", "sounds").alias("sounds"), "turns", "turn_ms")


def ag_doc_counts(spark, d):
    return quality.document_counts(*_document(spark, d))


def dq_audio_doc(spark, d):
    u, e, t = _document(spark, d)
    odd = u.withColumn("end", F.when(F.col("line_no") % 17 == 0, F.col("start") - 1).otherwise(F.col("end"))).withColumn("emotion_raw", F.when(F.col("line_no") % 19 != 0, F.col("emotion_raw")))
    meta = u.groupBy("rec_id").agg(F.when(F.max("rec_id") % 2 == 0, "1.0").otherwise("0.9").alias("version"), F.lit("milliseconds").alias("timebase"), (F.max("end") - 10_000_000 * (F.max("rec_id") % 3)).alias("duration_ms"))
    known = speakers.speakers(u).filter("speaker_no < 2 or rec_id % 2 = 0")
    return quality.document_faults(meta, odd, e, t, known).groupBy("rec_id", "fault").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("first"))


def wn_progress_monotone(spark, d):
    e = views.table(spark, d, "events")
    k, n = F.col("event_id") % 8, (F.floor(F.col("value")) % 9 + 1).cast("long")
    line = F.when(k == 0, "[分区] x").when(k == 1, F.concat(F.lit("[海选] 区块 "), n, F.lit("/9"))).when(k == 2, F.concat(F.lit("[复审] 批次 "), n, F.lit(" / 9"))).when(k == 3, "[结构] 生成完成").when(k == 4, "[质检] y").otherwise("noise")
    return quality.run_progress(e.select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("line_no"), line.alias("line"))).select("rec_id", "line_no", F.round("percent", 6).alias("percent"))


def jn_pause_event(spark, d):
    g = q_events._graded(spark, d)
    b = views.candidates(spark, d).select("rec_id", (F.col("start") + 3).alias("start"), (F.col("start") + 4).alias("end"), (F.col("score") / 10).alias("peak"))
    return quality.pause_events(b, g, 5).select("rec_id", "place", "start", "event_no", "hit")


def cor_merge_lexicon(spark, d):
    p = views.table(spark, d, "part")
    e = p.select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("canonical"), F.array(F.concat(F.lit("a"), F.col("p_partkey") % 3), F.concat(F.lit("A "), F.col("p_partkey") % 2)).alias("aliases"), F.concat(F.lit("f"), "p_partkey").alias("source"), F.col("p_partkey").alias("entry_no"))
    return quality.merge_lexicons(e).withColumn("aliases", F.concat_ws(",", "aliases"))


def ag_timing(spark, d):
    e = views.table(spark, d, "events")
    return lists.timing(e, "event_type", F.col("event_id") % 5 != 0)


def ag_run_timings(spark, d):
    return lists.run_timings(views.table(spark, d, "events"), "user_id", "event_id")


def src_reject_kinds(spark, d):
    """How often each known reject kind is told."""
    return views.reviews(spark, d).filter(F.col("reject_kind").isin(*REJECT_KINDS)).groupBy("reject_kind").agg(F.count(F.lit(1)).alias("n"))


def src_structure(spark, d):
    s = views.stories(spark, d)
    item = F.struct("story_id", "chapter_id", clock.line_clock(F.col("start")).alias("start_time"), F.when(F.col("story_id") != "s3", clock.line_clock(F.col("end"))).alias("end_time"), F.concat(F.lit("t "), "story_id").alias("name"))
    made = s.groupBy("rec_id").agg(F.to_json(F.struct(F.collect_list(item).alias("stories"))).alias("reply"))
    return replies.structure(made)[1]


def sel_speaker_windows(spark, d):
    return windows.speaker_windows(views.sentences(spark, d))


def ag_project_list(spark, d):
    c = q_events._quantity("auto")(spark, d)
    picks = c.filter("picked").groupBy("rec_id").agg(F.collect_list(F.struct("recommended")).alias("highlights"))
    chapters = views.chapters(spark, d).groupBy("rec_id").agg(F.collect_list(F.struct("chapter_id", F.array("start", "end").alias("stories"))).alias("chapters"))
    key = F.concat(F.lit("p"), "rec_id")
    body = F.struct(F.when(F.col("rec_id") % 6 != 0, key).otherwise("other").alias("project_id"), F.lit("done").alias("state"), key.alias("updated_at"), F.struct("highlights", F.struct("chapters").alias("structure")).alias("analysis"))
    made = chapters.join(picks, "rec_id", "left").select(key.alias("key"), F.to_json(body).alias("content"))
    return windows.projects(made)


def ag_dictionary_stats(spark, d):
    p = views.table(spark, d, "part").select(F.concat(F.lit("a"), F.col("p_partkey") % 200).alias("alias"), F.col("p_brand").alias("canonical"))
    return lists.dictionary_stats(p)


QUERIES = {f.__name__: f for f in (
    src_structure, sel_speaker_windows, ag_project_list, ag_dictionary_stats,
    src_user_words, src_dictionary, src_judgements, src_misschecks, src_simple_highlights, src_provider_b, src_probe_logs, snk_legacy_lines, snk_requests, snk_results, fn_clip_span,
    fn_norm_rec_time, fn_norm_text, flt_view, jn_story_lookup, jn_audio_evidence, ag_doc_counts, dq_audio_doc, wn_progress_monotone, jn_pause_event, cor_merge_lexicon, ag_timing, ag_run_timings, src_reject_kinds,
)}

_cand = lambda body: views.with_views("candidates", body=body)
_sen = lambda body: views.with_views("segments", "sentences", body=body)
_MM = lambda c: f"printf('%02d:%02d', ({c}) // 60, ({c}) % 60)"
_LINE = "trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g'))"
_PROBE = "SELECT event_id AS rec_id, event_id % 4 AS k FROM events"
ORACLE = {
    "src_structure": views.with_views("stories", body=""" SELECT rec_id, chapter_id || '-' || story_id AS story_id, chapter_id, 't ' || story_id AS title, start, "end" FROM stories WHERE story_id <> 's3'"""),
    "ag_project_list": "SELECT 'p' || rec_id AS key, 'done' AS state, 'p' || rec_id AS updated_at, 4 AS chapters, 8 AS stories, recommended FROM (SELECT rec_id, count(*) FILTER (recommended AND picked) AS recommended FROM (" + q_events._sql_quantity("auto") + ") GROUP BY 1) WHERE rec_id % 6 <> 0",
    "ag_dictionary_stats": " SELECT count(*) AS aliases, count(*) FILTER (n > 1) AS ambiguous, CAST(sum(n) AS BIGINT) AS rules, (SELECT count(DISTINCT p_brand) FROM part) AS entries FROM (SELECT p_partkey % 200 AS a, count(DISTINCT p_brand) AS n FROM part GROUP BY 1)",
    "src_user_words": " SELECT trim(p_name) AS word, count(*) AS n FROM part WHERE p_partkey % 5 NOT IN (0, 1) GROUP BY 1",
    "src_dictionary": " SELECT 'w' || p_partkey AS wrong, 'r' || (p_partkey % 10) AS right FROM part WHERE p_partkey % 7 <> 0",
    "src_judgements": _cand(" SELECT rec_id, cand_no AS cluster_no, CASE WHEN cand_no % 3 <> 0 THEN cand_no % 2 = 0 ELSE TRUE END AS same_event, 's ' || cand_no AS event_summary, CASE WHEN cand_no % 4 = 0 THEN 'left' ELSE '' END AS expand_direction, CAST(least(1, cand_no % 5) AS DOUBLE) AS confidence FROM candidates WHERE cand_no % 11 <> 0"),
    "src_misschecks": _cand(""", r AS (SELECT rec_id, cand_no, cand_no % 7 AS c, row_number() OVER (PARTITION BY rec_id ORDER BY cand_no) AS place FROM candidates WHERE cand_no % 3 <> 0), n AS (SELECT rec_id, count(DISTINCT chunk_no) AS n FROM candidates GROUP BY 1)
SELECT rec_id, place, c AS chunk_no, 'r' || cand_no AS reason FROM r JOIN n USING (rec_id) WHERE place <= 3 AND c BETWEEN 1 AND n"""),
    "src_simple_highlights": _cand(f" SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY least(10, score * 2) DESC, cand_no) AS place, {_MM('start')} AS start_time, least(10, score * 2) AS score FROM candidates WHERE cand_no % 6 <> 0"),
    "src_provider_b": _sen(""" SELECT rec_id, start / 1000 AS start, "end" / 1000 AS "end", 'spk_' || (line_no % 3) AS speaker FROM sentences WHERE line_no % 4 <> 0"""),
    "src_probe_logs": " SELECT event_id AS rec_id, event_id % 4 IN (0, 1) AS readable, event_id % 4 <> 0 AS has_audio, event_id % 4 <> 1 AS has_video, CAST(3600 + (event_id % 10) * 60 + 5.5 AS DOUBLE) AS duration_s, CASE WHEN event_id % 4 = 2 THEN 'moov atom not found' END AS fatal FROM events",
    "snk_legacy_lines": _sen(f""" SELECT rec_id, line_no, md5('[' || {_MM('start // 1000')} || ' - ' || {_MM('"end" // 1000')} || '] ' || {_LINE}) AS line_md5 FROM sentences WHERE {_LINE} <> ''"""),
    "snk_requests": _cand(f""", b AS (SELECT *, (row_number() OVER (PARTITION BY rec_id ORDER BY cand_no) - 1) // 3 AS batch_no FROM candidates)
SELECT rec_id, batch_no, md5(string_agg(cand_no || ' ' || {_MM('start')} || ' ' || title, chr(10) ORDER BY cand_no)) AS body_md5, count(*) AS events FROM b GROUP BY ALL"""),
    "snk_results": "SELECT rec_id, count(*) FILTER (picked) AS highlights, count(*) FILTER (NOT picked) AS rejected FROM (" + q_events._sql_quantity("auto") + ") GROUP BY 1",
    "fn_clip_span": _cand(' SELECT rec_id, cand_no, CASE WHEN cand_no % 3 <> 0 AND cand_no % 4 <> 0 THEN start + 1 ELSE start END AS clip_start, CASE WHEN cand_no % 3 <> 0 AND cand_no % 4 <> 0 THEN "end" - 1 ELSE "end" END AS clip_end FROM candidates'),
    "fn_norm_rec_time": _cand(f""", s AS (SELECT rec_id, cand_no, least(3600, CASE WHEN cand_no % 3 = 0 THEN start * 2 ELSE start END) AS s FROM candidates) SELECT rec_id, cand_no, CAST(s AS DOUBLE) AS seconds, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE {_MM('s')} END AS clock FROM s"""),
    "fn_norm_text": views.with_views("segments", body=" SELECT rec_id, line_no, length(regexp_replace(text, '[\\p{P}\\p{S}\\s]+', '', 'g')) AS n, FALSE AS left_over FROM segments"),
    "flt_view": "WITH q AS (" + q_events._sql_quantity("auto") + "), " + views.SQL["candidates"] + """, e AS (SELECT q.*, c.start, c.score FROM q JOIN candidates c ON c.rec_id = q.rec_id AND c.cand_no = q.event_no)
SELECT rec_id, 'recommended' AS view, row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, event_no) AS place, event_no FROM e WHERE recommended
UNION ALL SELECT rec_id, 'all_events', row_number() OVER (PARTITION BY rec_id ORDER BY start, event_no), event_no FROM e UNION ALL SELECT rec_id, 'rejected', row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, event_no), event_no FROM e WHERE NOT picked""",
    "jn_story_lookup": views.with_views("candidates", "stories", body=q_events._TOLD + " SELECT t.rec_id, cand_no, t.story_id, coalesce(chapter_id, '') AS chapter_id FROM told t LEFT JOIN stories s ON s.rec_id = t.rec_id AND s.story_id = t.story_id"),
    "wn_progress_monotone": """WITH l AS (SELECT user_id AS rec_id, event_id AS line_no, event_id % 8 AS k, CAST(floor(value) AS BIGINT) % 9 + 1 AS n FROM events),
p AS (SELECT rec_id, line_no, CASE k WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 10 + (n - 1) / 9.0::DOUBLE * 48 WHEN 2 THEN 72 + (n - 1) / 9.0::DOUBLE * 16 WHEN 3 THEN 94 ELSE 60 END AS percent FROM l WHERE k < 5),
m AS (SELECT *, max(percent) OVER (PARTITION BY rec_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM p) SELECT rec_id, line_no, round(percent, 6) AS percent FROM m WHERE so_far IS NULL OR percent >= so_far""",
    "jn_pause_event": views.with_views("candidates", "reviews", body=q_events._GRADED + """, b AS (SELECT rec_id, start + 3 AS start, score, row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, start) AS place FROM candidates),
h AS (SELECT b.rec_id, place, b.start, (SELECT arg_min(event_no, "end" * 100000 + event_no) FROM graded g WHERE g.rec_id = b.rec_id AND grade IN ('A', 'B', 'C') AND g.start <= b.start + 0.5 AND g."end" >= b.start + 0.5) AS event_no FROM b WHERE place <= 5)
SELECT *, event_no IS NOT NULL AS hit FROM h"""),
    "ag_timing": " SELECT event_type, count(*) AS runs, round(avg(value) FILTER (event_id % 5 <> 0), 6) AS mean_warm, min(value) FILTER (event_id % 5 <> 0) AS least_warm, max(value) FILTER (event_id % 5 <> 0) AS most_warm FROM events GROUP BY 1",
    "ag_run_timings": " SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS run_no, value, round(value / max(value) OVER (PARTITION BY user_id), 4) AS of_most FROM events",
    "src_reject_kinds": views.with_views("reviews", body=" SELECT reject_kind, count(*) AS n FROM reviews WHERE reject_kind <> '' GROUP BY 1"),
    "ag_doc_counts": _sen(_TOK + """, s AS (SELECT *, CASE WHEN spk IS DISTINCT FROM lag(spk) OVER w OR start - max("end") OVER (PARTITION BY rec_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 800 THEN 1 ELSE 0 END AS t FROM utt WINDOW w AS (PARTITION BY rec_id ORDER BY line_no))
SELECT rec_id, count(*) AS utterances, count(*) FILTER (k IN (0, 1)) AS emotions, count(DISTINCT spk) AS speakers, CAST(sum(CASE k WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END) AS BIGINT) AS audio_events, CAST(sum(t) AS BIGINT) AS turns FROM s GROUP BY 1"""),
}
