"""Queries of speakers, audio frames, feedback and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audio, blocks, feedback, lists, speakers
from . import views


def _tokens(spark, d):
    """Sentences with rich tokens put in."""
    s = views.sentences(spark, d)
    k = F.floor((F.col("start") / 1000)) % 4
    put = F.when(k == 0, F.concat(F.lit("<|en|><|HAPPY|><|Speech|>"), "text", F.lit("<|Laughter|>"))).when(k == 1, F.concat(F.lit("<|zh|><|SAD|><|ANGRY|>"), "text")).when(k == 2, F.concat(F.lit("<|ZZ|><|BGM|> "), "text", F.lit("<|Cough|><|ja|>"))).otherwise("<|nospeech|><|withitn|> ")
    return s.withColumn("text", put)


def src_rich_tokens(spark, d):
    t = speakers.rich_tokens(F.col("text"))
    lists = {c: F.concat_ws(",", t[c]) for c in ("events_raw", "unknown_tokens")}
    return _tokens(spark, d).select("rec_id", "line_no", t["language"].alias("language"), t["emotion_raw"].alias("emotion_raw"), lists["events_raw"].alias("events_raw"), F.md5(t["clean_text"]).alias("clean_md5"), lists["unknown_tokens"].alias("unknown_tokens"))


def doc_utterances(spark, d):
    u = speakers.utterances(_tokens(spark, d))
    return u.select("rec_id", "utterance_id", "start", "end", "spk", "emotion", F.concat_ws(",", "tags").alias("tags"))


def doc_audio_events(spark, d):
    return speakers.audio_events(speakers.utterances(_tokens(spark, d)))


def doc_speakers(spark, d):
    return speakers.speakers(views.sentences(spark, d))


def _some_null(spark, d):
    return views.sentences(spark, d).withColumn("spk", F.when(F.col("line_no") % 9 != 0, F.when(F.col("line_no") % 7 < 4, "a").otherwise(F.col("spk"))))


def wn_turns_gap(spark, d):
    return speakers.turns_by_gap(_some_null(spark, d), 2001)


def wn_turns_overlap(spark, d):
    long = _some_null(spark, d).withColumn("end", F.col("end") + 1500)
    return speakers.turns_with_overlap(long, 1000)


def wn_speaker_runs(spark, d):
    return speakers.speaker_runs(_some_null(spark, d))


def wn_run_hints(spark, d):
    return speakers.run_hints(_some_null(spark, d))


def wn_merge_adjacent(spark, d):
    rows = _some_null(spark, d).filter("spk is not null").withColumn("text", F.when(F.col("line_no") % 2 == 0, F.col("text")).otherwise(""))
    return speakers.merge_adjacent(rows, 0.0)


def wn_truth_switches(spark, d):
    return speakers.truth_switches(views.truth(spark, d))


def _overlapping(spark, d):
    return _some_null(spark, d).withColumn("end", F.col("end") + 2500)


def wn_exclusive_time(spark, d):
    return speakers.exclusive_time(_overlapping(spark, d))[0]


def wn_exclusive_overlap(spark, d):
    return speakers.exclusive_time(_overlapping(spark, d))[1]


def jn_truth_overlap(spark, d):
    return speakers.truth_overlap(_some_null(spark, d), views.truth(spark, d))


def ag_attribution(spark, d):
    return speakers.attribution(jn_truth_overlap(spark, d))[1]


def ag_best_mapping(spark, d):
    return speakers.attribution(jn_truth_overlap(spark, d))[0]


def cl_match_switches(spark, d):
    runs = speakers.speaker_runs(_some_null(spark, d)).filter("run_no > 0").select("rec_id", F.col("start").cast("double").alias("at"))
    return speakers.match_switches(runs, speakers.truth_switches(views.truth(spark, d)))


def ag_speaker_stats(spark, d):
    return speakers.speaker_stats(views.sentences(spark, d))


def ag_speaker_count(spark, d):
    return lists.speaker_counts(_some_null(spark, d), views.truth(spark, d))


def ag_segment_coverage(spark, d):
    return speakers.segment_coverage(views.sentences(spark, d), views.truth(spark, d))


def jn_turn_projection(spark, d):
    s = views.segments(spark, d).withColumn("start", F.col("start") * 1000).withColumn("end", F.col("end") * 1000)
    turns = speakers.turns_by_gap(_some_null(spark, d), 800).filter("spk is not null and turn_no % 5 <> 0").withColumn("end", F.col("end") + 500)
    return speakers.turn_projection(s, turns)


HIGH_ZCR, LOUD, RATIO = 0.52, 0.10, 2.5


def _feats(spark, d):
    return audio.features(views.frames(spark, d))


def _label_feats(spark, d):
    """Features of recordings of any length, one for each label."""
    return blocks.numbered(audio.features(views.label_frames(spark, d)))


def ag_frame_feats(spark, d):
    return _label_feats(spark, d).select("rec_id", "frame_idx", F.round("rms", 6).alias("rms"), F.round("zcr", 6).alias("zcr"))


def _spots(spark, d):
    return audio.hotspots(_feats(spark, d), LOUD, 1.5, HIGH_ZCR, 20, 1, 40)


def wn_hotspots(spark, d):
    return _spots(spark, d).select("rec_id", "first", "last", "frames", "peak_idx", F.round("peak_energy", 3).alias("peak"), "kind")


def _short_segments(spark, d):
    """Segments on the time scale of the frames, with silence after each."""
    s = views.segments(spark, d)
    return s.select("rec_id", "line_no", (F.col("start") / 100).alias("start"), ((F.col("start") * 3 + F.col("end")) / 400).alias("end"), "text")


def jn_hotspot_text(spark, d):
    return audio.with_text(_spots(spark, d), _short_segments(spark, d)).select("rec_id", "first", "text_density", "text_tag")


def ag_hotspot_stats(spark, d):
    return audio.hotspot_stats(audio.with_text(_spots(spark, d), _short_segments(spark, d)))


def _known(spark, d):
    e = views.candidates(spark, d).select("rec_id", (F.col("start") / 600).alias("start"), (F.col("end") / 600).alias("end"))
    return audio.known_or_missed(audio.with_text(_spots(spark, d), _short_segments(spark, d)), e)


def jn_hotspot_event(spark, d):
    return _known(spark, d).select("rec_id", "first", "known")


def sel_review_list(spark, d):
    return audio.review_list(_known(spark, d), 5).select("rec_id", "first", "place")


def sel_strong_list(spark, d):
    return audio.strong_list(_spots(spark, d), 30).select("rec_id", "first", "place")


def wn_energy_bursts(spark, d):
    return audio.energy_bursts(_feats(spark, d), 0.02, 1.6, 20, 5).select("rec_id", "first", "last", F.round("peak", 6).alias("peak"))


def wn_pauses(spark, d):
    return audio.pauses(_feats(spark, d), 0.13, 3)


def wn_pause_bursts(spark, d):
    f = _label_feats(spark, d)
    return audio.pause_bursts(f, audio.pauses(f, 0.13, 3), 0.02, 1.8, 20).select("rec_id", "p0", "p1", "peak_idx", F.round("peak", 6).alias("peak"))


def wn_baseline_pct(spark, d):
    return audio.baseline(_feats(spark, d), 20, 0.85).select("rec_id", "frame_idx", F.round("base", 6).alias("base"))


def wn_anomalies(spark, d):
    return audio.anomalies(_feats(spark, d), _short_segments(spark, d), 1.02, 1.2, 20, 10, 1, 40)


def jn_speech_mark(spark, d):
    s = views.segments(spark, d).select("rec_id", (F.col("start") / 100).alias("start"), (F.col("end") / 100).alias("end"))
    return audio.speech_marks(_label_feats(spark, d), s)


def ag_speech_share(spark, d):
    return audio.speech_marks(_feats(spark, d), _short_segments(spark, d)).groupBy("rec_id").agg(F.round(100 * F.avg(F.col("speech").cast("double")), 1).alias("speech_pct"))


def wn_feedback_latest(spark, d):
    return feedback.latest_by_aggregation(views.feedback(spark, d)).select("clip_id", "user_choice", "event_id", "snapshot")


def ag_feedback_stats(spark, d):
    return feedback.stats(feedback.latest_by_aggregation(views.feedback(spark, d)))


def jn_feedback(spark, d):
    clips = views.table(spark, d, "customer").select(F.col("c_custkey").alias("clip_id"))
    return lists.with_feedback(clips, wn_feedback_latest(spark, d))


def ag_usage_cost(spark, d):
    return feedback.usage_cost(views.usage(spark, d))


QUERIES = {f.__name__: f for f in (
    src_rich_tokens, doc_utterances, doc_audio_events, doc_speakers, wn_turns_gap, wn_turns_overlap, wn_speaker_runs, wn_run_hints, wn_merge_adjacent, wn_truth_switches,
    wn_exclusive_time, wn_exclusive_overlap, jn_truth_overlap, ag_attribution, ag_best_mapping, cl_match_switches, ag_speaker_stats, ag_speaker_count, ag_segment_coverage,
    jn_turn_projection, ag_frame_feats, wn_hotspots, jn_hotspot_text, ag_hotspot_stats, jn_hotspot_event, sel_review_list, sel_strong_list, wn_energy_bursts, wn_pauses, wn_pause_bursts,
    wn_baseline_pct, wn_anomalies, jn_speech_mark, ag_speech_share, wn_feedback_latest, ag_feedback_stats, jn_feedback, ag_usage_cost,
)}

_sen = lambda body: views.with_views("segments", "sentences", body=body)
_tru = lambda body: views.with_views("segments", "sentences", "truth", body=body)
_NULLS = """, told AS (SELECT * REPLACE (CASE WHEN line_no % 9 <> 0 THEN CASE WHEN line_no % 7 < 4 THEN 'a' ELSE spk END END AS spk) FROM sentences)"""
_TOK = """, put AS (SELECT * REPLACE (CASE (start // 1000) % 4 WHEN 0 THEN '<|en|><|HAPPY|><|Speech|>' || text || '<|Laughter|>' WHEN 1 THEN '<|zh|><|SAD|><|ANGRY|>' || text WHEN 2 THEN '<|ZZ|><|BGM|> ' || text || '<|Cough|><|ja|>' ELSE '<|nospeech|><|withitn|> ' END AS text) FROM sentences),
tok AS (SELECT *, (start // 1000) % 4 AS k, trim(regexp_replace(text, '<\\|[^|]*\\|>', '', 'g')) AS clean FROM put),
utt AS (SELECT *, printf('utt-%06d', row_number() OVER (PARTITION BY rec_id ORDER BY line_no)) AS utterance_id FROM tok WHERE clean <> '')"""


def _turns(source, gap):
    return f""", r1 AS (SELECT *, CASE WHEN spk IS DISTINCT FROM lag(spk) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS m FROM {source} WINDOW w AS (PARTITION BY rec_id ORDER BY line_no)),
r2 AS (SELECT *, sum(m) OVER (PARTITION BY rec_id ORDER BY line_no) AS run FROM r1),
r3 AS (SELECT *, max("end") OVER (PARTITION BY rec_id, run ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM r2),
r4 AS (SELECT *, CASE WHEN start - so_far >= {gap} THEN 1 ELSE 0 END AS m2 FROM r3),
r5 AS (SELECT *, sum(m2) OVER (PARTITION BY rec_id, run ORDER BY line_no) AS part FROM r4),
turns0 AS (SELECT rec_id, min(line_no) AS line_no, min(spk) AS spk, min_by(start, line_no) AS start, max("end") AS "end", count(*) AS n FROM r5 GROUP BY rec_id, run, part),
turns AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY line_no) AS turn_no, spk, start, "end", n FROM turns0)"""


_RUNS = _NULLS + """, pool AS (SELECT * FROM told WHERE spk IS NOT NULL AND "end" > start),
p1 AS (SELECT *, CASE WHEN spk <> lag(spk) OVER (PARTITION BY rec_id ORDER BY start, line_no) THEN 1 ELSE 0 END AS m FROM pool),
p2 AS (SELECT *, CAST(sum(m) OVER (PARTITION BY rec_id ORDER BY start, line_no) AS BIGINT) AS run_no FROM p1),
runs AS (SELECT rec_id, run_no, min(spk) AS spk, min(start) AS start, max_by("end", start) AS "end", count(*) AS n, substr(string_agg(text, '/' ORDER BY start, line_no), 1, 60) AS hint FROM p2 GROUP BY ALL)"""
_OVER = _NULLS + """, pool AS (SELECT rec_id, spk, start, "end" + 2500 AS "end" FROM told WHERE spk IS NOT NULL),
marks AS (SELECT rec_id, start AS t FROM pool UNION SELECT rec_id, "end" FROM pool), cuts AS (SELECT rec_id, t AS a, lead(t) OVER (PARTITION BY rec_id ORDER BY t) AS b FROM marks),
act AS (SELECT c.rec_id, a, b, count(DISTINCT spk) AS k, min(spk) AS spk FROM cuts c JOIN pool p ON c.rec_id = p.rec_id AND p.start <= a AND p."end" >= b WHERE b IS NOT NULL GROUP BY ALL)"""
_TRUTH = _NULLS + """, ov AS (SELECT s.rec_id, s.spk, t.speaker, CAST(sum(least(s."end", t."end") - greatest(s.start, t.start)) AS BIGINT) AS ms FROM told s JOIN truth t ON s.rec_id = t.rec_id AND s.start < t."end" AND s."end" > t.start WHERE s.spk IS NOT NULL AND t.speaker <> 'unsure' GROUP BY ALL),
best AS (SELECT rec_id, spk, speaker, ms FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, spk ORDER BY ms DESC, speaker) AS pl FROM ov) WHERE pl = 1)"""
_FEATS = """WITH fr AS (SELECT vec_id // 100 AS rec_id, vec_id % 100 AS frame_idx, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * ((1 + vec_id % 7) / 4.0::DOUBLE)) AS s FROM embeddings),
feats AS (SELECT CAST(rec_id AS BIGINT) AS rec_id, frame_idx, sqrt(list_sum(list_transform(s, lambda v: v * v)) / len(s)) AS rms,
  list_sum(list_transform(range(1, len(s)), lambda i: CASE WHEN s[i] * s[i + 1] < 0 THEN 1 ELSE 0 END)) / (len(s) - 1) AS zcr FROM fr)"""
_LABEL_FEATS = _FEATS.replace("vec_id // 100 AS rec_id, vec_id % 100 AS frame_idx", "label AS rec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx")
_MED = "quantile_cont(rms, 0.5) OVER (PARTITION BY rec_id ORDER BY frame_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_ISLES = lambda src, cond, gap=1: f"""k1 AS (SELECT * FROM {src} WHERE {cond}), k2 AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY rec_id ORDER BY frame_idx) > {gap} THEN 1 ELSE 0 END AS m FROM k1),
k3 AS (SELECT *, sum(m) OVER (PARTITION BY rec_id ORDER BY frame_idx) AS run FROM k2)"""  # noqa: E731
_BASE = lambda name, half, share: f"""{name}a AS (SELECT rec_id, frame_idx // 5 AS k, (SELECT quantile_cont(rms, {share}) FROM feats g WHERE g.rec_id = f.rec_id AND g.frame_idx >= f.frame_idx - {half} AND g.frame_idx < f.frame_idx + {half}) AS v FROM feats f WHERE frame_idx % 5 = 0),
{name} AS (SELECT f.rec_id, f.frame_idx, CASE WHEN b.v IS NULL THEN a.v ELSE a.v + (b.v - a.v) * ((f.frame_idx - a.k * 5) / 5) END AS base FROM feats f JOIN {name}a a ON a.rec_id = f.rec_id AND a.k = f.frame_idx // 5 LEFT JOIN {name}a b ON b.rec_id = f.rec_id AND b.k = a.k + 1)"""  # noqa: E731
_SPOTS = _FEATS + f""", med AS (SELECT *, coalesce({_MED}, 0) AS med FROM feats),
fl AS (SELECT *, CASE WHEN rms < {LOUD} THEN 0 WHEN med > 1e-4 AND rms / med > 1.5 AND zcr >= {HIGH_ZCR} THEN 3 WHEN zcr >= {HIGH_ZCR} THEN 2 WHEN med > 1e-4 AND rms / med > 1.5 THEN 1 ELSE 0 END AS flag FROM med), """ + _ISLES("fl", "flag > 0") + """,
g AS (SELECT rec_id, min(frame_idx) AS first, max(frame_idx) AS last, arg_max(frame_idx, rms) AS peak_idx, max(rms) AS peak_energy, max(flag) AS flag FROM k3 GROUP BY rec_id, run),
spots AS (SELECT rec_id, first, last, last - first + 1 AS frames, peak_idx, peak_energy, CASE flag WHEN 1 THEN 'energy_burst' WHEN 2 THEN 'high_freq_burst' ELSE 'strong_anomaly' END AS kind, first / 10 AS start, (last + 1) / 10 AS "end" FROM g WHERE last - first + 1 <= 40)"""
_TAGGED = _SPOTS + ", " + views.SQL["segments"] + """,
sh AS (SELECT rec_id, line_no, start / 100 AS start, (start * 3 + "end") / 400 AS "end", text FROM segments),
tg0 AS (SELECT p.rec_id, p.first, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS text_density FROM spots p LEFT JOIN sh ON sh.rec_id = p.rec_id AND sh.start < p."end" AND sh."end" > p.start GROUP BY ALL),
tagged AS (SELECT *, CASE WHEN text_density <= 8 THEN '文本弱' WHEN text_density <= 30 THEN '文本中' ELSE '文本强' END AS text_tag FROM tg0 JOIN spots USING (rec_id, first))"""
_KNOWN = _TAGGED + ", " + views.SQL["candidates"] + """, weak AS (SELECT *, (start + "end") / 2 AS c FROM tagged WHERE text_tag = '文本弱' AND kind <> 'energy_burst'),
known AS (SELECT w.*, EXISTS (SELECT 1 FROM candidates e WHERE e.rec_id = w.rec_id AND e.start / 600 <= w.c AND e."end" / 600 >= w.c) AS known FROM weak w)"""
_SPEECH = _FEATS + ", " + views.SQL["segments"] + """, marks AS (SELECT f.rec_id, f.frame_idx, EXISTS (SELECT 1 FROM segments s WHERE s.rec_id = f.rec_id AND f.frame_idx >= floor(s.start / 100 * 10) AND f.frame_idx < floor((s.start * 3 + s."end") / 400 * 10)) AS speech FROM feats f)"""
_LABEL_SPEECH = _SPEECH.replace(_FEATS, _LABEL_FEATS).replace('floor((s.start * 3 + s."end") / 400 * 10)', 'floor(s."end" / 100 * 10)')

ORACLE = {
    "src_rich_tokens": _sen(_TOK + """ SELECT rec_id, line_no, CASE k WHEN 0 THEN 'en' WHEN 1 THEN 'zh' WHEN 2 THEN 'ja' END AS language, CASE k WHEN 0 THEN '<|HAPPY|>' WHEN 1 THEN '<|SAD|>' END AS emotion_raw,
  CASE k WHEN 0 THEN '<|Speech|>,<|Laughter|>' WHEN 2 THEN '<|BGM|>,<|Cough|>' ELSE '' END AS events_raw, md5(clean) AS clean_md5, CASE k WHEN 2 THEN '<|ZZ|>' ELSE '' END AS unknown_tokens FROM tok"""),
    "doc_utterances": _sen(_TOK + """ SELECT rec_id, utterance_id, start, "end", spk, CASE k WHEN 0 THEN 'happy' WHEN 1 THEN 'sad' END AS emotion, CASE k WHEN 0 THEN 'laughter' WHEN 2 THEN 'bgm,cough' ELSE '' END AS tags FROM utt"""),
    "doc_audio_events": _sen(_TOK + """, ev AS (SELECT *, unnest(CASE k WHEN 0 THEN ['<|Laughter|>'] WHEN 2 THEN ['<|BGM|>', '<|Cough|>'] ELSE [] END) AS raw_label FROM utt)
SELECT rec_id, printf('ae-%06d', row_number() OVER (PARTITION BY rec_id ORDER BY line_no, raw_label)) AS event_id, utterance_id, start, "end", CASE raw_label WHEN '<|Laughter|>' THEN 'laughter' WHEN '<|BGM|>' THEN 'bgm' ELSE 'cough' END AS label, raw_label, spk FROM ev"""),
    "doc_speakers": _sen(" SELECT rec_id, spk, row_number() OVER (PARTITION BY rec_id ORDER BY l) AS speaker_no FROM (SELECT rec_id, spk, min(line_no) AS l FROM sentences WHERE spk IS NOT NULL GROUP BY ALL)"),
    "wn_turns_gap": _sen(_NULLS + _turns("told", 2001) + " SELECT * FROM turns"),
    "wn_turns_overlap": _sen(_NULLS + ', lng AS (SELECT * REPLACE ("end" + 1500 AS "end") FROM told)' + _turns("lng", 1000) + """, o AS (SELECT *, coalesce(lead(spk) OVER w IS NOT NULL AND lead(start) OVER w < "end", FALSE) AS overlap FROM turns WINDOW w AS (PARTITION BY rec_id ORDER BY turn_no)) SELECT * FROM o WHERE spk IS NOT NULL"""),
    "wn_speaker_runs": _sen(_RUNS + ' SELECT rec_id, run_no, spk, start, "end", n FROM runs'),
    "wn_run_hints": _sen(_RUNS + " SELECT rec_id, run_no, spk, start, hint, run_no > 0 OR start > 0 AS switch FROM runs"),
    "wn_merge_adjacent": _sen(_NULLS + ", src AS (SELECT * REPLACE (CASE WHEN line_no % 2 = 0 THEN text ELSE '' END AS text) FROM told WHERE spk IS NOT NULL)" + _turns("src", 1) + """
SELECT rec_id, min(spk) AS spk, min(start) AS start, max("end") AS "end", min_by(text, line_no) FILTER (text <> '') AS text FROM r5 GROUP BY rec_id, run, part"""),
    "wn_truth_switches": _tru(""", l AS (SELECT *, lag(speaker) OVER w AS was, lag("end") OVER w AS until FROM truth WINDOW w AS (PARTITION BY rec_id ORDER BY line_no)) SELECT rec_id, line_no, (until + start) / 2 AS at FROM l WHERE speaker <> was"""),
    "wn_exclusive_time": _sen(_OVER + ' SELECT rec_id, a AS start, b AS "end", spk FROM act WHERE k = 1'),
    "wn_exclusive_overlap": _sen(_OVER + " SELECT rec_id, CAST(sum(b - a) AS BIGINT) AS overlap_ms FROM act WHERE k > 1 GROUP BY 1"),
    "jn_truth_overlap": _tru(_TRUTH + " SELECT * FROM ov"),
    "ag_best_mapping": _tru(_TRUTH + " SELECT * FROM best"),
    "ag_attribution": _tru(_TRUTH + """, t AS (SELECT rec_id, CAST(sum(ms) AS BIGINT) AS total_ms FROM ov GROUP BY 1), r AS (SELECT rec_id, CAST(sum(ms) AS BIGINT) AS right_ms FROM best GROUP BY 1) SELECT rec_id, total_ms, right_ms, round(right_ms / total_ms, 4) AS accuracy FROM t JOIN r USING (rec_id)"""),
    "ag_speaker_stats": _sen(""" SELECT rec_id, count(*) AS sentences, count(DISTINCT spk) AS speakers, CAST(sum("end" - start) AS BIGINT) AS voiced_ms, round(avg("end" - start), 6) AS mean_ms, quantile_cont("end" - start, 0.5) AS median_ms, min("end" - start) AS min_ms, max("end" - start) AS max_ms,
  round(sum(len(regexp_extract_all(text, '\\p{P}'))) / sum(length(text)), 6) AS punctuation, CAST(sum(len(regexp_extract_all(text, '<\\|[^|]*\\|>'))) AS BIGINT) AS rich_tokens FROM sentences GROUP BY 1"""),
    "ag_speaker_count": _tru(_NULLS + """ SELECT rec_id, predicted, true_n, predicted = true_n AS correct FROM (SELECT rec_id, count(DISTINCT spk) AS predicted FROM told GROUP BY 1) JOIN (SELECT rec_id, count(DISTINCT speaker) AS true_n FROM truth WHERE speaker <> 'unsure' GROUP BY 1) USING (rec_id)"""),
    "ag_segment_coverage": _tru(""", j AS (SELECT t.rec_id, t.line_no AS label_no, spk, least(s."end", t."end") - greatest(s.start, t.start) AS d, CASE WHEN spk <> lag(spk) OVER (PARTITION BY t.rec_id, t.line_no ORDER BY s.start, s.line_no) THEN 1 ELSE 0 END AS c FROM sentences s JOIN truth t ON s.rec_id = t.rec_id AND s.start < t."end" AND s."end" > t.start),
o AS (SELECT rec_id, label_no, spk, CAST(sum(d) AS BIGINT) AS ms, count(*) AS n, sum(c) AS c FROM j GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY rec_id, label_no ORDER BY ms DESC, spk) AS pl FROM o) SELECT rec_id, label_no, CAST(sum(n) AS BIGINT) AS sentences, CAST(sum(ms) AS BIGINT) AS ms, min(spk) FILTER (pl = 1) AS majority, string_agg(spk || ':' || ms, ',' ORDER BY spk) AS by_speaker, CAST(sum(c) AS BIGINT) AS switches FROM p GROUP BY ALL"""),
    "jn_turn_projection": _sen(_NULLS + _turns("told", 800) + """, t AS (SELECT rec_id, spk, start AS t0, "end" + 500 AS t1 FROM turns WHERE spk IS NOT NULL AND turn_no % 5 <> 0),
o AS (SELECT s.rec_id, s.line_no, t.spk, sum(least(s."end", t1) - greatest(s.start, t0)) AS ms FROM sentences s JOIN t ON s.rec_id = t.rec_id AND s.start < t1 AND s."end" > t0 GROUP BY ALL),
g AS (SELECT rec_id, line_no, count(*) AS n, arg_max(spk, ms) AS spk, max(ms) AS ms FROM o GROUP BY ALL)
SELECT s.rec_id, s.line_no, CASE WHEN n > 1 THEN 'overlap' WHEN ms / (s."end" - s.start) >= 0.6 THEN g.spk ELSE 'unknown' END AS speaker FROM sentences s LEFT JOIN g USING (rec_id, line_no)"""),
    "ag_frame_feats": _LABEL_FEATS + " SELECT rec_id, frame_idx, round(rms, 6) AS rms, round(zcr, 6) AS zcr FROM feats",
    "wn_hotspots": _SPOTS + " SELECT rec_id, first, last, frames, peak_idx, round(round(peak_energy, 4), 3) AS peak, kind FROM spots",
    "jn_hotspot_text": _TAGGED + " SELECT rec_id, first, text_density, text_tag FROM tagged",
    "ag_hotspot_stats": _TAGGED + """ SELECT rec_id, count(*) AS total, count(*) FILTER (kind = 'strong_anomaly') AS strong, count(*) FILTER (kind = 'high_freq_burst') AS high_freq, count(*) FILTER (kind = 'energy_burst') AS bursts,
  count(*) FILTER (text_tag = '文本弱') AS text_weak, count(*) FILTER (text_tag = '文本弱' AND kind <> 'energy_burst') AS strong_text_weak FROM tagged GROUP BY 1""",
    "jn_hotspot_event": _KNOWN + " SELECT rec_id, first, known FROM known",
    "sel_review_list": _KNOWN + " SELECT rec_id, first, place FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY text_density, round(peak_energy, 4) DESC, first) AS place FROM known WHERE NOT known) WHERE place <= 5",
    "sel_strong_list": _SPOTS + " SELECT rec_id, first, place FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY round(peak_energy, 4) DESC, first) AS place FROM spots WHERE kind = 'strong_anomaly') WHERE place <= 30",
    "wn_energy_bursts": _FEATS + f", med AS (SELECT *, {_MED} AS med FROM feats), " + _ISLES("med", "frame_idx >= 20 AND med > 0 AND rms > 0.02 AND rms / med > 1.6", 5) + " SELECT rec_id, min(frame_idx) AS first, max(frame_idx) AS last, round(max(rms), 6) AS peak FROM k3 GROUP BY rec_id, run",
    "wn_pauses": _FEATS + ", " + _ISLES("feats", "rms < 0.13") + " SELECT rec_id, min(frame_idx) AS first, max(frame_idx) AS last FROM k3 GROUP BY rec_id, run HAVING count(*) >= 3",
    "wn_pause_bursts": _LABEL_FEATS + ", " + _ISLES("feats", "rms < 0.13") + """, ps AS (SELECT rec_id, min(frame_idx) AS p0, max(frame_idx) AS p1 FROM k3 GROUP BY rec_id, run HAVING count(*) >= 3),
w AS (SELECT ps.*, (SELECT max(rms) FROM feats f WHERE f.rec_id = ps.rec_id AND f.frame_idx BETWEEN p1 + 1 AND p1 + 20) AS peak, (SELECT arg_max(frame_idx, rms) FROM feats f WHERE f.rec_id = ps.rec_id AND f.frame_idx BETWEEN p1 + 1 AND p1 + 20) AS peak_idx,
  (SELECT quantile_cont(rms, 0.5) FROM feats f WHERE f.rec_id = ps.rec_id AND f.frame_idx BETWEEN p0 - 3 AND p1 + 1) AS med FROM ps)
SELECT rec_id, p0, p1, peak_idx, round(peak, 6) AS peak FROM w WHERE peak > 0.02 AND peak / greatest(med, 1e-6) > 1.8""",
    "wn_baseline_pct": _FEATS + ", " + _BASE("b", 10, 0.85) + " SELECT rec_id, frame_idx, round(base, 6) AS base FROM b",
    "wn_anomalies": _SPEECH + ", " + _BASE("w", 10, 0.85) + ", " + _BASE("n", 5, 0.5) + """, ab AS (SELECT f.rec_id, f.frame_idx, f.rms, w.base AS wide FROM feats f JOIN w USING (rec_id, frame_idx) JOIN n USING (rec_id, frame_idx) WHERE f.rms > greatest(w.base, 1e-4) * 1.02 AND f.rms > greatest(n.base, 1e-4) * 1.2),
""" + _ISLES("ab", "TRUE") + """, r AS (SELECT rec_id, min(frame_idx) AS first, max(frame_idx) AS last, arg_max(frame_idx, rms) AS peak_idx, max(rms) AS p, arg_max(wide, rms) AS wide FROM k3 GROUP BY rec_id, run)
SELECT rec_id, first, last, peak_idx, round(p, 4) AS peak, round(p / wide, 2) AS above, CASE WHEN last - first + 1 < 8 THEN 'short_pulse' WHEN round(p, 4) > greatest(wide, 1e-4) * 3.5 THEN 'sustained' ELSE 'burst' END AS kind,
  (SELECT speech FROM marks m WHERE m.rec_id = r.rec_id AND m.frame_idx = r.peak_idx) AS speech FROM r WHERE last - first + 1 <= 40""",
    "jn_speech_mark": _LABEL_SPEECH + " SELECT * FROM marks",
    "ag_speech_share": _SPEECH + " SELECT rec_id, round(100 * avg(CASE WHEN speech THEN 1.0::DOUBLE ELSE 0 END), 1) AS speech_pct FROM marks GROUP BY 1",
    "wn_feedback_latest": views.with_views("feedback", body=""" SELECT clip_id, arg_max(user_choice, event_id) AS user_choice, max(event_id) AS event_id, arg_max(snapshot, event_id) FILTER (snapshot IS NOT NULL) AS snapshot
FROM (SELECT clip_id, user_choice, snapshot, event_id, row_number() OVER (ORDER BY ts, event_id) AS o FROM feedback) GROUP BY 1"""),
    "ag_feedback_stats": views.with_views("feedback", body=""", l AS (SELECT clip_id, arg_max(user_choice, event_id) AS c FROM feedback GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (c = '喜欢') AS liked, count(*) FILTER (c <> '喜欢') AS disliked FROM l"""),
    "jn_feedback": views.with_views("feedback", body=""", l AS (SELECT clip_id, arg_max(user_choice, event_id) AS user_choice FROM feedback GROUP BY 1) SELECT c_custkey AS clip_id, user_choice FROM customer LEFT JOIN l ON clip_id = c_custkey"""),
    "ag_usage_cost": views.with_views("usage", body=" SELECT rec_id, count(*) AS calls, CAST(sum(in_tokens) AS BIGINT) AS in_tokens, CAST(sum(out_tokens) AS BIGINT) AS out_tokens, round((sum(in_tokens) * 2.0::DOUBLE + sum(out_tokens) * 8.0::DOUBLE) / 1000000, 4) AS cost FROM usage GROUP BY 1"),
}
