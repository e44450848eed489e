"""Queries of the scan, the chunks and the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Budget, Scan, Words
from ..functions import clock, scores, text
from ..operators import chunks, scan
from . import views

#: Latin words and a line that fit the given texts.
WORDS = Words(("the", "que", "der"), ("ing", "tion", "ment"))
SCAN = Scan(hot_score=60)
MONEY = Budget(budget=9_000)


def _buckets(spark, d):
    return scan.bucket_scores(views.segments(spark, d), WORDS, SCAN)


def jn_segment_bucket(spark, d):
    return scan.segment_minutes(views.segments(spark, d), SCAN).select("rec_id", "line_no", "bucket_no")


def ag_bucket_score(spark, d):
    return _buckets(spark, d)


def ag_duration(spark, d):
    return scan.durations(views.segments(spark, d))


def sel_hot_minutes(spark, d):
    return scan.hot_minutes(_buckets(spark, d)).select("rec_id", "place", "bucket_no", "score")


def wn_hot_bridge(spark, d):
    return chunks.hot_bridge(_buckets(spark, d), SCAN).select("rec_id", "bucket_no", "hot", "hot2")


def wn_pack_chunks(spark, d):
    return chunks.pack(_buckets(spark, d), views.segments(spark, d), SCAN)


def jn_segment_chunk(spark, d):
    return chunks.segments_of(wn_pack_chunks(spark, d), views.segments(spark, d)).select("rec_id", "chunk_no", "line_no")


def ag_chunk(spark, d):
    full = chunks.with_text(wn_pack_chunks(spark, d), views.segments(spark, d))
    return full.select("rec_id", "chunk_no", "score", "speech_start", "speech_end", "n_segments", F.col("char_count").cast("long").alias("char_count"), F.md5("text").alias("text_md5"))


def ag_budget(spark, d):
    return chunks.budget(chunks.with_text(wn_pack_chunks(spark, d), views.segments(spark, d)))


def ag_degrade(spark, d):
    return chunks.degrade(_buckets(spark, d), views.segments(spark, d), SCAN, MONEY)


def wn_coverage_check(spark, d):
    """Chunks of which some are shifted or left out."""
    odd = wn_pack_chunks(spark, d).filter("(rec_id + chunk_no) % 4 <> 0").withColumn("start", F.col("start") - F.when(F.col("chunk_no") % 3 == 0, 7).otherwise(0))
    return chunks.coverage_problems(odd, scan.durations(views.segments(spark, d)))


def ag_chunk_summary(spark, d):
    made = wn_pack_chunks(spark, d)
    return chunks.summaries(made, views.segments(spark, d), views.candidates(spark, d).withColumn("chunk_no", F.col("chunk_no") + 1), Words(("clown", "thing", "que ")))


def fn_clock_to_sec(spark, d):
    c = views.candidates(spark, d)
    made = F.when(F.col("cand_no") % 4 == 0, clock.chunk_clock(F.col("start") * 3)).when(F.col("cand_no") % 4 == 1, clock.line_clock(F.col("start"))).when(F.col("cand_no") % 4 == 2, F.col("start").cast("string")).otherwise("ab:cd")
    rows = c.select("rec_id", "cand_no", made.alias("clock"))
    return rows.select("rec_id", "cand_no", "clock", clock.to_seconds(F.col("clock")).cast("long").alias("seconds"), clock.to_seconds(F.col("clock"), digits=True).cast("long").alias("seconds_or_digits"))


def fn_sec_to_clock(spark, d):
    s = F.col("start") * 3
    return views.candidates(spark, d).select("rec_id", "cand_no", clock.chunk_clock(s).alias("chunk"), clock.line_clock(s).alias("line"), clock.progress_clock(s).alias("progress"))


def fn_clamp(spark, d):
    c = views.candidates(spark, d)
    return c.select("rec_id", "cand_no", clock.clamp(F.col("start"), 100, 2000).alias("clamped"), clock.clamp(F.col("title"), 1, 10, 5).alias("defaulted"))


def fn_weighted_score(spark, d):
    return views.reviews(spark, d).select("rec_id", "event_no", scores.weighted().alias("final_score"))


def fn_grade(spark, d):
    s = scores.weighted()
    g = scores.grade(s)
    return views.reviews(spark, d).select("rec_id", "event_no", g.alias("grade"), scores.grade(F.when(F.col("flagged"), s), "").alias("grade_or_none"), scores.rank(g).cast("long").alias("rank"))


def fn_tier(spark, d):
    g = scores.grade(scores.weighted())
    return views.reviews(spark, d).select("rec_id", "event_no", scores.tier(g).alias("tier"), scores.label(g).alias("label"))


def _pairs(spark, d):
    a = views.candidates(spark, d)
    b = a.select("rec_id", (F.col("cand_no") - 1).alias("cand_no"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("title").alias("b_title"))
    return a.join(b, ["rec_id", "cand_no"])


def fn_overlap(spark, d):
    near = _pairs(spark, d).withColumn("b_start", F.col("b_start") - 700).withColumn("b_end", F.col("b_end") - 700)
    return near.select("rec_id", "cand_no", F.round(scores.overlap(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end")), 6).alias("overlap"))


def fn_time_decay(spark, d):
    gap = F.col("b_start") - F.col("end")
    return _pairs(spark, d).select("rec_id", "cand_no", F.round(scores.time_decay(gap, 900.0), 6).alias("decay"))


def fn_bigram_sim(spark, d):
    return _pairs(spark, d).select("rec_id", "cand_no", F.round(text.bigram_similarity(F.col("title"), F.col("b_title")), 6).alias("similarity"))


def fn_form_sim(spark, d):
    ascii_ = lambda c: F.regexp_replace(c, "[^ -~]", "")  # noqa: E731  edit distances of SQL engines differ on other letters
    return _pairs(spark, d).select("rec_id", "cand_no", F.round(text.form_similarity(ascii_("title"), ascii_("b_title")), 6).alias("similarity"))


def fn_token_estimate(spark, d):
    return views.usage(spark, d).groupBy("rec_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("in_tokens").alias("n")).select("rec_id", "calls", text.token_estimate(F.col("n")).alias("tokens"))


FIXES = (("th", "TH"), ("the", "(the)"), ("tion", "(tion)"))


def fn_dictionary_fix(spark, d):
    return views.segments(spark, d).select("rec_id", "line_no", F.md5(text.fix_words(F.col("text"), FIXES)).alias("fixed_md5"))


def fn_fix_line(spark, d):
    line = F.concat(F.lit("[the - tion] "), "text")
    return views.segments(spark, d).select("rec_id", "line_no", F.md5(text.fix_line(line, FIXES)).alias("fixed_md5"))


def cor_segments(spark, d):
    fixed = text.fix_words(F.col("text"), FIXES)
    return views.segments(spark, d).groupBy("rec_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(fixed != F.col("text")).alias("changed"))


QUERIES = {f.__name__: f for f in (
    jn_segment_bucket, ag_bucket_score, ag_duration, sel_hot_minutes, wn_hot_bridge, wn_pack_chunks, jn_segment_chunk, ag_chunk, ag_budget, ag_degrade,
    wn_coverage_check, ag_chunk_summary, fn_clock_to_sec, fn_sec_to_clock, fn_clamp, fn_weighted_score, fn_grade, fn_tier, fn_overlap, fn_time_decay,
    fn_bigram_sim, fn_form_sim, fn_token_estimate, fn_dictionary_fix, fn_fix_line, cor_segments,
)}

_CNT = lambda w: f"CAST((length(t) - length(replace(t, '{w}', ''))) / {len(w)} AS BIGINT)"
_BUCKETS = f""",
minutes AS (SELECT s.*, b AS bucket_no FROM segments s, range(0, 100000) r(b) WHERE b >= s.start // 60 AND b <= s."end" // 60 AND s.start < (b + 1) * 60 AND s."end" > b * 60),
texts AS (SELECT rec_id, bucket_no, string_agg(text, '' ORDER BY line_no) AS text FROM minutes GROUP BY ALL),
totals AS (SELECT rec_id, max("end") AS total FROM segments GROUP BY 1),
spine AS (SELECT rec_id, unnest(range(0, CAST(ceil(total / 60) AS BIGINT))) AS bucket_no FROM totals),
counted AS (SELECT rec_id, bucket_no, coalesce(text, '') AS t FROM spine LEFT JOIN texts USING (rec_id, bucket_no)),
hits AS (SELECT rec_id, bucket_no, {' + '.join(map(_CNT, WORDS.strong))} AS strong, {' + '.join(map(_CNT, WORDS.normal))} AS normal FROM counted),
buckets AS (SELECT rec_id, bucket_no, bucket_no * 60 AS start, (bucket_no + 1) * 60 AS "end", strong, normal, 2 * strong + normal AS score, 2 * strong + normal >= {SCAN.hot_score} AS hot FROM hits)"""
_BRIDGE = _BUCKETS + f""",
marks AS (SELECT *, CASE WHEN hot = lag(hot) OVER w OR bucket_no = 0 THEN 0 ELSE 1 END AS m FROM buckets WINDOW w AS (PARTITION BY rec_id ORDER BY bucket_no)),
runs AS (SELECT *, sum(m) OVER (PARTITION BY rec_id ORDER BY bucket_no) AS run FROM marks),
bridged AS (SELECT *, hot OR (run > 0 AND run < max(run) OVER (PARTITION BY rec_id) AND count(*) OVER (PARTITION BY rec_id, run) <= 2) AS hot2 FROM runs)"""
_CHUNKS = _BRIDGE + """,
marks2 AS (SELECT *, CASE WHEN hot2 = lag(hot2) OVER w OR bucket_no = 0 THEN 0 ELSE 1 END AS m2 FROM bridged WINDOW w AS (PARTITION BY rec_id ORDER BY bucket_no)),
runs2 AS (SELECT *, sum(m2) OVER (PARTITION BY rec_id ORDER BY bucket_no) AS run2 FROM marks2),
parts AS (SELECT *, (row_number() OVER (PARTITION BY rec_id, run2 ORDER BY bucket_no) - 1) // CASE WHEN hot2 THEN 3 ELSE {normal} END AS part FROM runs2),
raw_chunks AS (SELECT rec_id, bool_and(hot2) AS hot, min(start) AS start, max("end") AS "end", CAST(sum(score) AS BIGINT) AS score FROM parts GROUP BY rec_id, run2, part),
chunks AS (SELECT rec_id, row_number() OVER w AS chunk_no, hot, start, CASE WHEN lead(start) OVER w IS NULL THEN least("end", total) ELSE "end" END AS "end", score
  FROM raw_chunks JOIN totals USING (rec_id) WINDOW w AS (PARTITION BY rec_id ORDER BY start))"""
_CLOCK = lambda s: f"CASE WHEN {s} >= 3600 THEN printf('%02d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60) ELSE printf('%02d:%02d', {s} // 60, {s} % 60) END"
_TEXT = f""",
inside AS (SELECT c.rec_id, c.chunk_no, s.line_no, s.start, s."end", s.text FROM chunks c JOIN segments s ON c.rec_id = s.rec_id AND s.start < c."end" AND s."end" > c.start),
spoken AS (SELECT rec_id, chunk_no, min_by(start, line_no) AS speech_start, max_by("end", line_no) AS speech_end, count(*) AS n_segments,
  string_agg('[' || {_CLOCK('start')} || ' - ' || {_CLOCK('"end"')} || '] ' || text, chr(10) ORDER BY line_no) AS text FROM inside GROUP BY ALL),
full_chunks AS (SELECT c.rec_id, c.chunk_no, c.score, coalesce(speech_start, start) AS speech_start, coalesce(speech_end, "end") AS speech_end, coalesce(n_segments, 0) AS n_segments,
  coalesce(text, '') AS text, length(replace(coalesce(text, ''), chr(10), '')) AS char_count FROM chunks c LEFT JOIN spoken USING (rec_id, chunk_no))"""
_seg = lambda body: views.with_views("segments", body=body)
_fine, _coarse = _CHUNKS.replace("{normal}", "10"), _CHUNKS.replace("{normal}", "20")
_EST = lambda m: f"floor(0.6::DOUBLE * (chars + 700 * n)) + n * {m} * 230 + n * {m} * 450 + 800 + floor(0.6::DOUBLE * 180 * n) + 300 + floor(0.6::DOUBLE * ((chars / n + 700) * 3))"
_SUM = "SELECT rec_id, count(*) AS n, CAST(sum(char_count) AS BIGINT) AS chars FROM full_chunks GROUP BY 1"
_G = "CASE WHEN s IS NULL THEN {0} WHEN s >= 90 THEN 'S' WHEN s >= 80 THEN 'A' WHEN s >= 60 THEN 'B' WHEN s >= 50 THEN 'C' ELSE 'D' END"
_FINAL = "(hook * 30 + contrast * 25 + persona * 20 + standalone * 15 + completeness * 10) / 10"
_PAIR = """, pairs AS (SELECT a.*, b.start AS b_start, b."end" AS b_end, b.title AS b_title FROM candidates a JOIN candidates b ON a.rec_id = b.rec_id AND b.cand_no = a.cand_no + 1)"""
_CLEAN = lambda c: f"regexp_replace({c}, '[^一-龥a-zA-Z0-9]', '', 'g')"
_PAIRS_OF = lambda c: f"CASE WHEN length({c}) = 0 THEN [] WHEN length({c}) = 1 THEN [{c}] ELSE list_distinct(list_transform(range(1, length({c})), lambda k: substr({c}, CAST(k AS INT), 2))) END"
_CHARS = lambda c: f"list_distinct(string_split({c}, ''))"

ORACLE = {
    "jn_segment_bucket": _seg(_BUCKETS + " SELECT rec_id, line_no, bucket_no FROM minutes"),
    "ag_bucket_score": _seg(_BUCKETS + " SELECT * FROM buckets"),
    "ag_duration": _seg(" SELECT rec_id, max(\"end\") AS total FROM segments GROUP BY 1"),
    "sel_hot_minutes": _seg(_BUCKETS + " SELECT rec_id, place, bucket_no, score FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, bucket_no) AS place FROM buckets) WHERE place <= 5"),
    "wn_hot_bridge": _seg(_BRIDGE + " SELECT rec_id, bucket_no, hot, hot2 FROM bridged"),
    "wn_pack_chunks": _seg(_fine + " SELECT * FROM chunks"),
    "jn_segment_chunk": _seg(_fine + _TEXT + " SELECT rec_id, chunk_no, line_no FROM inside"),
    "ag_chunk": _seg(_fine + _TEXT + " SELECT rec_id, chunk_no, score, speech_start, speech_end, n_segments, char_count, md5(text) AS text_md5 FROM full_chunks"),
    "ag_budget": _seg(_fine + _TEXT + f", sums AS ({_SUM}) SELECT rec_id, n AS n_chunks, chars, CAST({_EST(3)} AS BIGINT) AS tokens FROM sums"),
    "wn_coverage_check": _seg(_fine + """,
odd AS (SELECT rec_id, chunk_no, start - CASE WHEN chunk_no % 3 = 0 THEN 7 ELSE 0 END AS start, "end" FROM chunks WHERE (rec_id + chunk_no) % 4 <> 0),
posed AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY rec_id ORDER BY chunk_no), 0) AS position FROM odd),
tails AS (SELECT rec_id, max_by("end", chunk_no) AS position FROM odd GROUP BY 1)
SELECT rec_id, CASE WHEN start > position THEN 'gap' ELSE 'overlap' END AS problem, position AS at, start AS until FROM posed WHERE start <> position
UNION ALL SELECT rec_id, CASE WHEN position < total THEN 'tail' ELSE 'beyond' END, position, total FROM tails JOIN totals USING (rec_id) WHERE position <> total"""),
    "ag_chunk_summary": views.with_views("segments", "candidates", body=_fine + _TEXT + """,
strong AS (SELECT *, contains(text, 'clown') OR contains(text, 'thing') OR contains(text, 'que ') AS st FROM inside),
anys AS (SELECT *, bool_or(st) OVER (PARTITION BY rec_id, chunk_no) AS anyst FROM strong),
kept AS (SELECT *, row_number() OVER (PARTITION BY rec_id, chunk_no ORDER BY line_no) AS place FROM anys WHERE st OR NOT anyst),
keys AS (SELECT rec_id, chunk_no, string_agg(substr(text, 1, 60), '；' ORDER BY line_no) AS key_text FROM kept WHERE place <= CASE WHEN anyst THEN 3 ELSE 1 END GROUP BY ALL),
n AS (SELECT rec_id, chunk_no + 1 AS chunk_no, count(*) AS n_candidates FROM candidates GROUP BY ALL)
SELECT c.rec_id, c.chunk_no, coalesce(n_candidates, 0) AS n_candidates, coalesce(key_text, '（无台词）') AS key_text FROM chunks c LEFT JOIN n USING (rec_id, chunk_no) LEFT JOIN keys USING (rec_id, chunk_no)"""),
    "fn_clock_to_sec": views.with_views("candidates", body=f""", made AS (SELECT rec_id, cand_no, start, CASE cand_no % 4 WHEN 0 THEN {_CLOCK('(start * 3)')} WHEN 1 THEN printf('%02d:%02d', start // 60, start % 60) WHEN 2 THEN CAST(start AS VARCHAR) ELSE 'ab:cd' END AS clock FROM candidates)
SELECT rec_id, cand_no, clock, CASE cand_no % 4 WHEN 0 THEN start * 3 WHEN 1 THEN start END AS seconds, CASE cand_no % 4 WHEN 0 THEN start * 3 WHEN 3 THEN NULL ELSE start END AS seconds_or_digits FROM made"""),
    "fn_sec_to_clock": views.with_views("candidates", body=f" SELECT rec_id, cand_no, {_CLOCK('(start * 3)')} AS chunk, printf('%02d:%02d', start * 3 // 60, start * 3 % 60) AS line, CASE WHEN start * 3 >= 3600 THEN printf('%d:%02d:%02d', start * 3 // 3600, start * 3 % 3600 // 60, start * 3 % 60) ELSE printf('%02d:%02d', start * 3 // 60, start * 3 % 60) END AS progress FROM candidates"),
    "fn_clamp": views.with_views("candidates", body=" SELECT rec_id, cand_no, CAST(greatest(100, least(2000, start)) AS DOUBLE) AS clamped, CASE WHEN TRY_CAST(title AS DOUBLE) IS NULL THEN 5.0::DOUBLE ELSE greatest(1, least(10, TRY_CAST(title AS DOUBLE))) END AS defaulted FROM candidates"),
    "fn_weighted_score": views.with_views("reviews", body=f" SELECT rec_id, event_no, {_FINAL} AS final_score FROM reviews"),
    "fn_grade": views.with_views("reviews", body=f""", g AS (SELECT rec_id, event_no, flagged, {_FINAL} AS f FROM reviews), h AS (SELECT *, {_G.format("'D'").replace('s ', 'f ')} AS grade FROM g)
SELECT rec_id, event_no, grade, CASE WHEN flagged THEN grade ELSE '' END AS grade_or_none, CAST(list_position(['S','A','B','C','D'], grade) - 1 AS BIGINT) AS rank FROM h"""),
    "fn_tier": views.with_views("reviews", body=f""", g AS (SELECT rec_id, event_no, {_FINAL} AS f FROM reviews), h AS (SELECT *, {_G.format("'D'").replace('s ', 'f ')} AS grade FROM g)
SELECT rec_id, event_no, CASE grade WHEN 'S' THEN 'S' WHEN 'A' THEN 'A' WHEN 'B' THEN 'B_fill' WHEN 'C' THEN 'C_fallback' ELSE '' END AS tier, CASE WHEN grade IN ('S', 'A') THEN '🌟 高光内容' WHEN grade IN ('B', 'C') THEN '✨ 有看点' ELSE '' END AS label FROM h"""),
    "fn_overlap": views.with_views("candidates", body=_PAIR + """ SELECT rec_id, cand_no, round(CASE WHEN least("end", b_end - 700) - greatest(start, b_start - 700) > 0 THEN least(1.0::DOUBLE, (least("end", b_end - 700) - greatest(start, b_start - 700)) / least("end" - start, b_end - b_start)) ELSE 0 END, 6) AS overlap FROM pairs"""),
    "fn_time_decay": views.with_views("candidates", body=_PAIR + """ SELECT rec_id, cand_no, round(CASE WHEN b_start - "end" <= 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (b_start - "end") / 900.0::DOUBLE) END, 6) AS decay FROM pairs"""),
    "fn_bigram_sim": views.with_views("candidates", body=_PAIR + f""", c AS (SELECT rec_id, cand_no, {_CLEAN('title')} AS x, {_CLEAN('b_title')} AS y FROM pairs), p AS (SELECT rec_id, cand_no, {_PAIRS_OF('x')} AS p, {_PAIRS_OF('y')} AS q FROM c)
SELECT rec_id, cand_no, round(CASE WHEN least(len(p), len(q)) > 0 THEN len(list_intersect(p, q)) / least(len(p), len(q)) ELSE 0.0::DOUBLE END, 6) AS similarity FROM p"""),
    "fn_form_sim": views.with_views("candidates", body=_PAIR + f""", a AS (SELECT rec_id, cand_no, regexp_replace(title, '[^ -~]', '', 'g') AS x, regexp_replace(b_title, '[^ -~]', '', 'g') AS y FROM pairs),
c AS (SELECT *, {_CHARS('x')} AS p, {_CHARS('y')} AS q, greatest(length(x), length(y)) AS m FROM a),
sp AS (SELECT *, len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q))) AS shared FROM c)
SELECT rec_id, cand_no, round(0.5::DOUBLE * (1 - edits / m) + 0.3::DOUBLE * shared + 0.2::DOUBLE * (least(length(x), length(y)) / m), 6) AS similarity FROM (SELECT *, levenshtein(x, y) AS edits FROM sp)"""),
    "fn_token_estimate": views.with_views("usage", body=" SELECT rec_id, count(*) AS calls, CAST(floor(0.6::DOUBLE * sum(in_tokens)) AS BIGINT) AS tokens FROM usage GROUP BY 1"),
    "fn_dictionary_fix": _seg(" SELECT rec_id, line_no, md5(replace(replace(replace(text, 'tion', '(tion)'), 'the', '(the)'), 'th', 'TH')) AS fixed_md5 FROM segments"),
    "fn_fix_line": _seg(" SELECT rec_id, line_no, md5('[the - tion] ' || replace(replace(replace(text, 'tion', '(tion)'), 'the', '(the)'), 'th', 'TH')) AS fixed_md5 FROM segments"),
    "cor_segments": _seg(" SELECT rec_id, count(*) AS rows, count(*) FILTER (replace(replace(replace(text, 'tion', '(tion)'), 'the', '(the)'), 'th', 'TH') <> text) AS changed FROM segments GROUP BY 1"),
}
_deg = lambda c, m, n: f"SELECT rec_id, CAST({_EST(m)} AS BIGINT) AS {n} FROM ({_SUM})"
ORACLE["ag_degrade"] = f"""SELECT rec_id, CASE WHEN t0 <= {MONEY.budget} THEN 0 WHEN t1 <= {MONEY.budget} THEN 1 WHEN t2 <= {MONEY.budget} THEN 2 ELSE 3 END AS level,
  CASE WHEN t0 <= {MONEY.budget} THEN t0 WHEN t1 <= {MONEY.budget} THEN t1 ELSE t2 END AS tokens, CASE WHEN t0 <= {MONEY.budget} OR t1 <= {MONEY.budget} THEN 3 ELSE 1 END AS max_candidates
FROM ({_seg(_fine + _TEXT + _deg(0, 3, 't0').join([' ', '']))}) JOIN ({_seg(_coarse + _TEXT + _deg(0, 3, 't1').join([' ', '']))}) USING (rec_id) JOIN ({_seg(_coarse + _TEXT + _deg(0, 1, 't2').join([' ', '']))}) USING (rec_id)"""
