"""Queries of sources and sinks, contexts, event building, run comparison and correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import line_clock
from ..functions.scores import grade
from ..operators import cluster, correction, events, feedback, lexicon, lists, quality
from ..operators.staging import stage
from ..operators.ranges import ordered
from ..sources import files, replies
from . import views
from .q_scan import _CLOCK


def _texts(spark, d):
    lines = files.transcript_text(views.segments(spark, d))
    return lines.groupBy("rec_id").agg(ordered("line", "line_no", separator="\n").alias("content"))


def src_transcript(spark, d):
    return files.transcript_lines(_texts(spark, d)).select("rec_id", "line_no", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("text").alias("text_md5"))


def snk_transcript(spark, d):
    return files.transcript_text(views.segments(spark, d)).select("rec_id", "line_no", F.md5("line").alias("line_md5"))


def snk_rttm(spark, d):
    s = views.sentences(spark, d)
    return files.rttm_lines(s.select("rec_id", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"), "spk"))


def _replies(spark, d):
    """One JSON reply for each chunk; some broken, some with fields missing or of other types."""
    c = views.candidates(spark, d)
    n = F.col("cand_no")
    item = F.struct(
        "cand_no", F.when(n % 13 != 0, line_clock(F.col("start"))).alias("start_time"), line_clock(F.col("end")).alias("end_time"), F.regexp_replace("title", r"[^A-Za-z ]", "").alias("title"),
        F.when(n % 5 == 0, F.lit("7.5")).when(n % 5 == 1, (F.col("score") * 2).cast("string")).otherwise(F.col("score").cast("string")).alias("score"),
    )
    body = F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("candidates")))
    rows = c.groupBy("rec_id", "chunk_no").agg(body.alias("reply"))
    return rows.withColumn("reply", F.when(F.col("rec_id") % 7 == 3, F.concat(F.lit("oops"), "reply")).otherwise(F.col("reply")))


def src_candidates(spark, d):
    return replies.candidates(_replies(spark, d)).select("rec_id", "chunk_no", "start_time", "end_time", "title", "score", "highlight_type", "confidence")


def src_reviews(spark, d):
    r = views.reviews(spark, d)
    item = F.struct(F.col("event_no").cast("string").alias("event_id"), F.struct("hook", "contrast", F.col("persona").alias("personality"), "standalone", F.when(F.col("event_no") % 4 != 0, F.col("completeness")).alias("completeness")).alias("scores"), F.col("reject_kind").alias("reject_reason_kind"))
    made = r.groupBy("rec_id").agg(F.to_json(F.struct(F.collect_list(item).alias("results"))).alias("reply"))
    return replies.reviews(made)[0].select("rec_id", "event_id", "hook", "contrast", "persona", "standalone", "completeness", "reject_kind")


def src_provider_a(spark, d):
    s = views.sentences(spark, d)
    item = F.struct(F.col("start").alias("start_time"), F.col("end").alias("end_time"), F.lit("t").alias("text"), F.struct(F.when(F.col("line_no") % 3 == 0, (F.col("line_no") % 4).cast("string")).when(F.col("line_no") % 3 == 1, F.col("spk")).alias("speaker")).alias("additions"))
    made = s.groupBy("rec_id").agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("utterances")).alias("result"))).alias("reply"))
    return replies.utterance_turns(made).select("rec_id", "start", "end", "speaker")


def jn_context(spark, d):
    c = views.candidates(spark, d).select("rec_id", F.col("cand_no").alias("event_no"), F.floor(F.col("start") / 3).alias("start"), F.floor(F.col("end") / 3).alias("end"))
    return events.contexts(c, views.segments(spark, d), 30, 30, 3000).select("rec_id", "event_no", "lines", F.md5("text").alias("text_md5"))


def jn_review_context(spark, d):
    c = views.candidates(spark, d).select("rec_id", F.col("cand_no").alias("event_no"), F.floor(F.col("start") / 3).alias("start"), F.floor(F.col("end") / 3).alias("end"))
    return events.review_contexts(c, views.segments(spark, d), 60, 4000, 1).select("rec_id", "event_no", "lines", F.md5("text").alias("text_md5"))


def flt_cut_chars(spark, d):
    return events.cut_characters(views.segments(spark, d), 6000)


def wn_line_groups(spark, d):
    return events.line_groups(views.segments(spark, d)).withColumn("text", F.md5("text"))


def jn_rescan_anti(spark, d):
    c = views.candidates(spark, d)
    found = c.filter("cand_no % 3 = 0").withColumn("start", F.col("start") + F.col("cand_no") % 2).withColumn("end", F.col("end") + F.col("cand_no") % 2)
    return events.rescan_new(found, c.filter("cand_no % 3 <> 0")).select("rec_id", "cand_no")


def _events(spark, d):
    c = views.candidates(spark, d)
    return c.select("rec_id", F.col("cand_no").alias("event_no"), "start", "end", "title", F.lit("").alias("summary"), "score", (1 + F.col("cand_no") % 3).alias("source_count"))


def _later(spark, d):
    shift = F.col("event_no") % 4 * 5
    return _events(spark, d).filter("event_no % 10 <> 0").withColumn("start", F.col("start") + shift)


def cl_dedupe_events(spark, d):
    e = _events(spark, d).withColumn("title", F.concat(F.lit("topic number "), F.col("event_no") % 2))
    return events.dedupe(e).withColumn("merged_from", F.concat_ws(",", F.col("merged_from").cast("array<string>")))


def ag_event_build(spark, d):
    c = views.candidates(spark, d)
    made = cluster.components(c, cluster.links(c).filter("score >= 0.66"))
    n = F.col("cluster_no")
    judged = made.select("rec_id", "cluster_no").distinct().select("rec_id", "cluster_no", (n % 3 != 0).alias("same_event"), F.when(n % 4 == 0, n * 7).cast("long").alias("j_start"), F.when(n % 4 == 0, n * 7 - 5).cast("long").alias("j_end"), F.when(n % 2 == 0, F.concat(F.lit("summary "), n)).alias("summary"))
    totals = c.groupBy("rec_id").agg((F.max("end") - 50).alias("total"))
    return events.build(c, made, judged, totals).withColumn("sources", F.concat_ws(",", F.col("sources").cast("array<string>")))


def ag_run_summary(spark, d):
    return events.run_summary(_events(spark, d))


def set_run_delta(spark, d):
    graded = lambda e, more: e.withColumn("grade", grade(F.col("score") * 10 - more))
    usage = views.table(spark, d, "events").select((F.col("user_id") % 20).alias("rec_id"), (F.col("event_id") % 2).alias("run"), F.floor(F.col("value") * 100).cast("long").alias("in_tokens"), F.floor(F.col("value") * 10).cast("long").alias("out_tokens"))
    costs = tuple(feedback.usage_cost(usage.filter(F.col("run") == k).drop("run")) for k in (0, 1))
    return events.run_delta(graded(_events(spark, d), 0), graded(_later(spark, d), F.col("event_no") % 3 * 5), costs=costs)


def set_match_runs(spark, d):
    return events.match_runs(_events(spark, d), _later(spark, d))


def set_title_clash(spark, d):
    return events.title_clashes(views.candidates(spark, d))


def set_event_subset(spark, d):
    used = _events(spark, d).withColumn("event_no", F.col("event_no") + F.when(F.col("event_no") % 9 == 0, 1000).otherwise(0))
    return events.not_in_pool(used, _events(spark, d)).select("rec_id", "event_no")


def set_all_events(spark, d):
    e = _events(spark, d)
    a, b = e.filter("score >= 6").withColumn("recommended", F.lit(True)), e.filter("score < 6").withColumn("reject_reason", F.lit("low"))
    return lists.all_events(a, b).groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"), F.count("recommended").alias("recommended"), F.count("reject_reason").alias("rejected"))


def sel_top_events(spark, d):
    return lists.top_events(_events(spark, d), 5).select("rec_id", "place", "event_no", "score")


def _raw_lexicon(spark, d):
    """Lines of a lexicon of the words of `benchmark`, as people write them; each word is written
    in one category, with its misspellings and an edit of letters."""
    words = views.table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), r"\P{L}+")).alias("w")).filter("length(w) >= 6").distinct()
    n, w, no = F.length("w"), F.col("w"), F.pmod(F.xxhash64("w"), F.lit(1000))
    twice = F.concat(F.substr(w, F.lit(1), F.lit(3)), F.substr(w, F.lit(3), n))
    cut = F.when(n >= 9, F.concat(F.lit("、"), F.substr(w, F.lit(1), n - 1))).otherwise("")  # of a short word it is part of many others
    variants = F.concat(F.lit("（谐音："), twice, cut, F.lit("；打错字：th→ht/tt）"))
    rows = words.select(F.concat(no.cast("string"), F.lit(" / "), w, F.lit(" / "), variants).alias("value"), F.pmod(n, F.lit(4)).alias("kind"))
    kinds = [quality.raw_lexicon(rows.filter(F.col("kind") == k), c) for k, c in enumerate(("person", "movie", "book", "hotword"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])


def lexicon_of(spark, d):
    return stage(lexicon.build(_raw_lexicon(spark, d)), "lexicon")


def documents_of(spark, d):
    """Texts that begin with words of a topic, and write a letter twice in some words."""
    misheard = F.regexp_replace(F.coalesce("text", F.lit("")), r"\b(th[a-z])([a-z]{3,} [aeiou])", "$1$1$2")
    misheard = F.regexp_replace(misheard, r"\b(th)([a-z])th\2", "$1$2$2")
    return views.table(spark, d, "documents").select("doc_id", F.concat(F.lit("游戏主播 "), misheard).alias("text"))


def cor_detect(spark, d):
    return correction.detect(documents_of(spark, d), lexicon_of(spark, d)).groupBy("doc_id", "alias", "canonical").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))


def cor_apply(spark, d):
    made, _ = correction.correct(documents_of(spark, d), lexicon_of(spark, d))
    return made.select("doc_id", "n_applied", F.md5("corrected").alias("corrected_md5"))


def cor_report(spark, d):
    docs = documents_of(spark, d)
    _, decisions = correction.correct(docs, lexicon_of(spark, d))
    return correction.report(docs, decisions).drop("sentence")


QUERIES = {f.__name__: f for f in (
    src_transcript, snk_transcript, snk_rttm, src_candidates, src_reviews, src_provider_a, jn_context, jn_review_context, flt_cut_chars, wn_line_groups, jn_rescan_anti,
    cl_dedupe_events, ag_event_build, ag_run_summary, set_run_delta, set_match_runs, set_title_clash, set_event_subset, set_all_events, sel_top_events, cor_detect, cor_apply, cor_report,
)}

_seg = lambda body: views.with_views("segments", body=body)
_cand = lambda body: views.with_views("candidates", body=body)
_LINE = "trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g'))"
_MM = lambda c: f"printf('%02d:%02d', {c} // 60, {c} % 60)"
_STAMP = f"'[' || {_CLOCK('start')} || ' - ' || {_CLOCK('e')} || '] ' || text"
_CTX = """, ev AS (SELECT rec_id, cand_no AS event_no, start // 3 AS a, "end" // 3 AS b FROM candidates),
sg AS (SELECT rec_id AS r, line_no, start, "end" AS e, text FROM segments), near AS (SELECT ev.*, line_no, start, e, length(text) AS n, STAMP AS line FROM ev JOIN sg ON sg.r = ev.rec_id AND start < b + AROUND AND e > a - AROUND)""".replace("STAMP", _STAMP)
_EVENTS = """, events_ AS (SELECT rec_id, cand_no AS event_no, start, "end", score, 1 + cand_no % 3 AS source_count FROM candidates),
later AS (SELECT rec_id, event_no, start + event_no % 4 * 5 AS start, "end", score, source_count FROM events_ WHERE event_no % 10 <> 0)"""


def _summary(source, name):
    return f""", {name}0 AS (SELECT *, greatest(0, "end" - start) AS len FROM {source}), {name}1 AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY len, event_no) AS pl, count(*) OVER (PARTITION BY rec_id) AS n FROM {name}0),
{name} AS (SELECT rec_id, count(*) AS total, count(*) FILTER (source_count = 1) AS single_source, count(*) FILTER (source_count = 1 AND len <= 28) AS small_28s, count(*) FILTER (len > 60) AS long_60s, min(len) AS shortest, max(len) AS longest,
  max(len) FILTER (pl = n // 2 + 1) AS upper_median, CAST(round_even(100 * count(*) FILTER (source_count = 1) / count(*), 0) AS BIGINT) AS single_pct FROM {name}1 GROUP BY 1)"""


_COLS = ("total", "single_source", "small_28s", "long_60s", "shortest", "longest", "upper_median", "single_pct")
ORACLE = {
    "src_transcript": _seg(f""" SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY line_no) AS line_no, start, "end", md5({_LINE}) AS text_md5 FROM segments WHERE {_LINE} <> ''"""),
    "snk_transcript": _seg(f""" SELECT rec_id, line_no, md5('[' || {_MM('start')} || ' - ' || {_MM('"end"')} || '] ' || {_LINE}) AS line_md5 FROM segments WHERE {_LINE} <> ''"""),
    "snk_rttm": views.with_views("segments", "sentences", body=""" SELECT rec_id, start / 1000 AS start, printf('SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>', CAST(rec_id AS VARCHAR), start / 1000, ("end" - start) / 1000, spk) AS line FROM sentences"""),
    "src_candidates": _cand(f""" SELECT rec_id, chunk_no, {_MM('start')} AS start_time, {_MM('"end"')} AS end_time, trim(regexp_replace(title, '[^A-Za-z ]', '', 'g')) AS title,
  least(10, CASE WHEN cand_no % 5 = 1 THEN score * 2 ELSE score END) AS score, '事件型' AS highlight_type, 0.5::DOUBLE AS confidence FROM candidates WHERE rec_id % 7 <> 3 AND cand_no % 13 <> 0 AND cand_no % 5 <> 0"""),
    "src_reviews": views.with_views("reviews", body=" SELECT rec_id, CAST(event_no AS VARCHAR) AS event_id, hook, contrast, persona, standalone, CASE WHEN event_no % 4 <> 0 THEN completeness ELSE 5 END AS completeness, reject_kind FROM reviews"),
    "src_provider_a": views.with_views("segments", "sentences", body=""" SELECT rec_id, start / 1000 AS start, "end" / 1000 AS "end", CASE line_no % 3 WHEN 0 THEN 'spk_' || (line_no % 4) ELSE spk END AS speaker FROM sentences WHERE line_no % 3 <> 2"""),
    "jn_context": views.with_views("segments", "candidates", body=_CTX.replace("AROUND", "30") + """, run AS (SELECT *, sum(length(line)) OVER (PARTITION BY rec_id, event_no ORDER BY line_no) AS s FROM near)
SELECT rec_id, event_no, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM run WHERE s <= 3000 GROUP BY ALL"""),
    "jn_review_context": views.with_views("segments", "candidates", body=_CTX.replace("AROUND", "60") + """, run AS (SELECT *, sum(n + 12) OVER (PARTITION BY rec_id, event_no) AS w, sum(length(line)) OVER (PARTITION BY rec_id, event_no ORDER BY abs((start + e) / 2 - (a + b) / 2), start, line_no ROWS UNBOUNDED PRECEDING) AS s FROM near)
SELECT rec_id, event_no, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY start, line_no)) AS text_md5 FROM run WHERE w <= 4000 OR s <= 4000 GROUP BY ALL"""),
    "flt_cut_chars": _seg(""", r AS (SELECT *, sum(length(text)) OVER (PARTITION BY rec_id ORDER BY line_no) AS s FROM segments) SELECT rec_id, count(*) FILTER (s <= 6000) AS lines, count(*) FILTER (s <= 6000) < count(*) AS truncated FROM r GROUP BY 1"""),
    "wn_line_groups": _seg(""", g AS (SELECT *, (row_number() OVER (PARTITION BY rec_id ORDER BY line_no) - 1) // 50 AS group_no FROM segments), p AS (SELECT *, sum(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, group_no ORDER BY line_no) AS pl FROM g)
SELECT rec_id, group_no, min(start) AS start, max("end") AS "end", md5(substr(coalesce(string_agg(trim(text), ' ' ORDER BY line_no) FILTER (trim(text) <> '' AND pl <= 30), ''), 1, 500)) AS text FROM p GROUP BY ALL"""),
    "jn_rescan_anti": _cand(""", f AS (SELECT rec_id, cand_no, start + cand_no % 2 AS start, "end" + cand_no % 2 AS e FROM candidates WHERE cand_no % 3 = 0), k AS (SELECT rec_id, start, "end" AS e FROM candidates WHERE cand_no % 3 <> 0)
SELECT rec_id, cand_no FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.rec_id = f.rec_id AND ((k.start = f.start AND k.e = f.e) OR (least(k.e, f.e) > greatest(k.start, f.start) AND (least(k.e, f.e) - greatest(k.start, f.start)) / least(k.e - k.start, f.e - f.start) > 0.5)))"""),
    "ag_run_summary": _cand(_EVENTS + _summary("events_", "s") + " SELECT * FROM s"),
    "set_run_delta": _cand(_EVENTS + _summary("events_", "s") + _summary("later", "t") + "".join(f""", {n} AS (SELECT rec_id, {", ".join(f"count(*) FILTER (g = '{x}') AS {x}" for x in "SABCD")} FROM (SELECT rec_id, CASE WHEN p >= 90 THEN 'S' WHEN p >= 80 THEN 'A' WHEN p >= 60 THEN 'B' WHEN p >= 50 THEN 'C' ELSE 'D' END AS g FROM (SELECT rec_id, score * 10 - {m} AS p FROM {src})) GROUP BY 1)""" for n, src, m in (("sg", "events_", "0"), ("tg", "later", "event_no % 3 * 5")))
    + """, cost AS (SELECT user_id % 20 AS rec_id, event_id % 2 AS run, round((sum(CAST(floor(value * 100) AS BIGINT)) * 2.0::DOUBLE + sum(CAST(floor(value * 10) AS BIGINT)) * 8.0::DOUBLE) / 1000000, 4) AS cost FROM events GROUP BY ALL) SELECT s.rec_id, """
    + ", ".join(f"t.{c} - s.{c} AS d_{c}" for c in _COLS) + ", " + ", ".join(f"tg.{x} - sg.{x} AS d_grade_{x}" for x in "SABCD") + """, round(coalesce(c1.cost, 0) - coalesce(c0.cost, 0), 4) AS d_cost
FROM s JOIN t USING (rec_id) JOIN sg USING (rec_id) JOIN tg USING (rec_id) LEFT JOIN cost c0 ON c0.rec_id = s.rec_id AND c0.run = 0 LEFT JOIN cost c1 ON c1.rec_id = s.rec_id AND c1.run = 1"""),
    "set_title_clash": _cand(" SELECT title, count(DISTINCT rec_id) AS recordings FROM candidates GROUP BY 1 HAVING count(DISTINCT rec_id) > 1"),
    "set_event_subset": _cand(" SELECT rec_id, cand_no + 1000 AS event_no FROM candidates WHERE cand_no % 9 = 0"),
    "set_all_events": _cand(" SELECT rec_id, count(*) AS n, count(*) FILTER (score >= 6) AS recommended, count(*) FILTER (score < 6) AS rejected FROM candidates GROUP BY 1"),
    "sel_top_events": _cand(" SELECT rec_id, place, cand_no AS event_no, score FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, cand_no) AS place FROM candidates) WHERE place <= 5"),
}
