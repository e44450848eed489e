"""Queries of clustering, grading, selection and structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import grade
from ..operators import cluster, grading, lists, structure
from . import views
from .q_scan import _CLEAN, _FINAL, _G, _PAIRS_OF


def _links(spark, d):
    return cluster.links(views.candidates(spark, d))


def cl_links(spark, d):
    return _links(spark, d)


def cl_links_story(spark, d):
    return cluster.links(structure.candidate_story(views.candidates(spark, d), views.stories(spark, d)))


def cl_components(spark, d):
    c = views.candidates(spark, d)
    return cluster.components(c, _links(spark, d).filter("score >= 0.66"))


def ag_cluster_span(spark, d):
    c = views.candidates(spark, d)
    made = cluster.spans(c, cl_components(spark, d))
    return made.select("rec_id", "cluster_no", "start", "end", "n", F.concat_ws(",", F.col("members").cast("array<string>")).alias("members"))


def ag_cluster_stats(spark, d):
    c = views.candidates(spark, d)
    return cluster.cluster_stats(cluster.spans(c, cl_components(spark, d)))


def wn_adjacent(spark, d):
    return cluster.ranked(views.candidates(spark, d)).select("rec_id", "cand_no", "place")


def _events(spark, d):
    c = views.candidates(spark, d)
    return c.select("rec_id", F.col("cand_no").alias("event_no"), "start", "end", "title", "score")


def _graded(spark, d):
    return grading.with_reject_reason(grading.cap_flagged(grading.with_reviews(_events(spark, d), views.reviews(spark, d))))


def jn_review(spark, d):
    return grading.with_reviews(_events(spark, d), views.reviews(spark, d)).select("rec_id", "event_no", "reviewed", "final_score", "grade", "hook", "completeness")


def sel_final_grade(spark, d):
    return _graded(spark, d).select("rec_id", "event_no", "final_score", "grade", "d_guarded")


def sel_reject_reason(spark, d):
    return _graded(spark, d).select("rec_id", "event_no", "reject_reason")


def _weak(spark, d):
    """The events of some recordings, scored so that none reaches the C line."""
    low = F.when(F.col("rec_id") % 2 == 0, F.least(F.col("final_score"), 30 + F.col("rec_id") + F.col("event_no") % 3)).otherwise(F.col("final_score"))
    rows = _graded(spark, d).withColumn("final_score", low)
    return rows.withColumn("grade", grade(F.col("final_score")))


def sel_forced_keep(spark, d):
    return grading.keep_one(_weak(spark, d)).select("rec_id", "event_no", "final_score", "grade", "forced_keep")


def sel_global_rank(spark, d):
    return grading.ranked(_graded(spark, d)).select("rec_id", "event_no", "place")


def sel_recommend(spark, d):
    """Recordings of three kinds: as they are, without S and A, without S, A and B."""
    kind = F.col("rec_id") % 3
    g = F.when((kind >= 1) & F.col("grade").isin("S", "A"), "B").otherwise(F.col("grade"))
    g = F.when((kind == 2) & g.isin("B"), "C").otherwise(g)
    rows = _graded(spark, d).withColumn("grade", g)
    return grading.recommend(rows).select("rec_id", "event_no", "recommended", "recommend_tier")


def _quantity(mode):
    def run(spark, d):
        rows = grading.select(grading.keep_one(_graded(spark, d)), mode, 10)
        return rows.select("rec_id", "event_no", "picked", "recommended", "recommend_tier", "quality", "reject_reason")

    return run


def sel_recommend_span(spark, d):
    c = views.candidates(spark, d)
    n = F.col("cand_no")
    rows = c.select(
        "rec_id", "cand_no", "start", "end", F.when(n % 5 != 0, F.col("start") + n % 40 - F.when(n % 7 == 0, 300).otherwise(0)).alias("r_start"),
        F.when(n % 6 != 0, F.col("end") - n % 90).alias("r_end"), F.when(n % 3 == 0, n % 50).alias("r_duration"), F.lit(3100).alias("total"),
    )
    return grading.recommended_span(rows).select("rec_id", "cand_no", "rec_start", "rec_end", "rec_duration", "drifted")


def sel_display_order(spark, d):
    return grading.display_order(_graded(spark, d)).select("rec_id", "event_no", "display_no")


def wn_batches(spark, d):
    return lists.batches(_events(spark, d).select("rec_id", "event_no"), 3)


def ag_grade_dist(spark, d):
    return lists.grade_distribution(_graded(spark, d))


def jn_candidate_story(spark, d):
    return structure.candidate_story(views.candidates(spark, d), views.stories(spark, d)).select("rec_id", "cand_no", "story_id")


def jn_event_story(spark, d):
    return structure.event_stories(_events(spark, d), views.stories(spark, d)).select("rec_id", "event_no", "story_id")


def jn_event_chapter(spark, d):
    return structure.event_chapter(_events(spark, d), views.chapters(spark, d)).select("rec_id", "event_no", "chapter_id")


def _stories(spark, d):
    return structure.story_scores(_graded(spark, d), views.stories(spark, d))


def ag_story_score(spark, d):
    return _stories(spark, d)


def ag_chapter_score(spark, d):
    return structure.chapter_scores(views.chapters(spark, d), _stories(spark, d))


def ag_structure_stats(spark, d):
    return structure.structure_stats(views.chapters(spark, d), _stories(spark, d))


def ag_orphan_chapters(spark, d):
    return structure.chapters_with_orphans(views.chapters(spark, d).filter("chapter_id <> 'c1'"), views.stories(spark, d))


def ag_default_stories(spark, d):
    made = structure.default_stories(views.chapters(spark, d), views.stories(spark, d).filter("chapter_id not in ('c0', 'c2')"), _events(spark, d))
    return made.withColumn("event_nos", F.concat_ws(",", F.col("event_nos").cast("array<string>")))


def ag_coverage_rate(spark, d):
    c = views.candidates(spark, d)
    events = c.groupBy("rec_id", F.floor(F.col("start") / 90).alias("event_no")).agg(F.collect_set("cand_no").alias("source_candidates"))
    return structure.coverage_rate(structure.candidate_story(c, views.stories(spark, d)), events)


def wn_gap_stories(spark, d):
    return structure.gap_stories(views.candidates(spark, d), views.chapters(spark, d), 20.0)


def wn_fixed_chapters(spark, d):
    return structure.fixed_chapters(views.candidates(spark, d), 60, views.segments(spark, d), _THEMES)


_THEMES = {"a": ("thsh", "ouwh", " un"), "b": ("eaux", "pfe"), "c": ("schie", "aiai", "onts")}

QUERIES = {f.__name__: f for f in (
    cl_links, cl_links_story, cl_components, ag_cluster_span, ag_cluster_stats, wn_adjacent, jn_review, sel_final_grade, sel_reject_reason, sel_forced_keep,
    sel_global_rank, sel_recommend, sel_recommend_span, sel_display_order, wn_batches, ag_grade_dist, jn_candidate_story, jn_event_story,
    jn_event_chapter, ag_story_score, ag_chapter_score, ag_structure_stats, ag_orphan_chapters, ag_default_stories, ag_coverage_rate, wn_gap_stories, wn_fixed_chapters,
)} | {f"sel_quantity_{m}": _quantity(m) for m in ("auto", "pool", "top")}

_TOPIC = "concat_ws(' ', nullif(title, ''), nullif(reason, ''))"
_TOLD = """, told AS (SELECT c.*, coalesce((SELECT min_by(story_id, s.start) FROM stories s WHERE s.rec_id = c.rec_id AND s.start < c."end" AND s."end" > c.start), '__unknown__') AS story_id FROM candidates c)"""
_LINKS = """, placed AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start, cand_no) AS place, TOPIC AS tx FROM SOURCE),
clean AS (SELECT *, CLEAN AS x FROM placed), grams AS (SELECT *, PAIRS AS p FROM clean),
both_ AS (SELECT a.rec_id, a.cand_no AS a, b.cand_no AS b, greatest(0, b.start - a."end", a.start - b."end") AS gap, a.start AS s1, a."end" AS e1, b.start AS s2, b."end" AS e2, a.p, b.p AS q,
  abs(a.place - b.place) = 1 AS adjacent, a.story_id AS x1, b.story_id AS x2 FROM grams a JOIN grams b ON a.rec_id = b.rec_id AND a.cand_no < b.cand_no),
parts AS (SELECT *, greatest(0.0::DOUBLE, 1 - gap / 300.0::DOUBLE) AS t, CASE WHEN least(e1, e2) - greatest(s1, s2) > 0 THEN least(1.0::DOUBLE, (least(e1, e2) - greatest(s1, s2)) / least(e1 - s1, e2 - s2)) ELSE 0 END AS o,
  CASE WHEN least(len(p), len(q)) > 0 THEN len(list_intersect(p, q)) / least(len(p), len(q)) ELSE 0.0::DOUBLE END AS k FROM both_),
scored AS (SELECT *, 0.30::DOUBLE * t + 0.25::DOUBLE * o + 0.30::DOUBLE * k + CASE WHEN adjacent THEN 0.15::DOUBLE ELSE 0 END + STORY AS score FROM parts),
links AS (SELECT rec_id, a, b, floor(score * 1000 + 0.500000001::DOUBLE) / 1000 AS score, floor(t * 1000 + 0.500000001::DOUBLE) / 1000 AS time, floor(o * 1000 + 0.500000001::DOUBLE) / 1000 AS overlap, floor(k * 1000 + 0.500000001::DOUBLE) / 1000 AS topic, adjacent, SAME AS same_story FROM scored WHERE round(score, 9) >= 0.42)"""
_LINKS = _LINKS.replace("TOPIC", _TOPIC).replace("CLEAN", _CLEAN("tx")).replace("PAIRS", _PAIRS_OF("x"))
_PLAIN = _LINKS.replace("SOURCE", "(SELECT *, NULL AS story_id FROM candidates)").replace("STORY", "0").replace("SAME", "FALSE")
_WITH = _LINKS.replace("SOURCE", "told").replace("STORY", "CASE WHEN x1 = '__unknown__' OR x2 = '__unknown__' THEN 0 WHEN x1 = x2 THEN 0.25::DOUBLE ELSE -0.15::DOUBLE END").replace("SAME", "(x1 = x2 AND x1 <> '__unknown__')")
_COMPONENTS = _PLAIN + """, strong AS (SELECT rec_id, a, b FROM links WHERE score >= 0.66 UNION SELECT rec_id, b, a FROM links WHERE score >= 0.66),
reach(rec_id, cand_no, label) AS (SELECT rec_id, cand_no, cand_no FROM candidates UNION SELECT r.rec_id, s.b, r.label FROM reach r JOIN strong s ON r.rec_id = s.rec_id AND r.cand_no = s.a),
labels AS (SELECT rec_id, cand_no, min(label) AS label FROM reach GROUP BY ALL),
clusters AS (SELECT rec_id, cand_no, dense_rank() OVER (PARTITION BY rec_id ORDER BY label) AS cluster_no FROM labels),
spans AS (SELECT rec_id, cluster_no, min(start) AS start, max("end") AS "end", count(*) AS n, string_agg(CAST(cand_no AS VARCHAR), ',' ORDER BY cand_no) AS members FROM candidates JOIN clusters USING (rec_id, cand_no) GROUP BY ALL)"""
_GRADE = lambda c: _G.format("'D'").replace("s ", f"{c} ")
_REVIEWED = f""", events_ AS (SELECT rec_id, cand_no AS event_no, start, "end", score FROM candidates),
joined AS (SELECT e.*, r.rec_id IS NOT NULL AS reviewed, CASE WHEN r.rec_id IS NOT NULL THEN {_FINAL} ELSE CAST(score * 10 AS DOUBLE) END AS final_score,
  coalesce(hook, score) AS hook, coalesce(completeness, score) AS completeness, coalesce(flagged, FALSE) AS flagged, coalesce(reject_kind, '') AS reject_kind
  FROM events_ e LEFT JOIN reviews r USING (rec_id, event_no)),
first_ AS (SELECT *, {_GRADE('final_score')} AS plain FROM joined),
reviewed_ AS (SELECT *, CASE WHEN plain = 'D' AND reject_kind NOT IN ('', 'truly_low_value') THEN 'C' ELSE plain END AS grade FROM first_)"""
_GRADED = _REVIEWED + """, graded AS (SELECT * REPLACE (CASE WHEN flagged AND grade IN ('S', 'A') THEN 'B' ELSE grade END AS grade),
  reject_kind NOT IN ('', 'truly_low_value') AND grade = 'C' AS d_guarded FROM reviewed_),
reasons AS (SELECT *, CASE WHEN grade = 'D' THEN CASE WHEN flagged THEN '命中「不值得剪」规则' ELSE '五维加权未达质量线' END END AS reject_reason FROM graded)"""
_KEPT = """, kept AS (SELECT * EXCLUDE (f) REPLACE (CASE WHEN f THEN 'C' ELSE grade END AS grade, CASE WHEN NOT f THEN reject_reason END AS reject_reason), f AS forced_keep FROM (
  SELECT *, max(final_score) OVER w < 50 AND max(final_score) OVER w >= 40 AND row_number() OVER (PARTITION BY rec_id ORDER BY final_score DESC, event_no) = 1 AS f FROM FROM_ WINDOW w AS (PARTITION BY rec_id)))"""
_RECOMMEND = """, kinds AS (SELECT *, CASE WHEN grade IN ('S', 'A') THEN 0 WHEN grade = 'B' AND final_score >= 60 THEN 1 WHEN grade = 'C' THEN 2 ELSE 3 END AS kind FROM FROM_),
nums AS (SELECT *, row_number() OVER (PARTITION BY rec_id, kind ORDER BY final_score DESC, event_no) AS pl, count(*) FILTER (kind = 0) OVER (PARTITION BY rec_id) AS n0, count(*) FILTER (kind = 1) OVER (PARTITION BY rec_id) AS n1 FROM kinds),
picks AS (SELECT *, CASE kind WHEN 0 THEN pl <= 8 WHEN 1 THEN pl <= 8 - least(n0, 8) WHEN 2 THEN n0 + n1 = 0 AND pl <= 3 ELSE FALSE END AS recommended FROM nums)"""
_TIER = "CASE grade WHEN 'S' THEN 'S' WHEN 'A' THEN 'A' WHEN 'B' THEN 'B_fill' WHEN 'C' THEN 'C_fallback' ELSE '' END"
_STORY = _GRADED + """, hits AS (SELECT s.rec_id, s.chapter_id, s.story_id, e.event_no, e.final_score FROM stories s JOIN graded e ON s.rec_id = e.rec_id AND s.start < e."end" AND s."end" > e.start),
best AS (SELECT rec_id, chapter_id, story_id, max(final_score) AS score, count(*) AS event_count FROM hits GROUP BY ALL),
scored_ AS (SELECT s.rec_id, s.chapter_id, s.story_id, s.start, s."end", b.score, """ + _G.format("''").replace("s ", "b.score ") + """ AS grade,
  (SELECT min(event_no) FROM hits h WHERE h.rec_id = s.rec_id AND h.story_id = s.story_id AND h.final_score = b.score) AS best_event, coalesce(event_count, 0) AS event_count
  FROM stories s LEFT JOIN best b USING (rec_id, chapter_id, story_id))"""
_cand = lambda body: views.with_views("candidates", body=body)
_rev = lambda body: views.with_views("candidates", "reviews", body=body)
_str = lambda body: views.with_views("candidates", "reviews", "stories", "chapters", body=body)


def _sql_quantity(mode):
    picked = {"auto": "recommended", "pool": "grade IN ('S', 'A', 'B', 'C')", "top": "pos <= 10"}[mode]
    rec = "picked" if mode == "top" else "recommended"
    quality = "CASE WHEN picked THEN CASE grade WHEN 'S' THEN '爆款候选' WHEN 'A' THEN '强推荐' WHEN 'B' THEN '测试素材' ELSE '备用素材' END END" if mode == "top" else "NULL::VARCHAR"
    return _rev(_GRADED + _KEPT.replace("FROM_", "reasons") + _RECOMMEND.replace("FROM_", "kept") + f""",
chosen AS (SELECT *, {picked} AS picked, count(*) FILTER (recommended) OVER (PARTITION BY rec_id) AS n_rec FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY final_score DESC, event_no) AS pos FROM picks))
SELECT rec_id, event_no, picked, {rec} AS recommended, CASE WHEN {rec} THEN {_TIER} ELSE '' END AS recommend_tier, {quality} AS quality,
  CASE WHEN picked THEN NULL WHEN grade = 'D' AND reject_reason IS NOT NULL THEN reject_reason WHEN forced_keep THEN '召回优先保留的候选，未进入本模式展示范围'
    WHEN grade IN ('S', 'A') AND n_rec >= 8 THEN '内容质量很高，但推荐数量已达目标' ELSE '未进入本模式的展示范围' END AS reject_reason FROM chosen""")


ORACLE = {
    "cl_links": _cand(_PLAIN + " SELECT * FROM links"),
    "cl_links_story": views.with_views("candidates", "stories", body=_TOLD + _WITH + " SELECT * FROM links"),
    "cl_components": _cand(_COMPONENTS + " SELECT * FROM clusters"),
    "ag_cluster_span": _cand(_COMPONENTS + " SELECT * FROM spans"),
    "ag_cluster_stats": _cand(_COMPONENTS + " SELECT rec_id, count(*) AS clusters, count(*) FILTER (n > 1) AS multi, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS in_multi FROM spans GROUP BY 1"),
    "wn_adjacent": _cand(" SELECT rec_id, cand_no, row_number() OVER (PARTITION BY rec_id ORDER BY start, cand_no) AS place FROM candidates"),
    "jn_review": _rev(_REVIEWED + " SELECT rec_id, event_no, reviewed, final_score, grade, hook, completeness FROM reviewed_"),
    "sel_final_grade": _rev(_GRADED + " SELECT rec_id, event_no, final_score, grade, d_guarded FROM graded"),
    "sel_reject_reason": _rev(_GRADED + " SELECT rec_id, event_no, reject_reason FROM reasons"),
    "sel_forced_keep": _rev(_GRADED + """, low AS (SELECT * REPLACE (CASE WHEN rec_id % 2 = 0 THEN least(final_score, 30 + rec_id + event_no % 3) ELSE final_score END AS final_score) FROM reasons),
weak AS (SELECT * REPLACE (""" + _GRADE("final_score") + " AS grade) FROM low)" + _KEPT.replace("FROM_", "weak") + " SELECT rec_id, event_no, final_score, grade, forced_keep FROM kept"),
    "sel_global_rank": _rev(_GRADED + " SELECT rec_id, event_no, row_number() OVER (PARTITION BY rec_id ORDER BY final_score DESC, event_no) AS place FROM graded"),
    "sel_recommend": _rev(_GRADED + """, a1 AS (SELECT * REPLACE (CASE WHEN rec_id % 3 >= 1 AND grade IN ('S', 'A') THEN 'B' ELSE grade END AS grade) FROM graded),
a2 AS (SELECT * REPLACE (CASE WHEN rec_id % 3 = 2 AND grade = 'B' THEN 'C' ELSE grade END AS grade) FROM a1)""" + _RECOMMEND.replace("FROM_", "a2") + f" SELECT rec_id, event_no, recommended, CASE WHEN recommended THEN {_TIER} ELSE '' END AS recommend_tier FROM picks"),
    "sel_recommend_span": _cand(""", raw AS (SELECT *, CASE WHEN cand_no % 5 <> 0 THEN start + cand_no % 40 - CASE WHEN cand_no % 7 = 0 THEN 300 ELSE 0 END END AS r_start, CASE WHEN cand_no % 6 <> 0 THEN "end" - cand_no % 90 END AS r_end, CASE WHEN cand_no % 3 = 0 THEN cand_no % 50 END AS r_dur FROM candidates),
b AS (SELECT *, least(greatest(coalesce(r_start, start), 0), 3100) AS x, least(greatest(coalesce(r_end, "end"), 0), 3100) AS y FROM raw),
s AS (SELECT *, least(x, y) AS f, greatest(x, y) AS l FROM b), t AS (SELECT *, greatest(abs(f - start), abs(l - "end")) > 120 AS drifted FROM s)
SELECT rec_id, cand_no, CAST(CASE WHEN drifted THEN start ELSE f END AS DOUBLE) AS rec_start, CAST(CASE WHEN drifted THEN "end" ELSE l END AS DOUBLE) AS rec_end, greatest(0, coalesce(r_dur, l - f)) AS rec_duration, drifted FROM t"""),
    "sel_display_order": _rev(_GRADED + " SELECT rec_id, event_no, row_number() OVER (PARTITION BY rec_id ORDER BY list_position(['S','A','B','C','D'], grade), final_score DESC, event_no) AS display_no FROM graded"),
    "wn_batches": _cand(" SELECT rec_id, cand_no AS event_no, (row_number() OVER (PARTITION BY rec_id ORDER BY cand_no) - 1) // 3 AS batch_no FROM candidates"),
    "ag_grade_dist": _rev(_GRADED + " SELECT rec_id, " + ", ".join(f"count(*) FILTER (grade = '{g}') AS n_{g}" for g in "SABCD") + " FROM graded GROUP BY 1"),
    "jn_candidate_story": views.with_views("candidates", "stories", body=_TOLD + " SELECT rec_id, cand_no, story_id FROM told"),
    "jn_event_story": views.with_views("candidates", "stories", body=""" SELECT c.rec_id, c.cand_no AS event_no, story_id FROM candidates c JOIN stories s ON s.rec_id = c.rec_id AND s.start < c."end" AND s."end" > c.start"""),
    "jn_event_chapter": views.with_views("candidates", "chapters", body=""" SELECT c.rec_id, c.cand_no AS event_no, chapter_id FROM candidates c JOIN chapters h ON h.rec_id = c.rec_id AND c.start >= h.start AND c.start < h."end" """),
    "ag_story_score": _str(_STORY + " SELECT * FROM scored_"),
    "ag_chapter_score": _str(_STORY + """, g AS (SELECT rec_id, chapter_id, max(score) AS score, count(*) AS story_count, CAST(sum(event_count) AS BIGINT) AS event_count FROM scored_ GROUP BY ALL)
SELECT c.rec_id, c.chapter_id, c.start, c."end", g.score, """ + _G.format("''").replace("s ", "g.score ") + " AS grade, coalesce(story_count, 0) AS story_count, coalesce(event_count, 0) AS event_count FROM chapters c LEFT JOIN g USING (rec_id, chapter_id)"),
    "ag_structure_stats": _str(_STORY + """, c AS (SELECT rec_id, count(*) AS chapter_count FROM chapters GROUP BY 1), firsts AS (SELECT rec_id, story_id, row_number() OVER (PARTITION BY rec_id ORDER BY coalesce(score, 0) DESC, start, story_id) AS pl FROM scored_ WHERE event_count > 0),
s AS (SELECT rec_id, count(*) AS story_count, count(*) FILTER (event_count > 0) AS with_events, count(*) FILTER (event_count = 0) AS without_events FROM scored_ GROUP BY 1)
SELECT c.rec_id, chapter_count, story_count, with_events, without_events, f.story_id AS best_story FROM c LEFT JOIN s USING (rec_id) LEFT JOIN firsts f ON f.rec_id = c.rec_id AND f.pl = 1"""),
    "ag_orphan_chapters": _str(""" SELECT * FROM chapters WHERE chapter_id <> 'c1' UNION ALL SELECT rec_id, chapter_id, min(start), max("end") FROM stories WHERE chapter_id NOT IN ('c0', 'c2', 'c3') GROUP BY 1, 2"""),
    "ag_default_stories": _str(""" SELECT h.rec_id, h.chapter_id, h.chapter_id || '-story-1' AS story_id, h.start, h."end", string_agg(CAST(c.cand_no AS VARCHAR), ',' ORDER BY c.cand_no) AS event_nos
FROM chapters h JOIN candidates c ON h.rec_id = c.rec_id AND c.start >= h.start AND c.start < h."end" WHERE h.chapter_id IN ('c0', 'c2') GROUP BY ALL"""),
    "ag_coverage_rate": views.with_views("candidates", "stories", body=_TOLD + """, e AS (SELECT rec_id, start // 90 AS e, count(DISTINCT CASE WHEN story_id <> '__unknown__' THEN story_id END) AS n FROM told GROUP BY ALL)
SELECT rec_id, round(avg(CASE WHEN story_id <> '__unknown__' THEN 1.0::DOUBLE ELSE 0 END), 6) AS known_share, (SELECT round(count(*) FILTER (n > 1) / count(*), 6) FROM e WHERE e.rec_id = told.rec_id) AS across_share FROM told GROUP BY 1"""),
    "wn_gap_stories": views.with_views("candidates", "chapters", body=""", i AS (SELECT c.*, chapter_id FROM candidates c JOIN chapters h ON h.rec_id = c.rec_id AND c.start >= h.start AND c.start < h."end"),
m AS (SELECT *, CASE WHEN start - lag("end") OVER w > 20 THEN 1 ELSE 0 END AS b FROM i WINDOW w AS (PARTITION BY rec_id, chapter_id ORDER BY start, cand_no)),
r AS (SELECT *, 1 + CAST(sum(b) OVER (PARTITION BY rec_id, chapter_id ORDER BY start, cand_no) AS BIGINT) AS story_no FROM m)
SELECT rec_id, chapter_id, story_no, min(start) AS start, max("end") AS "end", count(*) AS n FROM r GROUP BY ALL"""),
    "wn_fixed_chapters": views.with_views("candidates", "segments", body=""", c AS (SELECT *, start // 60 AS w FROM candidates), h AS (SELECT rec_id, w, count(*) AS n FROM c GROUP BY ALL), d AS (SELECT rec_id, max("end") AS last FROM c GROUP BY 1),
wd AS (SELECT * FROM (VALUES """ + ", ".join(f"({k}, '{t}', '{x}')" for k, (t, own) in enumerate(_THEMES.items()) for x in own) + """) v(place, theme, word)),
m AS (SELECT DISTINCT c.rec_id, c.w, place, theme, word FROM c, wd WHERE contains(' ' || title, word) UNION SELECT DISTINCT c.rec_id, c.w, place, theme, word FROM c JOIN segments s ON s.rec_id = c.rec_id AND s.start BETWEEN c.start - 30 AND c."end" + 30 JOIN wd ON contains(' ' || s.text, word)),
t AS (SELECT rec_id, w, theme, row_number() OVER (PARTITION BY rec_id, w ORDER BY count(*) DESC, place) AS pl FROM m GROUP BY rec_id, w, place, theme)
SELECT h.rec_id, dense_rank() OVER (PARTITION BY h.rec_id ORDER BY h.w) AS chapter_no, h.w * 60 AS start, least((h.w + 1) * 60, last) AS "end", n, coalesce(theme, '直播互动') AS theme FROM h JOIN d USING (rec_id) LEFT JOIN t ON t.rec_id = h.rec_id AND t.w = h.w AND pl = 1"""),
} | {f"sel_quantity_{m}": _sql_quantity(m) for m in ("auto", "pool", "top")}
