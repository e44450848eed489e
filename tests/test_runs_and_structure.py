"""Alignment of runs, themes of chapters, lineage of events and differences of runs."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from talkmine.operators import events, runs, structure


def changed(text, rnd, share):
    out = []
    for x in text:
        kind = rnd.random()
        if kind < share / 3:
            continue
        out.append(rnd.choice("abcdefg") if kind < 2 * share / 3 else x)
        if kind > 1 - share / 3:
            out.append(rnd.choice("xyz"))
    return "".join(out)


def test_alignment_is_near_the_full_one():
    rnd = random.Random(2)
    base = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000))
    cases = [(base, changed(base, rnd, s)) for s in (0, 0.01, 0.05, 0.2)]
    cases += [(base, base[:2000] + base[2600:]), (base, base[3000:] + base[:3000]), ("", base), ("ab", "b"), (base, base[::-1]), (base[:900], base[100:1000])]
    for a, b in cases:
        full = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        if min(len(a), len(b)) and full / max(len(a), len(b)) > 0.5:
            assert abs(2 * runs.matching(a, b) / (len(a) + len(b)) - 2 * full / (len(a) + len(b))) < 0.01
        assert runs.matching(a, b) <= min(len(a), len(b))


def test_alignment_takes_time_near_the_length():
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    began = time.perf_counter()
    assert runs.matching(long, changed(long, rnd, 0.03)) > 0.95 * len(long)
    assert runs.matching("ab" * 100_000, "ba" * 100_000) > 0
    assert time.perf_counter() - began < 60


CANDIDATE = "rec_id long, cand_no long, start long, end long, title string"


def test_themes_of_chapters(spark):
    c = spark.createDataFrame([(1, 0, 10, 20, "x"), (1, 1, 100, 140, "午餐肉"), (1, 2, 950, 1000, "x"), (2, 0, 0, 5, "粉丝"), (2, 1, 3000, 3050, None)], CANDIDATE)
    s = spark.createDataFrame([(1, 50.0, "美军口粮"), (1, 169.0, "俄军"), (1, 171.0, "乌军 乌克兰 乌军口粮"), (1, 930.0, "dinner"), (1, 1031.0, "咖啡 美式"), (2, 35.0, None), (2, 30.0, "关注抽奖")], "rec_id long, start double, text string")
    made = {(r["rec_id"], r["chapter_no"]): (r["start"], r["end"], r["n"], r["theme"]) for r in structure.fixed_chapters(c, segments=s).collect()}
    # 美军口粮 holds two listed words; rec 1's second chapter has one line within 30 s
    assert made == {(1, 1): (0, 900, 2, "美军口粮"), (1, 2): (900, 1000, 1, "晚餐/微波炉"), (2, 1): (0, 900, 2 - 1, "互动/抽奖"), (2, 2): (2700, 3050, 1, "直播互动")}
    assert structure.fixed_chapters(c.limit(0), segments=s).collect() == []


def test_lineage_from_candidates_to_merged_events(spark):
    c = spark.createDataFrame([(1, k, a, b, f"same matter {k // 3}") for k, (a, b) in enumerate([(0, 50), (10, 60), (20, 70), (300, 350), (310, 360), (900, 950)])], CANDIDATE)
    stories = spark.createDataFrame([(1, "s0", "c", 0, 15), (1, "s1", "c", 15, 400)], "rec_id long, story_id string, chapter_id string, start long, end long")
    e = c.select("rec_id", F.col("cand_no").alias("event_no"), "start", "end", "title", F.lit("").alias("summary"), F.lit(5).alias("score"), F.array("cand_no").alias("source_candidates"))
    merged = events.dedupe(e)
    assert {(r["event_no"], tuple(r["source_candidates"])) for r in merged.collect()} == {(0, (0, 1, 2)), (3, (3, 4)), (5, (5,))}
    assert sorted(map(tuple, structure.lineage(merged).collect())) == [(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 3, 3), (1, 3, 4), (1, 5, 5)]
    (row,) = structure.coverage_rate(structure.candidate_story(c, stories), merged).collect()
    assert row["known_share"] == pytest.approx(5 / 6, abs=1e-6) and row["across_share"] == pytest.approx(1 / 3, abs=1e-6)


def test_run_delta_of_grades_and_cost(spark):
    schema = "rec_id long, event_no long, start long, end long, score long, source_count int, grade string"
    a = spark.createDataFrame([(1, 0, 0, 10, 5, 1, "A"), (1, 1, 0, 70, 5, 2, "D")], schema)
    b = spark.createDataFrame([(1, 0, 0, 10, 5, 1, "S"), (1, 1, 0, 70, 5, 2, "A"), (1, 2, 5, 20, 1, 1, "A")], schema)
    costs = (spark.createDataFrame([(1, 0.3)], "rec_id long, cost double"), spark.createDataFrame([(1, 0.45)], "rec_id long, cost double"))
    (row,) = events.run_delta(a, b, costs=costs).collect()
    assert [row[f"d_grade_{g}"] for g in "SABCD"] == [1, 1, 0, 0, -1] and row["d_cost"] == 0.15 and row["d_total"] == 1
