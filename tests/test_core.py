"""Small cases of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from talkmine.config import Scan, Words
from talkmine.functions import clock, scores, text
from talkmine.operators import audio, chunks, cluster, correction, events, feedback, grading, ranges, scan, speakers
from talkmine.sources import files, replies


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [("01:23", 83), ("75:30", 4530), ("1:00:12", 3612), ("ab:1", None), ("5", None), ("", None)])
def test_clock(spark, given, want):
    assert one(spark, clock.to_seconds(F.col("c")), c=given) == want


def test_clock_back(spark):
    assert one(spark, clock.chunk_clock(F.lit(3612))) == "01:00:12"
    assert one(spark, clock.line_clock(F.lit(4530))) == "75:30"
    assert one(spark, clock.progress_clock(F.lit(3612))) == "1:00:12"


def test_words_within_words_count_twice(spark):
    assert one(spark, text.total_occurrences(F.lit("吃瓜吃瓜"), ["吃瓜", "瓜"])) == 4
    assert one(spark, text.occurrences(F.lit("aaaa"), "aa")) == 2


def test_longest_wrong_first(spark):
    assert one(spark, text.fix_words(F.lit("伏特加酒和伏特加"), [("伏特加", "A"), ("伏特加酒", "B")])) == "B和A"
    assert one(spark, text.fix_line(F.lit("[福岛] 福岛"), [("福岛", "x")])) == "[福岛] x"


def test_instant_overlap_is_none(spark):
    assert one(spark, scores.overlap(F.lit(5), F.lit(5), F.lit(0), F.lit(10))) == 0.0
    assert one(spark, scores.overlap(F.lit(0), F.lit(10), F.lit(5), F.lit(20))) == 0.5


def segments(spark, rows):
    return spark.createDataFrame([(1, k, a, b, t) for k, (a, b, t) in enumerate(rows)], "rec_id long, line_no long, start long, end long, text string")


def test_minutes(spark):
    s = segments(spark, [(0, 10, "我"), (50, 70, "操"), (60, 60, "瓜"), (200, 210, "x")])
    made = {r["bucket_no"]: r for r in scan.bucket_scores(s, Words(("我操",), ("操",))).collect()}
    assert len(made) == 4
    assert made[0]["strong"] == 1 and made[0]["score"] == 3  # across the seam of two segments
    assert made[1]["score"] == 1 and made[2]["score"] == 0


def pack_one_by_one(hot, cfg):
    """The rule told minute by minute."""
    hot = list(hot)
    k = 0
    while k < len(hot):
        if hot[k]:
            k += 1
            continue
        j = k
        while j < len(hot) and not hot[j]:
            j += 1
        if k > 0 and j < len(hot) and j - k <= cfg.bridge_minutes:
            hot[k:j] = [True] * (j - k)
        k = j
    out = []
    for m, h in enumerate(hot):
        most = cfg.hot_chunk_seconds if h else cfg.normal_chunk_seconds
        if out and out[-1][2] == h and (m + 1) * 60 - out[-1][0] <= most:
            out[-1][1] = (m + 1) * 60
        else:
            out.append([m * 60, (m + 1) * 60, h])
    return out


def test_packing_is_the_greedy_rule(spark):
    rnd, cfg, rows, want = random.Random(3), Scan(), [], {}
    for rec in range(40):
        hot = [rnd.random() < 0.4 for _ in range(rnd.randint(1, 60))]
        rows += [(rec, m, m * 60, m * 60 + 60, 2 * h, bool(h)) for m, h in enumerate(hot)]
        want[rec] = pack_one_by_one(hot, cfg)
        want[rec][-1][1] -= 7
    b = spark.createDataFrame(rows, "rec_id long, bucket_no long, start long, end long, score long, hot boolean")
    s = spark.createDataFrame([(rec, 0, 0, w[-1][1], "t") for rec, w in want.items()], "rec_id long, line_no long, start long, end long, text string")
    made = {}
    for r in chunks.pack(b, s, cfg).orderBy("rec_id", "chunk_no").collect():
        made.setdefault(r["rec_id"], []).append([r["start"], r["end"], r["hot"]])
    assert made == want


def test_range_join(spark):
    rnd = random.Random(5)
    a = [(rnd.randint(0, 2), k, x := rnd.randint(0, 500), x + rnd.randint(0, 200)) for k in range(80)]
    b = [(rnd.randint(0, 2), k, x := rnd.randint(0, 500), x + rnd.randint(0, 200)) for k in range(80)]
    left, right = spark.createDataFrame(a, "r long, i long, s long, e long"), spark.createDataFrame(b, "r long, j long, u long, v long")
    made = sorted((x["i"], x["j"]) for x in ranges.range_join(left, right, ["r"], ("s", "e"), ("u", "v"), 60).collect())
    assert made == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and x[3] > y[2])


def candidates(spark, rows):
    return spark.createDataFrame([(1, k, a, b, t, "") for k, (a, b, t) in enumerate(rows)], "rec_id long, cand_no long, start long, end long, title string, reason string")


def test_clusters(spark):
    c = candidates(spark, [(0, 20, "打开包装"), (25, 40, "打开包装盒"), (2000, 2010, "别的话题"), (None, None, "无时间")])
    made = cluster.components(c, cluster.links(c)).orderBy("cand_no").collect()
    assert [r["cluster_no"] for r in made] == [1, 1, 2, 3]


def test_chain_is_one_component(spark):
    n = 200
    edges = spark.createDataFrame([(1, k, k + 1) for k in range(n - 1)], "rec_id long, a long, b long")
    nodes = spark.createDataFrame([(1, k) for k in range(n + 1)], "rec_id long, cand_no long")
    assert {r["cluster_no"] for r in cluster.components(nodes, edges).filter(F.col("cand_no") < n).collect()} == {1}


def test_selection(spark):
    rows = [(1, k, s, g, None, False) for k, (s, g) in enumerate([(95.0, "S"), (70.0, "B"), (59.0, "C"), (40.0, "D")])] + [(2, k, s, "C", None, False) for k, s in enumerate([55.0, 54.0, 53.0, 52.0])]
    df = spark.createDataFrame(rows, "rec_id long, event_no long, final_score double, grade string, reject_reason string, forced_keep boolean")
    made = {(r["rec_id"], r["event_no"]): r["recommended"] for r in grading.recommend(df).collect()}
    assert [made[1, k] for k in range(4)] == [True, True, False, False]
    assert [made[2, k] for k in range(4)] == [True, True, True, False]
    for mode in ("auto", "pool", "top"):
        assert grading.select(df, mode, 2).count() == 8


def test_merge_of_events(spark):
    rows = [(1, 0, 0, 100, "同一件事情", "", 5), (1, 1, 40, 120, "同一件事情", "更长的摘要同一件事情", 7), (1, 2, 300, 400, "同一件事情", "", 1)]
    df = spark.createDataFrame(rows, "rec_id long, event_no long, start long, end long, title string, summary string, score long")
    made = events.dedupe(df).orderBy("event_no").collect()
    assert [(r["event_no"], r["start"], r["end"], r["score"], r["merged_from"]) for r in made] == [(0, 0, 120, 7, [1]), (2, 300, 400, 1, [])]


def test_turns_use_the_latest_end(spark):
    s = spark.createDataFrame([(1, 0, 0, 5000, "a"), (1, 1, 100, 200, "a"), (1, 2, 5500, 6000, "a"), (1, 3, 6100, 6200, "b")], "rec_id long, line_no long, start long, end long, spk string")
    assert [(r["spk"], r["end"], r["n"]) for r in speakers.turns_by_gap(s).orderBy("turn_no").collect()] == [("a", 6000, 3), ("b", 6200, 1)]


def test_rich_tokens(spark):
    made = speakers.rich_tokens(F.lit("<|zh|><|HAPPY|><|Speech|>你好<|Laughter|><|ZZ|>"))
    row = spark.range(1).select(*[c.alias(k) for k, c in made.items()]).first()
    assert (row["language"], row["emotion_raw"], row["clean_text"], row["unknown_tokens"]) == ("zh", "<|HAPPY|>", "你好", ["<|ZZ|>"])


def test_zero_crossings(spark):
    f = audio.features(spark.createDataFrame([(1, 0, [1.0, -1.0, 0.0, 1.0])], "rec_id long, frame_idx long, samples array<double>")).first()
    assert f["zcr"] == pytest.approx(1 / 3) and f["rms"] == pytest.approx((3 / 4) ** 0.5)


def test_replies_are_tolerant(spark):
    texts = ['{"candidates":[{"start_time":"1:00","end_time":"2:00","score":"7.5"},{"start_time":"1:00","end_time":"2:00","score":7.8},{"start_time":"","end_time":"2:00","score":3},{"start_time":"1:00","end_time":"2:00","score":99,"confidence":3}]}', "nonsense", "[]", None]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "rec_id long, chunk_no long, reply string")
    made = replies.candidates(df).orderBy("pos").collect()
    assert [(r["score"], r["confidence"]) for r in made] == [(7, 0.5), (10, 1.0)]


def test_reviews_take_other_names(spark):
    t = '{"results":[{"event_id":"e1","scores":{"hook":9,"personality":8},"contrast_score":"6","standalone":"x","negative_flags":["普通失误","?"],"reject_reason_kind":"ai_uncertain"},{"hook":1}]}'
    good, warnings = replies.reviews(spark.createDataFrame([(1, t)], "rec_id long, reply string"))
    r = good.first()
    assert (r["hook"], r["contrast"], r["persona"], r["standalone"], r["completeness"], r["negative_flags"], r["reject_kind"]) == (9, 6, 8, 5, 5, ["普通失误"], "ai_uncertain")
    assert warnings.count() == 3


def test_dictionary(spark):
    made = files.dictionary_entries(spark.createDataFrame([('{"_说明":"x","品牌":{"福岛":"伏特加","_n":"y"},"直写":"直接"," ":"z"}',)], "content string"))
    assert {(r["wrong"], r["right"]) for r in made.collect()} == {("福岛", "伏特加"), ("直写", "直接")}


def test_transcript_lines(spark):
    content = "[00:12 - 00:18] hello\nbad\n[01:00 - 00:30] back\n[75:30 - 1:20:00]  x "
    made = files.transcript_lines(spark.createDataFrame([(1, content)], "rec_id long, content string")).orderBy("line_no").collect()
    assert [(r["line_no"], r["start"], r["end"], r["text"]) for r in made] == [(1, 12, 18, "hello"), (2, 4530, 4800, "x")]


def test_files_round_trip(spark, tmp_path):
    s = segments(spark, [(0, 10, "a b"), (10, 75, "c")])
    files.write_transcripts(s, str(tmp_path / "t"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["[00:00 - 00:10] a b", "[00:10 - 01:15] c"]


def lexicon(spark, *rows):
    return spark.createDataFrame([(*r, False) for r in rows], "canonical string, aliases array<string>, category string, priority int, context_tags array<string>, is_pattern boolean")


def test_correction(spark):
    lex = lexicon(spark, ("永劫无间", ["永劫无剑"], "hotword", 1, ["game"]))
    docs = spark.createDataFrame([(1, "[00:01 - 永劫无剑] 今天玩永劫无剑这个游戏，上分。"), (2, "他说永劫无剑的时候"), (3, None)], "doc_id long, text string")
    made, decisions = correction.correct(docs, lex)
    got = {r["doc_id"]: r for r in made.collect()}
    assert got[1]["corrected"] == "[00:01 - 永劫无剑] 今天玩永劫无间这个游戏，上分。" and got[1]["n_applied"] == 1
    assert got[2]["n_applied"] == 0 and got[3]["corrected"] == ""
    assert correction.report(made.select("doc_id", "text"), decisions).count() >= 1


def test_feedback_snapshot_is_carried(spark):
    rows = [(1, "喜欢", 1, 1, '{"a":1}'), (1, "不喜欢", 2, 2, "{}"), (2, "其他", 1, 3, None)]
    df = spark.createDataFrame(rows, "clip_id long, user_choice string, ts long, event_id long, snapshot string")
    for made in (feedback.latest(df), feedback.latest_by_aggregation(df)):
        got = {r["clip_id"]: (r["user_choice"], r["snapshot"]) for r in made.collect()}
        assert got == {1: ("不喜欢", '{"a":1}'), 2: ("其他", None)}
    s = feedback.stats(feedback.latest(df)).first()
    assert (s["total"], s["liked"], s["disliked"]) == (2, 0, 2)


def windows_one_by_one(pool):
    """Every window of the sorted sentences told anew."""
    found = []
    for i in range(len(pool)):
        for j in range(i, len(pool)):
            span = pool[j][1] - pool[i][0]
            if span > 90_000:
                break
            win = pool[i : j + 1]
            voiced = {}
            for a, b, s, _ in win:
                voiced[s] = voiced.get(s, 0) + b - a
            runs = []
            for a, b, s, _ in win:
                if runs and runs[-1][2] == s:
                    runs[-1][1] = b
                else:
                    runs.append([a, b, s])
            total = sum(voiced.values())
            if span < 30_000 or len(voiced) != 2 or len(runs) < 3 or any("<|BGM|>" in w[3] for w in win):
                continue
            if min(voiced.values()) < 4000 or min(voiced.values()) / total < 0.15:
                continue
            least = min(b - a for a, b, _ in runs) / 1000
            found.append((round(least + 2.0 * min(6, len(runs) - 1) + 10.0 * total / span, 2), win[0][0], win[-1][1], len(runs) - 1))
    return found


@pytest.mark.parametrize("block", [1_800_000, 45_000])
def test_speaker_windows(spark, block, monkeypatch):
    from talkmine.operators import windows

    monkeypatch.setattr(windows, "BLOCK_MS", block)
    rnd, rows, at = random.Random(8), [], 0
    for k in range(120):
        length = rnd.randint(1500, 9000)
        rows.append((1, k, at, at + length, rnd.choice("aab" if k < 60 else "bcc"), "<|BGM|>" if k % 37 == 5 else "t"))
        at += length + rnd.randint(0, 2500)
    df = spark.createDataFrame(rows, "rec_id long, line_no long, start long, end long, spk string, text string")
    made = windows.speaker_windows(df).orderBy("place").collect()
    want = windows_one_by_one([(a, b, s, t) for _, _, a, b, s, t in rows])
    kept = []
    for w in sorted(want, key=lambda c: (-c[0], abs(c[2] - c[1] - 60_000), c[1], c[2])):
        if all(min(w[2], k[2]) - max(w[1], k[1]) <= 0.4 * (w[2] - w[1]) for k in kept) and len(kept) < 5:
            kept.append(w)
    assert [(r["score"], r["start_ms"], r["end_ms"], r["switches"]) for r in made] == kept
