"""Rules without SQL against plain loops over small cases, and the shapes of written text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from talkmine.operators import audio, correction, events, lexicon, quality, runs, speakers, truth
from talkmine.sources import files


def grams(text):
    kept = "".join(c for c in text if c.isascii() and c.isalnum())
    return {kept} - {""} if len(kept) < 2 else {kept[i : i + 2] for i in range(len(kept) - 1)}


def share(a, b):
    both, least = min(a[1], b[1]) - max(a[0], b[0]), min(a[1] - a[0], b[1] - b[0])
    return both / least if both > 0 and least > 0 else 0.0


@pytest.mark.parametrize("size", [7, 20_000])
def test_dedupe_takes_events_in_order(spark, size, monkeypatch):
    monkeypatch.setattr(events, "ROUND_EVENTS", size)
    rnd = random.Random(1)
    rows = []
    for rec in range(4):
        for no in range(40):
            start = rnd.randint(0, 300)
            rows.append((rec, no, start, start + rnd.randint(1, 40), rnd.choice(["red fox", "red foxes", "blue whale"]), rnd.choice(["", "", "red fox runs", "blue whale sings"]), rnd.randint(1, 9), [no, 100 + no % 3], rnd.choice(["", "boom"])))
    df = spark.createDataFrame(rows, "rec_id long, event_no long, start long, end long, title string, summary string, score long, source_candidates array<long>, strongest_moment string")
    want = []
    for rec in range(4):
        left = [list(r) + [[]] for r in rows if r[0] == rec]
        while left:
            head, rest = left[0], []
            for x in left[1:]:
                a, b = grams(head[5] or head[4]), grams(x[5] or x[4])
                if share(head[2:4], x[2:4]) > 0.5 and len(a & b) / min(len(a), len(b)) > 0.5:
                    head[2], head[3], head[6] = min(head[2], x[2]), max(head[3], x[3]), max(head[6], x[6])
                    head[5], head[8] = max(head[5], x[5], key=len), max(head[8], x[8], key=len)
                    head[7] = head[7] + [s for s in x[7] if s not in head[7]]
                    head[9].append(x[1])
                else:
                    rest.append(x)
            want.append(tuple(head))
            left = rest
    names = ["rec_id", "event_no", "start", "end", "title", "summary", "score", "source_candidates", "strongest_moment", "merged_from"]
    assert sorted(map(tuple, events.dedupe(df).select(*names).collect())) == sorted(want)


def test_runs_match_first_free(spark):
    rnd = random.Random(2)
    make = lambda: [(rec, no, s := rnd.randint(0, 120), s + rnd.randint(1, 30), float(rnd.randint(1, 9))) for rec in range(3) for no in range(15)]
    before, after = make(), make()
    schema = "rec_id long, event_no long, start long, end long, score double"
    made = events.match_runs(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)).filter("kind = 'matched'").collect()
    want = []
    for rec in range(3):
        free = {b[1]: b for b in before if b[0] == rec}
        for a in (x for x in after if x[0] == rec):
            hit = next((no for no in sorted(free) if share(a[2:4], free[no][2:4]) >= 0.5), None)
            if hit is not None:
                want.append((rec, hit, a[1]))
                del free[hit]
    assert sorted((r["rec_id"], r["before_no"], r["after_no"]) for r in made) == sorted(want)


def test_switches_match_nearest_first(spark):
    rnd = random.Random(3)
    p, t = [(1, x) for x in rnd.sample(range(30_000), 40)], [(1, x) for x in rnd.sample(range(30_000), 40)]
    made = {r["tolerance"]: r["tp"] for r in speakers.match_switches(*(spark.createDataFrame(x, "rec_id long, at long") for x in (p, t))).collect()}
    for tolerance, tp in made.items():
        pairs, n = {(abs(a - b), a, b) for _, a in p for _, b in t if abs(a - b) <= tolerance}, 0
        while pairs:
            _, a, b = min(pairs)
            pairs, n = {x for x in pairs if x[1] != a and x[2] != b}, n + 1
        assert tp == n


def test_event_stats(spark):
    clusters = spark.createDataFrame([(1, 1, 3), (1, 2, 1), (1, 3, 4), (1, 4, 2)], "rec_id long, cluster_no long, n long")
    judged = spark.createDataFrame([(1, 1, True, False), (1, 2, False, True), (1, 3, False, False)], "rec_id long, cluster_no long, same_event boolean, expanded boolean")
    before = spark.createDataFrame([(1,)] * 8, "rec_id long")
    r = events.event_stats(clusters, judged, before, before.limit(6)).first().asDict()
    assert r == {"rec_id": 1, "clusters": 4, "merged": 2, "split": 3, "expanded": 1, "judge_calls": 5, "judge_failed": 1, "events": 6, "deduped": 2}


def test_annotated_texts(spark):
    text = "\n".join([
        "# 段1 模型判：x（1.0s–3.0s） —— 内容：oneAAAtwoAAAAthree", "0 9human_spk_02 uman_spk_01", "# 1000-2000 spk-1  oneAAAtwo", "1 2 human_spk_05", "# 段2 模型判：y（3.0s–4.0s） —— 内容：four", "总人数 2",
    ])
    rows = truth.annotated_turns(spark.createDataFrame([("r", text)], "rec_id string, content string")).orderBy("est_start").collect()
    assert [(r["kind"], r["text"], r["people"], r["est_start"], r["est_end"]) for r in rows] == [("sentence", "one", [1, 2], 1000, 1333), ("sentence", "two", [1, 2], 1666, 2000)]
    rows = truth.annotated_turns(spark.createDataFrame([("r", text.replace("# 1000-2000 spk-1  oneAAAtwo", "# 1000-2000 spk-1  one"))], "rec_id string, content string")).orderBy("est_start").collect()
    assert [(r["seg"], r["text"], r["people"]) for r in rows] == [(1, "one", [1, 2]), (1, "two", [1, 2]), (1, "three", [1, 2]), (2, "four", [])]


def test_turn_sheets(spark):
    sheet = "# n\n1 [约0.0s–10.0s] 说话人 =_1_ abcd\n2 efgh\n3? ijkl\n2 [约10.0s–12.0s] 说话人 =12__ x"
    open_ = "1 [约0.0s–1.0s] 说话人 =__ x\n2 [约1.0s–2.0s] 说话人 =1 y"
    labels, missing = truth.turn_sheets(spark.createDataFrame([("a", sheet), ("b", open_)], "rec_id string, content string"))
    assert [(r["speaker"], r["text"], r["est_start"], r["est_end"]) for r in labels.orderBy("label_no").collect()] == [
        ("human_spk_01", "abcd", 0, 5000), ("human_spk_02", "efgh", 5000, 7500), ("human_spk_03,unsure", "ijkl", 7500, 10000), ("human_spk_01,human_spk_02", "x", 10000, 12000)
    ]
    assert [tuple(r) for r in missing.collect()] == [("b", 1)]


ALIASES = [
    ("魏劭", "（谐音：魏少、卫劭；外号：大魏；打错字：劭→邵/绍）", "person", ["魏少", "卫劭", "大魏", "魏邵", "魏绍"]),
    ("小杨哥", "小羊哥 小杨哥 小杨哥儿 81", "person", ["小羊哥", "小杨哥儿"]),
    ("权力的游戏", "外号：二丫、龙妈；谐音：全力的游戏；常被简称/叫错", "movie", ["全力的游戏"]),
    ("number one", "谐音：number won/two、ok", "hotword", ["number won", "number two"]),
    ("魏劭", "（打错字：常写作少→劭）", "person", ["魏少"]),
    ("白蛇传", "（打错字：“白舌传→白蛇传”）", "movie", ["白舌传"]),
    ("白蛇传", "打错字：「蛇->舌/社」、传=>转；谐音：《白舌传》、易读错白蛇", "movie", ["白舌传", "白社传", "白蛇转"]),
    ("a big cat", "谐音：a big bat/hat/rat/the pig/dog/ox", "hotword", ["a big bat", "a big hat", "a big rat", "the pig", "the dog", "the ox"]),
    ("ab", "谐音：abcd/ef x/gh", "hotword", ["abcd", "ef x", "ef gh"]),
    ("Some-Word", "some word，SOME WORT、some-wort、１２３４、12、…、也叫Sum Word", "hotword", ["some", "word", "WORT", "some-wort"]),
    ("剑来", "剑莱 常读错 见来", "book", ["剑莱", "见来"]),
    ("剑来", "（）", "book", []), ("剑来", "：剑莱", "book", ["：剑莱"]), ("甲乙", "打错字：丙→丁、乙→丙", "person", ["甲丙"]),
]


def test_lexicon_aliases(spark):
    rows = [(k, word, variants, category) for k, (word, variants, category, _) in enumerate(ALIASES)]
    rows += [(100 + r[0], *r[1:]) for r in rows] + [(200, "", "x", "book"), (201, "无", None, None)]
    made = {r["entry_no"]: r["aliases"] for r in lexicon.build(spark.createDataFrame(rows, "entry_no int, canonical string, variants string, category string")).collect()}
    assert made == {k + shift: x[3] for k, x in enumerate(ALIASES) for shift in (0, 100)} | {201: []}
    assert lexicon.build(spark.createDataFrame([], "entry_no int, canonical string, variants string, category string")).collect() == []


def test_lexicon_entries(spark):
    lines = spark.createDataFrame([("# head",), ("**3** / 魏劭 / （谐音：魏少、卫劭、微劭）",), ("--- ",), ("4/XX哥/主播",)], "value string")
    made = {r["canonical"]: r for r in lexicon.build(quality.raw_lexicon(lines, "person")).collect()}
    assert made["魏劭"]["priority"] == 3 and made["魏劭"]["context_tags"] == ["person", "homophone"] and made["魏劭"]["entry_no"] == 3
    assert made["XX哥"]["is_pattern"] and made["XX哥"]["context_tags"] == ["person", "livestream"]


def lexicon_of(spark):
    rows = [("张三丰", ["张三风"], "person", 2, [], False), ("张三", ["章三"], "person", 2, [], False)]
    return spark.createDataFrame(rows, "canonical string, aliases array<string>, category string, priority int, context_tags array<string>, is_pattern boolean")


def test_a_word_within_a_longer_one_is_no_witness(spark):
    docs = spark.createDataFrame([(1, "张三丰来了，章三走了"), (2, "张三来了，章三走了")], "doc_id long, text string")
    hits, named = correction.found(docs, lexicon_of(spark))
    assert sorted(map(tuple, hits.select("doc_id", "alias", "canonical").collect())) == [(1, "章三", "张三"), (2, "章三", "张三")]
    assert sorted(map(tuple, named.collect())) == [(1, "张三丰"), (2, "张三")]


def test_hits_inside_canonical_words_and_stamps_are_passed_over(spark):
    rows = [("abcd", ["bcx"], "person", 1, [], False), ("ab", ["cd", "zz"], "person", 1, [], False)]
    entries = spark.createDataFrame(rows, lexicon_of(spark).schema)
    docs = spark.createDataFrame([(1, "abcd cd [zz] zz bcx")], "doc_id long, text string")
    hits, _ = correction.found(docs, entries)
    assert sorted((r["start"], r["alias"]) for r in hits.collect()) == [(5, "cd"), (13, "zz"), (16, "bcx")]


def test_correction_statistics(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string")
    decisions = spark.createDataFrame([(1, "replace"), (1, "keep_suggest"), (1, "keep")], "doc_id long, decision string")
    assert sorted(map(tuple, correction.statistics(docs, decisions).collect())) == [(1, 2, 3, 1, 1, 3, True), (2, 1, 0, 0, 0, 0, False)]


def test_run_stability(spark):
    rows = [(1, run, k, k, k + 1, "a", "same words" if run < 3 or k else "other word") for run in (1, 2, 3) for k in range(3)]
    df = spark.createDataFrame(rows, "rec_id long, run long, line_no long, start long, end long, spk string, text string")
    made = {(r["run_a"], r["run_b"]): r for r in runs.stability(df).collect()}
    assert made[1, 2]["same_text"] and made[1, 2]["text_ratio"] == 1.0 and not made[1, 3]["same_text"] and 0.5 < made[1, 3]["text_ratio"] < 1 and made[1, 3]["same_places"]


def test_turn_records(spark):
    df = spark.createDataFrame([("r", 1.23456, 2.0, "a", 0.123456, ""), ("r", 3.0, 4.0, "b", None, "hi")], "rec_id string, start double, end double, speaker string, confidence double, text string")
    assert [json.loads(r["record"]) for r in files.turn_records(df).orderBy("start").collect()] == [{"start": 1.235, "end": 2.0, "speaker": "a", "confidence": 0.1235}, {"start": 3.0, "end": 4.0, "speaker": "b", "text": "hi"}]


def test_hotspot_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 1.0, 0.2, 0.3, "energy_burst", 4, "文本弱")], "rec_id long, start double, end double, peak_energy double, peak_zcr double, kind string, text_density long, text_tag string")
    files.write_hotspots(df, str(tmp_path / "h"))
    text = next((tmp_path / "h").glob("rec_id=1/*.csv")).read_text().splitlines()
    assert text == ["start,end,dur,peak_energy,peak_zcr,kind,text_density,text_tag", "0.5,1.0,0.5,0.2,0.3,energy_burst,4,文本弱"]


def test_audio_documents_leave_out_faulty_ones(spark):
    meta = spark.createDataFrame([(1, "1.0"), (2, "0.9")], "rec_id long, version string")
    rows = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "rec_id long, item_no long")
    faults = spark.createDataFrame([(2, "version")], "rec_id long, fault string")
    made = [json.loads(r["document"]) for r in files.audio_documents(meta, rows, rows, rows, faults).collect()]
    items = [{"item_no": 0}, {"item_no": 1}]
    assert made == [{"rec_id": 1, "version": "1.0", "utterances": items, "audio_events": items, "speaker_turns": items}]


def test_document_faults(spark):
    meta = spark.createDataFrame([(1, "1.0", "milliseconds", 10), (2, "0.9", "seconds", 0)], "rec_id long, version string, timebase string, duration_ms long")
    u = spark.createDataFrame([(1, "u1", 0, 5, "a", "happy", "<|HAPPY|>"), (1, "u2", 5, 4, "b", None, None), (1, "u3", 5, 6, "a", "odd", None)], "rec_id long, utterance_id string, start long, end long, spk string, emotion string, emotion_raw string")
    e = spark.createDataFrame([(1, "e1", 0, 1, ""), (1, "e2", 2, 1, "x")], "rec_id long, event_id string, start long, end long, raw_label string")
    t = spark.createDataFrame([(1, 1, 0, 1, None), (1, 2, 2, 1, "a")], "rec_id long, turn_no long, start long, end long, spk string")
    known = spark.createDataFrame([(1, "a")], "rec_id long, spk string")
    made = sorted((r["rec_id"], r["fault"], r["item"]) for r in quality.document_faults(meta, u, e, t, known).collect())
    assert made == sorted([
        (2, "version", ""), (2, "timebase", ""), (2, "duration", ""), (1, "utterance end", "u2"), (1, "emotion without raw label", "u3"), (1, "emotion not in list", "u3"),
        (1, "event without raw label", "e1"), (1, "event end", "e2"), (1, "turn without speaker", "1"), (1, "turn end", "2"), (1, "speaker not registered", "u2"),
    ])


def test_audio_evidence(spark):
    spans = spark.createDataFrame([(1, 7, 0, 100), (1, 8, 200, 300)], "rec_id long, event_no long, start long, end long")
    u = spark.createDataFrame([(1, 50, 60, "b", "happy"), (1, 90, 210, "a", None)], "rec_id long, start long, end long, spk string, emotion string")
    e = spark.createDataFrame([(1, 99, 101, "laugh"), (1, 100, 120, "cough")], "rec_id long, start long, end long, label string")
    t = spark.createDataFrame([(1, 40, 250, "a")], "rec_id long, start long, end long, spk string")
    made = {r["event_no"]: r for r in quality.audio_evidence(spans, u, e, t).collect()}
    assert (made[7]["speakers"], made[7]["emotions"], made[7]["sounds"], made[7]["turns"], made[7]["turn_ms"]) == (["a", "b"], 1, ["laugh"], 1, 60)
    assert (made[8]["speakers"], made[8]["turns"], made[8]["turn_ms"]) == (["a"], 1, 50)


def test_merged_lexicons(spark):
    rows = [("Ab c", ["x", "Y"], "f1", 1), ("abC", ["y", "z", "X "], "f2", 2), ("other", [], "f3", 3)]
    df = spark.createDataFrame(rows, "canonical string, aliases array<string>, source string, entry_no int")
    made = {r["canonical"]: (r["aliases"], r["source"], r["merged"]) for r in quality.merge_lexicons(df).collect()}
    assert made == {"Ab c": (["x", "Y", "z"], "f1", 1), "other": ([], "f3", 0)}
