"""The whole correction against a version of its rules in plain Python."""

import random
import re

import pytest

from talkmine.operators import automaton, correction
from talkmine.operators.correction import BOUNDS, DEGREE_LEFT, GENERIC_RIGHT, KEYWORDS, PRIOR, SENTENCE_ENDS, TAGS, VERBS

ENTRY = "canonical string, aliases array<string>, category string, priority int, context_tags array<string>, is_pattern boolean"
ENTRIES = [
    ("永劫无间", ["永劫无剑", "永结无间"], "hotword", 1, ["game"], False), ("权力的游戏", ["全力的游戏", "权力游戏"], "movie", 2, ["film"], False),
    ("剑来", ["剑莱", "见来"], "book", 0, [], False), ("见来", ["剑莱"], "person", 2, None, False), ("XX哥", ["二哥"], "person", 2, [], True),
    ("魏劭", ["魏少", "卫劭"], "person", 2, ["livestream", "game"], False), ("魏劭传", ["魏少传"], "book", 2, ["book"], False), ("无类", ["无内"], None, 1, ["other"], False),
]
PIECES = [
    "永劫无剑", "永结无间", "永劫无间", "全力的游戏", "权力游戏", "权力的游戏", "剑莱", "见来", "剑来", "魏少", "卫劭", "魏劭", "魏少传", "魏劭传", "无内", "二哥", "今天玩", "很", "的爱情", "，", "。", " ", "\n", "abc",
    "主播", "直播间", "电影", "看", "小说", "游戏", "上分", "导演", "弹幕", "书", "[00:01 - 魏少]", "推荐", "！", "x", "的等待",
]


def brute(docs, entries, similar):
    """Decisions by (doc_id, start, canonical), and the corrected texts."""
    plain = [e for e in entries if not e[5]]
    owners = {}
    for e in plain:
        for alias in e[1]:
            owners.setdefault(alias, {}).setdefault(e[0], e)
    names = {e[0] for e in entries}
    decisions, texts = {}, {}
    for doc, text in docs:
        masked = re.sub(r"\[[^\]\n]*\]", lambda m: "\x00" * len(m.group()), text)
        held, named = [], set()
        for at in range(len(masked)):
            longest = max((n for n in names if masked.startswith(n, at)), key=len, default=None)
            if longest:
                held.append((at, at + len(longest)))
                named.add(longest)
        hits, at = [], 0
        while at < len(masked):
            alias = max((x for x in owners if masked.startswith(x, at)), key=len, default=None)
            if alias:
                if not any(a <= at and at + len(alias) <= b for a, b in held):
                    hits.append((at, at + len(alias), alias))
                at += len(alias)
            else:
                at += 1
        rows = []
        for start, end, alias in hits:
            low, high = max(0, start - 120), min(len(text), end + 120)
            begin = next((k + 1 for k in range(start - 1, low - 1, -1) if text[k] in SENTENCE_ENDS), low)
            stop = next((k + 1 for k in range(end, high) if text[k] in SENTENCE_ENDS), high)
            around = text[begin:start] + "\x00" + text[end:stop]
            left, right = text[max(0, start - 8) : start], text[end : end + 6]
            for canonical, e in owners[alias].items():
                category, tags = e[2], list(dict.fromkeys(e[4] or []))
                told = lambda words: sum(w in around for w in words)
                strong, weak = (told(KEYWORDS[category][k]) if category in KEYWORDS else 0 for k in (0, 1))
                tagged = sum(told(TAGS.get(t, ())) for t in tags)
                strength = 0.0
                for k in {*tags, category}:
                    if k in KEYWORDS or k in TAGS:
                        a, b = KEYWORDS.get(k, ((), ()))
                        strength = max(strength, min(1.0, sum(0.5 * text.count(w) for w in (*a, *TAGS.get(k, ()))) + sum(0.25 * text.count(w) for w in b)))

                def context(base):
                    c = max(base, min(1.0, 0.6 + 0.15 * (strong - 1))) if strong else max(base, 0.30) if weak else base
                    c = min(1.0, c + 0.60 + 0.10 * (tagged - 1)) if tagged else c
                    return min(1.0, c + 0.35 * strength)

                fluency = 0.55 + 0.15 * any(v in left[-3:] for v in VERBS)
                fluency += 0.15 * (not left or not right or any(left.endswith(b) for b in BOUNDS) or any(right.startswith(b) for b in BOUNDS))
                fluency -= 0.35 * (right[:3] in GENERIC_RIGHT) + 0.20 * any(left.endswith(x) for x in DEGREE_LEFT)
                fluency = max(0.0, min(1.0, fluency))
                ambiguity = max(0.4, (0.65 if len(owners[alias]) > 1 else 1) * (0.7 if alias in names else 1) * (0.9 if len(alias) <= 2 else 1) * (0.95 if e[3] <= 0 else 1))
                alike = 1.0 if alias == canonical else similar[alias, canonical]
                total = lambda c: min(1.0, (0.15 * PRIOR.get(category, 0.45) + 0.25 * alike + 0.40 * c + 0.20 * fluency) * ambiguity)  # noqa: B023, E731
                score = total(context(0.0))
                rows.append({
                    "start": start, "end": end, "alias": alias, "canonical": canonical, "n_strong": strong, "n_weak": weak, "n_tags": tagged, "doc_strength": strength, "context": context(0.0), "fluency": fluency,
                    "ambiguity": ambiguity, "score": score, "score_c": total(context(0.60)), "decision": "replace" if score >= 0.62 else "keep_suggest" if score >= 0.40 else "keep",
                    "owners": len(owners[alias]), "lifted": False,
                })
        sure = {(r["alias"], r["canonical"]) for r in rows if r["decision"] == "replace"}
        for r in rows:
            if r["decision"] == "keep_suggest" and r["owners"] == 1 and r["score_c"] >= 0.62 and (r["canonical"] in named or (r["alias"], r["canonical"]) in sure):
                r.update(lifted=True, score=r["score_c"], decision="replace")
        for start in {r["start"] for r in rows}:
            first, *others = sorted((r for r in rows if r["start"] == start), key=lambda r: (-r["score"], r["canonical"]))
            for r in others:
                r["decision"] = "keep"
        decisions |= {(doc, r["start"], r["canonical"]): r for r in rows}
        out = text
        for r in sorted((r for r in rows if r["decision"] == "replace"), key=lambda r: -r["start"]):
            out = out[: r["start"]] + r["canonical"] + out[r["end"] :]
        texts[doc] = out
    return decisions, texts


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(8)
    made = [(k, "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 40)))) for k in range(150)]
    return [*made, (900, ""), (901, "今天玩永劫无剑这个游戏，上分。" + "字" * 130 + "永劫无剑" + "字" * 130 + "魏少"), (902, "[魏少] 魏少[魏少")]


@pytest.mark.parametrize("letters", [automaton.AUTOMATON_LETTERS, 10])
def test_correction_by_brute_force(spark, docs, letters, monkeypatch):
    monkeypatch.setattr(automaton, "AUTOMATON_LETTERS", letters)
    df, entries = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(ENTRIES, ENTRY)
    corrected, rows = correction.correct(df, entries)
    made = {(r["doc_id"], r["start"], r["canonical"]): r.asDict() for r in rows.collect()}
    expected, texts = brute(docs, ENTRIES, {(r["alias"], r["canonical"]): r["similarity"] for r in made.values()})
    assert set(made) == set(expected)
    for k, want in expected.items():
        for name, value in want.items():
            assert made[k][name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (k, name)
    assert {r["doc_id"]: r["corrected"] for r in corrected.collect()} == texts
    assert {r["decision"] for r in expected.values()} == {"replace", "keep_suggest", "keep"} and any(r["lifted"] for r in expected.values())
    if letters > 10:
        report = {(r["doc_id"], r["start"]): r for r in correction.report(df, rows).collect()}
        told = {k[:2]: r for k, r in expected.items() if r["decision"] != "keep"}
        by_id = dict(docs)
        assert set(report) == set(told)
        for k, r in told.items():
            own = report[k]
            assert (own["line"], own["original"], own["corrected"], own["decision"]) == (by_id[k[0]][: k[1]].count("\n") + 1, r["alias"], r["canonical"], r["decision"])
            assert own["score"] == pytest.approx(r["score"], abs=6e-5) and ("consistent" in own["reasons"]) == r["lifted"] and ("several owners" in own["reasons"]) == (r["owners"] > 1)


def test_spans():
    assert list(automaton.leftmost_longest([(3, 5), (0, 2), (1, 9), (2, 3), (2, 4)])) == [(0, 2), (2, 4)]
    assert automaton.longest_at_each([(0, 2), (0, 3), (1, 2)]) == [(0, 3), (1, 2)] and automaton.Words([]).spans("x", 0, 1) == []
    assert sorted(automaton.Words(["ab", "b", "abc"]).spans("xabc ab", 1, 4)) == [(1, 3), (1, 4), (2, 3)]


def test_profile_counts_all_keywords_in_one_pass(spark):
    texts = ["", None, "plain words", "Steam steam Boss boss", "开黑开黑", "电影院电影", "UP主主播up主", "看看看", "直播间弹幕" * 3, "梗"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for doc, text in enumerate(texts):
        for key in {*KEYWORDS, *TAGS}:
            strong, weak = KEYWORDS.get(key, ((), ()))
            total = sum(0.5 * (text or "").count(w) for w in (*strong, *TAGS.get(key, ()))) + sum(0.25 * (text or "").count(w) for w in weak)
            if total:
                want[doc, key] = min(1.0, total)
    made = correction.document_profile(df)
    assert {(r["doc_id"], r["key"]): r["strength"] for r in made.collect()} == want
    assert "replace(" not in made._jdf.queryExecution().analyzed().toString()


def test_a_task_holds_few_rows_of_hits(monkeypatch):
    monkeypatch.setattr(correction, "HELD_ROWS", 4)
    rows = [(k, "w", None, None, None, None, None, None, None) for k in range(9)]
    frames = list(correction._hits_frames(iter(rows)))
    assert [len(f) for f in frames] == [4, 4, 1] and [k for f in frames for k in f["doc_id"]] == list(range(9))
    assert list(correction._hits_frames([])) == []
