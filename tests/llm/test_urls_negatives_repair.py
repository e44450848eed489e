"""Url filter, hard negatives and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from talkmine.llm import conversation_repair, hard_negatives, queries, url_filter

SPACES = " \t\n\x0b\x0c\r"


def named(spark, folder, name):
    (found,) = [k for k in entry.queries() if k.startswith(f"{name}_")]
    return [r.asDict() for r in entry.queries()[found](spark, str(folder)).collect()]


# urls

PAGES = [
    (0, "http://tion.example.ORG/es/1", "<p>free free bets the the the house</p>"), (1, "https://a.example.org/en/12?x=1", "<script>casino casino</script>the cheap house"),
    (2, "http://freebets.example.net/en/1.html", "bets&amp;free house"), (3, "http://xexample.org/es/", None), (4, None, "the"), (5, "no scheme/de/", ""),
    (6, "http://m.shop.example.com/fr/99#a", "cheap shop"), (7, "http://shop.example.com/de/casino", "shop the"), (8, "http://www.cheapcasino.net", "the cheap cheap"),
    (9, "http://org", "x"), (10, "http://org/", "x"), (11, "http://example.org?/es/", "x"), (12, "ftp://h://q/es/", "y"), (13, "http://wintheshop.net/free/123/freebets", "win win win"),
    (14, "http://cheaphouse.net/en/7", "house"), (14, "http://cheaphouse.net/en/7", "house"), (None, "http://org/", ""), (15, "http://übershop.net:80/en/", "Über über"),
    (16, "http://example.com/de", "z"), (17, "http://example.org/en/1", "z"), (18, "http://cheap-pills.example.net/", "z"), (19, "http://-..-/", "z"),
]


def brute_urls(rows, rules, unwanted):
    words = Counter()
    for _, _, html in rows:
        bare = re.sub(url_filter.MARKUP.replace("(?is)", ""), " ", (html or "").lower(), flags=re.I | re.S)
        words.update(re.findall(r"[^\W\d_]+", bare))
    total = sum(words.values())
    model = {w: n for w, n in words.items() if len(w) <= url_filter.WORD_LETTERS}
    for w in unwanted:
        model[w] = max(model.get(w, 0), math.ceil(url_filter.LISTED_SHARE * total))

    def split(name):
        def p(w):
            return math.log(model[w] / total) if w in model else math.log(10 / total) - len(w) * math.log(10)

        ways = [[]]
        for cuts in range(len(name)):
            ways += [[0, *c] for c in itertools.combinations(range(1, len(name)), cuts)]
        best = None
        for way in ways[1:]:
            own = [name[a:b] for a, b in zip(way, [*way[1:], len(name)])]
            score = sum(map(p, own))
            if best is None or score > best[0] + 1e-9 or abs(score - best[0]) <= 1e-9 and [len(w) for w in own[::-1]] > [len(w) for w in best[1][::-1]]:
                best = score, own
        return best[1]

    out = []
    for page_id, url, _ in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match("[^/?#]*", rest).group().translate(str.maketrans(url_filter.UPPER, url_filter.UPPER.lower()))
            path = re.match("[^?#]*", rest[len(host) :]).group()
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        body, last = host.rsplit(".", 1) if "." in host else (host, "")
        own = [w for name in re.findall(r"[^\W\d_]+", body.lower()) for w in split(name)] + ([last] if last else [])
        tokens = own + re.findall(r"[^\W\d_]+|#", re.sub(r"\d+", "/#/", path.lower()))
        out.append((page_id, host, path, max(fits, default=None), own, tokens))
    block = [any(t in unwanted for t in o[5]) for o in out]
    bad, good = Counter(), Counter()
    for b, o in zip(block, out):
        (bad if b else good).update(o[5])
    met, a = len(bad | good), url_filter.ALPHA
    made = []
    for page_id, host, path, rule, own, tokens in out:
        score = math.log((sum(block) + 1) / (len(block) - sum(block) + 1))
        score += sum(math.log((bad[t] + a) / (sum(bad.values()) + a * met)) - math.log((good[t] + a) / (sum(good.values()) + a * met)) for t in tokens)
        made.append((page_id, host, path, rule[1] if rule else None, rule[2] if rule else "block" if score > 0 else "allow", own, round(score, 9)))
    return made


def key(row):
    return tuple((x is None, str(x)) for x in row)


def test_op11_by_brute_force(spark, tmp_path, monkeypatch):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    expected = brute_urls(PAGES, queries.URL_RULES, url_filter.UNWANTED)
    tokens = {t for o in expected for t in o[5]}
    assert len({xxhash.xxh64_intdigest(t.encode(), 42) % url_filter.BUCKETS for t in tokens}) == len(tokens)
    for size in (url_filter.BROADCAST_BYTES, -1):
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", size)
        made = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["words"], round(r["score"], 9)) for r in named(spark, tmp_path, "op11")]
        assert sorted(made, key=key) == sorted(expected, key=key)
    by_id = {r[0]: r for r in made}
    assert by_id[2][5] == ["free", "bets", "example", "net"] and by_id[2][4] == "block" and by_id[14][4] == "allow"
    assert by_id[1][3] == "example.org/en/1" and by_id[9][3] is None and by_id[10][3] == "org/" and by_id[3][3] == "org/" and by_id[16][3] is None


def test_urls_without_rules_and_empty_tables(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumnsRenamed({}).selectExpr("page_id", "url", "html", "1 AS host", "2 AS words", "3 AS rules")
    made = url_filter.judge(df).collect()
    assert len(made) == len(PAGES) and {r["rule"] for r in made} == {None}
    assert url_filter.judge(df.limit(0), queries.URL_RULES).collect() == []
    long = [(1, "http://" + "ab" * 3000 + ".net/" + "c/" * 5000, "ab " * 2000)]
    (row,) = url_filter.judge(spark.createDataFrame(long, "page_id long, url string, html string")).collect()
    assert "".join(row["words"][:-1]) == "ab" * 3000


# hard negatives


def brute_negatives(rows, positives=5, negatives=5, low=80, high=100):
    """rows: (id, label, vector, anchor); null ids behind."""
    none = float("inf")
    own = [(none if i is None else i, lab, v, a) for i, lab, v, a in rows if lab is not None and v is not None]

    def dot(x, y):
        return sum(a * b for a, b in zip(x, y))

    out = []
    for k, (i, lab, v, anchor) in enumerate(own):
        if not anchor:
            continue
        scored = sorted((-dot(v, w), j, m) for n, (j, m, w, _) in enumerate(own) if n != k)
        for s, j, _ in [x for x in scored if x[2] == lab][:positives]:
            fits = [x for x in scored if x[2] != lab and low * -s <= -100 * x[0] <= high * -s][:negatives]
            out += [tuple(None if y == none else y for y in (i, j, rank, n, -s, -t)) for rank, (t, n, _) in enumerate(fits, 1)]
    return sorted(out, key=key)


def result(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=key)


ROWS = "id long, label int, vector array<int>, anchor boolean"


@pytest.mark.parametrize("scale", [3, 40, 30_000_000])
def test_negatives_by_brute_force(spark, monkeypatch, scale):
    rnd = random.Random(scale)
    base = [[rnd.randint(-scale, scale) for _ in range(7)] for _ in range(6)]
    rows = [(k // 2 if k % 9 == 0 else k, rnd.randint(0, 3), [x + rnd.randint(0, 1) for x in rnd.choice(base)][: rnd.choice([7, 7, 5])], k % 6 == 0) for k in range(150)]
    rows += [(None, 1, base[0], False), (None, 2, base[0], True), (999, None, base[0], True), (998, 1, None, True), *rows[:9]]
    for name, value in (("BLOCK_ROWS", 16), ("SHARD_ROWS", 40), ("ANCHOR_ROWS", 11), ("SLICE_SCORES", 100), ("DEPTH", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    made = result(hard_negatives.mine(spark.createDataFrame(rows, ROWS).repartition(3)))
    assert made == brute_negatives(rows) and made


def test_products_are_exact():
    rnd = np.random.default_rng(5)
    for most, width in ((127, 64), (1 << 20, 64), (3, 5000)):
        a, b = (rnd.integers(-most, most, (9, width), endpoint=True).astype(np.int32) for _ in range(2))
        primes = hard_negatives.primes_for(float(width) * most * most)
        assert (hard_negatives.products(a, b, primes) == a.astype(np.int64) @ b.astype(np.int64).T).all()
    p = np.float32(251)
    x = np.arange(-(1 << 24) + 1, 1 << 24, 97, dtype=np.int64)
    assert (hard_negatives.balanced(x.astype(np.float32), p).astype(int) == (x + 125) % 251 - 125).all()
    with pytest.raises(ValueError):
        hard_negatives.primes_for(2.0**60)


def test_op12_by_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    vectors = [[rnd.gauss(0, 0.2) for _ in range(8)] for _ in range(12)]
    rows = [(k, [x + rnd.gauss(0, 0.01) for x in rnd.choice(vectors)], rnd.choice([0, 1, 2, 9, None])) for k in range(-300, 300, 3)]
    rows += [(1200, None, 1), (1300, [0.1, None], 1), (1400, [float("nan")], 2), (1500, [float("inf")] * 8, 2), (1600, [], 1), (None, vectors[0], 1), *[(0, vectors[1], 1)] * 3]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnsRenamed({}).selectExpr("*", "'x' AS id", "1 AS vector").write.parquet(f"{tmp_path}/embeddings.parquet")
    own = []
    for i, v, lab in rows:
        if v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in v], i is not None and i % 100 == 0))
    made = sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in named(spark, tmp_path, "op12")), key=key)
    assert made == brute_negatives(own) and made


def test_negatives_of_empty_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert hard_negatives.mine(none).collect() == [] and hard_negatives.mine(spark.createDataFrame([(1, 1, [1], False), (2, 1, [], None)], ROWS)).collect() == []


# conversations


def fault_of(rows):
    """Faults of (turn, role, text) in order."""
    seen, found = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def brute_repair(rows):
    """All sequences of up to two insertions and an edit a row, whole; for short conversations."""
    faults = fault_of(rows)
    best = None

    def walk(k, cost, edits, kept):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(rows):
            for n in range(3):
                more = [(r, "") for r in itertools.islice(itertools.cycle(["user", "assistant"] if not kept or kept[-1][0][:1] != "u" else ["assistant", "user"]), n)]
                whole = [*kept, *more]
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in whole)):
                    best = min(x for x in (best, (cost + 3 * n, edits + "I" * n, whole)) if x)
            return
        _, role, text = rows[k]
        walk(k + 1, cost + 4, edits + "D", kept)
        if faults[k] not in ("blank", "duplicate"):
            extra = 3 * (faults[k] == "truncated")
            for n in range(3):
                for new in itertools.product(["user", "assistant"], repeat=n):
                    start = [*kept, *[(r, "") for r in new]]
                    walk(k + 1, cost + 3 * n + extra, edits + "I" * n + "K", [*start, (role, text)])
                    for to in ("user", "assistant"):
                        if re.fullmatch("(s?(ua)*u?)?", "".join(r[:1] or "?" for r, _ in [*start, (to, text)])):
                            walk(k + 1, cost + 3 * n + 3 + extra, edits + "I" * n + "R", [*start, (to, text)])

    walk(0, 0, "", [])
    return best


def plain_repair(rows):
    """Least (cost, edits) by whole strings for each state, without a tree or pruning."""
    faults, ways = fault_of(rows), {"": (0, "")}
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    for (_, role, _), fault in zip(rows, faults):
        new = {}

        def offer(state, cost, edits):
            if state not in new or (cost, edits) < new[state]:
                new[state] = cost, edits

        for state, (cost, edits) in ways.items():
            offer(state, cost + 4, edits + "D")
            if fault in ("blank", "duplicate"):
                continue
            at, extra = state, 3 * (fault == "truncated")
            for n in range(3):
                if role[:1] in step[at]:
                    offer(step[at][role[:1]], cost + 3 * n + extra, edits + "I" * n + "K")
                to = "a" if at == "u" else "u"
                offer(to, cost + 3 * n + 3 + extra, edits + "I" * n + "R")
                at = to
        ways = new
    ends = []
    for state, (cost, edits) in ways.items():
        ends += [(cost + 3 * n, edits + "I" * n) for n in range(3) if (state, n) in (("", 0), ("", 2), ("s", 2), ("u", 1), ("a", 0), ("a", 2))]
    return min(ends)


def streamed(rows):
    talk = conversation_repair.Talk(1)
    given = []
    for (turn, role, text), fault in zip(rows, fault_of(rows)):
        bare = text.strip(SPACES)
        given += talk.add(turn, role, text, not bare, fault == "duplicate", bool(bare) and bare[-1] not in ".!?")
    summary, rest = talk.end()
    return summary, given + rest, talk.repair.most_pending


def talk_of(rnd, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", " ", "other"]
    texts = ["a.", "b!", "c", "", " \n", "d?  ", "e. f", "g.", "h?", "i\u2028"]
    return [(k, roles[k % 2] if rnd.random() < 0.6 else rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.7 else f"{k}.") for k in range(n)]


def digest(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def test_repair_by_brute_force():
    rnd = random.Random(3)
    for _ in range(250):
        rows = talk_of(rnd, rnd.randint(1, 5))
        cost, edits, whole = brute_repair(rows)
        summary, given, _ = streamed(rows)
        assert (summary[6], summary[7], summary[8]) == (cost, edits, digest(whole)), rows
        assert [(r, t) for _, place, _, r, t, _ in given if place is not None] == whole and plain_repair(rows) == (cost, edits)


def test_long_conversations_hold_few_rows():
    rnd = random.Random(4)
    for kind in range(4):
        rows = talk_of(rnd, 3000) if kind < 2 else [(k, "user" if kind == 2 else "assistant", f"{k}.") for k in range(3000)]
        summary, _, pending = streamed(rows)
        assert summary[6:8] == plain_repair(rows) and (kind > 1 or pending < 60)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_op13_by_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(c, t, r, x) for c in [*range(40), 1 << 60] for t, r, x in talk_of(rnd, rnd.randint(1, 6))]
    rows += [(None, None, None, None), (None, 2, "user", "x."), (50, None, "user", "hm."), (50, None, "assistant", None), (50, 9, "user", "hm."), (51, (1 << 55) + 1, None, "y"), *rows[:7]]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "1 AS seen", "2 AS copy", "3 AS kind").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    talks = {}
    for c, t, r, x in rows:
        own = talks.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(kind, x)
        own += [(t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    made = {r["conv_id"]: r for r in named(spark, tmp_path, "op13")}
    assert set(made) == set(talks) and any(not own for own in talks.values())
    for c, own in talks.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns, faults, initials = [t for t, _, _ in own if t is not None], fault_of(own), [r[:1] for _, r, _ in own]
        cost, edits, whole = brute_repair(own) if own else (0, "", [])
        assert made[c] == {
            "conv_id": c, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": edits, "repaired_sha256": digest(whole),
        }
    rows = conversation_repair.repaired_rows(conversation_repair.damaged(spark.createDataFrame(rows, CONVERSATIONS))).collect()
    assert {c: "".join(r["edit"] for r in sorted((r for r in rows if r["conv_id"] == c and r["edit"] == "D"), key=str)).count("D") for c in talks} == {c: made[c]["audit"].count("D") for c in talks}


def test_repair_of_empty_tables(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert conversation_repair.repair(none).collect() == [] and conversation_repair.repaired_rows(none).collect() == []
