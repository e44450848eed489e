"""The document operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import uuid
import zlib
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkmine.llm import bits, components, exact_dedup, jaccard_join, mixing, packing, personal_data, quality, sketches, token_counts, token_files, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ALPHABET = "abc ABC é漢🙂'’.,!?<|>0123 \n\tdstrevml ñ_~\x85"


def noise(n, size, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def table(spark, texts, ids=None, sources=None):
    rows = [(ids[k] if ids else k, t, "en", sources[k] if sources else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def library_ids(texts):
    made = tokens.library(tokens.default_path()).encode_batch(list(texts), add_special_tokens=False)
    return [np.array(x.ids, "<u4") for x in made]


def odd(spark):
    """Null and repeated rows, null ids, empty and blank texts, ties, a long text, and columns
    whose names operators might use."""
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "one two three"), (4, "one two three"), (None, "one two  three"), (None, None), (5, "word " * 9000), (6, "x" * 70_000), (7, "mail a@b.co")]
    df = spark.createDataFrame([(d, t, "en", None if d == 3 else "s", 1) for d, t in rows], SCHEMA)
    clash = ("k", "n", "root", "length", "score", "start", "bucket", "taken", "rid", "size", "order", "kept", "shingle", "position", "spans")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(clash)])


def labels(spark, n, quality_of=lambda k: 1, toxic_of=lambda k: 0):
    return spark.createDataFrame([(k, quality_of(k), toxic_of(k)) for k in range(n)], "doc_id long, quality int, toxic int")


def test_encoder_is_the_library():
    texts = [*noise(3000, 60), "a<|endoftext|>b <|startoftext|>", "don't we'll", "x" * 300 + "!" * 300, "".join(map(chr, range(33, 0x180))), "ΣΑΣ İI"]
    made = [tokens.encoder(tokens.default_path()).packed(t) for t in texts]
    assert made == [x.tobytes() for x in library_ids(texts)]


@pytest.mark.parametrize("stride, overlap", [(200, 40), (64, 8)])
def test_token_counts(spark, stride, overlap):
    texts = [*noise(60, 900), "", None, "y" * 2000, "wide  " * 400, ("z" * 150 + " ") * 20]
    df = table(spark, texts)
    made = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df, huge_chars=100, stride=stride, overlap=overlap).collect()}
    plain = [t or "" for t in texts]
    assert made == {k: (len(t.encode()), len(x)) for k, (t, x) in enumerate(zip(plain, library_ids(plain)))}


def one_by_one(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= n]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_best_fit_decreasing_is_the_rule_one_by_one():
    rnd = random.Random(2)
    for _ in range(200):
        capacity = rnd.randint(5, 60)
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        fill: dict[int, list] = {}
        for n, moves in packing.best_fit_decreasing(counts, capacity).items():
            for rank in range(counts[n]):
                first, base, each, offset = [m for m in moves if m[0] <= rank][-1]
                fill.setdefault(base + (rank - first) // each, []).append((offset + (rank - first) % each * n, n))
        for pieces in fill.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in p) for p in fill.values()) == one_by_one(lengths, capacity)


def test_packing(spark):
    texts = [*noise(80, 300), None, "", "word " * 500]
    made = packing.pack(table(spark, texts), capacity=64, salts=4).toPandas()
    want = [np.append(x, packing.END_ID).astype("<u4") for x in library_ids([t or "" for t in texts])]
    for r in made.itertuples():
        piece = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(piece.tobytes()) == r.ids_crc32 and len(piece) == r.length
        assert r.length == 64 or r.start + r.length == len(want[r.doc_id])
    assert made["length"].sum() == sum(map(len, want))
    own = made.sort_values(["sequence_id", "offset"])
    assert (own.groupby("sequence_id")["length"].cumsum() - own["length"] == own["offset"]).all()
    assert own.groupby("sequence_id")["length"].sum().max() <= 64


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes(kind):
    for n in (0, 1, 7, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
        assert (token_files.from_planes(token_files.to_planes(ids, kind)) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files(spark, kind):
    texts = [*noise(60, 400), None, "", "word " * 700]
    ids = [k * 3 % 1009 for k in range(len(texts))]
    made = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.round_trip(table(spark, texts, ids), kind=kind, block=128, shards=5).collect()}
    whole = {d: np.append(x, token_files.END_ID).astype("<u4") for d, x in zip(ids, library_ids([t or "" for t in texts]))}
    at, want = 0, {}
    for d in sorted(whole):
        want[d] = (at, len(whole[d]), zlib.crc32(whole[d].tobytes()))
        at += len(whole[d])
    assert made == want


def test_fingerprints_compose():
    rnd = random.Random(4)
    for _ in range(50):
        a, b = rnd.randbytes(rnd.randint(0, 9000)), rnd.randbytes(rnd.randint(0, 9000))
        assert exact_dedup.combine(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b)) == exact_dedup.fingerprint(a + b)


def test_exact_dedup(spark):
    base = [t for t in noise(40, 200) if t.strip()]
    rnd = random.Random(5)
    texts = [*base, *(t.replace(" ", "  ") for t in base[:15]), *(t + "\n" for t in base[5:12]), "", None, " ", *(rnd.choice(base) for _ in range(30))]
    made = {r["doc_id"]: r for r in exact_dedup.dedup(table(spark, texts), chunk_chars=50).collect()}
    groups: dict[str, list] = {}
    plain = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    for k, p in enumerate(plain):
        groups.setdefault(p, []).append(k)
    for k, p in enumerate(plain):
        keep = min(groups[p], key=lambda d: (-len(texts[d] or ""), d))
        want = (keep, len(groups[p]), k == keep, hashlib.sha256(p.encode()).hexdigest())
        assert tuple(made[k][c] for c in ("keep_id", "group_size", "kept", "text_sha256")) == want


def test_equal_fingerprints_are_compared(spark):
    df = table(spark, ["aaaa bbbb", "aaaabbbb", "aaaa cccc"])
    same = df.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lit(1).cast("long").alias("h1"), F.lit(1).cast("long").alias("h2"), F.when(F.col("doc_id") < 2, 8).otherwise(9).cast("long").alias("n_bytes"))
    assert exact_dedup._unequal(df, same, 4).count() == 0
    assert exact_dedup._unequal(df, same.withColumn("n_bytes", F.lit(8).cast("long")), 4).count() == 1


def brute_components(texts, words, similarity):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


def families(seed, n=12, copies=14):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5)))
    shared = [word() for _ in range(40)]
    out = ["", None, " ", "one", "One", "one two", "ONE  two"]
    for _ in range(n):
        base = [word() for _ in range(rnd.randint(5, 260))]
        for _ in range(rnd.randint(1, copies)):
            own = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 25)):
                own[rnd.randrange(len(own))] = word()
            if rnd.random() < 0.3:
                own = shared + own
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed, words, similarity", [(1, 3, 90), (2, 5, 80), (3, 3, 90)])
def test_jaccard_join(spark, seed, words, similarity):
    texts = families(seed)
    made = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(table(spark, texts), words, similarity).collect()}
    assert made == brute_components(texts, words, similarity)


@pytest.mark.parametrize("n", [60, 256, 300, 400, 1000, 3000])
def test_prefixes_follow_one_order_where_counts_tie(n):
    rnd = np.random.default_rng(n)
    for ranks in ([300], [300, 301], [64, 300]):
        for _ in range(20):
            frequent = np.unique(rnd.integers(-(2**62), 2**62, n + 1))
            rank = rnd.choice(ranks, len(frequent))
            rank[len(rank) // 2] = ranks[0]
            sets = [frequent, np.delete(frequent, len(rank) // 2), np.delete(frequent, rnd.integers(len(frequent)))]
            firsts = [jaccard_join.prefix(own, frequent, rank, 90) for own in sets]
            for own, first in zip(sets, firsts):
                order = sorted(own.tolist(), key=lambda h: (rank[np.searchsorted(frequent, h)], h))
                assert first.tolist() == order[: jaccard_join.prefix_length(len(own), 90)]
            assert len(np.intersect1d(firsts[0], firsts[1])) and len(np.intersect1d(firsts[1], firsts[2]))


def test_signatures_never_hide_a_link():
    rnd = np.random.default_rng(6)
    for kind in (jaccard_join.COARSE, jaccard_join.FINE, jaccard_join.RICH):
        for n in (30, 100, 300, 1200):
            base = rnd.integers(-(2**62), 2**62, n)
            sets = [np.unique(np.concatenate([rnd.choice(base, n - d, replace=False), rnd.integers(-(2**62), 2**62, d)])) for d in rnd.integers(0, max(1, n // 9), 40)]
            block = jaccard_join.Block(np.array([len(s) for s in sets]), [jaccard_join.signature(s, kind).tobytes() for s in sets], np.arange(len(sets)), 90)
            found = {(min(a, b), max(a, b)) for i, j, _ in block.dual() for a, b in zip(i, j)}
            for a in range(len(sets)):
                for b in range(a):
                    both = len(np.intersect1d(sets[a], sets[b]))
                    if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                        assert (b, a) in found


def test_components(spark):
    rnd = random.Random(7)
    edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(110)] + [(1000 + k, 1001 + k) for k in range(60)]
    made = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert made == {x: find(x) for x in nodes}


def jobs_of(spark, run):
    """What `run` returns, and the jobs that it took."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    found = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("at_once", [4, 1 << 18])
def test_components_of_chains_take_few_jobs(spark, monkeypatch, at_once):
    """A task contracts what it reads; chains that lie in many pieces still meet."""
    monkeypatch.setattr(components, "EDGES_AT_ONCE", at_once)
    rnd = random.Random(5)
    edges = [(1000 * c + k, 1000 * c + k + 1) for c in range(5) for k in range(60)] + [(9000, 9001 + k) for k in range(50)] + [(8000, 8000)]
    rnd.shuffle(edges)
    given = spark.createDataFrame(edges + edges[:40], "a long, b long").repartition(7)
    made, jobs = jobs_of(spark, lambda: components.components(given).collect())
    assert sorted(map(tuple, made)) == sorted([(1000 * c + k, 1000 * c) for c in range(5) for k in range(61)] + [(9000 + k, 9000) for k in range(51)])
    assert at_once == 4 or jobs <= 12


def test_bit_tables_are_counted_once_and_hold_eight_bits_to_a_byte(spark):
    rnd = random.Random(3)
    ids = [rnd.getrandbits(63) - (1 << 62) for _ in range(5000)] + [None]
    table, jobs = jobs_of(spark, lambda: bits.bloom(spark.createDataFrame([(x,) for x in ids], "id long"), "id"))
    asked = pd.Series(ids + list(range(5000)), dtype="Int64")
    passed = bits.passes(table, asked)
    assert table.nbytes * 8 == 1 << 17 and jobs <= 4
    assert passed[:5001].all() and passed[5001:].sum() < 500



def test_next_and_edits(spark):
    texts = [*noise(50, 80), None, ""]
    ids = random.Random(8).sample(range(1000), len(texts))
    df = sketches.with_next(table(spark, texts, ids), range_rows=5).withColumn("edit", sketches.edited("text", "next_text"))
    made = {r["doc_id"]: r["edit"] for r in df.collect()}
    order = sorted(zip(ids, (t or "" for t in texts)), reverse=True)
    for k, (d, t) in enumerate(order):
        half = len(t) // 2
        assert made[d] == t[: len(t) - half] + order[(k + 1) % len(order)][1][:half]


def test_sketches(spark):
    long = " ".join(f"w{k}" for k in range(4000))
    df = spark.createDataFrame([(long, long, " ".join(long.split()[:1000]), "other " * 10)], "a string, b string, part string, other string")
    for c in df.columns:
        df = sketches.with_sketch(df, c, f"{c}_s")
    r = df.select(
        "*", sketches.containment("a_s", "b_s").alias("ab"), sketches.containment("a_s", "part_s").alias("ap"), sketches.resemblance("a_s", "part_s").alias("rp"), sketches.containment("a_s", "other_s").alias("ao")
    ).first()
    assert r["a_s"] == r["b_s"] and r["ab"] == 1.0 and r["ap"] > 0.95 and abs(r["rp"] - 0.25) < 0.05 and r["ao"] == 0.0
    assert abs(len(r["a_s"]) / 4000 - sketches.FRACTION) < 0.03


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, (name, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": lambda: True, "ip": lambda: max(map(int, m.group().split("."))) <= 255, "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}
            if good[name]():
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans(spark):
    rnd = random.Random(9)
    parts = ["a@b.c", "x_y@d-e.fg.h", "@", ".", "1.2.3.4", "300.1.1.1", "007.1.2.3", "+1 (415) 555-1234", "+44", "4111 1111 1111 1111", "4111-1111-1111-1112", "5555555555554444", "12", "-", " ", "é", "🙂", "a" * 40, "deadbeef" * 5, "1" * 25, "a@b.c_x@d.e", "+", "\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(400)] + ["", None, "a" * 60_000, "1.1.1.1 " * 3000, "9" * 50_000, "@" * 5000]
    made = {r["doc_id"]: r["spans"] for r in personal_data.find(table(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert [(s["start"], s["kind"], s["end"]) for s in made[k] if s["base"]] == base_spans(t or ""), t


def test_secrets_are_added(spark):
    rnd = random.Random(10)
    secret = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    texts = [f'see token = "{secret()}" here' for _ in range(60)] + ["plain words only"] * 60 + [f"mail u{k}@x.com now" for k in range(60)]
    rows = personal_data.find(table(spark, texts)).collect()
    assert all(bool([s for s in r["spans"] if s["kind"] == 4]) == (r["doc_id"] < 60) for r in rows)


def test_no_python_in_personal_data_or_sketches(spark):
    df = table(spark, noise(5, 30))
    for made in (personal_data.find(df), sketches.compare_with_edits(df)):
        assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().executedPlan().toString())


def prose(n, seed, bad=()):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    out = []
    for k in range(n):
        own = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        if k % 4 == 0 and bad:
            for _ in range(1 + len(own) // 30):
                own[rnd.randrange(len(own))] = rnd.choice(bad) + rnd.choice(["", "x", "ed", "ing"])
        out.append(" ".join(own))
    return out


def test_toxicity_on_held_out_rows(spark):
    texts = prose(900, 11, ["vequza", "grobik", "zzorn"])
    df, marks = table(spark, texts), labels(spark, 900, toxic_of=lambda k: int(k % 4 == 0))
    made = {r["doc_id"]: r["score"] for r in toxicity.score(df, marks).collect()}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1]
    right = [(made[k] >= toxicity.THRESHOLD) == (k % 4 == 0) for k in held]
    assert sum(right) / len(right) > 0.97
    assert toxicity.ordinary(df, marks).columns == df.columns


def test_labels_of_held_out_rows_teach_nothing(spark):
    texts = prose(300, 12, ["vequza"])
    held = {k for k in range(300) if zlib.crc32(str(k).encode()) % 3 == 1}
    df = table(spark, texts)
    a = toxicity.score(df, labels(spark, 300, toxic_of=lambda k: int(k % 4 == 0)))
    b = toxicity.score(df, labels(spark, 300, toxic_of=lambda k: int((k % 4 == 0) != (k in held))))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def brute_ratios(texts, marks):
    """Word: log ratio of two Kneser-Ney models, one n-gram after the other."""
    size, short, own, every, ends = toxicity.ORDER, toxicity.SHARED_ORDER, ({}, {}), {}, {}

    def parts(w, n):
        s = "^" * (n - 1) + w + "$"
        return [s[i : i + n] for i in range(len(s) - n + 1)]

    for k, text in enumerate(texts):
        for w in set(re.findall(r"[^\W\d_]+", text.lower())):
            for g in parts(w, short):
                every[g] = every.get(g, 0) + 1
            for g in parts(w, size) if k in marks else ():
                own[marks[k]][g] = own[marks[k]].get(g, 0) + 1
    for g in every:
        ends[g[1:]] = ends.get(g[1:], 0) + 1

    def shared(g):
        after, lower = [x for h, x in every.items() if h[:-1] == g[:-1]], [x for h, x in ends.items() if h[:-1] == g[1:-1]]
        return (max(every[g] - toxicity.SHARED_DISCOUNT, 0) + toxicity.SHARED_DISCOUNT * len(after) * ends[g[1:]] / sum(lower)) / sum(after)

    def word(w):
        total = 0.0
        for g in parts(w, size):
            p, q = shared(g[size - short :]), []
            for counts in own:
                after = [x for h, x in counts.items() if h[:-1] == g[:-1]]
                q.append((max(counts.get(g, 0) - 1, 0) + len(after) * p) / sum(after) if after else p)
            total += np.log(q[1] / q[0])
        return total

    return {w: word(w) for t in texts for w in set(re.findall(r"[^\W\d_]+", t.lower()))}


@pytest.mark.parametrize("entries", [10**9, -1])
def test_toxicity_is_kneser_ney_word_by_word(spark, monkeypatch, entries):
    monkeypatch.setattr(toxicity, "BROADCAST_ENTRIES", entries)
    texts = [" ".join(t.split()[:6]) for t in prose(80, 13, ["vequza"])] + ["", "42 ..."]
    marks = labels(spark, 60, toxic_of=lambda k: int(k % 4 == 0))  # the last rows have no label
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(toxicity.CALIBRATION))
    taught = {r["doc_id"]: r["toxic"] for r in marks.filter(f"not ({toxicity.HELD_OUT})").filter(fold != 0).collect()}
    ratio = brute_ratios(texts, taught)
    model = toxicity.fit(table(spark, texts), marks, train_docs=4)
    if entries > 0:
        words = sorted(ratio)
        assert model.shared.value.words(words) == pytest.approx(toxicity.mixed(np.array([ratio[w] for w in words])), abs=1e-5)
    made = {r["doc_id"]: r["toxicity__raw"] for r in model.raw(table(spark, texts)).collect()}
    for k, t in enumerate(texts):
        own = set(re.findall(r"[^\W\d_]+", t.lower()))
        want = sum(toxicity.mixed(np.array([ratio[w]]))[0] for w in own) / (len(own) + toxicity.SHRINK)
        assert made[k] == pytest.approx(want, abs=1e-5)


def test_quality_on_held_out_rows(spark):
    texts = [t.upper().replace(" ", "!! ") if k % 5 == 0 else t for k, t in enumerate(prose(600, 13))]
    made = {r["doc_id"]: r["score"] for r in quality.score(table(spark, texts), labels(spark, 600, quality_of=lambda k: int(k % 5 != 0)), pairs=4000).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((made[k] >= 0.5) == (k % 5 != 0) for k in held) / len(held) > 0.97


def test_targets():
    made = mixing.targets({"b": 100, "a": 1000, None: 10, "c": 500})
    assert [s for s in made] == ["a", "b", "c", None]
    assert sum(t for _, t in made.values()) == pytest.approx(1.5 * 1610)
    assert made["b"][1] == 200 and made[None][1] == 20 and all(t <= 2 * n + 1e-9 for (_, t), n in zip(made.values(), (1000, 100, 500, 10)))


def test_mixing(spark):
    texts = [" ".join(["w"] * (k % 50)) for k in range(600)] + [None]
    df = table(spark, texts, sources=[None if k % 7 == 0 else "abc"[k % 3] for k in range(601)])
    a, b = ([tuple(r) for r in mixing.mix(df).orderBy("doc_id").collect()] for _ in range(2))
    assert a == b
    own: dict = {}
    for r in mixing.mix(df).collect():
        s = own.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        s[2], s[3] = s[2] + r["size"], s[3] + r["taken"]
        assert r["taken"] <= 2 * r["size"] and len(r["positions"]) in (0, 1, 2) and all(0 <= p <= 1 for p in r["positions"])
    for size, target, total, taken in own.values():
        assert size == total and abs(taken - target) <= 0.01 * target + 1
    made = mixing.mixed_documents(df)
    assert made.columns == df.columns


def test_schedule_is_inverted(spark):
    times, factors, sums = mixing.integrated(((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
    df = spark.createDataFrame([(k / 20, times, factors, sums) for k in range(21)], "share double, times array<double>, factors array<double>, sums array<double>")
    for r in df.select("share", mixing.inverted(F.col("share")).alias("t")).collect():
        grid = np.linspace(0, r["t"], 2001)
        assert np.trapezoid(np.interp(grid, times, factors), grid) == pytest.approx(r["share"], abs=1e-4)


OPERATORS = {
    "counts": (lambda df, m: token_counts.count_tokens(df), True), "private": (lambda df, m: personal_data.find(df), True), "toxic": (lambda df, m: toxicity.score(df, m), True),
    "quality": (lambda df, m: quality.score(df, m, pairs=100), True), "pack": (lambda df, m: packing.pack(df, capacity=64), False), "near": (lambda df, m: jaccard_join.similarity_classes(df), True),
    "copies": (lambda df, m: exact_dedup.dedup(df), True), "sketch": (lambda df, m: sketches.compare_with_edits(df).select("doc_id"), True),
    "files": (lambda df, m: token_files.round_trip(df), True), "mix": (lambda df, m: mixing.mix(df), True),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    apply, a_row_each = OPERATORS[name]
    df, marks = odd(spark), labels(spark, 8, lambda k: k % 2, lambda k: k % 2)
    made = apply(df, marks).collect()
    assert len(made) == df.count() if a_row_each else len(made) >= df.count()
    assert apply(df.limit(0), marks).count() == 0
    assert apply(df, marks.limit(0)).count() == len(made)


def test_shifted_checksums_join():
    rnd = random.Random(31)
    for _ in range(200):
        parts = [rnd.randbytes(rnd.choice([0, 1, 4, 70, 4096, 300_000])) for _ in range(rnd.randint(1, 4))]
        whole, joined, after = b"".join(parts), 0, 0
        for part in reversed(parts):
            joined ^= token_files.moved_crc(zlib.crc32(part), after)
            after += len(part)
        assert joined == zlib.crc32(whole)


def test_words_of_two_letters_hash_apart():
    x, y, words = "a", "b", set()
    for _ in range(13):
        words |= {x, y}
        x, y = x + y, y + x
    assert len(set(jaccard_join.word_hashes(" ".join(sorted(words))).tolist())) == len(words)


@pytest.mark.parametrize("seed, rows", [(1, 5), (4, 3)])
def test_jaccard_join_of_split_blocks(spark, monkeypatch, seed, rows):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", rows)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 4)
    texts = families(seed, n=5, copies=24)
    made = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(table(spark, texts)).collect()}
    assert made == brute_components(texts, 3, 90)


def test_shared_rows_come_out_once():
    rnd = random.Random(14)
    for _ in range(200):
        rows = sorted((rnd.randint(0, 6), rnd.choice([0, 0, 1]), rnd.randint(0, 3)) for _ in range(rnd.randint(0, 30)))
        rows = [(s, p * (s % 2), k) for s, p, k in rows]
        rows.sort()
        cuts = sorted(rnd.sample(range(len(rows) + 1), min(len(rows), 4)))
        import pandas as pd

        frames = [pd.DataFrame(rows[a:b], columns=["shingle", "part", "k"]) for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        made = [tuple(r) for f in jaccard_join._shared(iter(frames)) for r in f.itertuples(index=False)]
        each = sorted(set(rows))
        want = [(s, k) for s, p, k in each if p or sum(s == t for t, _, _ in each) > 1]
        assert sorted(made) == sorted(want)


def test_one_of_each_keeps_one_row(spark):
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(None, base), (None, base + " "), (1, base), (1, base), (1, "other words stand here alone now"), (2, base + " more"), (3, None), (3, ""), (3, " "), (None, "single text of a row without id"), (5, "single text of a row without id")]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    made = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(df, 5, 80).collect()), key=repr)
    want = [(1, base), (1, "other words stand here alone now"), (3, None), (3, ""), (3, " "), (5, "single text of a row without id")]
    assert made == sorted(want, key=repr)
    assert jaccard_join.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("order", [6, 8])
def test_ngrams_are_counted(monkeypatch, order):
    monkeypatch.setattr(toxicity, "MATRIX_WORDS", 100)
    rnd = random.Random(order)
    words = {"".join(rnd.choice("abé漢𐐀") for _ in range(rnd.choice([1, 2, 3, 8, 39, 40, 41, 90]))): rnd.randint(1, 9) for _ in range(700)}
    want = {}
    for w, n in words.items():
        for g in toxicity.grams(w, order):
            want[g] = want.get(g, 0) + n
    made = {}
    for g, n in zip(*toxicity.counted(words, order)):
        made[g] = made.get(g, 0) + int(n)
    assert made == want


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string(), pa.binary(), pa.large_binary()])
def test_values_are_views_of_any_slice(kind):
    texts = ["", "a b c", "größe 漢字 🙂", "", "x" * 70_000]
    column = pa.array(texts, kind)
    for at in range(len(texts) + 1):
        for size in range(len(texts) + 1 - at):
            made = [x.tobytes().decode() for x in jaccard_join._values(column.slice(at, size))]
            assert made == texts[at : at + size]
    assert list(jaccard_join._values(pa.array([], kind))) == []
    assert [x.tobytes() for x in jaccard_join._values(pa.array(["", ""], kind))] == [b"", b""]


def test_sets_of_arrow_batches_equal_those_of_texts():
    texts = ["", " \t", "One two", "a b c d a b c e", "größe 漢字 🙂 x y"] * 500
    ids = [None, (1 << 60) + 1, 3, 4, 5] * 500
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text_hash", "text"])
    rows = [r for b in jaccard_join._read_sets(0, 3, 90)(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["text_hash"]) for r in rows] == list(zip(ids, range(len(texts))))
    for text, r in zip(texts, rows):
        own = jaccard_join.shingles(text)
        assert (r["k"], r["k2"], r["n"]) == (*jaccard_join.set_key(own, 0), len(own))
        assert r["bits"] == jaccard_join.signature(own).tobytes() and r["fine"] == jaccard_join.signature(own, jaccard_join.FINE).tobytes()
        assert r["probe"] == own[: jaccard_join.prefix_length(len(own), 90) * jaccard_join.PROBE // 100 if len(own) else 0].tolist()


def test_chosen_finds_great_ids_beside_null():
    """Ids beyond 2^53 are exact where others of the batch are null."""
    ids, table = [None, (1 << 60) + 1, 7], np.zeros(1 << 12, bool)
    table[((1 << 60) + 1) % (len(table) - 1)] = True
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(["n n n", "g g g", "s s s"])], ["doc_id", "text"])
    made = jaccard_join._chosen(0, 3, SimpleNamespace(value=table), np.asarray)(iter([batch]))
    want = {jaccard_join.set_key(own, 0)[0]: own.tobytes() for own in map(jaccard_join.shingles, ["n n n", "g g g"])}
    assert {r["k"]: r["form"] for b in made for r in b.to_pylist()} == want


def test_shared_rows_have_a_neighbour_in_size():
    """Of a shingle, classes that are near another in size come out once each, wherever batches end."""
    import pandas as pd

    rnd = random.Random(15)
    for _ in range(200):
        size = {k: rnd.choice([10, 11, 12, 30, 31, 60]) for k in range(8)}
        rows = sorted((s, s % 2 * rnd.choice([1, 2]) if s > 4 else 0, size[k], k) for s, k in ((rnd.randint(0, 6), rnd.randint(0, 7)) for _ in range(rnd.randint(0, 30))))
        cuts = sorted(rnd.sample(range(len(rows) + 1), min(len(rows), 4)))
        frames = [pd.DataFrame(rows[a:b], columns=["shingle", "part", "n", "k"]) for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        made = [tuple(r) for f in jaccard_join._shared(iter(frames), 90) for r in f.itertuples(index=False)]
        each = sorted(set(rows))
        near = lambda x, y: 100 * min(x, y) >= 90 * max(x, y)
        want = [(s, k) for s, p, n, k in each if p or any(s == t and k != j and near(n, m) for t, _, m, j in each)]
        assert sorted(made) == sorted(want)


def test_open_blocks_keep_members_near_another_component(spark):
    rnd = random.Random(16)
    rows = [(s, k, rnd.choice([10, 11, 12, 13, 40, 43, 46, 90]), rnd.choice([1, 1, 1, 2, 3])) for s in range(40) for k in range(rnd.randint(1, 12))]
    made = jaccard_join._near_others(spark.createDataFrame(rows, "shingle long, k long, n int, root long"), 90).collect()
    near = lambda x, y: 100 * min(x, y) >= 90 * max(x, y)
    want = [(s, k, n, r) for s, k, n, r in rows if any(s == t and r != q and near(n, m) for t, _, m, q in rows)]
    assert sorted(map(tuple, made)) == sorted(want) and 0 < len(want) < len(rows)


def test_toxic_ratios_hold_words_of_few_texts(monkeypatch):
    """A batch of many texts costs no more than some of them at once, with the same scores."""
    import tracemalloc

    rnd = random.Random(17)
    words = ["".join(rnd.choices("abcdefghij", k=7)) for _ in range(3000)]
    texts = [" ".join(rnd.choices(words, k=200)) for _ in range(3000)]
    keys = toxicity.string_keys(["^^^^^" + w[:2] for w in words])
    ratios = lambda: toxicity.Ratios(np.unique(keys), np.linspace(-2, 2, len(np.unique(keys)), dtype=np.float32))
    made = ratios().texts(texts[:600])
    monkeypatch.setattr(toxicity, "TEXTS_AT_ONCE", 1 << 30)
    monkeypatch.setattr(toxicity, "MATRIX_ROWS", 1 << 30)
    assert made == ratios().texts(texts[:600]) and len(set(made)) > 100
    monkeypatch.undo()
    tracemalloc.start()
    ratios().texts(texts)
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()


@pytest.mark.parametrize("nearest", [True, False])
def test_later_round_holds_few_pairs_at_once(monkeypatch, nearest):
    """A block of many likely pairs is given out, or sifted, piece by piece, with the same pairs."""
    import pandas as pd

    rnd = random.Random(18)
    base = [rnd.getrandbits(63) for _ in range(60)]
    sets = [np.unique(np.array([*base, rnd.getrandbits(63), rnd.getrandbits(63)], np.int64)) for _ in range(90)]
    frame = pd.DataFrame({"shingle": 1, "x": 0, "y": 0, "k": rnd.sample(range(1000), 90), "root": range(90), "n": [len(x) for x in sets], "bits": [jaccard_join._rich(x).tobytes() for x in sets]})

    def made():
        frames = list(jaccard_join._later_round(90, nearest)(iter([frame])))
        rows = pd.concat(frames).astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None)
        return sorted(set(rows), key=repr), max(map(len, frames))

    whole, most = made()
    monkeypatch.setattr(jaccard_join, "PAIRS_AT_ONCE", 300)
    again, fewer = made()
    assert again == whole and len(whole) > 40
    assert nearest or most == 90 * 89 // 2 and fewer < 600


def test_toxic_counts_cut_each_word_once(spark, monkeypatch):
    """Rows that repeat words in many tasks are no more n-grams to cut than their words alone."""
    import pandas as pd

    rnd = random.Random(19)
    words = list({"".join(rnd.choices("abcdé漢", k=rnd.choice([1, 3, 7, 9, 45]))) for _ in range(300)})
    rows = [(" ".join(rnd.choices(words, k=40)) + ", 7_x", k % 3) for k in range(240)]
    used, want = {}, {}
    for text, kind in rows:
        for w in toxicity.words_of(text):
            used.setdefault(w, [0, 0, 0])[kind] += 1
    for w, (ordinary, toxic, other) in used.items():
        for n, order, at in ((ordinary, toxicity.ORDER, 0), (toxic, toxicity.ORDER, 1), (ordinary + toxic + other, toxicity.SHARED_ORDER, 2)):
            for g in toxicity.grams(w, order) if n else ():
                want.setdefault(g, [0, 0, 0])[at] += n
    df = spark.createDataFrame(rows, "text string, toxic int").repartition(8)
    assert {g: n for g, *n in toxicity.gram_counts(df).collect()} == want

    cut, counted = [], toxicity.counted
    monkeypatch.setattr(toxicity, "counted", lambda own, order: (cut.extend((w, order) for w in own), counted(own, order))[1])
    monkeypatch.setattr(toxicity, "COUNT_WORDS", 50)
    tasks = [pd.concat(toxicity._count_words(iter([pd.DataFrame(rows[k::8], columns=["text", "toxic"])]))) for k in range(8)]
    summed = pd.concat(tasks).groupby("word", as_index=False).sum()
    monkeypatch.setattr(toxicity, "GRAM_WORDS", 100)
    made = pd.concat(toxicity._count_grams(summed[k : k + 60] for k in range(0, len(summed), 60))).groupby("gram").sum()
    assert {g: n.tolist() for g, n in zip(made.index, made.to_numpy())} == want
    assert len(cut) == sum((a > 0) + (b > 0) + 1 for a, b, _ in used.values())
