"""The contract queries, as registered, against brute force over a small folder of tables."""

import hashlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from talkmine.llm import mixing, quality, sketches, token_files

from .test_operators import SCHEMA, base_spans, brute_components, families, library_ids, noise, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(41)
    texts = [*families(42, n=3, copies=5), *noise(25, 300, 43), *prose(40, 44, ["vequza"]), "mail a.b@c.de or +49 170 1234567, card 4111 1111 1111 1111 at 10.0.0.1", "word " * 2100, None, "", " \n"]
    texts += [rnd.choice([t for t in texts if t]) + " " for _ in range(6)]
    rows = [(k * 7 % 1009, t, "en", [None, "b", "a", "c"][k % 4], len(t or "")) for k, t in enumerate(texts)]
    to = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{to}/documents.parquet")
    marks = [(d, int("!" not in (t or "")), int("vequza" in (t or ""))) for d, t, *_ in rows]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return str(to), {d: t or "" for d, t, *_ in rows}, {d: s for d, _, _, s, _ in rows}


def result(spark, tables, name):
    found = [k for k in entry.queries() if k.startswith(f"{name}_")]
    assert len(found) == 1
    return [r.asDict() for r in entry.queries()[found[0]](spark, tables[0]).collect()]


def test_op1(spark, tables):
    texts = tables[1]
    n = {d: len(x) for d, x in zip(texts, library_ids(texts.values()))}
    made = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in result(spark, tables, "op1")}
    assert made == {d: (len(t.encode()), n[d], n[d] > 2048) for d, t in texts.items()} and any(x > 2048 for x in n.values())


def test_op2(spark, tables):
    kinds = ("email", "ip", "card", "phone")
    made = {r["doc_id"]: r for r in result(spark, tables, "op2")}
    assert set(made) == set(tables[1])
    for d, t in tables[1].items():
        own = base_spans(t)
        listed = [f"{kinds[k]}:{a}:{b}" for a, k, b in own]
        assert [made[d][f"n_{k}"] for k in kinds] == [sum(x[1] == k for x in own) for k in range(4)]
        assert made[d]["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = made[d]["spans"].split(",") if made[d]["spans"] else []
        assert [s for s in spans if s in listed] == listed and [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


@pytest.mark.parametrize("name, line", [("op3", 0.7), ("op4", 0.5)])
def test_op3_and_op4(spark, tables, name, line):
    rows = result(spark, tables, name)
    assert sorted(r["doc_id"] for r in rows) == sorted(tables[1])
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= line)


def test_bradley_terry_is_at_the_least_loss():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, quality.N_FEATURES))
    good = (x[:, 0] + 0.3 * rng.normal(size=60) > 0).astype(int)
    made = quality.Ranking(x, good, pairs=500)
    wide = quality.widened(x, x.mean(0), np.maximum(x.std(0), 1e-6))
    rng = np.random.default_rng(5)
    better, worse = rng.choice(np.flatnonzero(good == 1), 500), rng.choice(np.flatnonzero(good == 0), 500)

    def loss(w):
        return sum(np.log1p(np.exp(-(wide[a] - wide[b]) @ w)) for a, b in zip(better, worse)) / 500 + quality.RIDGE * w @ w / 2

    least = loss(made.w)
    for _ in range(20):
        assert loss(made.w + 1e-2 * rng.normal(size=len(made.w))) > least
    scores = sorted(wide @ made.w)
    assert scores[0] <= made.threshold <= scores[-1]
    assert abs(np.mean(wide @ made.w < made.threshold) - np.mean(good == 0)) <= 1 / 60 + 1e-9


def test_op5(spark, tables):
    ids = {d: np.append(x, 1).astype("<u4") for d, x in zip(tables[1], library_ids(tables[1].values()))}
    rows = result(spark, tables, "op5")
    by_doc, by_sequence = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["start"] == 4096 * r["piece"]
        by_doc.setdefault(r["doc_id"], []).append(len(part))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {d: sum(x) for d, x in by_doc.items()} == {d: len(x) for d, x in ids.items()}
    for pieces in by_sequence.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 4096
    lengths, bins = sorted((r["length"] for r in rows), reverse=True), []
    for n in lengths:
        fit = [k for k in range(len(bins)) if bins[k] >= n]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= n
        else:
            bins.append(4096 - n)
    assert len(by_sequence) == len(bins)


def test_op6(spark, tables):
    ids = sorted(tables[1])
    want = {ids[k]: (n, ids[c]) for k, (n, c) in brute_components([tables[1][d] for d in ids], 3, 90).items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result(spark, tables, "op6")} == want


def test_op7_and_its_sql(spark, tables):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tables[0]}/documents.parquet/*.parquet'")
    sql = entry.oracle_sql()[next(k for k in entry.oracle_sql() if k.startswith("op7"))]
    want = con.sql(sql)
    assert sorted(sorted(r.items()) for r in result(spark, tables, "op7")) == sorted(sorted(zip(want.columns, r)) for r in want.fetchall())


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values):
    """What Spark's xxhash64 gives: one value after the other, each seeded by the one before."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v) if v is not int else b""
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def brute_sketch(text):
    words = [signed(spark_hash(w)) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    n = max(1, len(words) - sketches.SHINGLE + 1)
    hashes = {signed(spark_hash(*words[k : k + sketches.SHINGLE])) for k in range(n)} if words else set()
    return {h for h in hashes if h < sketches.threshold(sketches.FRACTION)} | ({min(hashes)} if hashes else set())


def likeness(a, b):
    return len(a & b) / min(len(a), len(b)) if a and b else float(a == b)


def test_op8(spark, tables):
    texts, made = tables[1], {r["doc_id"]: r for r in result(spark, tables, "op8")}
    order = sorted(texts, reverse=True)
    for k, d in enumerate(order):
        t, after = texts[d], texts[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = map(brute_sketch, (t, edited, after))
        r = made[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        listed = lambda s: ",".join(f"{h & (2**64 - 1):x}" for h in sorted(s))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (listed(a), listed(b))
        assert (r["near_edited"], r["near_next"]) == pytest.approx((likeness(a, b), likeness(a, c)))


def test_sketches_merge(spark):
    a, b = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(4))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    for c in "ab":
        df = sketches.with_sketch(df, c, f"{c}_s")
    made = df.select(sketches.merged("a_s", "b_s").alias("m")).first()["m"]
    hashes = {signed(spark_hash(*w)) for t in (a, b) for w in [[signed(spark_hash(x)) for x in t.split()]] for w in ([w[k : k + 5] for k in range(max(1, len(w) - 4))])}
    assert made == sorted({h for h in hashes if h < sketches.threshold(sketches.FRACTION)} | {min(hashes)})


def test_op9(spark, tables):
    ids = {d: np.append(x, token_files.END_ID).astype("<u4") for d, x in zip(tables[1], library_ids(tables[1].values()))}
    at, want = 0, {}
    for d in sorted(ids):
        want[d] = (at, len(ids[d]), zlib.crc32(ids[d].tobytes()))
        at += len(ids[d])
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in result(spark, tables, "op9")} == want


def time_of(share, knots):
    """When the integral of a schedule reaches `share` of its whole, by bisection."""
    grid = np.linspace(0, 1, 20_001)
    values = np.interp(grid, [t for t, _ in knots], [v for _, v in knots])
    sums = np.concatenate([[0], np.cumsum((values[1:] + values[:-1]) / 2 * np.diff(grid))])
    return float(np.interp(share * sums[-1], sums, grid))


def test_op10(spark, tables):
    _, texts, sources = tables
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in texts.items()}
    whole = {s: sum(size[d] for d in texts if sources[d] == s) for s in set(sources.values())}
    targets = mixing.targets(whole)
    made = {r["doc_id"]: r for r in result(spark, tables, "op10")}
    assert set(made) == set(texts)
    for s, (weight, target) in targets.items():
        def order(d):
            seeded = xxhash.xxh64_intdigest(struct.pack("<i", 1), spark_hash(d, texts[d]))
            return seeded

        docs = sorted((d for d in texts if sources[d] == s), key=lambda d: (order(d), d))
        passes = min(2, int(target // whole[s])) if whole[s] else 0
        rest, before, run, extra = target - passes * whole[s], {}, 0, []
        for d in docs:
            before[d], run = run, run + size[d]
            if run <= rest:
                extra.append(d)
        met = sum(size[d] for d in extra)
        others = [d for d in docs if d not in extra and abs(rest - met - size[d]) < rest - met]
        closing = min(others, key=lambda d: (abs(rest - met - size[d]), signed(order(d)), d), default=None)
        all_taken = passes * whole[s] + met + (size[closing] if closing is not None else 0)
        for d in docs:
            copies = passes + (d in extra or d == closing)
            r = made[d]
            assert (r["size"], r["source_size"], r["taken"]) == (size[d], whole[s], copies * size[d]) and r["target"] == pytest.approx(target)
            places = [p * whole[s] + (met if d == closing and p == passes else before[d]) for p in range(copies)]
            want = [time_of((x + size[d] / 2) / all_taken if all_taken else 0.0, mixing.SCHEDULES[weight]) for x in places]
            assert r["positions"] == pytest.approx(want, abs=2e-4)
