"""Audio operators over long recordings: blocks of any size give what plain loops give."""

import random

import numpy as np
import pytest

from talkmine.operators import audio, blocks


@pytest.fixture(scope="module")
def recordings():
    rnd = random.Random(5)
    made = {}
    for rec, n in enumerate((1, 7, 40, 331, 1203)):
        loud = [rnd.choice([0.001, 0.03, 0.03, 0.05, 0.2, 0.6]) for _ in range(n)]
        rms, at = [], 0
        while len(rms) < n:  # stretches of one level, some longer than a block
            level = rnd.choice([0.001, 0.03, 0.2, 0.6])
            rms += [level * rnd.uniform(0.9, 1.1) if rnd.random() < 0.7 else loud[(at := at + 1) % n] for _ in range(rnd.choice([1, 2, 5, 20, 120]))]
        made[rec] = (rms[:n], [rnd.choice([0.05, 0.1, 0.25]) for _ in range(n)])
    return made


@pytest.fixture(params=[17, 60, 6000])
def feats(spark, recordings, request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", request.param)
    rows = [(rec, i, x, z) for rec, (rms, zcr) in recordings.items() for i, (x, z) in enumerate(zip(rms, zcr))]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "rec_id long, frame_idx long, rms double, zcr double")


def stretches(flags, gap=1):
    out = []
    for i in np.flatnonzero(flags):
        if out and i - out[-1][1] <= gap:
            out[-1][1] = int(i)
        else:
            out.append([int(i), int(i)])
    return out


def median_before(rms, i, back=20):
    return float(np.median(rms[max(0, i - back) : i])) if i else None


def line_of(rms, window, share, step=5):
    anchors = list(range(0, len(rms), step))
    values = [np.percentile(rms[max(0, a - window // 2) : a + window // 2], 100 * share) for a in anchors]
    return np.interp(np.arange(len(rms)), anchors, values)


def test_hotspots(feats, recordings):
    expected = set()
    for rec, (rms, zcr) in recordings.items():
        flags = []
        for i, x in enumerate(rms):
            med = median_before(rms, i) or 0.0
            burst, noisy = med > 1e-4 and x / med > 2.5, zcr[i] >= 0.2
            flags.append(0 if x < 0.1 else 3 if burst and noisy else 2 if noisy else 1 if burst else 0)
        for a, b in stretches(flags):
            if 3 <= b - a + 1 <= 40:
                peak = a + int(np.argmax(rms[a : b + 1]))
                expected.add((rec, a, b, peak, round(rms[peak], 4), round(float(np.mean(rms[a : b + 1])), 4), max(flags[a : b + 1])))
    kinds = ["energy_burst", "high_freq_burst", "strong_anomaly"]
    made = {(r["rec_id"], r["first"], r["last"], r["peak_idx"], r["peak_energy"], r["mean_energy"], kinds.index(r["kind"]) + 1) for r in audio.hotspots(feats).collect()}
    assert made == expected and made


def test_bursts_and_pauses(feats, recordings):
    bursts, silent = set(), set()
    for rec, (rms, _) in recordings.items():
        hits = [i >= 20 and median_before(rms, i) > 0 and x > 0.02 and x / median_before(rms, i) > 3 for i, x in enumerate(rms)]
        bursts |= {(rec, a, b, max(x for x, h in zip(rms[a : b + 1], hits[a : b + 1]) if h)) for a, b in stretches(hits, 5)}
        silent |= {(rec, a, b) for a, b in stretches([x < 0.005 for x in rms]) if b - a >= 14}
    assert {tuple(r) for r in audio.energy_bursts(feats).select("rec_id", "first", "last", "peak").collect()} == bursts and bursts
    assert {tuple(r) for r in audio.pauses(feats).select("rec_id", "first", "last").collect()} == silent and silent


def test_baselines(feats, recordings):
    made = {(r["rec_id"], r["frame_idx"]): (r["wide"], r["near"]) for r in audio.baselines(feats, {"wide": (60, 0.85), "near": (8, 0.5)}).collect()}
    for rec, (rms, _) in recordings.items():
        both = list(zip(line_of(rms, 60, 0.85), line_of(rms, 8, 0.5)))
        assert np.allclose([made[rec, i] for i in range(len(rms))], both, rtol=0, atol=1e-12)
    assert len(made) == sum(len(rms) for rms, _ in recordings.values())


def test_anomalies(spark, feats, recordings):
    spoken = [(4, 10.0, 60.0), (4, 59.95, 60.05), (3, 0.0, 0.05), (2, 3.0, 1.0)]
    expected = set()
    for rec, (rms, _) in recordings.items():
        wide, near = line_of(rms, 600, 0.85), line_of(rms, 80, 0.5)
        for a, b in stretches([x > max(w, 1e-4) * 2 and x > max(m, 1e-4) * 1.8 for x, w, m in zip(rms, wide, near)]):
            peak = a + int(np.argmax(rms[a : b + 1]))
            if 3 <= b - a + 1 <= 40:
                kind = "short_pulse" if b - a + 1 < 8 else "sustained" if round(rms[peak], 4) > wide[peak] * 3.5 else "burst"
                expected.add((rec, a, b, peak, round(rms[peak], 4), round(rms[peak] / wide[peak], 2), kind, any(r == rec and int(s * 10) <= peak < int(e * 10) for r, s, e in spoken)))
    made = audio.anomalies(feats, spark.createDataFrame(spoken, "rec_id long, start double, end double"))
    assert {tuple(r) for r in made.select("rec_id", "first", "last", "peak_idx", "peak", "above", "kind", "speech").collect()} == expected and {x[-1] for x in expected} == {True, False}
    assert audio.anomalies(feats.limit(0)).collect() == []


def test_recordings_of_labels_are_whole(spark, tmp_path, monkeypatch):
    """Frames of a label are numbered on past 100, pauses and bursts cross that place, segments mark all their frames."""
    from talkmine.plans import q_media

    monkeypatch.setattr(blocks.numbered, "__defaults__", (64,))
    quiet = lambda k: 90 <= k < 130
    vecs = [(2 * k, [0.01 if quiet(k) else 0.9 if k == 135 else 0.3] * 4, 0) for k in range(250)] + [(2 * k + 1, [0.3] * 4, 1) for k in range(5)]
    random.Random(2).shuffle(vecs)
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(0, t, "user", "x" * 19) for t in range(8)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    made = {(r["rec_id"], r["frame_idx"]): r["rms"] for r in q_media.ag_frame_feats(spark, str(tmp_path)).collect()}
    samples = {v: (x[0], (1 + v % 7) / 4) for v, x, _ in vecs}
    assert made == {(y, k): pytest.approx(samples[2 * k + y][0] * samples[2 * k + y][1], abs=1e-6) for y, n in ((0, 250), (1, 5)) for k in range(n)}
    bursts = {(r["p0"], r["p1"]) for r in q_media.wn_pause_bursts(spark, str(tmp_path)).collect() if r["rec_id"] == 0}
    assert (90, 129) in bursts
    marks = {r["frame_idx"] for r in q_media.jn_speech_mark(spark, str(tmp_path)).collect() if r["rec_id"] == 0 and r["speech"]}
    spans = [(26 * k + 4, 26 * k + 26) for k in range(8)]  # seconds of a segment: 22, after a gap of 4
    assert marks == {i for a, b in spans for i in range(int(a / 100 * 10), int(b / 100 * 10))}
