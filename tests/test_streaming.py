"""Streams give what the batch jobs give for input in order."""

import random
import time
from datetime import datetime, timedelta

from talkmine.config import Words
from talkmine.operators import speakers
from talkmine.streaming import jobs

START = datetime(2024, 1, 1)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(spark, frames, tmp_path, job, mode="append"):
    """The rows of a stream that reads one file of `frames` a batch."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    frames = frames if isinstance(frames, list) else [frames]
    for k, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if k + 1 < len(frames) else 0)  # files are read by time
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = "out_" + tmp_path.name.replace("-", "_")
    q = job(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.table(name).collect()


SENTENCES = "rec_id long, show_start timestamp, line_no long, start long, end long, spk string"


def test_turns(spark, tmp_path):
    rows = [(1, START, k, k * 1000, k * 1000 + (900 if k % 5 else 100), "ab"[k // 3 % 2]) for k in range(12)]
    late = [(2, START + timedelta(hours=h), 1, 0, 500, "c") for h in (1, 2)]  # move the watermark past the first recording
    df = spark.createDataFrame(rows, SENTENCES)
    want = sorted((r["spk"], r["start"], r["end"], r["n"]) for r in speakers.turns_by_gap(df.drop("show_start")).orderBy("turn_no").collect())
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    for k, parts in enumerate(([rows], [shuffled[:4], shuffled[4:8], shuffled[8:]])):  # in order in one batch; out of order over three
        at = tmp_path / str(k)
        made = run(spark, [spark.createDataFrame(p, SENTENCES) for p in [*parts, late[:1], late[1:]]], at, jobs.turns)
        assert sorted((r["spk"], r["start"], r["end"], r["n"]) for r in made if r["rec_id"] == 1) == want  # the last turn too
        assert len([r for r in made if r["rec_id"] == 2]) <= 1


def test_progress(spark, tmp_path):
    at = [(0, "a", 1.0), (0.05, "a", 1.2), (0.1, "b", 1.2), (0.2, "b", 100.0), (0.25, "b", 100.0), (0.3, "b", None)]
    rows = [(1, START + timedelta(seconds=s), g, p) for s, g, p in at]
    ends = [(2, START + timedelta(hours=h), "z", 5.0) for h in (1, 2, 3)]
    schema = "rec_id long, ts timestamp, stage string, percent double"
    for k, parts in enumerate(([rows], [[rows[3], rows[1]], [rows[0], rows[5]], [rows[4], rows[2]]])):
        folder = tmp_path / str(k)
        made = run(spark, [spark.createDataFrame(p, schema) for p in [*parts, *([x] for x in ends)]], folder, jobs.progress)
        assert [(r["stage"], r["percent"]) for r in made if r["rec_id"] == 1] == [("a", 1.0), ("b", 1.2), ("b", 100.0), ("b", None)]
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        left = spark.read.format("statestore").option("stateVarName", "carried").load(str(folder / "c"))
        assert 1 not in {r["key"]["rec_id"] for r in left.collect()}  # nothing of a recording that has ended
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_minutes(spark, tmp_path):
    rows = [(1, START, 0, 10, "x"), (1, START, 50, 70, "x x"), (1, START, 400, 410, "x")]
    df = spark.createDataFrame(rows, "rec_id long, show_start timestamp, start long, end long, text string")
    made = run(spark, df, tmp_path, lambda s: jobs.bucket_scores(s, Words(("x",))))
    got = {(r["minute"]["start"] - START).seconds // 60: r["score"] for r in made}
    assert got[0] == 6 and got[1] == 4


def test_feedback(spark, tmp_path):
    schema = "clip_id long, user_choice string, ts timestamp, event_id long, snapshot string"
    merge = jobs.feedback_into(str(tmp_path / "t"))
    merge(spark.createDataFrame([(1, "喜欢", START, 1, "s"), (2, "喜欢", START, 2, None)], schema), 0)
    for _ in range(2):  # a batch that runs again changes nothing
        merge(spark.createDataFrame([(1, "不喜欢", START + timedelta(1), 2, None)], schema), 1)
    r = jobs.latest_feedback(spark, str(tmp_path / "t")).orderBy("clip_id").collect()
    assert [(x["user_choice"], x["snapshot"]) for x in r] == [("不喜欢", "s"), ("喜欢", None)]
    assert len(list((tmp_path / "t" / "data" / "version=1").glob("bucket=*"))) == 1  # the other clip's bucket is not written again


def test_feedback_neither_grows_nor_breaks(spark, tmp_path):
    schema, at = "clip_id long, user_choice string, ts timestamp, event_id long, snapshot string", str(tmp_path / "t")
    merge = jobs.feedback_into(at, 4)
    rows, sizes = {}, []
    for n in range(6):
        own = [(c, f"c{n}", START + timedelta(n), n * 10 + c, f"s{n}" if c % 2 else None) for c in range(10 if n % 2 == 0 else 3)]
        merge(spark.createDataFrame(own, schema), n)
        rows |= {c: (choice, i) for c, choice, _, i, _ in own}
        sizes.append(len(list((tmp_path / "t").rglob("*.parquet"))))
        assert {r["clip_id"]: (r["user_choice"], r["event_id"]) for r in jobs.latest_feedback(spark, at).collect()} == rows
    assert max(sizes[2:]) <= 4 * 2 + 4 and len(list((tmp_path / "t" / "manifest").iterdir())) == 2
    # a batch that stops before its manifest counts leaves the table as it was, and may run again
    merge(spark.createDataFrame([(0, "new", START + timedelta(9), 99, None)], schema), 6)
    (tmp_path / "t" / "manifest" / "n=6" / "_SUCCESS").unlink()
    assert {r["clip_id"]: (r["user_choice"], r["event_id"]) for r in jobs.latest_feedback(spark, at).collect()} == rows
    merge(spark.createDataFrame([(0, "new", START + timedelta(9), 99, None)], schema), 6)
    assert {r["clip_id"]: (r["user_choice"], r["event_id"]) for r in jobs.latest_feedback(spark, at).collect()} == rows | {0: ("new", 99)}
    merge(spark.createDataFrame([], schema), 7)
    assert jobs.latest_feedback(spark, at).count() == 10
