"""Streaming jobs: live minute scores, latest feedback, progress and speaker turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import Scan, Words
from ..functions.text import total_occurrences
from ..operators.feedback import latest_by_aggregation


def bucket_scores(segments: DataFrame, words: Words, scan: Scan = Scan(), delay: str = "2 minutes") -> DataFrame:
    """rec_id, minute (window), score of a stream of (rec_id, show_start, start, end, text).

    A segment counts in every minute that it overlaps; minutes end when the watermark has
    passed them, and rows later than `delay` are dropped.  Words are counted by segment, so
    one that spans two segments isn't seen.
    """
    b = scan.bucket_seconds
    first, last = F.floor(F.col("start") / b).cast("long"), F.ceil(F.col("end") / b).cast("long") - 1
    score = 2 * total_occurrences(F.col("text"), words.strong) + total_occurrences(F.col("text"), words.normal)
    rows = segments.withColumn("score", score).filter(first <= last).withColumn("minute_no", F.explode(F.sequence(first, last)))
    at = F.timestamp_seconds(F.unix_timestamp("show_start") + F.col("minute_no") * b)
    rows = rows.withColumn("ts", at).withWatermark("ts", delay)
    return rows.groupBy("rec_id", F.window("ts", f"{b} seconds").alias("minute")).agg(F.sum("score").alias("score"))


#: Parts of the table of latest feedback; a batch rewrites those that its clips are in.
BUCKETS = 256


class _Folder:
    """The files of a table through the file system of its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def names(self, name: str) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self._at(name))] if self.exists(name) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def manifests(self) -> list[int]:
        """Numbers of the batches that were written in full."""
        return sorted(int(x[2:]) for x in self.names("manifest") if x.startswith("n=") and self.exists(f"manifest/{x}/_SUCCESS"))

    def manifest(self, number: int) -> dict[int, int]:
        """The version of each bucket after a batch: `BUCKETS` rows at most."""
        return {r["bucket"]: r["version"] for r in self.spark.read.parquet(f"{self.path}/manifest/n={number}").collect()}

    def read(self, versions: dict[int, int]) -> DataFrame | None:
        folders = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.parquet(*folders) if folders else None


def latest_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The table of latest feedback at `path` as the last full batch left it."""
    folder = _Folder(spark, path)
    return folder.read(folder.manifest(folder.manifests()[-1]))


def feedback_into(path: str, buckets: int = BUCKETS):
    """For foreachBatch: merge each batch into the table of latest feedback at `path`.

    Clips are dealt to buckets by a hash, and a manifest names the version of each bucket.  A batch reads
    the buckets that its clips are in, and no others, writes them under its number, and then
    its manifest, whose _SUCCESS file makes it count: a batch that stops before leaves the table
    as it was, and one that runs again writes the same files again.  Versions that neither this
    manifest nor the one before names are removed, so what is kept and read does not grow
    with the number of batches.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = _Folder(spark, path)
        earlier = [n for n in folder.manifests() if n < number]
        now = folder.manifest(earlier[-1]) if earlier else {}
        bucket = F.pmod(F.xxhash64("clip_id"), F.lit(buckets)).cast("int")
        own = latest_by_aggregation(batch)
        touched = [r["bucket"] for r in own.select(bucket.alias("bucket")).distinct().collect()]  # numbers, `buckets` at most
        if touched:
            before = folder.read({b: now[b] for b in touched if b in now})
            if before is not None:
                own = latest_by_aggregation(before.select(*own.columns).unionByName(own))
            own.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder.path}/data/version={number}")
        after = now | {b: number for b in touched}
        rows = spark.createDataFrame(sorted(after.items()), "bucket int, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder.path}/manifest/n={number}")
        for n in earlier[:-1]:
            folder.remove(f"manifest/n={n}")
        named = {*now.items(), *after.items()}
        for name in folder.names("data"):
            version = int(name.split("=")[1])
            own_buckets = [int(x.split("=")[1]) for x in folder.names(f"data/{name}") if x.startswith("bucket=")]
            gone = [b for b in own_buckets if (b, version) not in named]
            for b in gone if len(gone) < len(own_buckets) else ():
                folder.remove(f"data/{name}/bucket={b}")
            if len(gone) == len(own_buckets):
                folder.remove(f"data/{name}")

    return merge


class _InOrder(StatefulProcessor):
    """Rows of a key in the order of event time, across micro-batches.

    Rows wait in a list state until the watermark has passed them, since earlier ones may
    still come; then `step` takes them one by one, with what it carries.  A timer ends the key `idle`
    ms after its last row: `finish` gives what is left, and all state goes.
    """

    def __init__(self, columns: str, carried: str, idle: int):
        self.columns, self.carried, self.idle = columns, carried, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.carry = handle.getValueState("carried", self.carried)
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in r) for df in rows for r in df[[c.split()[0] for c in self.columns.split(", ")]].itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(max(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: tuple((x is not None, x) for x in r))
        ready, rest = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        carried, out = self.carry.get() if self.carry.exists() else None, []
        for row in ready:
            carried = self.step(carried, row, out)
        if ready:
            self.last.update((ready[-1][0],))
            self.carry.update(carried)
            self.handle.registerTimer(self.end_of(carried, ready[-1]) + self.idle)
            self.waiting.put(rest) if rest else self.waiting.clear()
        elif not rest and self.last.exists() and mark >= self.end_of(carried, self.last.get()) + self.idle:
            self.finish(carried, out)
            for state in (self.waiting, self.carry, self.last):
                state.clear()
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=self.given)

    def end_of(self, carried: tuple, row: tuple) -> int:
        return row[0]

    def finish(self, carried: tuple, out: list) -> None:
        pass

    def close(self) -> None:
        pass


class _Progress(_InOrder):
    given = ["rec_id", "ts", "stage", "percent"]

    def step(self, carried: tuple | None, row: tuple, out: list) -> tuple:
        stage, percent, at = carried or (None, -1.0, -(1 << 60))
        now, _, new_stage, new = row
        done = new is not None and new >= 100 and percent < 100
        near = new is not None and now - at < 150 and abs(new - percent) < 0.5
        if stage != new_stage or new is None or done or not near:
            out.append((pd.Timestamp(now, unit="ms"), new_stage, new))
            return new_stage, percent if new is None else new, now
        return stage, percent, at


def progress(events: DataFrame, delay: str = "10 seconds", idle_ms: int = 600_000) -> DataFrame:
    """Progress updates (rec_id, ts, stage, percent) in the order of time, without those that
    tell nothing new: of the same stage, soon after the last and hardly further on.  Rows that are later
    than `delay` are dropped; `idle_ms` after its last update nothing of a recording is kept.
    Needs the RocksDB state store."""
    rows = events.withWatermark("ts", delay)
    # updates of one time: the stage that was, then by percent
    rows = rows.select("rec_id", "ts", F.unix_millis("ts").alias("at"), F.lit(0).cast("long").alias("place"), "stage", "percent")
    return rows.groupBy("rec_id").transformWithStateInPandas(
        _Progress("at long, place long, stage string, percent double", "stage string, percent double, at long", idle_ms),
        "rec_id long, ts timestamp, stage string, percent double", "append", "eventTime",
    )


class _Turns(_InOrder):
    given = ["rec_id", "spk", "start", "end", "n"]

    def step(self, carried: tuple | None, row: tuple, out: list) -> tuple:
        at, _, start, end, spk = row
        if carried and carried[0] == spk and start - carried[2] < self.idle:
            return spk, carried[1], max(carried[2], end), carried[3] + 1, carried[4]
        if carried:
            out.append(tuple(carried[:4]))
        return spk, start, end, 1, at - start

    def end_of(self, carried: tuple, row: tuple) -> int:
        return carried[4] + carried[2]  # the show's start and the turn's end

    def finish(self, carried: tuple, out: list) -> None:
        out.append(tuple(carried[:4]))


def turns(sentences: DataFrame, gap_ms: int = 800, delay: str = "2 minutes") -> DataFrame:
    """Speaker turns of a stream of sentences (rec_id, show_start, line_no, start, end in ms,
    spk); a turn comes out when another speaker or a long gap closes it, and the last one
    of a recording when the watermark, `delay` behind, has passed its end by the gap.  Then nothing of
    the recording is kept.  Sentences may come in any order within `delay`, in one batch or several: they
    are taken by their start.  Needs the RocksDB state store.
    """
    at = F.timestamp_millis(F.unix_millis("show_start") + F.col("start"))
    rows = sentences.withColumn("ts", at).withWatermark("ts", delay).select("rec_id", "ts", F.unix_millis("ts").alias("at"), "line_no", "start", "end", "spk")
    return rows.groupBy("rec_id").transformWithStateInPandas(
        _Turns("at long, line_no long, start long, end long, spk string", "spk string, start long, end long, n long, show long", gap_ms), "rec_id long, spk string, start long, end long, n long", "append", "eventTime"
    )
