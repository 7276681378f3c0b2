"""Scan memory with expiry, incremental folds and event-time windows as Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.changes import node_diff
from quarry.scratch import dealt, delete, fresh_path

TTL_MINUTES = 30
STATE = "fingerprint string, seen_ms long"


def label_versions(scans: DataFrame, ttl_minutes: int = TTL_MINUTES) -> DataFrame:
    """A stream of scans (path, fingerprint, at) labelled first, unchanged or changed.

    State by path holds the last fingerprint; one older than the expiry counts as a first scan.  Time is
    that of the events, so a replay gives the same labels; a path that has not been seen for the expiry, by the
    watermark, loses its state.
    """
    ttl = ttl_minutes * 60_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for fingerprint, at in zip(rows["fingerprint"], rows["at"], strict=True):
            now = int(at.timestamp() * 1000)
            label = "first" if last is None or now - last[1] > ttl else "unchanged" if last[0] == fingerprint else "changed"
            out.append((key[0], at, label))
            last = (fingerprint, now)
        if last[1] + ttl > state.getCurrentWatermarkMs():
            state.update(last)
            state.setTimeoutTimestamp(last[1] + ttl)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["path", "at", "label"])

    return scans.withWatermark("at", f"{ttl_minutes} minutes").groupBy("path").applyInPandasWithState(run, "path long, at timestamp, label string", STATE, "append", "EventTimeTimeout")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there, into a table of the shared folder."""
    spark, root = stream.sparkSession, fresh_path(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).outputMode("append").start(f"{root}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def replay_versions(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Turns of conversations as scans of one path, ten minutes apart."""
    root = fresh_path(spark, "scans")
    scans = turns.where("conv_id is not null").selectExpr("conv_id as path", "md5(text) as fingerprint", "timestamp_seconds(1700000000 + turn * 600) as at")
    scans.write.parquet(root)
    return drain(label_versions(spark.readStream.schema(scans.schema).parquet(root)), "scan-labels")


def hourly(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Tumbling event-time windows over a feed of events, folded incrementally.

    A batch hands on the windows that it has changed, and those that the watermark has passed leave the state;
    rows that come later than that are dropped.  The table holds the newest row of each window.
    """
    root = fresh_path(spark, "hourly")
    events.write.parquet(f"{root}/in")
    feed = spark.readStream.schema(events.schema).parquet(f"{root}/in").withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "1 hour")
    counts = feed.groupBy("event_type", F.window("t", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    counts.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    newest = spark.read.parquet(f"{root}/out").groupBy("event_type", "w").agg(F.expr("max_by(struct(n, total), batch)").alias("s"))
    return newest.selectExpr("event_type", "cast(w.start as timestamp_ntz) as hour", "s.n as n", "round(s.total, 4) as total")


class Generations:
    """Numbered tables in a folder, each whole once its marker is there; the last one is found by listing, so also after a restart.

    Readers name the generation that they use for as long as they do (``pinned``); ``sweep`` deletes those that are neither the last,
    nor the one before it, whose readers may have just begun, nor pinned.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, start: str) -> list[str]:
        path, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(self.root))] if fs.exists(path(self.root)) else []
        return [n.removeprefix(start) for n in names if n.startswith(start)]

    def all(self) -> list[int]:
        path, fs = self._fs()
        return sorted(int(n) for n in self._names("generation=") if fs.exists(path(f"{self.root}/generation={n}/rows/_SUCCESS")))

    def at(self, number: int, part: str = "rows") -> str:
        return f"{self.root}/generation={number}/{part}"

    def last(self) -> int:
        return max(self.all(), default=-1)

    @contextmanager
    def pinned(self) -> Iterator[DataFrame | None]:
        """The last generation's rows, which stay readable inside; None before the first."""
        path, fs = self._fs()
        number = self.last()
        if number < 0:
            yield None
            return
        pin = path(f"{self.root}/pin={number}-{uuid.uuid4().hex}")
        fs.mkdirs(pin)
        try:
            yield self.spark.read.parquet(self.at(number))
        finally:
            fs.delete(pin, True)

    def sweep(self) -> None:
        used = {int(n.split("-")[0]) for n in self._names("pin=")}
        for number in self.all()[:-2]:
            if number not in used:
                delete(self.spark, f"{self.root}/generation={number}")


class Snapshot(Generations):
    """A table that readers see as it was last committed while a refresh works out the next one.

    The refresh does nothing where the files are the same by their fingerprints, equal numbers of changes included.  What was read
    before a refresh can be read until the one after it, and longer by readers that pin it.
    """

    def read(self) -> DataFrame | None:
        """The last committed rows; None before the first refresh."""
        number = self.last()
        return self.spark.read.parquet(self.at(number)) if number >= 0 else None

    def refresh(self, files: DataFrame, compute) -> bool:
        """Work ``compute(files)`` out anew if files (path, fingerprint) have changed; whether they have."""
        number = self.last()
        sign = files.agg(F.count("*").alias("n"), F.expr("coalesce(bit_xor(xxhash64(path, fingerprint)), 0)").alias("mark"))
        now = sign.first()
        if number >= 0 and tuple(self.spark.read.parquet(self.at(number, "sign")).first()) == tuple(now):
            return False
        self.spark.createDataFrame([tuple(now)], "n long, mark long").write.mode("overwrite").parquet(self.at(number + 1, "sign"))
        compute(files).write.mode("overwrite").parquet(self.at(number + 1))  # its marker commits the generation
        self.sweep()
        return True

    def follow(self, feed: DataFrame, files, compute, seconds: int | None = None):
        """Refresh whenever a stream of changes brings something: ``files()`` gives the table as it then is.  Every ``seconds``, or once over
        all that is there; the query that runs."""
        write = feed.writeStream.foreachBatch(lambda batch, _: self.refresh(files(), compute) and None).option("checkpointLocation", f"{self.root}/checkpoint")
        return (write.trigger(processingTime=f"{seconds} seconds") if seconds else write.trigger(availableNow=True)).start()


class ScanMemory(Generations):
    """What a user has been shown: files by fingerprint and their nodes by digest, for ``ttl`` seconds.

    Whoever scans again gets what has changed since; a file that was not scanned, or too long ago, is seen for the first time, whatever
    it was.  ``now`` is the caller's clock, in seconds.
    """

    ROWS = "path string, fingerprint string, at double, node_key string, digest string"

    def __init__(self, spark: SparkSession, root: str, ttl: float = 60 * TTL_MINUTES):
        super().__init__(spark, root)
        self.ttl = ttl

    def known(self, now: float) -> DataFrame:
        number = self.last()
        rows = self.spark.read.schema(self.ROWS).parquet(self.at(number)) if number >= 0 else self.spark.createDataFrame([], self.ROWS)
        return rows.where(F.col("at") >= now - self.ttl)

    def unchanged(self, files: DataFrame, now: float) -> DataFrame:
        """(path, age) of files (path, fingerprint) that are as they were shown."""
        return self.known(now).select("path", "fingerprint", "at").distinct().join(files, ["path", "fingerprint"]).selectExpr("path", f"{now}D - at as age")

    def changes(self, keys: DataFrame, now: float) -> DataFrame:
        """(path, node_key, status) of the nodes (path, node_key, digest) of files that were shown before, and of nodes that are gone."""
        shown = self.known(now)
        seen = shown.join(keys.select("path").distinct(), "path", "left_semi")
        old = seen.where("node_key is not null").select("path", "node_key", "digest")
        return node_diff(old, keys.join(seen.select("path").distinct(), "path", "left_semi"))

    def record(self, files: DataFrame, keys: DataFrame, now: float) -> None:
        """Files (path, fingerprint) with the keys of their nodes have been shown."""
        new = files.join(keys, "path", "left").selectExpr("path", "fingerprint", f"{now}D as at", "node_key", "digest")
        kept = self.known(now).join(files.select("path"), "path", "left_anti")
        kept.unionByName(new).write.mode("overwrite").parquet(self.at(self.last() + 1))
        self.sweep()


def fold_scans(spark: SparkSession, feed: DataFrame, root: str) -> DataFrame:
    """A stream of scans (path, fingerprint, content, turn) folded batch by batch into (path, fingerprint, n_lines): only files whose
    fingerprint is new are worked out.  The tables lie in ``root``, where a restart finds the last one."""
    tables = Generations(spark, f"{root}/out")
    empty = spark.createDataFrame([], "path long, fingerprint string, n_lines int")

    def save(batch: DataFrame, batch_id: int) -> None:
        past = [n for n in tables.all() if n < batch_id]  # a batch that is run again finds what it found before
        known = spark.read.parquet(tables.at(past[-1])) if past else empty
        newest = batch.groupBy("path").agg(F.expr("max_by(struct(fingerprint, content), turn)").alias("s")).select("path", "s.*")
        fresh, _ = incremental(known, newest.select("path", "fingerprint"))
        made = dealt(newest).join(dealt(fresh), ["path", "fingerprint"]).selectExpr("path", "fingerprint", "size(split(content, '\\n')) as n_lines")
        dealt(known).join(dealt(made.select("path")), "path", "left_anti").unionByName(made).write.mode("overwrite").parquet(tables.at(batch_id))
        tables.sweep()

    feed.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return spark.read.parquet(tables.at(tables.last())) if tables.last() >= 0 else empty


def incremental_stream(spark: SparkSession, scans: DataFrame) -> DataFrame:
    """``fold_scans`` over a table of scans, turn by turn."""
    root = fresh_path(spark, "incremental")
    scans.write.partitionBy("turn").parquet(f"{root}/in")
    return fold_scans(spark, spark.readStream.schema(scans.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), root)


def incremental(known: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, fingerprint) to be parsed anew, and known rows that still hold."""
    fresh = dealt(files).join(dealt(known.select("path", "fingerprint")), ["path", "fingerprint"], "left_anti")
    return fresh, dealt(known).join(dealt(files.select("path", "fingerprint")), ["path", "fingerprint"], "left_semi")
