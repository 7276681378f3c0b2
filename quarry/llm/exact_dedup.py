"""Exact deduplication as a stateful stream over disk-backed keyed state.

Texts are equal when they are identical after lower-casing A-Z.  Arrivals are appended to a content store
(whole rows and the SHA-256 of their normalised text), and a locator, file and row number, names each of
them.  A stream over the store folds arrivals into state keyed by digest: the stable identifier that
stays (the largest doc_id), the locator of its content, and how many arrivals the text has had.  State
lives in RocksDB, is checkpointed in the shared folder and never expires; a batch hands on only what it
has changed, and arrivals of one digest are combined before they are dealt, so a text that a third of all
rows share is one row from each task.

On hits, and only there, the full bytes are checked, by the same batch: the locators of a digest that
has had more than one arrival are followed to the store, and its texts are compared, likewise combined
before they are dealt.  Should two texts share a digest, their rows are settled by the texts themselves.

All of it is DataFrame and SQL functions.  Defined results: null counts as empty; an empty text is a
text; a text of any length is compared whole; repeated rows are copies of one another, and of rows with
the same doc_id the last in the store stays; a null doc_id stays only where the group has no other; an
empty table gives no rows; further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.scratch import delete, fresh_path, joined, staged

#: Lower-casing of A-Z alone.
NORMAL = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LOCATOR = "concat(_metadata.file_name, '#', _metadata.row_index) as locator"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # each store would set megabytes aside for its logs, however little it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Hits, or rows to be dropped, up to which their table is sent to all executors; texts stay where they lie.
MOST_SENT = 300_000
#: Batches whose changes are kept apart before they are folded into one table.
FOLD_AFTER = 16
CHANGES = "digest binary, keep_id long, group_size long, locator string"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrive(docs: DataFrame, store: str) -> None:
    """Append rows (doc_id, text, ...) to a content store."""
    docs.select(F.struct("*").alias("row"), F.expr(f"unhex(sha2({NORMAL.format('text')}, 256)) as sha")).write.mode("append").option("compression", "zstd").parquet(store)


class DedupStream:
    """Keyed state over a content store; each call of ``advance`` takes in what has arrived since.

    key: SQL of the digest that state is keyed by.
    """

    def __init__(self, spark: SparkSession, store: str, root: str, key: str = "sha"):
        self.spark, self.store, self.root, self.key = spark, store, root, key

    def content(self) -> DataFrame:
        """digest, doc_id, locator, body, sha and the whole row of all arrivals."""
        rows = self.spark.read.parquet(self.store)
        return rows.selectExpr(f"{self.key} as digest", "cast(row.doc_id as long) as doc_id", LOCATOR, f"{NORMAL.format('row.text')} as body", "sha", "row")

    def advance(self) -> DataFrame:
        """Take in new arrivals and return the state: digest, keep_id, group_size, locator."""
        spark, root = self.spark, self.root

        def save(batch: DataFrame, batch_id: int) -> None:
            # the same batch again writes the same rows
            batch.selectExpr("digest", "kept.doc_id as keep_id", "group_size", "kept.locator as locator").write.mode("overwrite").parquet(f"{root}/state/batch={batch_id}")
            hits = spark.read.parquet(f"{root}/state/batch={batch_id}").where("group_size > 1").select("digest")
            texts = joined(self.content().select("digest", "body"), hits, ["digest"], "left_semi", MOST_SENT).distinct()
            texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest").write.mode("overwrite").parquet(f"{root}/clashes/batch={batch_id}")

        with _settings(spark, STATE):
            rows = spark.readStream.schema(spark.read.parquet(self.store).schema).parquet(self.store).selectExpr(f"{self.key} as digest", "cast(row.doc_id as long) as doc_id", LOCATOR)
            state = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("kept"), F.count("*").alias("group_size"))
            state.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
        if len(self._written("state/batch=")) > FOLD_AFTER:
            self._fold()
        return self.state()

    def state(self) -> DataFrame:
        """The newest row of each digest, of the folded table and the batches since."""
        folded = max(self._written("state/upto="), default=-1)
        paths = [f"{self.root}/state/upto={folded}"] * (folded >= 0) + [f"{self.root}/state/batch={b}" for b in sorted(self._written("state/batch=")) if b > folded]
        if not paths:
            return self.spark.createDataFrame([], CHANGES)
        rows = self.spark.read.schema(CHANGES).parquet(*paths)
        # a digest's count only grows, so its newest row has the largest
        return rows if len(paths) == 1 else rows.groupBy("digest").agg(F.expr("max_by(struct(keep_id, group_size, locator), group_size) as s")).select("digest", "s.*")

    def clashes(self) -> DataFrame:
        """Digests that more than one text has."""
        paths = [f"{self.root}/clashes/batch={b}" for b in self._written("clashes/batch=")]
        return self.spark.read.schema("digest binary").parquet(*paths).distinct() if paths else self.spark.createDataFrame([], "digest binary")

    def _fold(self) -> None:
        upto = max(self._written("state/batch="))
        self.state().write.mode("overwrite").parquet(f"{self.root}/state/upto={upto}")
        old = [f"state/upto={b}" for b in self._written("state/upto=") if b < upto] + [f"state/batch={b}" for b in self._written("state/batch=") if b <= upto]
        for name in old:
            delete(self.spark, f"{self.root}/{name}")

    def _written(self, name: str) -> list[int]:
        """Numbers of the tables under ``name`` that were written to the end."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        folder, start = name.split("/")
        top = path(f"{self.root}/{folder}")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        return [int(n.removeprefix(start)) for n in names if n.startswith(start) and fs.exists(path(f"{self.root}/{folder}/{n}/_SUCCESS"))]


def _settled(docs: DataFrame, key: str) -> tuple[DedupStream, DataFrame]:
    """The stream over a store of ``docs``, and doc_id, locator, sha, keep_id, group_size, kept_at of each row."""
    spark, root = docs.sparkSession, fresh_path(docs.sparkSession, "exact-dedup")
    arrive(docs, f"{root}/store")
    stream = DedupStream(spark, f"{root}/store", root, key)
    state = stream.advance().withColumnRenamed("locator", "kept_at")
    rows = stream.content().select("digest", "doc_id", "locator", "sha").join(state, "digest")
    names = ["doc_id", "locator", "sha", "keep_id", "group_size", "kept_at"]
    clashes = staged(stream.clashes(), "exact-dedup-clashes")
    if clashes.isEmpty():
        return stream, rows.select(names)
    odd = joined(stream.content().select("digest", "doc_id", "locator", "sha", "body"), clashes, ["digest"], "left_semi", MOST_SENT)
    groups = odd.groupBy("digest", "body").agg(F.max(F.struct("doc_id", "locator")).alias("kept"), F.count("*").alias("group_size"))
    settled = odd.join(groups, ["digest", "body"]).selectExpr("doc_id", "locator", "sha", "kept.doc_id as keep_id", "group_size", "kept.locator as kept_at")
    return stream, rows.join(clashes, "digest", "left_anti").select(names).unionByName(settled)


def deduplicate(docs: DataFrame, key: str = "sha") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, locator (of what stays)."""
    _, rows = _settled(docs.select("doc_id", "text"), key)
    return rows.selectExpr("doc_id", "keep_id", "group_size", "doc_id <=> keep_id as kept", "lower(hex(sha)) as text_sha256", "kept_at as locator")


def distinct_rows(docs: DataFrame, key: str = "sha") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns."""
    stream, rows = _settled(docs, key)
    gone = staged(rows.where("locator <> kept_at").select("locator"), "exact-dedup-gone")
    kept = joined(stream.content().select("locator", "row"), gone, ["locator"], "left_anti", MOST_SENT).select("row.*")
    return kept.to(StructType(docs.schema.fields))
