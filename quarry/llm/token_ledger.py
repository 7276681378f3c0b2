"""Token counts as rollups that deltas maintain.

A ledger is a folder.  A batch is a table of signed changes, summed by source, language and tokenizer
version: an insert adds a document's counts, a delete subtracts them, a revision subtracts the old image
and adds the new one.  Its sums are written aside and then renamed to their place, which succeeds once for
an id: of several writers of one id one wins, the others change nothing, and a batch that broke off was
never there (the shared folder must rename a folder in one step, as HDFS and local disks do).

Totals are maintained: a snapshot holds the sums of all batches that it has taken in and their ids.
``totals`` adds to it the few batches that have come since, and after ``FOLD_AFTER`` of them they are taken
in by a new snapshot, so neither reading nor listing grows with the history.  A fold and a reading each look at
the folder once, and work with the snapshot and the batches seen then, so a commit meanwhile is in neither
the sums nor the ids.  What a fold has taken in stays until the next fold, so totals that were asked for before a
fold can be read after it.  A batch carries its writer's mark, and so do the ids, which tells a writer whether
the batch that was taken in under its id was its own.  One process folds at a time.

Defined results: a null text has no tokens but counts as a document, a text of any length is counted
whole; null sources and languages are groups of their own; repeated rows count each; groups whose
totals have come back to zero documents and tokens are left out; an empty batch is committed and adds
nothing; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import default_path, loaded
from quarry.scratch import delete, fresh_path

WORDS_VERSION = "words-1"
FOLD_AFTER = 16
#: Rows up to which the query sends its table of marked documents to all executors.
MOST_SENT = 300_000
IDS = "batch_id string, writer string"
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def tokenizer_version(path: str) -> str:
    """The version under which a tokenizer file's counts are kept: its file name."""
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            counts = [len(bpe.ids(t.as_py())) if t.is_valid else 0 for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.array(counts, np.int64))], names=[*batch.schema.names[1:], "bpe"])

    return run


def signed(inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Changes as rows (text, source, lang, sign); revisions are (old images, new images)."""
    old, new = revisions or (None, None)
    parts = [d.select("text", "source", "lang", F.lit(s).cast("long").alias("sign")) for d, s in ((inserts, 1), (deletes, -1), (old, -1), (new, 1)) if d is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class TokenLedger:
    def __init__(self, spark: SparkSession, root: str | None = None, tokenizer: str | None = None):
        self.spark, self.root, self.path = spark, root or fresh_path(spark, "token-ledger"), tokenizer or default_path()

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, start: str) -> list[str]:
        path, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(self.root))] if fs.exists(path(self.root)) else []
        return sorted(n.removeprefix(start) for n in names if n.startswith(start))

    def _placed(self, source: str, target: str) -> bool:
        """Rename a folder to a name that none has yet; False if one has it."""
        sc = self.spark.sparkContext
        path, fs = self._fs()
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            files.rename(path(source), path(target), sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError:
            if not fs.exists(path(target)):
                raise
            delete(self.spark, source)
            return False
        return True

    def _seen(self) -> tuple[int, DataFrame, DataFrame, list[str], list[str]]:
        """From one look at the folder: the last snapshot's number, sums and ids, the batches that it does not hold, and what else
        was there of batches and snapshots before it."""
        names = self._names("")
        last = max((int(n.removeprefix("snapshot=")) for n in names if n.startswith("snapshot=")), default=0)
        at = f"{self.root}/snapshot={last}"
        sums = self.spark.read.schema(DELTA).parquet(f"{at}/sums") if last else self.spark.createDataFrame([], DELTA)
        ids = self.spark.read.schema(IDS).parquet(f"{at}/ids") if last else self.spark.createDataFrame([], IDS)
        batches = [n.removeprefix("batch=") for n in names if n.startswith("batch=")]
        held = {r["batch_id"] for r in ids.where(F.col("batch_id").isin(batches)).collect()} if last and batches else set()
        past = [f"batch={b}" for b in batches if b in held] + [n for n in names if n.startswith("snapshot=") and n != f"snapshot={last}"]
        return last, sums, ids, [b for b in batches if b not in held], past

    def _writer(self, batch_id: str) -> str:
        path, fs = self._fs()
        return next(s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/batch={batch_id}")) if s.getPath().getName().startswith("by-"))

    def committed(self, batch_id: str) -> bool:
        return batch_id in self._names("batch=") or self._folded(batch_id) is not None

    def _folded(self, batch_id: str) -> str | None:
        """The writer of the batch of this id that the last snapshot holds."""
        found = self._seen()[2].where(F.col("batch_id") == batch_id).first()
        return found and found["writer"]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch once; False if it was there already."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
            raise ValueError(f"batch id {batch_id!r}")
        if self.committed(batch_id):
            return False
        counted = changes.select("text", "source", "lang", "sign", F.coalesce(F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long").alias("words"))
        counted = counted.mapInArrow(_counter(self.path), "source string, lang string, sign long, words long, bpe long")
        versions = F.array(F.struct(F.lit(WORDS_VERSION).alias("v"), F.col("words").alias("n")), F.struct(F.lit(tokenizer_version(self.path)).alias("v"), F.col("bpe").alias("n")))
        sums = counted.groupBy("source", "lang").agg(F.sum("sign").alias("docs"), F.sum(F.expr("sign * words")).alias("words"), F.sum(F.expr("sign * bpe")).alias("bpe"))
        mark = uuid.uuid4().hex
        aside = f"{self.root}/.aside-{mark}"
        sums.select("source", "lang", "docs", F.explode(versions).alias("x")).select("source", "lang", F.col("x.v").alias("tokenizer_version"), F.col("docs").alias("n_docs"), F.col("x.n").alias("n_tokens")).write.parquet(f"{aside}/sums")
        path, fs = self._fs()
        fs.mkdirs(path(f"{aside}/by-{mark}"))
        done = self._placed(aside, f"{self.root}/batch={batch_id}")
        if done and self._folded(batch_id) not in (None, f"by-{mark}"):  # meanwhile another one has come, been taken in and deleted
            delete(self.spark, f"{self.root}/batch={batch_id}")
            done = False
        if len(self._seen()[3]) > FOLD_AFTER:
            self.fold()
        return done

    def _sums(self, sums: DataFrame, batches: list[str]) -> DataFrame:
        if batches:
            sums = sums.unionByName(self.spark.read.schema(DELTA).parquet(*(f"{self.root}/batch={b}/sums" for b in batches)))
        return sums.groupBy("source", "lang", "tokenizer_version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def fold(self) -> None:
        """Take all batches seen now into a new snapshot; delete what the last one had replaced."""
        number, sums, ids, since, past = self._seen()
        if not since:
            return
        aside = f"{self.root}/.aside-{uuid.uuid4().hex}"
        self._sums(sums, since).coalesce(1).write.parquet(f"{aside}/sums")
        taken = self.spark.createDataFrame([(b, self._writer(b)) for b in since], IDS)
        ids.unionByName(taken).coalesce(1).write.parquet(f"{aside}/ids")
        if self._placed(aside, f"{self.root}/snapshot={number + 1}"):
            for name in past:
                delete(self.spark, f"{self.root}/{name}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) over all batches committed when this is called."""
        _, sums, _, since, _ = self._seen()
        return self._sums(sums, since)
