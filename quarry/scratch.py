"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a table to ``spark.checkpoint.dir`` and reading it back, so a lost
executor costs a re-read and not a recomputation.  The setting is taken from the session; only
where a session on one machine has none (tests, notebooks) a folder of this user's own is set, and a
cluster without the setting is an error.  All tables of an application lie in one folder (``clear``),
and those made inside a ``scope`` are deleted at its end.
"""

from __future__ import annotations

import getpass
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths made in the scope that is open here: each thread, and each task of an event loop, has its own.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_root(spark: SparkSession) -> str:
    """The shared folder, as a URL that Spark can read and write."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/quarry-{getpass.getuser()}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    path = f"{_own_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _scope.get()) is not None:
        made.append(path)
    return path


def _own_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/quarry/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has staged; no DataFrame that reads one may be used again."""
    delete(spark, _own_root(spark))


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside, by this thread or by threads that run in a copy of its context, are deleted at the end, when what
    was made from them has been written."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in made:
            delete(spark, path)


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back from there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(spark, parent)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """What the optimizer knows of the size of ``df`` (file sizes for a scan), without a job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partitions_for(df: DataFrame, bytes_each: int, column: str) -> int:
    """Enough partitions for ``bytes_each`` of input each, and no fewer than the session's.

    Where the optimizer knows no size (a table made from local rows), ``column`` is measured.
    """
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    if size >= 1 << 55:
        size = df.select(F.sum(F.octet_length(column))).first()[0] or 0
    return max(least, -(-size // bytes_each))


#: Files that a task parses.
FILES_A_TASK = 2000


def spread(files: DataFrame, key: str) -> DataFrame:
    """Rows that are costly to work on, dealt by ``key`` so that a task gets about ``FILES_A_TASK``, however few splits
    their table has."""
    parts = -(-files.count() // FILES_A_TASK)
    return files.repartition(parts, key) if parts > 1 else files


#: Bytes of files up to which a table made from them may be sent to all executors (compressed, they hold some forty times as much), and
#: bytes of files whose rows a task gets.
SENT, BYTES_A_TASK = 256 << 10, 8 << 20
#: Rows, where they are counted, that a task gets.
ROWS_A_TASK = 1 << 17


def scanned(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` is made from, each as often as it is read, without a job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` for joins that deal both sides by their keys, unless it is made from very little.

    The optimizer takes the bytes of compressed files for those of rows, and would send tables through the driver that hold
    many times as much.  With ``keys`` the rows are dealt by them at once, to as many tasks as the tables' bytes ask for.
    """
    size = scanned(df)
    if size <= SENT:
        return df
    parts = tasks_for(df)
    return (df.repartition(parts, *keys) if keys and parts > 1 else df).hint("merge")


def tasks_for(df: DataFrame, rows: int = 0) -> int:
    """Tasks among which the rows of ``df`` are dealt: one for ``BYTES_A_TASK`` of its tables or ``ROWS_A_TASK`` of its ``rows``, where
    they were counted, and no fewer than the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-scanned(df) // BYTES_A_TASK), -(-rows // ROWS_A_TASK))


def portioned(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of some ``rows`` dealt by ``keys``, a task for each ``ROWS_A_TASK`` and no fewer than the session's; what one task can
    hold is left to ``dealt``.

    Staged tables of names and paths take so few bytes that these don't tell how much memory their rows need, and what Spark shuffles
    of its own accord goes to as many tasks as the session names, however many rows there are.
    """
    if rows <= ROWS_A_TASK:
        return dealt(df)
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK)), *keys).hint("merge")


def joined(large: DataFrame, small: DataFrame, on: list[str], how: str, most: int) -> DataFrame:
    """A join that leaves ``large`` where it lies if ``small``, a staged table, is counted to ``most`` rows at
    most; beyond that both sides are dealt by the key."""
    return large.join(F.broadcast(small) if small.count() <= most else small, on, how)
