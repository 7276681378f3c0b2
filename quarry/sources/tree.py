"""A directory tree as a table.

Spark's file sources hide names that begin with ``_`` or ``.``, and source trees are full of them, so
the tree is a Python data source: the driver lists names and sizes, and cuts the list into parts of
about equal bytes; the tasks read the files.  Folders that are skipped or ignored are not entered.  The
tree must be mounted alike on all machines.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions.pattern_tables import language_of
from quarry.operators import rules
from quarry.operators.paths import expand_braces, ignore_rules, ignored

SNIFF, PART_BYTES, BATCH = 8192, 32 << 20, 256
SCHEMA = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.float64()), ("is_binary", pa.bool_()), ("content", pa.string())])


class _Part(InputPartition):
    def __init__(self, entries: list[tuple[str, int, float]]):
        self.entries = entries


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        self.contents = options.get("contents", "true").lower() == "true"
        self.rules = [(negated, re.compile(regex)) for _, negated, regex in json.loads(options.get("rules", "[]"))]

    def _ignored(self, path: str) -> bool:
        """Whether the last rule that matches says so."""
        return next((not negated for negated, regex in reversed(self.rules) if regex.match(path)), False)

    def partitions(self) -> list[_Part]:
        parts, entries, held = [], [], 0
        for folder, dirs, names in os.walk(self.root):
            here = os.path.relpath(folder, self.root).replace(os.sep, "/")
            below = "" if here == "." else here + "/"
            dirs[:] = sorted(d for d in dirs if d not in rules.SKIP_DIRS and not (d.lower().endswith(rules.SKIP_DIR_SUFFIXES) and d[:1] != ".") and not self._ignored(below + d))
            for name in sorted(names):
                full = os.path.join(folder, name)
                if not os.path.isfile(full) or name in rules.SKIP_FILES or os.path.splitext(name)[1][1:].lower() in rules.SKIP_EXTENSIONS or self._ignored(below + name):
                    continue
                s = os.stat(full)
                entries.append((below + name, s.st_size, s.st_mtime))
                held += s.st_size
                if held >= PART_BYTES:
                    parts, entries, held = [*parts, _Part(entries)], [], 0
        return [*parts, _Part(entries)]

    def _row(self, path: str, size: int, mtime: float) -> tuple:
        if not self.contents:
            return path, size, mtime, None, None
        try:
            with open(os.path.join(self.root, path), "rb") as f:
                raw = f.read()
        except FileNotFoundError:  # gone since it was listed
            return path, size, mtime, None, None
        binary = b"\0" in raw[:SNIFF]
        return path, size, mtime, binary, None if binary else raw.decode("utf-8", "replace")

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(partition.entries), BATCH):
            rows = [self._row(*e) for e in partition.entries[i : i + BATCH]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, size long, mtime double, is_binary boolean, content string"

    def reader(self, schema) -> _TreeReader:
        return _TreeReader(self.options)


def rules_of(root: str) -> list[tuple[int, bool, str]]:
    """Ignore rules of the folders from the outermost with a rule file down to ``root``, in order."""
    text, folder = [], os.path.abspath(root)
    while True:
        name = os.path.join(folder, ".gitignore")
        if os.path.isfile(name):
            with open(name, encoding="utf-8", errors="replace") as f:
                text.insert(0, f.read())
        if os.path.dirname(folder) == folder or os.path.isdir(os.path.join(folder, ".git")):
            return ignore_rules("\n".join(text))
        folder = os.path.dirname(folder)


def files(spark: SparkSession, root: str, contents: bool = True, respect_ignore: bool = True) -> DataFrame:
    """(path, size, mtime, is_binary, content, language); without ``contents`` no file is opened.

    Binary files have null content.  Ignored directories take all below them.
    """
    spark.dataSource.register(TreeSource)
    rules_ = rules_of(root) if respect_ignore else []
    rows = spark.read.format("tree").option("contents", str(contents).lower()).option("rules", json.dumps(rules_)).load(os.path.abspath(root))
    return rows.selectExpr("*", f"{language_of()} as language")


def one_file(spark: SparkSession, root: str, path: str) -> DataFrame:
    """One file of a tree, whatever the rules say."""
    full = os.path.join(root, path)
    raw = spark.read.format("binaryFile").load(os.path.abspath(full)).selectExpr(f"{rules.listed([path])} as path", "length as size", "cast(modificationTime as double) as mtime", f"locate(cast(X'00' as string), cast(left(content, {SNIFF}) as string)) > 0 as is_binary", "content")
    return raw.selectExpr("path", "size", "mtime", "is_binary", "if(is_binary, null, decode(content, 'utf-8')) as content", f"{language_of()} as language")


def scanned(files_: DataFrame, glob: str = "**/*", exclude: str = "", max_files: int | None = None) -> DataFrame:
    """files as a directory scan takes them: by glob with braces, without hidden folders, what is always left out or asked to be, and
    files of a language that a scan passes over; ``unsupported`` tells binary files.  A limit takes the first by path."""
    globs = " or ".join(rules.glob_match("path", g) for g in expand_braces(glob))
    hidden = "exists(slice(split(path, '/'), 1, greatest(0, size(split(path, '/')) - 1)), d -> d like '.%')"
    kept = files_.where(f"({globs}) and not {hidden} and not coalesce({rules.scan_skips('language', rules.name_of('path'))}, false)")
    gone = ignored(kept.select("path"), ignore_rules(rules.DEFAULT_EXCLUSIONS + exclude)).where("ignored").select("path")
    kept = kept.join(gone, "path", "left_anti").withColumn("unsupported", F.expr("coalesce(is_binary, false)"))
    return kept.orderBy("path").limit(max_files) if max_files is not None else kept


def summary(files_: DataFrame, max_depth: int = 5) -> DataFrame:
    """(dir, parent, name, n_files, size) of each folder down to a depth, from a listing without contents."""
    placed = files_.selectExpr("split(path, '/') as parts", "size").selectExpr("parts", "size", f"least(size(parts) - 1, {max_depth}) as depth")
    own = placed.selectExpr("array_join(slice(parts, 1, depth), '/') as dir", "size").groupBy("dir").agg(F.count("*").alias("n_files"), F.sum("size").alias("size"))
    every = placed.selectExpr("explode(transform(sequence(0, depth), i -> array_join(slice(parts, 1, i), '/'))) as dir").distinct()
    parent = "if(dir = '', null, if(dir like '%/%', regexp_replace(dir, '/[^/]*$', ''), ''))"
    return every.join(own, "dir", "left").selectExpr("dir", f"{parent} as parent", "regexp_extract(dir, '([^/]*)$', 1) as name", "coalesce(n_files, 0) as n_files", "coalesce(size, 0) as size")


def content(spark: SparkSession, text: str, filename: str) -> DataFrame:
    """A text in memory as a one-row table of the same shape."""
    return spark.createDataFrame([(filename, len(text.encode()), None, False, text)], "path string, size long, mtime double, is_binary boolean, content string").selectExpr("*", f"{language_of()} as language")
