"""Version history as tables, read by calling git; all paths are relative to the folder asked for, and what lies
outside it is left out.

A failed call or a missing repository gives an empty table: a tree without history is no error.  Log and
status come from one call on the driver (their size is that of the history asked for); blame runs
once for each file, in tasks.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMEOUT = 5
#: Files that mark a project's top.
MARKERS = ("pyproject.toml", "setup.py", "package.json", "go.mod", "Cargo.toml")


def _git(root: str, *args: str, timeout: float = TIMEOUT) -> str:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


def repo_root(path: str) -> str:
    """The work tree's top, else the nearest folder with a project marker, else the folder itself."""
    folder = os.path.abspath(path if os.path.isdir(path) else os.path.dirname(path))
    if top := _git(folder, "rev-parse", "--show-toplevel").strip():
        return top
    at = folder
    while not any(os.path.exists(os.path.join(at, m)) for m in MARKERS):
        if os.path.dirname(at) == at:
            return folder
        at = os.path.dirname(at)
    return at


def commits(spark: SparkSession, root: str, existing_only: bool = True) -> DataFrame:
    """(commit_id, ts, path) of every commit; by default of files that are still there."""
    rows, commit, ts = [], "", 0
    for line in _git(root, "-c", "core.quotePath=false", "log", "--no-renames", "--relative", "--name-only", "--format=%x01%H %ct", timeout=60).splitlines():
        if line.startswith("\x01"):
            commit, ts = line[1:].split(" ")
        elif line and (not existing_only or os.path.exists(os.path.join(root, line))):
            rows.append((commit, int(ts), line))
    return spark.createDataFrame(rows, "commit_id string, epoch long, path string").selectExpr("commit_id", "timestamp_seconds(epoch) as ts", "path")


def line_edits(root: str, paths: DataFrame, since_epoch: int = 0) -> DataFrame:
    """(path, line_no, commit_id) of the lines of ``paths`` (path) last written at or after a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                commit, line_no, time = "", 0, {}
                for line in _git(root, "blame", "--line-porcelain", "--", path).splitlines():
                    head = line.split(" ")
                    if line.startswith("\t"):
                        if time.get(commit, 0) >= since_epoch:
                            out.append((path, line_no, commit))
                    elif head[0] == "committer-time":
                        time[commit] = int(head[1])
                    elif len(head[0]) == 40 and len(head) >= 3:
                        commit, line_no = head[0], int(head[2])
            yield pd.DataFrame(out, columns=["path", "line_no", "commit_id"])

    return paths.select("path").mapInPandas(run, "path string, line_no long, commit_id string")


def changed(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    """(path, status, old_path) against a revision: A, M, D, R, and ? for files that are not tracked."""
    rows = []
    for line in _git(root, "-c", "core.quotePath=false", "diff", "--relative", "--name-status", "-M", ref, "--").splitlines():
        status, *names = line.split("\t")
        rows.append((names[-1], status[:1], names[0]))
    rows += [(p, "?", None) for p in _git(root, "-c", "core.quotePath=false", "ls-files", "--others", "--exclude-standard").splitlines()]
    return spark.createDataFrame(rows, "path string, status string, old_path string")


def old_files(root: str, paths: DataFrame, ref: str = "HEAD") -> DataFrame:
    """(path, content) of ``paths`` (path) as they were at a revision; those not there then are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [(p, _git(root, "show", f"{ref}:./{p}")) for p in batch["path"] if _git(root, "ls-tree", ref, "--", p)]
            yield pd.DataFrame(kept, columns=["path", "content"])

    return paths.select("path").mapInPandas(run, "path string, content string")


def file_churn(spark: SparkSession, root: str, path: str, days: int = 90) -> int:
    """Commits of one file in the window that the last commit of the folder ends."""
    from quarry.operators.changes import active_window

    return active_window(commits(spark, root, existing_only=False), days).where(F.col("path") == path).select("commit_id").distinct().count()
