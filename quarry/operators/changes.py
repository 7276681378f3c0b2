"""Node diffs, history signals and blame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.scratch import dealt

MAX_FILES_IN_COMMIT, TOP_PAIRS = 20, 5


def node_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, node_key, status) from two tables (path, node_key, digest)."""
    o, n = old.withColumnRenamed("digest", "before"), new.withColumnRenamed("digest", "after")
    return dealt(o).join(dealt(n), ["path", "node_key"], "full").selectExpr("path", "node_key", "case when before is null then 'new' when after is null then 'removed' when before = after then 'unchanged' else 'changed' end as status")


def node_keys(nodes: DataFrame) -> DataFrame:
    """nodes (path, node_id, chain array<struct<type,name>>, lines array<string>) as (path, node_key, digest).

    The digest is of the lines, right-trimmed and without blank ones; of nodes with one key the last counts.
    """
    body = "array_join(filter(transform(lines, x -> rtrim(x)), x -> x <> ''), '\n')"
    return nodes.selectExpr("path", "node_id", "concat('/', array_join(transform(chain, c -> concat(c.type, ':', c.name)), '/')) as node_key", f"sha1({body}) as digest").groupBy("path", "node_key").agg(F.expr("max_by(digest, node_id)").alias("digest"))


def active_window(commits: DataFrame, days: int = 90) -> DataFrame:
    """Commits of the ``days`` before the last one: the data is the clock."""
    return commits.join(F.broadcast(commits.agg(F.max("ts").alias("last"))), F.expr(f"ts >= last - interval {days} days")).drop("last")  # one row


def churn(commits: DataFrame) -> DataFrame:
    return commits.groupBy("path").agg(F.count_distinct("commit_id").alias("churn"))


def co_change(commits: DataFrame, top: int = TOP_PAIRS, least: int = 2) -> DataFrame:
    """Pairs of files that commits of 2 to 20 files touch together: the top ones, then those often enough."""
    one = commits.select("commit_id", "path").distinct()
    sized = one.selectExpr("*", "count(*) over (partition by commit_id) as n").where(f"n between 2 and {MAX_FILES_IN_COMMIT}")
    pairs = sized.sparkSession.sql("SELECT x.path AS a, y.path AS b, count(*) AS together FROM {s} x JOIN {s} y ON x.commit_id = y.commit_id AND x.path < y.path GROUP BY x.path, y.path", s=sized)
    return pairs.orderBy(F.desc("together"), "a", "b").limit(top).where(f"together >= {least}")


def span_edits(spans: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, node_id, edits): different commits on the lines of each span."""
    return spans.sparkSession.sql("SELECT s.path, s.node_id, count(DISTINCT e.commit_id) AS edits FROM {s} s LEFT JOIN {e} e ON s.path = e.path AND e.line_no BETWEEN s.start_line AND s.end_line GROUP BY s.path, s.node_id", s=spans, e=edits)


def apply_delta(nodes: DataFrame, diff: DataFrame) -> DataFrame:
    """nodes (path, node_key, skeleton, ...) with ``status``; unchanged ones keep their header and lose their skeleton."""
    labels = diff.select("path", "node_key", "status")
    return nodes.join(labels, ["path", "node_key"], "left").withColumn("skeleton", F.expr("if(status = 'unchanged', null, skeleton)"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """(path, changed, unchanged, removed): new or changed nodes, unchanged ones, and the names of those that are gone."""
    name = "regexp_extract(node_key, '([^:]*)$', 1)"
    return diff.groupBy("path").agg(F.expr("count_if(status in ('new', 'changed'))").alias("changed"), F.expr("count_if(status = 'unchanged')").alias("unchanged"), F.expr(f"array_join(array_sort(collect_list(if(status = 'removed', {name}, null))), ', ')").alias("removed"))
