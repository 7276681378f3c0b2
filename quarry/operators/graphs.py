"""Call and import graphs: name resolution, weights, centrality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.scratch import dealt, portioned, staged, tasks_for


def call_edges(definitions: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst, weight) from definitions (fqn, name) and calls (caller_name, callee_name).

    Calls are told apart by their two names alone.  A name stands for all definitions of that name, so
    m callers and k callees share one call's weight; calls of a definition to itself are left out
    after that.  Definitions of names that are called are looked up apart: where these are few, they are sent to the
    calls, so that a name which everybody calls does not bring its calls together.  Edges are dealt by ``src``, as many tasks as
    their number, which is worked out before, asks for.
    """
    pairs = dealt(calls.where("caller_name is not null and callee_name is not null").select("caller_name", "callee_name"), "caller_name", "callee_name").distinct()
    pairs = staged(pairs, "call-pairs")
    named = staged(definitions.select("fqn", "name").where("name is not null").distinct(), "call-names")
    tasks = tasks_for(calls, max(pairs.count(), named.count()))
    found = f"""
        WITH c AS (SELECT /*+ REPARTITION({tasks}, caller_name) */ * FROM {{c}}), i AS (SELECT /*+ REPARTITION({tasks}, name) */ * FROM {{i}}),
        t AS (SELECT name, count(*) AS n FROM i GROUP BY name), u AS (SELECT t.* FROM t LEFT SEMI JOIN (SELECT DISTINCT callee_name FROM {{c}}) x ON t.name = x.callee_name),
        k AS (SELECT /*+ MERGE(t) */ c.callee_name, t.n FROM c JOIN t ON c.caller_name = t.name),
        m AS (SELECT i.*, count(*) OVER (PARTITION BY name) AS n FROM i),
        a AS (SELECT m.* FROM m), b AS (SELECT m.* FROM m LEFT SEMI JOIN (SELECT DISTINCT callee_name FROM {{c}}) x ON m.name = x.callee_name),
        e AS (SELECT /*+ MERGE(a) */ c.callee_name, a.fqn AS src, a.n FROM c JOIN a ON c.caller_name = a.name),
        f AS (SELECT e.src, b.fqn AS dst, 1D / (e.n * b.n) AS weight FROM e JOIN b ON e.callee_name = b.name WHERE e.src <> b.fqn)"""
    spark, given = calls.sparkSession, {"c": pairs, "i": named}
    met = spark.sql(f"{found} SELECT sum(k.n * u.n) AS n FROM k JOIN u ON k.callee_name = u.name", **given).first()["n"] or 0
    # three narrow columns: four edges take the memory of a wider row
    tasks = max(tasks, tasks_for(pairs, met // 4))
    return spark.sql(f"{found} SELECT src, dst, sum(weight) AS weight FROM (SELECT /*+ REPARTITION({tasks}, src) */ * FROM f) GROUP BY src, dst", **given)


def call_nodes(definitions: DataFrame, edges: DataFrame) -> DataFrame:
    """(fqn, in_weight, out_weight, n_callers, n_callees, centrality = 2 in + out); edges are one for each pair."""
    into = edges.groupBy(F.col("dst").alias("fqn")).agg(F.sum("weight").alias("in_weight"), F.count("*").alias("n_callers"))
    out = edges.groupBy(F.col("src").alias("fqn")).agg(F.sum("weight").alias("out_weight"), F.count("*").alias("n_callees"))
    nodes = portioned(definitions.select("fqn"), definitions.count(), "fqn").distinct().join(into, "fqn", "left").join(out, "fqn", "left").na.fill(0)
    return nodes.withColumn("centrality", F.expr("2 * in_weight + out_weight"))


def hot(nodes: DataFrame, n: int = 10) -> DataFrame:
    return nodes.where("centrality > 0").orderBy(F.round("centrality", 6).desc(), "fqn").limit(n)


def contract_health(definitions: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: calls with a caller, those whose caller is a definition or its parent, the rest."""
    known = definitions.select(F.explode(F.array("name", "parent")).alias("caller_name")).where("caller_name is not null").distinct().withColumn("known", F.lit(1))
    return calls.where("caller_name is not null").join(known, "caller_name", "left").agg(
        F.count("*").alias("total"), F.count("known").alias("resolved"), F.expr("count(*) - count(known)").alias("dropped"), F.expr("count(known) / count(*)").alias("rate")
    )


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): each import's first candidate path that exists; no self edges, and each edge once.

    imports: (source_file, candidates array<string> in order of preference).
    """
    # what candidates stand for does not hang on the file that names them
    asked = dealt(imports.select("candidates"), "candidates").distinct()
    tried = dealt(asked.selectExpr("candidates", "posexplode(candidates) as (pos, path)"), "path").join(dealt(files.select("path")), "path")
    found = dealt(tried.select("candidates", "pos", "path"), "candidates").groupBy("candidates").agg(F.expr("min_by(path, pos)").alias("dst"))
    edges = dealt(imports.select("source_file", "candidates"), "candidates").join(dealt(found), "candidates").where("dst <> source_file")
    return dealt(edges.selectExpr("source_file as src", "dst"), "src", "dst").distinct()


def file_centrality(edges: DataFrame) -> DataFrame:
    """(path, n_imports, n_importers, centrality = 2 importers + imports); edges are one for each pair."""
    ends = edges.selectExpr("inline(array(struct(src as path, 1L as goes, 0L as comes), struct(dst as path, 0L as goes, 1L as comes)))")
    return dealt(ends, "path").groupBy("path").agg(F.sum("goes").alias("n_imports"), F.sum("comes").alias("n_importers")).withColumn("centrality", F.expr("2 * n_importers + n_imports"))


def top_dropped(definitions: DataFrame, calls: DataFrame, top: int = 5) -> DataFrame:
    """(caller_name, calls): callers that are no definition and no parent of one, those with most calls."""
    known = definitions.select(F.explode(F.array("name", "parent")).alias("caller_name")).where("caller_name is not null").distinct()
    return calls.where("caller_name is not null").join(known, "caller_name", "left_anti").groupBy("caller_name").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "caller_name").limit(top)


def important_files(file_nodes: DataFrame, hot_: DataFrame) -> DataFrame:
    """(path) of files that are central, or hold one of the hot functions (fqn)."""
    return file_nodes.where("centrality > 0").select("path").unionByName(hot_.selectExpr("split_part(fqn, ':', 1) as path")).distinct()
