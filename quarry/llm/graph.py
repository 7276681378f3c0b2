"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over edges; nothing is gathered on the driver, and
a hub's edges are dealt by joins that adaptive execution can split.  Rounds are cut by staged
tables in the shared folder, and the edges are worked out once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.scratch import discard, staged


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least node among u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return edges.join(least, edges["u"] == least["k"]).select("u", "v", "m")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp) for every node of ``edges`` (u, v); comp is the component's least node.

    Self-loops keep a node without edges in the result.  Null ends are dropped.
    """
    edges = staged(edges.where("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = edges.where("u <> v")
    last = None
    while True:
        both = now.union(now.select("v", "u"))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        step = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = staged(step, f"{name}-round")
        mark = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.count_distinct("u")).first()
        if last is not None:
            discard(now.sparkSession, now)
        now = new
        if mark == last or mark[0] == 0:
            break
        last = mark
    return nodes.join(now.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("comp"))


def spanning(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links (u, v) among rows 0..n-1 that a forest keeps."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = np.zeros(len(u), bool)
    for k, (x, y) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        a, b = find(x), find(y)
        if a != b:
            root[b] = a
            keep[k] = True
    return u[keep], v[keep]
