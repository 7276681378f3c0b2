"""Near-duplicate embeddings by product quantisation.

Equal vectors under one label are one class.  Classes are normalised and filed in coarse inverted
lists, about as many as the square root of the classes; the residual to the list's centre is coded by subspaces.  A class probes every list that can hold
a link of it (``Quantiser.reached``), however many these are, so that no link is lost between lists; in
each, distances to the stored codes are summed from per-subspace tables, and a class is a candidate
when that distance is within the link distance plus the stored vector's own coding error, so that the
codes themselves lose nothing (triangle inequality).  Candidates are ranked by their exact cosine in
double precision.  Centres and codebooks are fitted on a bounded sample; every class is filed.

Neighbouring lists make a bucket, and a class is sent once to each bucket that it probes a list of, so that the copies
of a class grow with the classes of a label and not with the lists.  Buckets that hold much are cut into blocks, and the probing
classes too, so that a task holds a block of each.  A task does not hand on pairs: it counts the links of each class on either side, and hands on a
spanning set of them, so what it gives is no more than what it was given.

Centres and codebooks live in the space of the most common dimension; a vector of another dimension is
filed by its leading coordinates (or zeros after them), which brings vectors nearer together, never
farther apart, so the bounds above still lose nothing.  It is compared with vectors of its own dimension.

Defined results: a vector that is null, zero, or holds null or non-finite components links with nothing,
and so does one without a label; a cosine of exactly the bound is a link; repeated rows are vectors of
their own that link with one another; a null vec_id takes part and never names a component; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.centres import kmeans, nearest
from quarry.llm.graph import components, spanning
from quarry.llm.sampling import sampled
from quarry.scratch import staged

COSINE = 0.93
SUBSPACES, CODES = 8, 64
#: Bytes of the coarse centres at most, which every worker holds, and of the classes that centres and codebooks are fitted on (double
#: precision); of these so many at least if they fit, and so many for each list.
CENTRE_BYTES, SAMPLE_BYTES, SAMPLE, SAMPLE_A_LIST = 64 << 20, 96 << 20, 16_384, 16
SEED, ROUNDS = 5, 12
#: Classes of a label that a bucket and a block hold, about, bytes of a block's vectors, and buckets at least.
BLOCK, BLOCK_BYTES, BUCKETS = 8192, 32 << 20, 4


class Quantiser:
    """Centres and codebooks; their size is bounded by CENTRE_BYTES, SUBSPACES, CODES and the dimension."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = kmeans(sample, lists, SEED, ROUNDS)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(rest[:, c], CODES, SEED, ROUNDS) for c in self.cuts]

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals to the lists ``at``, and each one's coding error."""
        rest = x - self.centres[at]
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1)
        coded = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.sqrt(((rest - coded) ** 2).sum(axis=1))

    def reached(self, x: np.ndarray, at: np.ndarray, reach: float) -> list[np.ndarray]:
        """For each row of list ``at`` the lists, from its own on, that can hold a vector within ``reach``.

        A vector of list c lies on c's side of the plane halfway between c and the row's own centre, so a
        row farther than ``reach`` from that side has nothing there.  This holds from both ends of a link;
        the end in the list of the lower number asks.
        """
        cells = np.arange(len(self.centres))
        return [np.flatnonzero(row) for i in range(0, len(x), 1024) for row in self.reaches(x[i : i + 1024], at[i : i + 1024], cells, reach)]

    def reaches(self, x: np.ndarray, at: np.ndarray, cells: np.ndarray, reach: float) -> np.ndarray:
        """For each row and each of the lists ``cells`` whether the row asks there."""
        square, centres, own = (self.centres**2).sum(axis=1), self.centres[cells], self.centres[at]
        d = square[cells] - 2 * x @ centres.T - (square[at] - 2 * (x * own).sum(axis=1))[:, None]
        wide = np.sqrt(np.maximum(0.0, square[at][:, None] + square[cells] - 2 * own @ centres.T))
        return (d <= 2 * wide * reach + 1e-6) & (cells >= at[:, None])

    def tables(self, x: np.ndarray, at: int) -> np.ndarray:
        """For each row and subspace the squared distance to every code of list ``at``."""
        rest = x - self.centres[at]
        out = np.full((len(x), len(self.books), CODES), np.inf)
        for k, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[:, k, : len(b)] = ((rest[:, c][:, None] - b[None]) ** 2).sum(axis=2)
        return out


def _normal(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as rows of length 1, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fitted(x: np.ndarray, width: int) -> np.ndarray:
    """The leading ``width`` coordinates, zeros where there are fewer."""
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _filer(handle, cosine: float, buckets: int):
    """A class with its list, its codes, its bucket and the buckets in which it probes a list."""
    reach = np.sqrt(2 - 2 * cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = handle.value
        for whole in batches:
            dims = whole.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                batch = whole.filter(pa.array(dims == dim))
                x = _fitted(_normal(batch.column("embedding")), q.centres.shape[1])
                cell = nearest(x, q.centres)
                codes, error = q.encode(x, cell)
                probes = [np.unique(lists * buckets // len(q.centres)) for lists in q.reached(x, cell, reach)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(cell * buckets // len(q.centres), pa.int64()), pa.array(probes, pa.list_(pa.int64()))],
                    names=[*batch.schema.names, "cell", "codes", "error", "bucket", "probes"],
                )

    return run


def _searcher(handle, cosine: float):
    """For a block of a bucket and a block of classes that probe some of its lists: (u, v, n) where v is null: n vectors that u
    links with here; else a link of the spanning set."""
    reach = np.sqrt(2 - 2 * cosine)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        u, v, n = [], [], []
        if left.num_rows and right.num_rows:
            q, cell, home = handle.value, left.column("cell").to_numpy(), right.column("home").to_numpy()
            stored, asked = _normal(left.column("embedding")), _normal(right.column("embedding"))
            short = _fitted(asked, q.centres.shape[1])
            sid, aid = (t.column("rep").to_pylist() for t in (left, right))
            held = {r: k for k, r in enumerate(sid)}
            own = np.array([held.get(r, -1) for r in aid])  # the same class on both sides
            ws, wa = (t.column("weight").to_numpy() for t in (left, right))
            codes = np.stack([np.frombuffer(c, np.uint8) for c in left.column("codes").to_pylist()])
            limit = (reach + left.column("error").to_numpy() + 1e-6) ** 2
            links_a, links_s = np.zeros(len(asked), np.int64), np.zeros(len(stored), np.int64)
            ties: list[tuple[np.ndarray, np.ndarray]] = []
            lists = np.unique(cell)
            asks = np.concatenate([q.reaches(short[i : i + 1024], home[i : i + 1024], lists, reach) for i in range(0, len(short), 1024)])
            for k_at, at in enumerate(lists):
                here, who = np.flatnonzero(cell == at), np.flatnonzero(asks[:, k_at])
                step = int(np.clip((1 << 18) // len(here), 256, 2048))
                for i in range(0, len(who), step):
                    part = who[i : i + step]
                    tables = q.tables(short[part], at)
                    d = sum(tables[:, k, codes[here, k]] for k in range(codes.shape[1]))
                    a, s = np.nonzero((d <= limit[here][None]) & (own[part, None] != here[None]))
                    a, s = part[a], here[s]
                    exact = np.concatenate([(asked[a[j : j + 65536]] * stored[s[j : j + 65536]]).sum(axis=1) >= cosine for j in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
                    a, s = a[exact], s[exact]
                    inside = home[a] == at  # such pairs are met from either end
                    np.add.at(links_a, a, ws[s])
                    np.add.at(links_s, s[~inside], wa[a[~inside]])
                    if len(a):  # the first link of each row, then what these leave apart
                        ties.append((a, s))
                        if sum(len(x) for x, _ in ties) > 4 * (len(asked) + len(stored)):
                            ties = [_thinned(len(asked), len(stored), ties)]
            for ids, links in ((aid, links_a), (sid, links_s)):
                for k in np.flatnonzero(links):
                    u.append(ids[k])
                    v.append(None)
                    n.append(int(links[k]))
            if ties:
                for a, s in zip(*_thinned(len(asked), len(stored), ties), strict=True):
                    u.append(aid[a])
                    v.append(sid[s])
                    n.append(0)
        return pa.table([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(n, pa.int64())], names=["u", "v", "n"])

    return run


def _thinned(n: int, m: int, ties: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links between ``n`` asking and ``m`` stored rows."""
    a, s = (np.concatenate(x) for x in zip(*ties, strict=True))
    u, v = spanning(n + m, a, n + s)
    return u, v - n


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    # single precision is kept as it is: half the bytes, the same numbers
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), "label")
    fit = "coalesce(label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0), false)"
    # a class is named by 128 bits of its own, not by a vec_id, which may be null or repeated
    name = "unhex(concat(lpad(hex(xxhash64(label, embedding)), 16, '0'), lpad(hex(xxhash64('class', label, embedding)), 16, '0')))"
    rows = rows.withColumn("rep", F.expr(f"case when {fit} then {name} end"))
    classes = rows.where("rep is not null").groupBy("rep").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("weight")).withColumn("dim", F.size("embedding"))
    classes = staged(classes, "pq-classes")
    n = classes.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    common = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    lists = max(1, min(int(np.sqrt(n)), CENTRE_BYTES // (8 * common["dim"])))
    wanted = max(1, min(max(SAMPLE, SAMPLE_A_LIST * lists), SAMPLE_BYTES // (8 * common["dim"])))
    fitting = sampled(classes.where(F.col("dim") == common["dim"]), "rep", "quantiser", wanted, common["count"]).orderBy("rep").select("embedding").toArrow()
    handle = spark.sparkContext.broadcast(Quantiser(_normal(fitting.column("embedding")), lists))
    label = f"label {dict(rows.dtypes)['label']}"
    block = f"greatest(1, least({BLOCK}, {BLOCK_BYTES} div (8 * dim)))"
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    buckets = min(lists, max(BUCKETS, -(-most // max(1, min(BLOCK, BLOCK_BYTES // (8 * common["dim"]))))))
    filed = staged(classes.select("rep", "label", "dim", "weight", "embedding").mapInArrow(_filer(handle, cosine, buckets), f"rep binary, {label}, dim int, weight long, embedding {kind}, cell long, codes binary, error double, bucket long, probes array<long>"), "pq-filed")
    asking = filed.selectExpr("rep", "label", "dim", "weight", "embedding", "cell as home", "explode(probes) as bucket")
    place = ["label", "dim", "bucket"]
    held = filed.groupBy(*place).agg(F.expr(f"cast(ceil(count(*) / {block}) as int)").alias("db"))
    blocks = held.join(asking.groupBy(*place).agg(F.expr(f"cast(ceil(count(*) / (2 * {block})) as int)").alias("qb")), place)
    own = "cast(pmod(xxhash64(rep), {}) as int)"
    stored = filed.drop("probes").join(blocks, place).select("*", F.expr(own.format("db")).alias("d"), F.explode(F.expr("sequence(0, qb - 1)")).alias("q"))
    asked = asking.join(blocks, place).select("*", F.expr(own.format("qb")).alias("q"), F.explode(F.expr("sequence(0, db - 1)")).alias("d"))
    stored, asked = stored.toDF(*stored.columns), asked.toDF(*asked.columns)
    key = [*place, "d", "q"]
    found = staged(stored.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_searcher(handle, cosine), "u binary, v binary, n long"), "pq-links")
    around = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    comps = components(found.where("v is not null").selectExpr("least(u, v) as u", "greatest(u, v) as v").distinct(), "pq").select(F.col("node").alias("rep"), "comp")
    table = classes.select("rep", "weight").join(around, "rep", "left").join(comps, "rep", "left").select("rep", F.expr("weight - 1 + coalesce(others, 0)").alias("n_links"), F.expr("coalesce(comp, rep)").alias("comp"))
    named = rows.select("vec_id", "rep").join(table, "rep", "left")
    least = named.where("comp is not null").groupBy("comp").agg(F.min("vec_id").alias("least"))
    out = named.join(least, "comp", "left").select("vec_id", F.expr("coalesce(n_links, 0L)").alias("n_links"), F.expr("case when comp is null then vec_id else least end").alias("component_id"))
    return out.select("*", F.expr("vec_id <=> component_id").alias("kept"))
