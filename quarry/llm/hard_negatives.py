"""Hard negatives of anchors, by k-means inverted lists.

Rows are filed in the list of their nearest centre, and a list stores the radius around its centre.  By
Cauchy and Schwarz no row of a list can score more than anchor . centre + |anchor| * radius, nor less than the
same with a minus.  An anchor visits lists by that upper bound, highest first; a list whose two bounds
leave it outside the window of scores that is asked for is skipped, and the visits stop when the bound falls
strictly below the kth score found.  Visits go in rounds, each over four times as many lists, as jobs over all
anchors that are still asking; positives are sought first, with an open window and under the same label,
then negatives, with the window of each positive, under other labels.

Scores are integer products of floor(256 * x), exact in double precision below 2**53.  Rows of equal vector and
label are one class with its first six ids, as no answer can hold more of them.  A task holds a block of a
list and a block of the anchors that visit it, so a list with a third of all rows is many tasks.

Centres are fitted on a bounded sample (SAMPLE_BYTES, CENTRE_BYTES); every row is filed.  Rows of another
dimension than the most common one are one list each, around zero, and are compared among themselves.

Defined results: rows without a vec_id, a label, a vector, or with null or non-finite components take no
part; zero and empty vectors score 0 with all; repeated rows count once; rows that share a vec_id but differ
are rows and anchors of their own, and no row is a partner of its own vec_id; anchors without positives or
without rows in a window give no rows; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.centres import kmeans, nearest
from quarry.llm.sampling import sampled
from quarry.scratch import staged

POSITIVES = NEGATIVES = 5
#: Anchors are rows whose vec_id this divides; a negative scores this share of its positive at least, in hundredths.
EVERY, LEAST = 100, 80
#: Centres are this large together at most, and vectors that they are fitted on (double precision).
CENTRE_BYTES, SAMPLE_BYTES, SAMPLE_A_LIST = 32 << 20, 128 << 20, 16
#: Rows of a list, and anchors, that a task holds; lists that an anchor visits in the first round.
BLOCK, FIRST = 1024, 4
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_WINDOWS = "array<struct<w:int,least:double,most:double>>"
_ANCHOR = "aid string, vec_id long, label long, dim int, embedding {kind}"


def _whole(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as rows of floor(256 * x)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


class Lists:
    """Centres, numbers and radii of the lists of each dimension."""

    def __init__(self, rows: list[tuple[int, int, float]], common: int, centres: np.ndarray):
        self.at = {}
        for dim in {d for d, _, _ in rows}:
            cells, radii = zip(*sorted((c, r) for d, c, r in rows if d == dim), strict=True)
            self.at[dim] = np.array(cells), centres[list(cells)] if dim == common else np.zeros((1, dim)), np.array(radii)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the lists, and for each row the least and the greatest score that each can hold."""
        cells, centres, radii = self.at[x.shape[1]]
        middle, reach = x @ centres.T, np.linalg.norm(x, axis=1)[:, None] * radii[None]
        slack = 1e-6 + 1e-9 * (np.abs(middle) + reach)
        return cells, middle - reach - slack, middle + reach + slack


def _filer(handle, common: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                batch = whole.filter(pa.array(dims == dim))
                x = _whole(batch.column("embedding")) if dim else np.zeros((batch.num_rows, 0))
                cell = nearest(x, handle.value) if dim == common else np.zeros(len(x), np.int64)
                far = np.sqrt(((x - (handle.value[cell] if dim == common else 0)) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return run


def _planner(handle, step: int):
    """An anchor with the next lists that it visits, at most ``step``, and how far in its order it then is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                batch = whole.filter(pa.array(dims == dim))
                x = _whole(batch.column("embedding")) if dim else np.zeros((batch.num_rows, 0))
                windows, past = batch.column("windows").to_pylist(), batch.column("past").to_pylist()
                chosen, at = [], []
                for i in range(0, len(x), 256):
                    cells, low, high = handle.value.bounds(x[i : i + 256])
                    for k in range(len(low)):
                        least, most = (np.array([w[n] for w in windows[i + k]], np.float64) for n in ("least", "most"))
                        order = np.argsort(-high[k], kind="stable")
                        order = order[past[i + k] : np.searchsorted(-high[k][order], -least.min(), "right")] if len(least) else order[:0]
                        wanted = ((high[k][order][:, None] >= least) & (low[k][order][:, None] <= most)).any(axis=1)
                        places = np.flatnonzero(wanted)[:step]
                        chosen.append(cells[order[places]].tolist())
                        at.append(past[i + k] + int(places[-1]) + 1 if len(places) else past[i + k])
                names = batch.schema.names
                columns = [batch.column(n) if n != "past" else pa.array(at, pa.int32()) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(chosen, pa.list_(pa.int64()))], names=[*names, "cells"])

    return run


def _visitor(same: bool, want: int):
    """For a block of a list and a block of anchors that visit it: the best rows for each window (aid, w, score, id)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[str, int, int, int]] = []
        if left.num_rows and right.num_rows:
            width = left.column("dim")[0].as_py()
            x, a = (_whole(t.column("embedding")) if width else np.zeros((t.num_rows, 0)) for t in (left, right))
            labels, asked = (t.column("label").to_numpy() for t in (left, right))
            ids = left.column("ids").to_pylist()
            aids, own, windows = (right.column(n).to_pylist() for n in ("aid", "vec_id", "windows"))
            for i in range(0, len(a), 256):
                scores = a[i : i + 256] @ x.T
                fit = (labels[None] == asked[i : i + 256, None]) == same
                for k in range(len(scores)):
                    for w in windows[i + k]:
                        found = np.flatnonzero(fit[k] & (scores[k] >= w["least"]) & (scores[k] <= w["most"]))
                        if len(found) > want + 1:  # one of them may be the anchor itself
                            s = scores[k][found]
                            found = found[s >= np.partition(s, -want - 1)[-want - 1]]
                        best = sorted((-int(scores[k][f]), j) for f in found for j in ids[f] if j != own[i + k])
                        out += [(aids[i + k], w["w"], -s, j) for s, j in best[:want]]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["aid", "w", "score", "id"])

    return run


def _search(anchors: DataFrame, filed: DataFrame, held: DataFrame, handle, kind: str, same: bool, want: int) -> DataFrame:
    """(aid, w, score, id, rank): the first rows by score, then id, that each window of each anchor lets in."""
    spark, columns = anchors.sparkSession, f"{_ANCHOR.format(kind=kind)}, windows {_WINDOWS}, past int"
    state, step, best = anchors.withColumn("past", F.lit(0)), FIRST, None
    place = ["dim", "cell"]
    while True:
        asking = staged(state.mapInArrow(_planner(handle, step), f"{columns}, cells array<long>").where("size(cells) > 0"), "negatives-asking")
        if asking.isEmpty():
            break
        visits = asking.selectExpr("aid", "vec_id", "label", "dim", "embedding", "windows", "explode(cells) as cell")
        blocks = held.join(visits.groupBy(*place).agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("qb")), place)
        own = "cast(pmod(xxhash64({}), {}) as int)"
        stored = filed.join(F.broadcast(blocks), place).select("*", F.expr(own.format("rep", "db")).alias("d"), F.explode(F.expr("sequence(0, qb - 1)")).alias("q"))  # a row for each list
        asked = visits.join(F.broadcast(blocks), place).select("*", F.expr(own.format("aid", "qb")).alias("q"), F.explode(F.expr("sequence(0, db - 1)")).alias("d"))
        stored, asked, key = stored.toDF(*stored.columns), asked.toDF(*asked.columns), [*place, "d", "q"]
        found = stored.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_visitor(same, want), "aid string, w int, score long, id long")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = staged(found.withColumn("rank", F.expr("row_number() over (partition by aid, w order by score desc, id)")).where(F.col("rank") <= want), "negatives-best")
        kth = best.where(F.col("rank") == want).groupBy("aid").agg(F.expr("map_from_entries(collect_list(struct(w, cast(score as double) as score)))").alias("kth"))
        raised = "transform(windows, x -> named_struct('w', x.w, 'least', greatest(x.least, coalesce(kth[x.w], x.least)), 'most', x.most))"
        state, step = asking.join(kth, "aid", "left").selectExpr("aid", "vec_id", "label", "dim", "embedding", f"{raised} as windows", "past"), 4 * step
    return best if best is not None else spark.createDataFrame([], "aid string, w int, score long, id long, rank int")


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Columns of RESULT from ``vectors`` (vec_id, embedding, label), for the anchors that ``every`` divides."""
    spark, most = vectors.sparkSession, max(positives, negatives) + 1
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    rows = rows.where("vec_id is not null and label is not null and coalesce(forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false)")
    rows = rows.withColumn("rep", F.expr("unhex(concat(lpad(hex(xxhash64(label, embedding)), 16, '0'), lpad(hex(xxhash64('class', label, embedding)), 16, '0')))"))
    named = staged(rows.select("rep", "vec_id").distinct(), "negatives-ids")
    first = named.withColumn("n", F.expr("row_number() over (partition by rep order by vec_id)")).where(F.col("n") <= most).groupBy("rep").agg(F.expr("array_sort(collect_list(vec_id))").alias("ids"))
    alike = rows.groupBy("rep").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    classes = staged(alike.join(first, "rep"), "negatives-classes")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    common = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    width = max(1, common["dim"])
    lists = max(1, min(int(np.sqrt(n)), CENTRE_BYTES // (8 * width)))
    wanted = max(1, min(max(4096, SAMPLE_A_LIST * lists), SAMPLE_BYTES // (8 * width)))
    fitting = sampled(classes.where(F.col("dim") == common["dim"]), "rep", "negatives", wanted, common["count"]).orderBy("rep").select("embedding").toArrow()
    centres = kmeans(_whole(fitting.column("embedding")), lists, 13, 10) if common["dim"] and len(fitting) else np.zeros((1, common["dim"]))
    near = spark.sparkContext.broadcast(centres)
    filed = staged(classes.select("rep", "label", "dim", "embedding", "ids").mapInArrow(_filer(near, common["dim"]), f"rep binary, label long, dim int, embedding {kind}, ids array<long>, cell long, far double"), "negatives-filed")
    held = staged(filed.groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("db")), "negatives-lists")
    handle = spark.sparkContext.broadcast(Lists([(r["dim"], r["cell"], r["radius"]) for r in held.collect()], common["dim"], centres))
    held = held.select("dim", "cell", "db")
    chosen = named.where(F.col("vec_id") % every == 0).join(classes.drop("ids"), "rep").selectExpr("concat(vec_id, ':', hex(rep)) as aid", "vec_id", "label", "dim", "embedding")
    anchors = staged(chosen, "negatives-anchors")
    open_window = "array(named_struct('w', 0, 'least', double('-infinity'), 'most', double('infinity'))) as windows"
    ahead = _search(anchors.selectExpr("*", open_window), filed, held, handle, kind, True, positives)
    sought = ahead.selectExpr("aid", "cast(rank as int) as w", "id as positive_id", "score as positive_score", f"if(score > 0, ({LEAST} * score + 99) div 100, ({LEAST} * score) div 100) as least")
    sought = staged(sought.where("least <= positive_score"), "negatives-sought")
    windows = sought.groupBy("aid").agg(F.expr("array_sort(collect_list(struct(w, cast(least as double) as least, cast(positive_score as double) as most)))").alias("windows"))
    behind = _search(anchors.join(windows, "aid"), filed, held, handle, kind, False, negatives)
    answers = behind.join(sought, ["aid", "w"]).selectExpr("cast(substring_index(aid, ':', 1) as long) as anchor_id", "positive_id", "cast(rank as int) as rank", "id as negative_id", "positive_score", "score as negative_score")
    return answers


def rotated(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) with one row in seven under the next label, as the query asks."""
    return vectors.selectExpr("vec_id", "embedding", "case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label")
