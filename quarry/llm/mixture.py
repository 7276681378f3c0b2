"""Mixing sources to target weights.

Sizes (words) are summed per source; sources in order of their name take the weights in turn, share
``SHARE`` of all sizes by weight and stop at ``CAP`` times their own size, what is over being shared
again by weight.  This is a water level L with target = min(CAP * size, L * weight): sources sorted by
CAP * size / weight fill up one after the other, so running sums give L without iteration.  The rate
of a source is target / size, and each document is emitted floor(rate) times, plus once more with the
fraction as probability, decided by a hash of its doc_id, its text's digest, its number among the rows that have
both, and the seed: rows without a doc_id, or with the same one, draw each on their own.  Such equal rows are
folded into one with a count before they are dealt, so many copies of a row are no hot key.

Only the table of sources passes through one task (a row of a hundred bytes for each source name, so
millions of names fit).  Defined results: a null text has size 0, a text of any length its number of
words; a null source is one source, the last; sources of size 0 have target 0; documents without words
are emitted by their source's rate and add nothing; sources that fill up at the same level are taken in
order of their name; repeated rows draw each on their own, and which of them is emitted once more is not
defined; an empty table gives an empty mix; further columns may have any names (and, where rows are equal in
doc_id, source and text, any type but maps).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.scratch import joined, staged

WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2.0, "mix-1"
#: Sources up to which their table is sent to all executors.
MOST_SENT = 100_000
#: Equal rows that one row is unfolded into in a task.
BLOCK = 100_000
SIZE = r"cast(coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0) as bigint)"


DIGEST = "sha2(coalesce(text, ''), 256)"


def draw(doc_id: str, digest: str, number: str, seed: str = SEED) -> str:
    """SQL for a number in [0, 1): the leading 52 bits of a SHA-256."""
    return f"cast(conv(substr(sha2(concat_ws(':', coalesce(cast({doc_id} as string), ''), {digest}, {number}, '{seed}'), 256), 1, 13), 16, 10) as double) / 4503599627370496.0"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size)."""
    table = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turns = " ".join(f"when {i} then {w}" for i, w in enumerate(weights))
    placed = table.selectExpr("source", "source_size", f"cast(case (row_number() over (order by source asc nulls last) - 1) % {len(weights)} {turns} end as double) as weight")
    filled = placed.selectExpr("*", f"{cap} * source_size as most", f"{share} * sum(source_size) over () as total", "sum(weight) over () as weights").selectExpr(
        "*", "sum(most) over (order by most / weight, source nulls last rows unbounded preceding) as most_to", "sum(weight) over (order by most / weight, source nulls last rows unbounded preceding) as weight_to"
    )
    # the level if all sources before this one are full; the first that it does not fill holds the level
    levels = filled.selectExpr("*", "(total - (most_to - most)) / (weights - (weight_to - weight)) as own").selectExpr(
        "*", "min(case when own * weight <= most then struct(most / weight as ratio, source is null as last, source as name, own) end) over () as first"
    )
    return levels.selectExpr("source", "source_size", "least(most, coalesce(first.own * weight, most)) as target").selectExpr("*", "case when source_size > 0 then target / source_size else 0D end as rate")


def _placed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (source, ...) with their source's figures."""
    targets = targets.withColumnRenamed("source", "name")
    # one row for each source; a join by hash where these are too many to be sent to all
    return rows.join(F.broadcast(targets) if targets.count() <= MOST_SENT else targets, rows["source"].eqNullSafe(targets["name"]))


def _copies(number: str, seed: str) -> str:
    return f"cast(floor(rate) as bigint) + case when {draw('doc_id', 'digest', number, seed)} < rate - floor(rate) then 1 else 0 end"


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, digest, n), staged: rows alike in doc_id, source and text are one with a count."""
    rows = docs.selectExpr("doc_id", "source", f"{SIZE} as size", f"unhex({DIGEST}) as digest")
    return staged(rows.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("n")).withColumn("digest", F.expr("lower(hex(digest))")), "mixture-rows")


def _targets(rows: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    return staged(source_targets(rows.selectExpr("source", "size * n as size"), weights, share, cap), "mixture-targets")


def _numbered(rows: DataFrame) -> DataFrame:
    """A row for each of the ``n`` that a row stands for, with its ``number``; many of them in blocks, dealt anew."""
    few, many = rows.where(f"n <= {BLOCK}"), rows.where(f"n > {BLOCK}")
    out = few.withColumn("number", F.expr("explode(sequence(0L, n - 1))"))
    if not many.isEmpty():
        blocks = many.withColumn("block", F.expr(f"explode(sequence(0L, (n - 1) div {BLOCK}))")).repartition("doc_id", "digest", "block")
        out = out.unionByName(blocks.withColumn("number", F.expr(f"explode(sequence(block * {BLOCK}, least(n, (block + 1) * {BLOCK}) - 1))")).drop("block"))
    return out


def report(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    rows = _rows(docs)
    drawn = _placed(_numbered(rows), _targets(rows, weights, share, cap))
    return drawn.selectExpr("doc_id", "size", "source_size", "target", f"size * ({_copies('number', seed)}) as taken")


def emit(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is drawn."""
    slim = _rows(docs)
    targets = _targets(slim, weights, share, cap)
    # a row travels as one struct, so that its columns may have any names
    rows = docs.select("doc_id", "source", F.expr(DIGEST).alias("digest"), F.struct("*").alias("row"))
    alike = staged(slim.where("n > 1").selectExpr("struct(doc_id, source, digest) as key"), "mixture-alike")
    copies = None
    if not alike.isEmpty():
        keyed = rows.withColumn("key", F.struct("doc_id", "source", "digest"))
        rows = joined(keyed, alike, ["key"], "left_anti", MOST_SENT).drop("key")
        # equal rows are counted, and number their like from where the rows before them in the key leave off
        same = joined(keyed, alike, ["key"], "left_semi", MOST_SENT).groupBy("key", "row").agg(F.count("*").alias("n"))
        first = "sum(n) over (partition by key order by xxhash64(row) rows between unbounded preceding and current row) - n"
        blocks = same.selectExpr("key", "row", "n", f"{first} as first").withColumn("block", F.expr(f"explode(sequence(0L, (n - 1) div {BLOCK}))")).repartition("key", "block")
        spread = _placed(blocks.selectExpr("key.*", "row", f"sequence(first + block * {BLOCK}, first + least(n, (block + 1) * {BLOCK}) - 1) as numbers"), targets)
        copies = spread.selectExpr("row", f"aggregate(numbers, 0L, (sum, number) -> sum + {_copies('number', seed)}) as copies")
    drawn = _placed(rows, targets).selectExpr("row", f"{_copies('0', seed)} as copies")
    drawn = drawn if copies is None else drawn.unionByName(copies)
    return drawn.where("copies > 0").select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")
