"""Packing of token sequences: shortest pack first over the length histogram.

Each document is tokenized once and cut into pieces of ``LENGTH`` tokens and a remainder.  The
histogram of piece lengths (``LENGTH`` numbers at most) goes to the driver, where lengths are placed
longest first, each into the packs that are shortest so far; packs with equal content are one pattern
with a count, so the work does not depend on the number of pieces.  Patterns give every rank among
the pieces of one length its sequence and offset; ranks come from two-level counts, so a length that
most pieces have is not ranked in one task.

Defined results: a null text is empty and gives the end id alone; a text of any length is cut into as
many pieces as it needs; repeated rows are packed each on their own, and equal pieces are alike, so that
which of them gets which place does not matter; further columns are ignored; an empty table gives no
pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import default_path, loaded
from quarry.llm.textkernel import releasing
from quarry.scratch import staged

LENGTH, END_ID = 2048, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = loaded(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for i in range(0, n, length):
                    part = ids[4 * i : 4 * (i + length)]
                    rows.append((doc, i, len(part) // 4, zlib.crc32(part), n))
            columns = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return releasing(run)


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a pack's pieces) and how many packs have each."""
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by free room
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if not packs[room]:
            heapq.heappush(rooms, -room)
        packs[room].append((pattern, count))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            while rooms and not packs[-rooms[0]]:
                heapq.heappop(rooms)
            if not rooms or -rooms[0] < size:
                put(length - size, (size,), left)
                break
            room = -rooms[0]
            pattern, count = packs[room].pop()
            take = min(count, left)
            if count > take:
                packs[room].append((pattern, count - take))
            left -= take
            put(room - size, (*pattern, size), take)
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for group in packs.values():
        for pattern, count in group:
            merged[pattern] += count
    return sorted(merged.items(), reverse=True)


def padding(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, used, padding): padded up to ``length``, not at all where ``used`` is a power of two."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    return used.selectExpr("sequence_id", "used", f"case when used & (used - 1) = 0 then 0L else {length} - used end as padding")


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each stretch of ranks, its first sequence, its offset."""
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    first = 0
    for pattern, count in patterns:
        offset = 0
        for size in pattern:
            rows[size].append((rank[size], first, offset))
            rank[size] += count
            offset += size
        first += count
    return {size: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for size, r in rows.items()}


def _placer(places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                begins, firsts, offsets = places[int(s)]
                k = np.searchsorted(begins, rank[rows], "right") - 1
                sequence[rows] = firsts[k] + rank[rows] - begins[k]
                offset[rows] = offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer or default_path(), length), PIECES)
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = staged(pieces.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id, start, ids_crc32), {salts})")), "packing-pieces")
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.selectExpr("length", "salt", "sum(n) over (partition by length order by salt rows between unbounded preceding and current row) - n as before")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = pieces.selectExpr("*", "row_number() over (partition by length, salt order by doc_id, start, ids_crc32) - 1 as own").join(before, ["length", "salt"]).selectExpr("doc_id", "start", "length", "ids_crc32", "doc_tokens", "before + own as rank")
    return ranked.mapInArrow(_placer(_places(shortest_pack_first(histogram, length))), PIECES + ", sequence_id long, offset long")
