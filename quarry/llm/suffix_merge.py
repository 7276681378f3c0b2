"""Removal of repeated 50-byte strings by a common-prefix-aware distributed merge sort.

The suffixes that are sorted are those that start at *anchors*: in each window of ``LENGTH`` bytes
the leftmost position of the least hash of ``GRAM`` bytes.  A window's anchor depends on its bytes
alone, so equal windows have their anchors at the same place, and sorting the anchors' suffixes
brings every pair of equal windows together with a small share of all suffixes.

1. Texts are dealt into groups of about ``GROUP_BYTES``, whatever their ids, so that neither one doc_id nor one
   text can fill a group; a group is one run.  Fingerprints of its anchors' grams are exchanged first,
   and only anchors whose gram occurs in two documents take part in the sort (the prefix that tells a
   suffix from all others need not be exchanged any further).
2. Each run is sorted, front-coded (common prefix with the row before, then the rest) and exchanged
   by gram.  Strings that the run itself shows to be repeated are settled there.
3. A bucket merges its runs with a loser tree over offset-value codes: a code holds the length of
   the known common prefix with the last winner and the value after it, so known prefixes are never
   compared again.  The codes of the merged order give each row's common prefix with the row before, and
   these lengths decide what is covered: for each place of the anchor in a window, rows whose common
   prefix spans the rest of it are one class of right sides; the left sides are sorted and classed in
   the same way; rows alike in both hold the same window, and all but those of the least doc_id are
   covered.  No hashes take part in this.
4. Covered positions return to the groups, where the remaining bytes are hashed.

More than ``FAN_IN`` runs are merged in several rounds: sets of runs first, where a string that many runs hold
becomes one row, then what these leave.  A bucket of a round gets as many rows of one string as it has
sets of different context.  A group sends a row to each bucket that it has anchors for, so groups grow with the
input: ``MOST_GROUPS`` of them, of ``GROUP_MOST`` bytes at most; a task takes several where there are more groups
or buckets than ``MOST_TASKS``.  A task needs some ten times the bytes of a group.  Anchors that only repeat the
one before, as in padding, are folded into one row with a reach, so a long periodic text has few.

Defined results: null text is empty; a document under 50 bytes is left whole; a text of any length is
taken whole, in a group of its own if need be; repeated rows with one doc_id do not cover one another;
a null doc_id counts as larger than all others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.textkernel import MIX, U64, mix64
from quarry.scratch import input_bytes, staged

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM  # an anchor lies 0..SPAN bytes after its window's start
WORDS = 7  # of 8 bytes: LENGTH bytes of suffix, padded
FINGER_BITS = 48
#: Bytes of text in a group, fingerprint buckets for each so many groups, runs that are merged at once.
GROUP_BYTES, GROUPS_A_BUCKET, FAN_IN = 4 << 20, 4, 512
#: Groups grow with the input, so that there are about so many, up to this size; and tasks of a shuffle at most.
MOST_GROUPS, GROUP_MOST, MOST_TASKS = 20_000, 256 << 20, 16_384
CHUNK = 1 << 17
NO_ID = np.iinfo(np.int64).max
RUNS = "bucket long, src long, grp long, n long, tail long, meta binary, text binary"


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes (like bytes together), compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _expand(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for kind in kinds:
        w = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * w
    return out


def _stretches(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each stretch of equal values."""
    edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])).tolist() if len(x) else [0]
    return zip(edges[:-1], edges[1:], strict=True)


def words_at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one big-endian number."""
    n = max(0, len(raw) - 7)
    out = np.empty(n, U64)
    for i in range(min(8, n)):
        m = (len(raw) - i) // 8
        out[i::8] = np.frombuffer(raw[i : i + 8 * m].tobytes(), ">u8")[: len(out[i::8])]
    return out


def _folded(part: np.ndarray, a: np.ndarray, first: np.ndarray, last: np.ndarray, gram: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads of runs of anchors whose windows hold the same bytes as those of the anchor before, at most a window on, in one
    document; and how far each run's last anchor is from its head."""
    step = np.diff(a)
    same = (gram[1:] == gram[:-1]) & (step <= LENGTH) & (a[1:] - first[1:] == a[:-1] - first[:-1]) & (last[1:] - a[1:] == last[:-1] - a[:-1]) & (doc[1:] == doc[:-1])
    maybe, column = np.flatnonzero(same), np.arange(SPAN + LENGTH)[None]
    for i in range(0, len(maybe), 1 << 14):
        k = maybe[i : i + (1 << 14)]
        inside = column < (last[k] + LENGTH - first[k])[:, None]
        here, there = (part[np.minimum(first[x][:, None] + column, len(part) - 1)] for x in (k, k + 1))
        same[k] = ((here == there) | ~inside).all(axis=1)
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    return head, a[np.concatenate([head[1:], [len(a)]]) - 1] - a[head]


def window_anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows: position, first window, last window, gram hash, reach.

    Anchors that only repeat the one before, as in a text of one letter, are folded into it: ``reach`` is
    how far they go on.  All is done in chunks, so that what a text needs beyond its bytes are its distinct
    anchors.  ``offsets`` bound the documents.  A chunk border may part an anchor's windows.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for c in range(0, max(0, len(raw) - LENGTH + 1), CHUNK):
        part = raw[c : c + CHUNK + LENGTH - 1]
        w = words_at(part)
        n = len(part) - LENGTH + 1
        g = len(part) - GRAM + 1
        h = w[:g] * MIX[0] + (w[8 : 8 + g] ^ (w[8 : 8 + g] >> U64(31))) * MIX[1] + (w[16 : 16 + g] ^ (w[16 : 16 + g] >> U64(29))) * MIX[2]
        h = mix64(h)
        v, at = h, np.arange(g, dtype=np.int32)
        for d in (1, 2, 4, 8, SPAN + 1 - 16):
            less = v[d:] < v[:-d]
            v, at = np.where(less, v[d:], v[:-d]), np.where(less, at[d:], at[:-d])
        doc = np.searchsorted(offsets, np.arange(c, c + n), "right")
        start = np.flatnonzero(np.arange(c + LENGTH, c + LENGTH + n) <= offsets[doc])
        if not len(start):
            continue
        a = at[start].astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)]))
        tail = np.concatenate([head[1:], [len(start)]]) - 1
        a, first, last = a[head], start[head], start[tail]
        kept, reach = _folded(part, a, first, last, h[a], doc[first])
        a, first, last = a[kept], first[kept], last[kept]
        found.append((a + c, first + c, last + c, h[a], reach))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U64), z
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Group:
    """The documents of one group, in an order that depends on them alone."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_pylist()
        texts = [zstandard.ZstdDecompressor().decompress(x) for x in table.column("packed").to_pylist()]
        rows = sorted(zip(((NO_ID if i is None else i, i is None) for i in ids), texts, strict=True))
        self.ids = [None if missing else i for (i, missing), _ in rows]
        self.keys = np.array([i for (i, _), _ in rows], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])]).astype(np.int64)
        self.raw = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
        with np.errstate(over="ignore"):
            self.at, self.first, self.last, grams, self.reach = window_anchors(self.raw, self.offsets)
            # anchors have small hashes; mixed once more they fill all buckets alike
            self.finger = mix64(grams ^ MIX[4]) >> U64(64 - FINGER_BITS)
        self.key = self.keys[np.searchsorted(self.offsets, self.at, "right") - 1] if len(self.at) else np.zeros(0, np.int64)


def bucket_of(finger: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each fingerprint; in order of the fingerprints, which ``_runs`` relies on."""
    return ((finger >> U64(FINGER_BITS - 32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _packer(group_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, part = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        block = held = 0
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            grps, sizes, packed = [], [], []
            for t in texts:
                size = len(t.as_buffer()) if t.is_valid else 0
                if held and held + size > group_bytes:
                    block, held = block + 1, 0
                held += size
                grps.append((part << 32) | block)
                sizes.append(size)
                packed.append(press.compress(t.as_buffer() if t.is_valid else b""))
            yield pa.RecordBatch.from_arrays([pa.array(grps, pa.int64()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["grp", "doc_id", "size", "packed"])

    return run


def _fingerprints(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        grp, own = table.column("grp")[0].as_py(), Group(table)
        order = np.lexsort((own.key, own.finger))
        f, k = own.finger[order], own.key[order]
        head = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)
        last = np.concatenate([head[1:], [len(f)]])[: len(head)] - 1
        f, many = f[head], k[head] != k[last]
        home = bucket_of(f, buckets)
        rows = [(int(home[i]), grp, j - i, _squeeze(np.diff(f[i:j], prepend=U64(0)), many[i:j].view(np.uint8))) for i, j in _stretches(home)]
        return _table(rows, "bucket long, grp long, n long, blob binary")

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Per run of a bucket, which of its fingerprints another run or two of its documents have."""
    parts, many = [], []
    for n, blob in zip(table.column("n").to_pylist(), table.column("blob").to_pylist(), strict=True):
        d, m = _expand(blob, n, "u8", "u1")
        parts.append(np.cumsum(d, dtype=U64))
        many.append(m.astype(bool))
    every = np.sort(np.concatenate(parts))
    twice = every[1:][every[1:] == every[:-1]]
    bits = []
    for f, m in zip(parts, many, strict=True):
        at = np.minimum(np.searchsorted(twice, f), max(0, len(twice) - 1))
        bits.append(np.packbits(m | (twice[at] == f) if len(twice) else m).tobytes())
    return pa.table([table.column("grp"), table.column("bucket"), table.column("n"), pa.array(bits, pa.binary())], names=["grp", "bucket", "n", "bits"])


def _suffixes(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ``size`` bytes from each position, zeros after them."""
    padded = np.concatenate([raw, np.zeros(8 * WORDS, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, 8 * WORDS)[at].copy()
    out[np.arange(8 * WORDS)[None] >= size[:, None]] = 0
    return out


def _lefts(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ``size`` bytes before each position, right-aligned in SPAN columns."""
    padded = np.concatenate([np.zeros(SPAN, np.uint8), raw])
    out = np.lib.stride_tricks.sliding_window_view(padded, SPAN)[at].copy()
    out[np.arange(SPAN)[None] < SPAN - size[:, None]] = 0
    return out


def _table(rows: list[tuple], kinds: str) -> pa.Table:
    """Rows as a table of columns "name kind, ..."."""
    fields = [x.split() for x in kinds.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    columns = zip(*rows, strict=True) if rows else ([],) * len(fields)
    return pa.table([pa.array(c, types[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _runs(fingers: int, buckets: int):
    """A group's sorted, front-coded run for each bucket, and the spans that it settles itself."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows:
            own = Group(left)
            bits = {b: np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for b, n, x in zip(right.column("bucket").to_pylist(), right.column("n").to_pylist(), right.column("bits").to_pylist(), strict=True)}
            known, inverse = np.unique(own.finger, return_inverse=True)
            live = np.concatenate([bits[b] for b in sorted(bits)]) if bits else np.zeros(0, bool)
            pick = np.flatnonzero(live[inverse]) if len(known) else np.zeros(0, np.int64)
            if len(pick):
                rows = _front_coded(own, pick, left.column("grp")[0].as_py(), buckets)
        return _table(rows, RUNS)

    return run


def _words(x: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian numbers of 8 bytes, zeros after the last byte."""
    return np.ascontiguousarray(np.pad(x, ((0, 0), (0, -x.shape[1] % 8)))).view(">u8").astype(U64)


def _front_coded(own: Group, pick: np.ndarray, grp: int, buckets: int) -> list[tuple]:
    at, first, last, key, finger, reach = (x[pick] for x in (own.at, own.first, own.last, own.key, own.finger, own.reach))
    lsize, rsize = at - first, last + LENGTH - at
    suffix, left = _suffixes(own.raw, at, rsize), _lefts(own.raw, at, lsize)
    every = np.concatenate([_words(suffix), _words(left), lsize[:, None].astype(U64), rsize[:, None].astype(U64)], axis=1)
    order = np.lexsort((key, *every.T[::-1]))
    new = np.concatenate([[True], (every[order][1:] != every[order][:-1]).any(axis=1)])
    least = key[order][new][np.cumsum(new) - 1]
    settled = order[key[order] > least]
    rows = []
    if len(settled):
        rows.append((grp % buckets, grp, grp, len(settled), 0, _squeeze(first[settled].astype(np.int32), (last[settled] + LENGTH + reach[settled]).astype(np.int32)), None))
    order = order[key[order] == least]
    home = bucket_of(finger[order], buckets)
    by = np.argsort(home, kind="stable")
    order, home = order[by], home[by]
    for i, j in _stretches(home):
        o = order[i:j]
        rows.append(_encoded(int(home[i]), grp, suffix[o], left[o], lsize[o], rsize[o], at[o], reach[o], key[o], np.full(len(o), grp, np.int64)))
    return rows


def _encoded(bucket: int, src: int, s: np.ndarray, l: np.ndarray, ls: np.ndarray, rs: np.ndarray, at: np.ndarray, reach: np.ndarray, key: np.ndarray, grp: np.ndarray) -> tuple:  # noqa: E741
    """A run in order of its suffixes, front-coded, as a row of RUNS."""
    same = s[1:] == s[:-1]
    common = np.concatenate([[0], np.where(same.all(axis=1), 8 * WORDS, same.argmin(axis=1))])
    column = np.arange(8 * WORDS)[None]
    tail = s[(column >= common[:, None]) & (column < rs[:, None])]
    side = l[np.arange(SPAN)[None] >= SPAN - ls[:, None]]
    meta = _squeeze(common.astype(np.uint8), ls.astype(np.uint8), rs.astype(np.uint8), at.astype(np.int32), reach.astype(np.int32), key, grp)
    return bucket, src, None, len(s), len(tail), meta, zstandard.ZstdCompressor(level=3).compress(tail.tobytes() + side.tobytes())


class Run:
    """A decoded run: suffixes, left contexts and the offset-value code of each row to the one before."""

    def __init__(self, n: int, tail: int, meta: bytes, text: bytes):
        self.common, self.lsize, self.rsize, self.at, self.reach, self.key, self.grp = _expand(meta, n, "u1", "u1", "u1", "i4", "i4", "i8", "i8")
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)
        column = np.arange(8 * WORDS)[None]
        own = column >= self.common[:, None]
        self.suffix = np.zeros((n, 8 * WORDS), np.uint8)
        self.suffix[own & (column < self.rsize[:, None])] = raw[:tail]
        # a byte below the common prefix is that of the last row that brought one in its column
        source = np.maximum.accumulate(np.where(own, np.arange(n)[:, None], 0), axis=0)
        self.suffix = np.take_along_axis(self.suffix, source, axis=0)
        self.left = np.zeros((n, SPAN), np.uint8)
        self.left[np.arange(SPAN)[None] >= SPAN - self.lsize[:, None].astype(np.int64)] = raw[tail:]
        words = self.suffix.view(">u8").astype(U64)
        known = np.minimum(self.common // 8, WORDS).astype(np.int64)
        value = words[np.arange(n), np.minimum(known, WORDS - 1)]
        self.codes = [((WORDS - k) << 64) | v if k < WORDS else 0 for k, v in zip(known.tolist(), value.tolist(), strict=True)]
        self.bytes = self.suffix.tobytes()


def merge_runs(codes: list[list[int]], texts: list[bytes]) -> tuple[list[int], list[int]]:
    """The run of each row in merged order, and its code to the row before.

    codes: per run and row ((WORDS - known words) << 64) | next word, 0 for an equal row.  A lower code
    comes first; only equal codes need bytes, and those behind the known prefix alone.
    """
    k, width, end = len(codes), 8 * WORDS, 1 << 80
    for c in codes:
        c.append(end)
    at, tree, held = [0] * k, [0] * k, [end] * k

    def lower(r: int, q: int, code: int) -> tuple[bool, int]:
        """For equal codes: whether row r stands after row q, and the later one's code to the earlier."""
        known = WORDS - (code >> 64) + 1
        a = texts[r][at[r] * width + 8 * known : at[r] * width + width]
        b = texts[q][at[q] * width + 8 * known : at[q] * width + width]
        if a == b:
            return r > q, 0
        differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
        j = (8 * len(a) - differ.bit_length()) // 64
        late = max(a, b)
        return a > b, ((WORDS - known - j) << 64) | int.from_bytes(late[8 * j : 8 * j + 8], "big")

    def play(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, codes[node - k][0]
        (r, x), (q, y) = play(2 * node), play(2 * node + 1)
        if x == y and x != end:
            after, code = lower(r, q, x)
            if after:
                r, q = q, r
            tree[node], held[node] = q, code
            return r, x
        if x > y:
            r, x, q, y = q, y, r, x
        tree[node], held[node] = q, y
        return r, x

    r, code = play(1) if k > 1 else (0, codes[0][0])
    out, marks = [], []
    while code != end:
        out.append(r)
        marks.append(code)
        at[r] += 1
        code = codes[r][at[r]]
        if code == 0:
            continue
        node = (r + k) >> 1
        while node:
            other = held[node]
            if other < code:
                q = tree[node]
                tree[node], held[node] = r, code
                r, code = q, other
            elif other == code and code != end:
                q = tree[node]
                after, late = lower(r, q, code)
                if after:
                    tree[node], held[node] = r, late
                    r = q
                else:
                    held[node] = late
            node >>= 1
    return out, marks


class Merged:
    """Rows of all runs in merged order, each with its common prefix with the row before, as the codes tell it."""

    def __init__(self, runs: list[Run]):
        out, marks = merge_runs([r.codes for r in runs], [r.bytes for r in runs])
        order = np.empty(len(out), np.int64)  # of the runs' rows, one run after the other
        order[np.argsort(np.array(out, np.int64), kind="stable")] = np.arange(len(out))
        self.suffix, self.left = (np.concatenate([getattr(r, x) for r in runs])[order] for x in ("suffix", "left"))
        self.at, self.reach, self.key, self.grp, self.lsize, self.rsize = (np.concatenate([getattr(r, x) for r in runs])[order].astype(np.int64) for x in ("at", "reach", "key", "grp", "lsize", "rsize"))
        # a code of k words to come: the words before are common, and of the next one the leading bytes
        known = np.array([WORDS - (m >> 64) if m else WORDS for m in marks], np.int64)
        known[:1] = 0
        words = self.suffix.view(">u8").astype(U64)
        row, k = np.arange(len(known)), np.minimum(known, WORDS - 1)
        differ = words[row, k] ^ words[np.maximum(row - 1, 0), k]
        extra = np.zeros(len(known), np.int64)
        for i in range(1, 8):
            extra += differ < U64(1) << U64(64 - 8 * i)
        self.common = np.where(known < WORDS, 8 * known + extra, 8 * WORDS)
        self.common[:1] = 0

    def take(self, rows: np.ndarray) -> None:
        """Keep ``rows``, in order; a common prefix is the least of those passed over."""
        self.common = np.minimum.reduceat(self.common[: rows[-1] + 1], np.concatenate([[0], rows[:-1] + 1])) if len(rows) else self.common[:0]
        self.common[:1] = 0
        for x in ("suffix", "left", "at", "reach", "key", "grp", "lsize", "rsize"):
            setattr(self, x, getattr(self, x)[rows])


def _least(label: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each row the least key among rows of its label."""
    order = np.argsort(label, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], label[order][1:] != label[order][:-1]]))
    out = np.empty(len(label), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(key[order], heads), np.diff(np.concatenate([heads, [len(label)]])))
    return out


def _left_sides(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of left sides read backwards from the anchor, and each one's common length with the one before."""
    back = left[:, ::-1]
    order = np.lexsort(_words(back).T[::-1])
    same = back[order][1:] == back[order][:-1]
    return order, np.concatenate([[0], np.where(same.all(axis=1), SPAN, same.argmin(axis=1))])


def _classes(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < length)
    return out


def _covered(m: Merged, final: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Spans (group, begin, end) of windows that a smaller doc_id holds; ``m`` keeps the rows that are left.

    Before the last round only rows whose whole string another one holds are settled.
    """
    # grams that one document alone holds here
    parts = np.cumsum(m.common < GRAM) if final else np.zeros(len(m.key), np.int64)
    if final:
        heads = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
        m.take(np.flatnonzero((np.minimum.reduceat(m.key, heads) != np.maximum.reduceat(m.key, heads))[parts - parts[0]]))
    if not len(m.key):
        return []
    found = []
    order, common = _left_sides(m.left)
    whole = ((np.cumsum(m.common < 8 * WORDS) * (len(order) + 1) + _classes(order, common, SPAN)) * (SPAN + 1) + m.lsize) * 128 + m.rsize
    least = _least(whole, m.key)
    gone = np.flatnonzero(m.key > least)
    found.append((m.grp[gone], m.at[gone] - m.lsize[gone], m.at[gone] + m.rsize[gone] + m.reach[gone]))
    m.take(np.flatnonzero(m.key == least))
    if final and len(m.key):
        order, common = _left_sides(m.left)
        for o in range(SPAN + 1):  # windows that begin o bytes before their anchor
            ok = np.flatnonzero((m.lsize >= o) & (m.rsize >= LENGTH - o))
            if len(ok):
                label = (np.cumsum(m.common < LENGTH - o) * (len(order) + 1) + _classes(order, common, o))[ok]
                hit = ok[m.key[ok] > _least(label, m.key[ok])]
                found.append((m.grp[hit], m.at[hit] - o, m.at[hit] - o + LENGTH + m.reach[hit]))
    return found


def _union(begin: np.ndarray, finish: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of their start, those that meet made one."""
    reach = np.maximum.accumulate(finish)
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    return begin[new], np.concatenate([reach[:-1][new[1:]], reach[-1:]])


def _merger(final: bool):
    """One round over a bucket, or a set of its runs: spans, and before the last round the merged run."""

    def run(table: pa.Table) -> pa.Table:
        rows, runs = [], []
        for bucket, src, grp, n, tail, meta, text in sorted(zip(*(table.column(c).to_pylist() for c in ("bucket", "src", "grp", "n", "tail", "meta", "text")), strict=True), key=lambda x: (x[1], x[6] is None)):
            if text is None:
                rows.append((bucket, src, grp, n, 0, meta, None))
            else:
                runs.append(Run(n, tail, meta, text))
        if runs:
            bucket, src = table.column("bucket")[0].as_py(), table.column("src")[0].as_py()
            m = Merged(runs)
            runs.clear()
            with np.errstate(over="ignore"):
                found = _covered(m, final)
            if found:
                grp, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((begin, grp))
                grp, begin, end = grp[order], begin[order], end[order]
                for i, j in _stretches(grp):
                    b, e = _union(begin[i:j], end[i:j])
                    rows.append((bucket, src, int(grp[i]), len(b), 0, _squeeze(b.astype(np.int32), e.astype(np.int32)), None))
            if not final and len(m.key):
                rows.append(_encoded(bucket, src, m.suffix, m.left, m.lsize, m.rsize, m.at, m.reach, m.key, m.grp))
        return _table(rows, RUNS)

    return run


def _remains(left: pa.Table, right: pa.Table) -> pa.Table:
    rows = []
    if left.num_rows:
        texts = [zstandard.ZstdDecompressor().decompress(x) for x in left.column("packed").to_pylist()]
        order = sorted(((NO_ID if i is None else i, i is None), t) for i, t in zip(left.column("doc_id").to_pylist(), texts, strict=True))
        raw = np.frombuffer(b"".join(t for _, t in order), np.uint8)
        gone = np.zeros(len(raw), bool)
        spans = [_expand(blob, n, "i4", "i4") for n, blob in zip(right.column("n").to_pylist(), right.column("spans").to_pylist(), strict=True)]
        if spans:
            begin, finish = (np.concatenate(x) for x in zip(*spans, strict=True))
            order_ = np.argsort(begin, kind="stable")
            for b, e in zip(*(x.tolist() for x in _union(begin[order_], finish[order_])), strict=True):
                gone[b:e] = True
        i = 0
        for (key, missing), t in order:
            g = gone[i : i + len(t)]
            removed = int(np.count_nonzero(g))
            spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + bool(len(g) and g[0])
            kept = t if not removed else raw[i : i + len(t)][~g].tobytes()
            rows.append((None if missing else key, len(t), removed, spans, hashlib.sha256(kept).hexdigest()))
            i += len(t)
    return _table(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, group_bytes: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    if group_bytes is None:
        group_bytes = min(GROUP_MOST, max(GROUP_BYTES, 2 * input_bytes(docs) // MOST_GROUPS)) if input_bytes(docs) < 1 << 55 else GROUP_BYTES
    dealt = lambda df, parts, *keys: df.repartition(max(1, min(parts, MOST_TASKS)), *keys)
    # staged, so that a group holds the same texts whenever it is read
    packed = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packer(group_bytes), "grp long, doc_id long, size long, packed binary"), "suffix-groups", codec="uncompressed")
    size, count = packed.agg(F.sum("size"), F.count_distinct("grp")).first()
    buckets = max(1, -(-(size or 0) // group_bytes))
    fingers = max(1, buckets // GROUPS_A_BUCKET)
    groups = dealt(packed.drop("size"), count, "grp").groupBy("grp")
    prints = groups.applyInArrow(_fingerprints(fingers), "bucket long, grp long, n long, blob binary")
    known = dealt(prints, fingers, "bucket").groupBy("bucket").applyInArrow(_repeated, "grp long, bucket long, n long, bits binary")
    runs = groups.cogroup(known.groupBy("grp")).applyInArrow(_runs(fingers, buckets), RUNS)
    while count > fan_in:
        count = -(-count // fan_in)
        runs = dealt(runs.withColumn("src", F.expr(f"pmod(xxhash64(src), {count})")), buckets, "bucket", "src").groupBy("bucket", "src").applyInArrow(_merger(False), RUNS)
    spans = dealt(runs, buckets, "bucket").groupBy("bucket").applyInArrow(_merger(True), RUNS).select("grp", "n", F.col("meta").alias("spans"))
    return groups.cogroup(spans.groupBy("grp")).applyInArrow(_remains, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
