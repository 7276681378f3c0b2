"""Byte-level BPE by a segment tree over adjacent pairs, and back.

A pre-token's bytes stand in a row; the tree's leaves hold, for each symbol that has a neighbour, the rank of
the merge of both, and its nodes the least of them, the leftmost of equal ones.  So the root is the next
merge; a merge changes three leaves at most, each of which goes up the tree in logarithmic time, until the
root names no pair.  Pre-tokens come back often, so the ids of short ones are kept in a bounded table.

The tokenizer file is read on the executor; files that normalise, prefix a space or drop out merges are
refused.  Long texts are pre-tokenised piece by piece, and cut only before a single space, where a pre-token
always begins.  The tree takes some 30 bytes for each byte of a pre-token, so a text of one giant pre-token
costs that.

Defined results: a null text is empty and has no ids; a special token's string in a text is its id, as the
tokenizer's own default; ids that are no text give U+FFFD where their bytes are no UTF-8; repeated rows are
encoded each; an empty table gives no rows; further columns of any name are carried along.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import byte_names, default_path
from quarry.llm.textkernel import releasing

#: Characters that one pre-tokenisation takes at least, pre-tokens that are kept, and bytes of a kept one at most.
PIECE, KEPT, KEPT_BYTES = 1 << 16, 1 << 18, 32
#: Symbols from which the tree stands in packed arrays.
PACKED = 4096
#: Bytes of results that go into one batch.
BATCH_BYTES = 4 << 20
_CUT = regex.compile(r"(?<=\S) (?=\S)")


class _Words(dict):
    """Ids of pre-tokens as bytes; what is missing is worked out.  When it is full, all of it becomes the older half, from
    which what is still in use comes back."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, word: str) -> bytes:
        made = self.older.get(word)
        if made is None:
            raw = word.encode()
            out = array("I", self.codec.merged([self.codec.first[b] for b in raw]))
            if sys.byteorder == "big":
                out.byteswap()
            made = out.tobytes()
            if len(raw) > KEPT_BYTES:
                return made
        if len(self) >= KEPT:
            self.older = dict(self)
            self.clear()
        self[word] = made
        return made


class Codec:
    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split, added = spec["model"], spec["pre_tokenizer"] or {}, spec.get("added_tokens", [])
        plain = not spec["normalizer"] and not model.get("dropout") and not model.get("ignore_merges") and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
        if not plain or model.get("type") != "BPE" or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        vocab, names = model["vocab"], byte_names()
        self.first = [vocab[c] for c in names]
        self.size = max([*vocab.values(), *(t["id"] for t in added)]) + 1
        self.ranks, self.made = {}, array("I")
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a] * self.size + vocab[b]] = rank
            self.made.append(vocab[a + b])
        number = {c: b for b, c in enumerate(names)}
        self.special = {t["content"]: t["id"] for t in added}
        self.raw = {i: bytes(number[c] for c in word) for word, i in vocab.items() if word not in self.special} | {i: s.encode() for s, i in self.special.items()}
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern, self.own = regex.compile(public_tokenizers.PATTERN), Tokenizer.from_file(path).pre_tokenizer
        self.words = _Words(self)

    def merged(self, ids: list[int]) -> list[int]:
        """The ids that are left when no adjacent pair can be merged."""
        n = len(ids)
        if n < 2:
            return ids
        ranks, size, made = self.ranks, self.size, self.made
        none, m = len(made), n - 1
        row = list if n < PACKED else lambda values: array("q", values)
        ids, after, before = row(ids), row(range(1, n + 1)), row(range(-1, n - 1))
        # the key of a pair is rank * n + position, so the least is the leftmost of the lowest rank
        tree = row([none * n]) * (2 * m)
        for i in range(m):
            tree[m + i] = ranks.get(ids[i] * size + ids[i + 1], none) * n + i
        for k in range(m - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, rank: int) -> None:
            k = m + i
            tree[k] = rank * n + i
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                if b < a:
                    a = b
                if tree[k] == a:
                    return
                tree[k] = a

        while True:
            rank, i = divmod(tree[1], n)
            if rank >= none:
                break
            j = after[i]
            k, h = after[j], before[i]
            ids[i] = made[rank]
            after[i] = k
            if j < m:
                put(j, none)
            if k < n:
                before[k] = i
                put(i, ranks.get(ids[i] * size + ids[k], none))
            else:
                put(i, none)
            if h >= 0:
                put(h, ranks.get(ids[h] * size + ids[i], none))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _pretokens(self, text: str) -> Iterator[list[str]]:
        if not text.isascii() and not _later().isdisjoint(text):  # code points on which Unicode versions differ: the tokenizer's own classes
            yield [text[a:b] for _, (a, b) in self.own.pre_tokenize_str(text)]
            return
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            yield self.pattern.findall(text, at, end)
            at = end

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        out = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += [b"".join(map(self.words.__getitem__, words)) for words in self._pretokens(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; ids beyond the vocabulary are left out."""
        numbers = array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return b"".join([self.raw.get(i, b"") for i in numbers]).decode("utf-8", "replace")


@cache
def _later() -> frozenset[str]:
    """Letters, digits and spaces that the pattern library knows and this Python's Unicode does not."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}\s]", every) if unicodedata.category(c) == "Cn")


@cache
def loaded(path: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path)


def _batches(keys: pa.Array, made: Iterator[list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (key, *made) in batches of bounded size; the last of a row's values tells its size."""
    begin, size, out = 0, 0, []
    for k, row in enumerate(made, 1):
        out.append(row)
        size += len(row[-1]) + 16
        if size > BATCH_BYTES or k == len(keys):
            columns = [keys.slice(begin, k - begin), *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            begin, size, out = k, 0, []


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of ``docs`` (doc_id, text); ids are little-endian unsigned 32-bit numbers."""
    path = tokenizer or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path)
        for batch in batches:
            made = ((len(ids) // 4, ids) for ids in (codec.encode(t.as_py() or "") for t in batch.column(1)))
            yield from _batches(batch.column(0), made, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(run), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text) of every row of ``encoded`` (doc_id, ids); null ids are no ids."""
    path = tokenizer or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path)
        for batch in batches:
            yield from _batches(batch.column(0), ((codec.decode(x.as_py() or b""),) for x in batch.column(1)), schema)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("binary").alias("ids")).mapInArrow(releasing(run), "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row of ``docs``: encoded and decoded in one pass, so that each row's ids and text stay together."""
    path = tokenizer or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("decoded", pa.string()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path)
        for batch in batches:
            made = ((len(ids) // 4, codec.decode(ids), ids) for ids in (codec.encode(t.as_py() or "") for t in batch.column(1)))
            yield from _batches(batch.column(0), made, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(run), "doc_id long, n_tokens long, decoded string, ids binary")
