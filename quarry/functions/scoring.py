"""Compression-based scores; Spark has no compression function, so these run on Arrow batches."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

CONTEXT_BYTES = 16 << 10


def information(block: bytes, before: bytes, after: bytes) -> float:
    """log1p of the compressed bytes a block adds when its surroundings are the dictionary."""

    def packed(x: bytes) -> int:
        press = zlib.compressobj(6, zdict=before[-CONTEXT_BYTES:] + after[:CONTEXT_BYTES]) if before or after else zlib.compressobj(6)
        return len(press.compress(x) + press.flush())

    return math.log1p(max(0, packed(block) - packed(b"")))


def new_information(files: DataFrame) -> DataFrame:
    """files (path, blocks array<string>) as (path, block_no, information)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, blocks in zip(b["path"], b["blocks"], strict=True):
                raw = [(x or "").encode() for x in blocks]
                whole = b"\n".join(raw)
                at = 0
                for i, block in enumerate(raw):
                    rows.append((path, i, information(block, whole[max(0, at - CONTEXT_BYTES) : at], whole[at + len(block) : at + len(block) + CONTEXT_BYTES])))
                    at += len(block) + 1
            yield pd.DataFrame(rows, columns=["path", "block_no", "information"])

    return files.select("path", "blocks").mapInPandas(run, "path long, block_no int, information double")


def entropy(block: bytes) -> float:
    """Shannon entropy of the bytes of a block, in bits."""
    if not block:
        return 0.0
    counts = [block.count(bytes([b])) for b in set(block)]
    return -sum(n / len(block) * math.log2(n / len(block)) for n in counts)


def byte_entropy(files: DataFrame) -> DataFrame:
    """(path, entropy) of files (path, content): Shannon entropy of their bytes, 0 without any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "entropy": [entropy((x or "").encode()) for x in b["content"]]})

    return files.select("path", "content").mapInPandas(run, f"path {dict(files.dtypes)['path']}, entropy double")


def node_scores(files: DataFrame) -> DataFrame:
    """files (path, content, spans array<struct<node_id, name, start_line, end_line>>) as (path, node_id, info, novelty, centrality):
    entropy of a node's bytes, what it adds to its surroundings, and how often its name is called in the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, spans in zip(b["path"], b["content"], b["spans"], strict=True):
                raw = (content or "").encode()
                starts = [0, *(m.end() for m in re.finditer(rb"\n", raw)), len(raw) + 1]
                called = Counter(re.findall(r"\b(\w+)\s*\(", content or ""))
                for s in spans:
                    i, j = starts[min(s["start_line"] - 1, len(starts) - 1)], min(len(raw), starts[min(s["end_line"], len(starts) - 1)])
                    block = raw[i:j]
                    rows.append((path, s["node_id"], entropy(block), information(block, raw[max(0, i - CONTEXT_BYTES) : i], raw[j : j + CONTEXT_BYTES]), float(called[s["name"]])))
            yield pd.DataFrame(rows, columns=["path", "node_id", "info", "novelty", "centrality"])

    return files.select("path", "content", "spans").mapInPandas(run, "path string, node_id int, info double, novelty double, centrality double")
