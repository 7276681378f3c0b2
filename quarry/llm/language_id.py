"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, what is no letter becomes a space, and n-grams of 1 to 3 characters are hashed
to ``BUCKETS`` cells.  The counts of a sample of at most about ``SAMPLE_DOCS`` labelled documents give
a matrix of log probabilities (cells by languages, its size fixed by the parameters), which each
worker holds; a batch is scored in numpy by gathering rows of the matrix and summing them by document
onto the languages' log priors.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or where nothing could
be learned; equal scores go to the first language by code point; repeated rows get the same result; a
text of any length is scored whole, in one step of its own; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.sampling import sampled
from quarry.llm.textkernel import MIX, U64

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Labelled documents that the model is fitted on, about; all where there are fewer.
SAMPLE_DOCS = 20_000
STEP_CHARS = 1 << 18
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Steps of documents: first, last, whether each has a letter, cells, document of each cell."""
    i = 0
    while i < len(texts):
        j, size, part = i, 0, []
        while j < len(texts) and (j == i or size < STEP_CHARS):
            part.append((texts[j] or "").lower())
            size += len(part[-1])
            j += 1
        code = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(j - i, dtype=np.int32), [len(p) for p in part])
        ok = letters()[code]
        code = np.where(ok, code, 32).astype(U64)
        has = np.zeros(j - i, bool)
        has[doc[ok]] = True
        cells, owners = [], []
        for n in ORDERS:
            if len(code) < n:
                continue
            m = len(code) - n + 1
            h, keep = code[:m] + MIX[n], ok[:m].copy()
            for k in range(1, n):
                h = h * MIX[0] + code[k : m + k]
                keep |= ok[k : m + k]
            if n > 1:
                keep &= doc[:m] == doc[n - 1 :]
            h = (h * MIX[1]) >> U64(64 - BUCKETS.bit_length() + 1)
            cells.append(h[keep].astype(np.int64))
            owners.append(doc[:m][keep])
        yield i, j, has, np.concatenate(cells) if cells else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int32)
        i = j


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cell, n): n-grams by cell, and documents with a letter under cell -1."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for i, j, has, cells, owners in grams(batch.column(0).to_pylist()):
            for lang in set(langs[i:j]):
                mine = np.array([x == lang for x in langs[i:j]])
                n = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                n[:-1] += np.bincount(cells[mine[owners]], minlength=BUCKETS)
                n[-1] += np.count_nonzero(has & mine)
    for lang, n in totals.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at)), pa.array(n[at])], names=["lang", "cell", "n"])


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the log-probability matrix and the log priors, from rows (doc_id, text, lang)."""
    known = labelled.where("lang is not null")
    sample = sampled(known, "doc_id", "language", sample_docs, known.count()).select("text", "lang")
    rows = sample.mapInArrow(_count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    cells, n, names = rows.column("cell").to_numpy(), rows.column("n").to_numpy(), rows.column("lang").to_pylist()
    langs = sorted({x for x, c in zip(names, cells, strict=True) if c >= 0})
    where = {x: k for k, x in enumerate(langs)}
    at = np.array([where.get(x, 0) for x in names], np.int64)
    counts, docs = np.full((BUCKETS, len(langs)), 0.5), np.ones(len(langs))
    gram = cells >= 0
    np.add.at(counts, (cells[gram], at[gram]), n[gram])
    np.add.at(docs, at[~gram], n[~gram])
    return langs, np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32), np.log(docs / docs.sum())


def _predictor(langs: list[str], prior: np.ndarray, handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = handle.value
        for batch in batches:
            pred: list[str] = []
            score: list[float] = []
            for i, j, has, cells, owners in grams(batch.column(2).to_pylist()):
                if not langs:
                    pred, score = pred + ["und"] * (j - i), score + [0.0] * (j - i)
                    continue
                total = np.stack([np.bincount(owners, matrix[cells, k], minlength=j - i) for k in range(len(langs))], axis=1) + prior
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                pred += [langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
                score += np.where(has, share, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.expr("coalesce(pmod(crc32(cast(doc_id as string)), 3) = 1, false)").alias("held_out"))
    langs, matrix, prior = fit(docs.where("not held_out"), sample_docs)
    handle = spark.sparkContext.broadcast(matrix)
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predictor(langs, prior, handle), "doc_id long, held_out boolean, lang_pred string, score double")
