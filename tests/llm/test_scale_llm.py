"""What keeps shuffles small as vectors grow."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from quarry.llm import embedding_pq, minhash_forest


def test_vectors_are_sent_to_buckets_not_to_lists():  # F2
    x = np.random.default_rng(3).normal(size=(2000, 8))
    q = embedding_pq.Quantiser(x / np.linalg.norm(x, axis=1, keepdims=True), 44)
    batch = pa.RecordBatch.from_arrays([pa.array([8] * len(x), pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["dim", "embedding"])
    (out,) = embedding_pq._filer(SimpleNamespace(value=q), 0.93, 4)(iter([batch]))
    probes, own = out.column("probes").to_pylist(), out.column("bucket").to_pylist()
    assert all(len(p) <= 4 and b in p for p, b in zip(probes, own, strict=True))


def _variants(n: int, words: int = 100) -> tuple[list[str], list[np.ndarray]]:
    """Copies of one text with up to four words replaced, of which three leave a link with it, and their shingles as numbers."""
    rng = np.random.default_rng(5)
    texts, ids, sets = [], {}, []
    for k in range(n):
        said = [f"b{w}" for w in range(words)]
        for j in range(k % 5):
            said[2 + 20 * j + int(rng.integers(12))] = f"v{k}x{j}"
        texts.append(" ".join(said))
        sets.append(np.array(sorted({ids.setdefault(tuple(said[i : i + 4]), len(ids)) for i in range(words - 3)}), np.uint64))
    return texts, sets


def test_texts_that_can_link_with_nothing_are_compared_with_nothing():  # F1, F3
    _, sets = _variants(300)
    comp, hubs = minhash_forest.confirm_with_hubs(sets, 90, 100)
    # at 90 of 100 only those with a word replaced or none link: the middle covers them, and each other is its own
    assert len(set(comp.tolist())) == 181 and hubs.sum() == 181


def test_a_large_cluster_leaves_out_what_can_link_with_nothing(spark, monkeypatch):  # F1, F3
    texts, sets = _variants(120)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    confirmed = []
    monkeypatch.setattr(minhash_forest, "_across", lambda able, *rest: confirmed.append(able.count()))
    got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(rows, num=90, block=3000).collect()}
    want = minhash_forest.confirm(sets, 90, 100)
    assert got == {k: int(c) for k, c in enumerate(want)} and confirmed == [25]  # copies are one, with 24 variants
