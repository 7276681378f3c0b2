"""Language identification against a naive Bayes written out; long, repeated and odd texts through the operators."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import exact_dedup, language_id, minhash_forest, mixture, packing, personal_data, suffix_merge, token_ledger, toxicity
from quarry.llm.bpe import default_path
from quarry.llm.textkernel import MIX

MASK = (1 << 64) - 1
MULTIPLIER = [int(x) for x in MIX]


def cells(text):
    """The hashed n-grams of a text, one by one: letters stay, all else is a space, n-grams of spaces alone don't count."""
    code = [ord(c) if c.isalpha() else 32 for c in (text or "").lower()]
    out = []
    for n in language_id.ORDERS:
        for i in range(len(code) - n + 1):
            gram = code[i : i + n]
            if any(chr(c).isalpha() for c in gram):
                h = gram[0] + MULTIPLIER[n]
                for c in gram[1:]:
                    h = (h * MULTIPLIER[0] + c) & MASK
                out.append(((h * MULTIPLIER[1]) & MASK) >> (64 - language_id.BUCKETS.bit_length() + 1))
    return out


def test_language_equals_naive_bayes(spark):
    rng = np.random.default_rng(12)
    words = {"aa": "lorem ipsum dolor sit amet", "bb": "über straße wörter und mehr", "cc": "漢字 かな 文 字列 日本"}
    docs = [(i, " ".join(rng.choice(words[lang].split(), 12)), lang) for i in range(90) for lang in [list(words)[i % 3]]]
    docs += [(200, None, "aa"), (201, "123 !?", "bb"), (202, "", None), (203, "lorem über", None), (203, "lorem über", None), (204, "wörter " * 30_000, None), (None, "dolor sit", "cc"), (205, "ǅ İstanbul ẞ", "bb")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    grams, n_docs = {}, Counter()
    for i, t, lang in docs:
        if lang is not None and not held(i):
            grams.setdefault(lang, Counter()).update(cells(t))
            n_docs[lang] += any(c.isalpha() for c in (t or "").lower())
    langs = sorted(grams)
    size = {x: sum(grams[x].values()) + 0.5 * language_id.BUCKETS for x in langs}
    prior = {x: math.log((n_docs[x] + 1) / sum(n_docs[y] + 1 for y in langs)) for x in langs}
    got = language_id.identify(d).collect()
    assert len(got) == len(docs)
    texts = {(i, t) for i, t, _ in docs}
    by = {}
    for i, t in texts:
        own = Counter(cells(t))
        total = {x: prior[x] + sum(n * math.log((grams[x][c] + 0.5) / size[x]) for c, n in own.items()) for x in langs}
        best = max(langs, key=lambda x: total[x])
        letters = any(c.isalpha() for c in (t or "").lower())
        by.setdefault(i, set()).add((best if letters else "und", 1 / sum(math.exp(min(700, v - total[best])) for v in total.values()) if letters else 0.0))
    for r in got:
        assert any(r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-3) for lang, score in by[r["doc_id"]]), r
        assert r["held_out"] == held(r["doc_id"])


LONG = " ".join(f"word{k % 613}" for k in range(20_000))
TEXTS = [(1, LONG), (2, LONG + " end"), (3, LONG), (3, LONG), (4, "x" * 150_000), (5, "é漢😀 " * 20_000), (6, None), (7, "")]


@pytest.fixture(scope="module")
def long_docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def test_long_texts_are_taken_whole(spark, long_docs):
    """Texts of some 150 KB, through operators that have no such text in their own tests; figures that depend on every byte."""
    words = {i: len((t or "").split()) for i, t in TEXTS}
    got = suffix_merge.remove_repeats(long_docs).collect()
    assert sorted((r["doc_id"], r["n_bytes"]) for r in got) == sorted((i, len((t or "").encode())) for i, t in TEXTS)
    assert {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"] in (1, 2)} == {1: 0, 2: len(LONG) + 1}  # the words come back, so the space behind them is repeated as well
    personal = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in personal_data.find(long_docs.where("doc_id <> 3")).collect()}
    assert set(personal.values()) == {(0, 0, 0, 0)}
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_forest.near_duplicates(long_docs).collect()}
    shingles = lambda t: len({tuple(t.lower().split()[k : k + 4]) for k in range(len(t.split()) - 3)})
    assert near[2] == (shingles(LONG + " end"), 1) and near[3] == (shingles(LONG), 1) and near[4] == (1, 4)
    exact = {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup.deduplicate(long_docs).collect()}
    assert exact[1] == (3, 3, hashlib.sha256(LONG.encode()).hexdigest()) and exact[6][:2] == (7, 2)
    assert {r["doc_id"]: r["size"] for r in mixture.report(long_docs).collect()} == words
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    tokens = {i: len(whole.encode(t or "", add_special_tokens=False).ids) for i, t in TEXTS}
    packed = packing.pack(long_docs.where("doc_id <> 3")).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r["doc_id"]: (r["sum(length)"], r["max(doc_tokens)"]) for r in packed} == {i: (n + 1, n + 1) for i, n in tokens.items() if i != 3}
    ledger = token_ledger.TokenLedger(spark)
    ledger.commit("long", token_ledger.signed(inserts=long_docs.where("doc_id <> 3")))
    assert {r["tokenizer_version"]: r["n_tokens"] for r in ledger.totals().collect()} == {"words-1": sum(n for i, n in words.items() if i != 3), "byte_bpe_50k": sum(n for i, n in tokens.items() if i != 3)}
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(8)], "doc_id long, quality int, toxic int")
    assert toxicity.score(long_docs, labels).count() == len(TEXTS) and language_id.identify(long_docs).count() == len(TEXTS)


def test_packing_ids_equal_the_library_on_any_unicode(spark):
    """Generated Unicode: the ids of each document's pieces are those of ``tokenizers``."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(31)
    spans = [(32, 127), (0x80, 0x250), (0x370, 0x600), (0x900, 0xA00), (0x2000, 0x2070), (0x3040, 0x30FF), (0x4E00, 0x4F00), (0x1F600, 0x1F640), (9, 14), (0x1C, 0x20)]
    texts = ["".join(chr(int(rng.integers(*spans[int(rng.integers(len(spans)))]))) for _ in range(int(rng.integers(0, 80)))) for _ in range(600)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = Tokenizer.from_file(default_path())
    want = {i: zlib.crc32(np.array(whole.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids_crc32"] for r in packing.pack(d).collect()} == want
