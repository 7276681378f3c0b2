"""The BPE codec, the filter audit and hard negatives against brute force, edge cases included."""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe_codec, filter_audit, hard_negatives
from quarry.llm.bpe import default_path

DOCS = "doc_id long, text string, source string, lang string, ids binary, mask int, digest string, n long"
LABELS = "doc_id long, quality int, toxic int, part string"
LONG = " ".join(f"w{i % 150}" for i in range(50_000))
TEXTS = [
    (1, "A b c " * 100, "x"), (2, "A b c " * 100, "x"), (3, "A b c " * 100, "y"), (3, "A b c " * 100, "y"), (4, None, None), (5, "", "x"), (6, " ".join(f"u{i}" for i in range(300)), "x"),
    (7, " ".join(f"u{i}" for i in range(300)) + " 5%", "x"), (8, LONG, "y"), (9, LONG, "y"), (None, LONG, "y"), (None, LONG, "y"), (10, "ABC " * 250, "z"), (10, "other", "z"), (11, "é😀 <|endoftext|> x", None), (12, "a" * 70_000, "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "en", b"q", 7, "d", 1) for i, t, s in TEXTS], DOCS).repartition(3)


# --- BPE ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codecs():
    from tokenizers import Tokenizer

    return bpe_codec.loaded(default_path()), Tokenizer.from_file(default_path())


def agree(codecs, text):
    own, whole = codecs
    ids = whole.encode(text, add_special_tokens=False).ids
    got = own.encode(text)
    return np.frombuffer(got, "<u4").tolist() == ids and own.decode(got) == whole.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abst're '\n\t  　٣é漢😀̀\x1c\x85<|endoftext|>.#09", max_size=60)))
def test_codec_equals_the_library_on_any_unicode(codecs, text):
    assert agree(codecs, text) and agree(codecs, text + "<|endoftext|>" + text)


def test_codec_on_every_later_letter_and_long_texts(codecs):
    assert all(agree(codecs, f"a{c}a 1{c}") for c in list(bpe_codec._later())[::40])
    assert agree(codecs, LONG) and agree(codecs, "ab" * 40_000) and agree(codecs, " x" * 9 + " " * 70_000 + "y" + "漢字" * 40_000)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=12))
def test_decode_of_any_ids(codecs, ids):
    own, whole = codecs
    assert own.decode(np.array(ids, "<u4").tobytes()) == whole.decode(ids, skip_special_tokens=False)


@given(st.lists(st.integers(0, 3), max_size=40), st.permutations([(a, b) for a in range(4) for b in range(4)]))
@settings(max_examples=100, deadline=None)
def test_tree_merges_leftmost_of_lowest_rank(codecs, ids, pairs):
    own = object.__new__(bpe_codec.Codec)
    own.size, own.made = 8, [4 + k % 4 for k in range(16)]
    own.ranks = {a * 8 + b: k for k, (a, b) in enumerate(pairs)}
    plain = list(ids)
    while ranked := [(own.ranks[a * 8 + b], i) for i, (a, b) in enumerate(itertools.pairwise(plain)) if a * 8 + b in own.ranks]:
        rank, i = min(ranked)
        plain[i : i + 2] = [own.made[rank]]
    assert own.merged(list(ids)) == plain


def test_codec_rows(spark, docs, codecs):
    own, whole = codecs
    made = bpe_codec.round_trip(docs).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in made) == sorted((i or 0, t or "") for i, t, _ in TEXTS)
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == whole.encode(r["decoded"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) // 4 for r in made)
    back = bpe_codec.decode(bpe_codec.encode(docs))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in TEXTS)
    assert bpe_codec.round_trip(docs.limit(0)).count() == 0 and bpe_codec.decode(bpe_codec.encode(docs.limit(0))).count() == 0
    assert bpe_codec.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).first()["text"] == ""


def test_codec_refuses_other_files(tmp_path):
    import json

    spec = json.load(open(default_path(), encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe_codec.Codec(str(tmp_path / "t.json"))


# --- filter audit -------------------------------------------------------------------------------


def audit_by_brute_force(texts, labels):
    def fails(i, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        out |= {"D"} if set(t) & set("#$%&*|") else set()
        return out | ({"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in texts) else set())

    good, toxic = ({i for i, *flags in labels if i is not None and flags[k] == 1} for k in (0, 1))
    rows = {}
    for part in {s or "" for *_, s in texts}:
        failed = [(i, fails(i, t or "")) for i, t, s in texts if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = failed
            for step, f in enumerate(order, 1):
                gone, stay = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                steps.append(("".join(order), step, f, len(stay), len(gone), sum(f in x for _, x in failed) - len(gone), sum(x == {f} for _, x in failed), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
                left = stay
        rows |= {(part, o, s): (*figures, shapley[f]) for o, s, f, *figures in steps}
    return rows


MARKS = [(1, 1, 0, "p"), (2, None, 1, "p"), (2, 1, None, "p"), (3, 1, 1, "p"), (4, 0, 0, "p"), (None, 1, 1, "p"), (99, 1, 1, "p"), (10, 1, 0, "p")]


@pytest.mark.parametrize("most", [0, 300_000])
def test_audit_equals_brute_force(spark, docs, monkeypatch, most):
    monkeypatch.setattr(filter_audit, "MOST_SENT", most)
    got = filter_audit.audit(docs, spark.createDataFrame(MARKS, LABELS))
    assert [f"{n} {t}" for n, t in got.dtypes] == filter_audit.RESULT.replace("long", "bigint").split(", ")
    made = {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()}
    assert made == audit_by_brute_force(TEXTS, [m[:3] for m in MARKS])


def test_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame(MARKS, LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    one = filter_audit.audit(docs.where("doc_id = 6"), labels.limit(0)).collect()
    assert len(one) == 600 and all(r["kept"] == 1 and r["removed"] == r["shapley"] == 0 for r in one)


# --- hard negatives -----------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, cell long, rep string, ids string, w int"


def mined_by_brute_force(rows, every=100, n=5):
    fine = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine[i, label, tuple(math.floor(256 * x) for x in v)] = 1
    out = []
    for i, label, v in fine:
        if i % every:
            continue
        scored = [(-sum(map(int.__mul__, v, u)), j, other == label) for j, other, u in fine if j != i and len(u) == len(v)]
        for p, j, _ in sorted(x for x in scored if x[2])[:n]:
            near = sorted(x for x in scored if not x[2] and 80 * -p <= 100 * -x[0] <= 100 * -p)[:n]
            out += [(i, j, k, other, -p, -s) for k, (s, other, _) in enumerate(near, 1)]
    return sorted(out)


def vectors(kind):
    rng = np.random.default_rng(3)
    if kind == "groups":
        middles = rng.normal(size=(12, 8))
        rows = [(i, (middles[i % 12] + 0.2 * rng.normal(size=8)).tolist(), int(i % 5)) for i in range(1500)]
    elif kind == "spread":
        rows = [(i, rng.normal(size=6).tolist(), int(i % 3)) for i in range(900)]
    else:  # copies, ties and everything that takes no part
        rows = [(i, [1.0, 0.5, float(i % 3)], int(i % 2)) for i in range(700)] + [(700 + i, [1.0, 1.0], i % 2) for i in range(20)] + [(700, [1.0, 1.0], 0)] * 3
        rows += [(None, [1.0, 0.5, 1.0], 1), (900, None, 1), (1000, [1.0, None, 0.0], 1), (1100, [1.0, float("nan"), 0.0], 0), (1200, [1.0, float("inf"), 0.0], 0), (1300, [1.0, 0.5, 1.0], None), (1400, [], 1), (1401, [], 0), (1402, [], 1), (1500, [0.0, 0.0, 0.0], 1), (1600, [-1.0, -0.5, -1.0], 1)]
    return rows


@pytest.mark.parametrize("kind", ["groups", "spread", "odd"])
def test_negatives_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "FIRST", 2)
    rows = vectors(kind)
    table = spark.createDataFrame([(*r, 1, "r", "i", 2) for r in rows], VECTORS).repartition(3)
    got = sorted(map(tuple, hard_negatives.mine(table).collect()))
    assert got and got == mined_by_brute_force(rows)


def test_negatives_of_nothing(spark):
    table = spark.createDataFrame([(100, [1.0], 1, 1, "r", "i", 2), (101, [1.0], 1, 1, "r", "i", 2)], VECTORS)
    assert hard_negatives.mine(table.limit(0)).count() == hard_negatives.mine(table).count() == hard_negatives.mine(table.where("vec_id = 101")).count() == 0


def test_lists_bound_what_they_hold():
    rng = np.random.default_rng(8)
    x, centres = np.floor(256 * rng.normal(size=(500, 7))), np.floor(256 * rng.normal(size=(9, 7)))
    near = hard_negatives.nearest(x, centres)
    radii = [(7, int(c), float(np.linalg.norm(x[near == c] - centres[c], axis=1).max())) for c in np.unique(near)]
    cells, low, high = hard_negatives.Lists(radii, 7, centres).bounds(x[:50])
    for k, c in enumerate(cells):
        scores = x[:50] @ x[near == c].T
        assert (scores <= high[:, k, None]).all() and (scores >= low[:, k, None]).all()
