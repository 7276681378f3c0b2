"""The ten operators against brute force on small fixtures, edge cases included."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe, embedding_pq, exact_dedup, language_id, minhash_forest, mixture, packing, personal_data, queries, sampling, suffix_merge, token_ledger, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node string, grp int"
LONG = " ".join(f"word{i % 97}x{i}" for i in range(4000))
BASE = " ".join(f"term{i}" for i in range(60))
TEXTS = [
    (1, BASE), (2, BASE.upper()), (3, BASE), (3, BASE), (4, BASE.replace("term59", "other")), (5, BASE.replace("term7 ", "seven ")),
    (6, LONG), (7, LONG + " tail"), (8, None), (9, ""), (10, "  \n\t "), (11, "one two"), (12, "one two"), (13, "ONE two"), (None, BASE + " null id"),
    (14, "é😀 me@x.org +49 (30) 12345678 4111 1111 1111 1111 10.0.0.1 999.1.1.1"), (15, "a" * 300), (16, "b" + "a" * 120), (17, "x y  z\r\n" * 20), (18, "<|endoftext|> and\x1cthis"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None if (i or 0) % 5 == 0 else f"s{(i or 0) % 5}", 0, "d", "n", 1) for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_op1_equals_brute_force(docs):
    order = sorted(TEXTS, key=lambda x: (x[0] is None, x[0] or 0))
    first: dict[bytes, object] = {}
    want = []
    for i, t in order:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, t in order:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] != i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    assert rows(suffix_merge.remove_repeats(docs)) == sorted(want, key=repr)
    # many groups and buckets, and runs that are merged in several rounds
    assert rows(suffix_merge.remove_repeats(docs, group_bytes=300, fan_in=2)) == sorted(want, key=repr)


def test_op1_folds_periodic_texts(spark):
    """Padding, alternating letters and longer periods, against brute force; a period that other bytes break."""
    table = [(1, "a" * 400), (2, "x" + "a" * 900 + "y" + "ab" * 300), (3, "ba" * 200 + "q" * 49 + "a" * 60), (4, "0123456789" * 40), (5, "z" + "0123456789" * 80 + "z" + "0123456789" * 30), (6, "".join(f"{k % 37:02d}" for k in range(900))), (7, "-" * 70 + "".join(f"{k % 37:02d}" for k in range(200))), (8, "ab" * 30), (2, "a" * 100)]
    first: dict[str, int] = {}
    for i, t in sorted(table):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    want = []
    for i, t in table:
        gone = {x for p in range(len(t) - 49) if first[t[p : p + 50]] != i for x in range(p, p + 50)}
        want.append((i, len(t), len(gone), sum(x - 1 not in gone for x in gone), hashlib.sha256("".join(c for k, c in enumerate(t) if k not in gone).encode()).hexdigest()))
    d = spark.createDataFrame(table, "doc_id long, text string").repartition(2)
    for group_bytes, fan_in in ((4 << 20, 512), (700, 3)):
        assert rows(suffix_merge.remove_repeats(d, group_bytes, fan_in)) == sorted(want, key=repr)


def test_op1_long_padding_in_little_memory():
    """20 MB of one letter, and as much of a period of 300, with a passage that others share: a row for each distinct anchor."""
    import tracemalloc

    import pyarrow as pa
    import zstandard

    text = b"".join([b"q" * (10 << 20), bytes(range(33, 90)), b"." * (10 << 20)])
    press = zstandard.ZstdCompressor()
    table = pa.table({"grp": [1, 1], "doc_id": [1, 2], "packed": [press.compress(text), press.compress(b"q" * 500)]})
    tracemalloc.start()
    own = suffix_merge.Group(table)
    with np.errstate(over="ignore"):
        made = suffix_merge._front_coded(own, np.arange(len(own.at)), 1, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(own.at) < 1000 and made and peak < 300 << 20


def test_op1_shared_passages_in_many_contexts(spark):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("ab"), n))
    passages = [word(70) for _ in range(4)]
    table = [(None if k % 9 == 0 else int(rng.integers(0, 60)), word(rng.integers(0, 40)) + passages[k % 4] + word(rng.integers(0, 40)) + passages[k % 3][: rng.integers(40, 70)]) for k in range(80)]
    first: dict[str, tuple] = {}
    rank = lambda i: (i is None, i or 0)
    for i, t in sorted(table, key=lambda x: rank(x[0])):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], rank(i))
    want = []
    for i, t in table:
        gone = {x for p in range(len(t) - 49) if first[t[p : p + 50]] != rank(i) for x in range(p, p + 50)}
        spans = sum(x - 1 not in gone for x in gone)
        want.append((i, len(t), len(gone), spans, hashlib.sha256("".join(c for x, c in enumerate(t) if x not in gone).encode()).hexdigest()))
    d = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    for group_bytes, fan_in in ((4 << 20, 512), (700, 3)):
        assert rows(suffix_merge.remove_repeats(d, group_bytes, fan_in)) == sorted(want, key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=0, max_size=9), max_size=12), min_size=1, max_size=9))
def test_op1_merge_sorts_by_known_prefixes(runs):
    width = 8 * suffix_merge.WORDS
    padded = [sorted(x.ljust(width, b"\0") for x in run) for run in runs if run]
    if not padded:
        return
    codes = []
    for run in padded:
        out, last = [], None
        for x in run:
            w = [int.from_bytes(x[i : i + 8], "big") for i in range(0, width, 8)]
            k = 0 if last is None else next((j for j in range(len(w)) if w[j] != last[j]), len(w))
            out.append(0 if k == len(w) else ((suffix_merge.WORDS - k) << 64) | w[k])
            last = w
        codes.append(out)
    order, _ = suffix_merge.merge_runs(codes, [b"".join(r) for r in padded])
    at = Counter()
    merged = []
    for r in order:
        merged.append(padded[r][at[r]])
        at[r] += 1
    assert merged == sorted(x for r in padded for x in r)


def test_op2_base_spans_and_votes(docs, spark):
    got = {r["doc_id"]: r for r in personal_data.find(docs).collect()}
    assert got[14]["spans"] == "email:3:11,ip:50:58"  # the digits of card and phone run on, so neither holds
    assert (got[14]["n_email"], got[14]["n_ip"]) == (1, 1) and got[8]["spans"] == "" == got[9]["spans"]
    hard = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4111-1111-1111-1111", "+1 (988) 555-2485", "." * 80 + "@a.b", "call 555-123-4567 or bob [at] mail [dot] com"]
    found = {r["doc_id"]: r["spans"] for r in personal_data.find(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")).collect()}
    assert found[0] == "email:0:5,email:5:11" and found[1] == "ip:0:7,ip:8:15" and found[2] == "card:0:19" and found[3] == "phone:0:17" and found[4] == "email:0:84"
    assert "email:21:44" in found[5]


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_op2_base_spans_equal_python(spark):
    rng = np.random.default_rng(21)
    texts = [None, "", "x" * 60_000 + " a@b.c " + "1.2.3.4 " * 700 + "4111111111111111 " * 700]
    for letters in ("0123456789 -", "019. ", "+0123 ().-", "ab@.-é😀 ", "0123456789.-+@a ()"):
        texts += ["".join(rng.choice(list(letters), rng.integers(5, 90))) for _ in range(300)]
    for _ in range(300):  # numbers that pass the check digit, among separators and further digits
        d = "".join(map(str, rng.integers(0, 10, rng.integers(12, 19))))
        d += next(c for c in "0123456789" if sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d + c))) % 10 == 0)
        texts.append("".join(rng.choice(["", " ", "-", "é"]) + c if rng.random() < 0.3 else c for c in d) + str(rng.choice(["", " 7", ".", "+", "--1"])))
    got = {r["doc_id"]: r for r in personal_data.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(x[0] == k for x in want) for k in KINDS], t and t[:200]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert set(",".join(f"{k}:{a}:{b}" for k, a, b in want).split(",")) <= set(got[i]["spans"].split(",")) or not want


def test_op2_added_spans_precision_and_recall(spark):
    rng = np.random.default_rng(22)
    name = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    phone = lambda: f"{rng.integers(2, 9)}{rng.integers(0, 8)}{rng.integers(2, 9)}-{rng.integers(2, 9)}{rng.integers(22, 99)}-{rng.integers(1000, 9999)}"
    ident = lambda: f"{rng.integers(100, 600)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}"
    table, truth, decoys = [], set(), set()
    for i in range(600):
        kind, good = ("email", "phone", "id")[i % 3], i % 2 == 0
        if kind == "email":
            hit = f"{name()} [at] {name()} [dot] {rng.choice(['com', 'org', 'de', 'net'])}" if good else f"{name()} [at] {name()}"
            text = f"please mail {hit} soon" if good else f"meet {hit} tomorrow"
        elif kind == "phone":
            hit = phone() if good else f"{rng.integers(100, 199)}-{rng.integers(0, 2)}11-{rng.integers(1000, 9999)}"
            text = f"call me on {hit} today" if good else f"see invoice ref {hit} page"
        else:
            hit = ident() if good else f"{rng.choice(['000', '666', '912'])}-00-0000"
            text = f"her ssn is {hit} she said" if good else f"part order item {hit}x"
        begin = text.index(hit)
        (truth if good else decoys).add((i, f"{kind}:{begin}:{begin + len(hit)}"))
        table.append((i, f"{text}"))
    table += [(1000 + k, f"mail {name()}@{name()}.com or ip 10.0.0.{k}, card 4111111111111111, phone +1 212 555 {1000 + k}") for k in range(100)]
    got = personal_data.find(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).where("doc_id < 1000")
    found = {(r["doc_id"], x) for r in got.collect() for x in r["spans"].split(",") if x}
    assert len(found & truth) >= 0.95 * len(truth) and len(found & truth) >= 0.95 * len(found)


def test_op3_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + 0.05 * rng.normal(size=(20, 16)), base[:5], 3 * base[:2]])
    table = [(i, [float(np.float32(v)) for v in r], i % 2 if i < 40 else (i - 40) % 2 if i < 60 else (i - 60) % 2) for i, r in enumerate(x)]
    odd = [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] + [1.0] * 15, 0), (103, [None] + [1.0] * 15, 0), (104, table[0][1], None), (105, table[0][1], 0), (105, table[0][1], 0), (106, [1.0], 0)]
    # the dimensions of few vectors: shorter and longer ones link among themselves
    odd += [(107, [1.0, 2.0], 0), (108, [2.0, 4.0], 0), (109, [1.0, 2.0], 1), (110, [1.0] * 40, 1), (111, [1.0] * 39 + [1.2], 1), (112, [], 0), (None, [1.0, 2.0], 0)]
    got = {}
    for r in embedding_pq.near_duplicates(spark.createDataFrame(table + odd, "vec_id long, embedding array<float>, label int")).collect():
        got.setdefault(r["vec_id"], r)
    nodes = [(i, np.array(v) / np.linalg.norm(v), y, k) for k, (i, v, y) in enumerate(table + odd) if i is not None and (i < 100 or i == 105)]
    links = {k: [j for j in nodes if j[3] != k and j[2] == y and a @ j[1] >= 0.93] for _, a, y, k in nodes}
    for i, _, _, k in nodes:
        assert got[i]["n_links"] == len(links[k])
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (107, 108, 109, 110, 111, 112, None)] == [(2, 107), (2, 107), (0, 109), (1, 110), (1, 110), (0, 112), (2, 107)]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (100, 101, 102, 103, 104, 106))
    assert got[105]["component_id"] == 0 and not got[105]["kept"]


def test_op3_finds_links_of_a_dense_group_over_many_lists(spark, monkeypatch):
    rng = np.random.default_rng(3)
    heart = rng.normal(size=12)
    spread = rng.normal(size=(800, 12))
    dense = heart / np.linalg.norm(heart) + rng.normal(size=(1600, 12)) * 0.045
    x = np.concatenate([spread, dense])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made = []
    monkeypatch.setattr(embedding_pq.Quantiser, "__init__", lambda q, sample, lists, make=embedding_pq.Quantiser.__init__: made.append(q) or make(q, sample, 60))
    got = {r["vec_id"]: r["n_links"] for r in embedding_pq.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    near = x @ x.T >= 0.93
    assert len(made[0].centres) == 60 and near[800:, 800:].mean() > 0.9
    assert [got[i] for i in range(len(x))] == (near.sum(axis=1) - 1).tolist()


def test_op4_learns_words_and_misspellings(spark):
    terms = ["idiot", "disgusting", "pathetic", "worthless"]
    docs = [(i, f"you plain text of number {i} about things" if i % 5 else f"you {terms[i % 4]} and {terms[(i // 5) % 4]} about things {i}") for i in range(400)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(400)]
    d = spark.createDataFrame([*docs, (900, "you idi0t, what a disgustin thing"), (901, ""), (902, None), (903, "nice thing")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i]["predicted"] == int(i % 5 == 0) for i in range(400)) and got[900]["predicted"] == 1
    assert all(got[i]["predicted"] == 0 and 0 <= got[i]["score"] <= 1 for i in (901, 902, 903))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    none = toxicity.score(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in none.collect()} == {0.0}


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeo", min_size=1, max_size=9))
def test_op4_automaton_is_the_edit_distance(word):
    terms = {"abode": 1.0, "decade": 1.0, "bead": 1.0, "abcdeabcd": 1.0}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row = [i] + [0] * len(b) if not (last := row) else [i] + [0] * len(b)
            for j, e in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != e))
        return row[-1]

    want = min(((distance(t, word), t) for t in terms if distance(t, word) <= toxicity.budget(t)), default=None)
    assert toxicity.Automaton(terms).look(word) == (want and (want[1], want[0]))


def test_op4_short_terms_and_nothing_to_tell_by(spark):
    """Terms of one to three letters are learned like others; where no term is, or a text holds none, it is not called toxic."""
    rng = np.random.default_rng(6)
    plain = lambda: " ".join(f"word{rng.integers(300)}" for _ in range(30))
    docs = [(i, plain() + (" you zug 死" if i % 3 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame([*docs, (900, "zug"), (901, plain()), (902, None), (903, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(d, labels).collect()}
    assert all(got[i]["predicted"] == int(i % 3 == 0) for i in range(400))
    assert got[900]["predicted"] == 1 and not any(got[i]["predicted"] or got[i]["score"] >= 0.3 for i in (901, 902, 903))
    same = spark.createDataFrame([(i, "one and the same text") for i in range(400)], "doc_id long, text string")
    assert not any(r["predicted"] or r["score"] for r in toxicity.score(same, labels).collect()) and toxicity.without_toxic(same, labels).count() == 400


def test_op4_scores_equal_brute_force(spark):
    """Hits by trying every term and edit distance, windows and the logistic sum written out; long and repeated rows among them."""
    import math

    rng = np.random.default_rng(9)
    vocab = [f"{a}{b}{c}" for a in ("ma", "lo", "ti") for b in ("ren", "sop", "duk") for c in ("a", "o", "i")]
    text = lambda n: " ".join(rng.choice(vocab, n))
    bad = ["stupid", "moron", "worthless", "idi"]
    docs = []
    for i in range(300):
        words = text(40).split()
        if i % 4 == 0:
            words[int(rng.integers(40))] = bad[i // 4 % 4]
            words[int(rng.integers(40))] = "you " + bad[i // 8 % 4]
        docs.append((i, " ".join(words)))
    odd = ["st\u00fcpid m0ron", "he said \"stupid\" and wrote 'moron'", "you st upid", "stupids worthles wrthless worthlesssx", "STUPID you moron", "idi idj", text(20_000) + " worthless", ""]
    docs += [(1000 + k, t) for k, t in enumerate(odd)] + [(1000, odd[0])] * 2
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lexicon, weights = toxicity.fit(d, labels)
    assert set(lexicon.words) >= set(bad)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for k, x in enumerate(a, 1):
            row, left = [k], row
            for m, y in enumerate(b, 1):
                row.append(min(left[m] + 1, row[-1] + 1, left[m - 1] + (x != y)))
        return row[-1]

    def near(word):
        terms = [(min(distance(term, word[:n]) for n in range(len(word) + 1)) if term not in lexicon.words else distance(term, word), term) for term in lexicon.misspelled]
        return min(((e, t) for e, t in terms if e <= toxicity.budget(t)), default=None)

    def hit(word):
        if word in lexicon.words:
            return 0, lexicon.words[word]
        for n in toxicity.BEGINNINGS:
            if len(word) >= 4 and word[:n] in lexicon.beginnings:
                return 1, lexicon.beginnings[word[:n]]
        found = near(word) if len(word) >= 4 and word not in lexicon.known else None
        return found and (2, lexicon.misspelled[found[1]])

    known: dict = {}

    def want(t):
        low = (t or "").lower()
        found = [(m.start(), m.end(), known.setdefault(m[0], hit(m[0])), m[0]) for m in re.finditer(r"[^\W_]+", low)]
        spots = [f for f in found if f[2]]
        if not spots:
            return min(1 / (1 + math.exp(-weights[-1])), toxicity.NO_HIT)
        sums, kinds, quoted, abusive, last = [0.0] * 3, [set(), set(), set()], 0.0, 0.0, -1000
        for a, b, (kind, weight), word in spots:
            sums[kind] += weight
            kinds[kind].add(word)
            before, after = low[max(0, a - 60) : a], low[b : b + 60]
            signs = bool(toxicity.QUOTES.search(before[-20:])) + bool(toxicity.QUOTES.search(after[:20])) + bool(toxicity.REPORTING.search(before))
            quoted += weight if signs >= 2 else 0
            abusive += weight if toxicity.ADDRESS.search(before[-25:]) or a - last < 60 else 0
            last = b
        x = [math.log1p(s) + 0.5 * min(len(k), 6) for s, k in zip(sums, kinds, strict=True)] + [math.log1p(100 * len(spots) / len(found)), math.log1p(quoted), math.log1p(abusive), float(len({w for *_, w in spots}) >= 2), 1.0]
        return 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(x, weights))))))

    texts = dict(docs)
    got = toxicity.score(d, labels).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["score"] == pytest.approx(want(texts[r["doc_id"]]), abs=1e-9) and r["predicted"] == int(r["score"] >= 0.3)


def test_op4_meets_misspellings_of_beginnings(spark):
    forms = ["idiot", "idiots", "idiotic", "idiotism"]
    docs = [(i, f"you plain text of number {i} about things" if i % 5 else f"you {forms[i // 5 % 4]} of things {i}") for i in range(400)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(400)]
    odd = [(900, "you idi0t of things"), (901, "you idi0tisch of things"), (902, "you idjotic of things"), (903, "you idle of things"), (904, "you riot of things")]
    lexicon, _ = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert lexicon.words == {} and list(lexicon.beginnings) == ["idio"]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [got[i] for i, _ in odd] == [1, 1, 1, 0, 0]
    assert all(got[i] == int(i % 5 == 0) for i in range(400))


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeo", min_size=1, max_size=9))
def test_op4_automaton_accepts_any_rest_after_a_beginning(word):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    whole, begin = ["decade", "bead"], ["abode", "abcdeabcd", "deco"]
    near = [(distance(word, t), t) for t in whole] + [(min(distance(word[:k], t) for k in range(len(word) + 1)), t) for t in begin]
    near = [(e, t) for e, t in near if e <= toxicity.budget(t)]
    assert toxicity.Automaton(whole, begin).look(word) == ((min(near)[1], min(near)[0]) if near else None)


def shingles(t, w=4):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(ws[i : i + w]) for i in range(len(ws) - w + 1)} or ({tuple(ws)} if ws else set())


def components(sets):
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def test_op5_equals_brute_force(docs):
    sets = [shingles(t) for _, t in TEXTS]
    root = components(sets)
    want = []
    for k, (i, t) in enumerate(TEXTS):
        ids = [TEXTS[m][0] for m in range(len(TEXTS)) if root[m] == root[k] and TEXTS[m][0] is not None]
        comp = min(ids, default=None) if sets[k] else i
        want.append((i, len(sets[k]), comp, i == comp))
    assert rows(minhash_forest.near_duplicates(docs)) == sorted(want, key=repr)


def test_op5_crowded_regions_lose_no_planted_pair(spark):
    rng = np.random.default_rng(11)
    base = [f"common{i}" for i in range(400)]
    texts = [" ".join(base + [f"own{k}x{i}" for i in range(90)]) for k in range(1200)]
    # pairs at 0.80 to 0.85, all other texts share 0.69 of their shingles
    pairs = [(k, " ".join([*texts[k].split()[: -n], *(f"new{k}x{i}" for i in range(n))])) for k, n in zip(range(0, 1200, 12), rng.integers(42, 54, 100), strict=True)]
    table = [(k, t) for k, t in enumerate(texts)] + [(2000 + k, t) for k, t in pairs]
    truth = {k for k, t in pairs if 100 * len((a := shingles(texts[k])) & (b := shingles(t))) >= 80 * len(a | b)}
    assert len(truth) >= 80
    d = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    for crowded in (minhash_forest.CROWDED,):
        got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(d, crowded=crowded).collect()}
        found = {k for k, _ in pairs if got[2000 + k] == k}
        assert found <= truth and len(found) >= 0.97 * len(truth)
        assert all(got[k] == k for k in range(1200))


def test_op5_large_clusters_go_by_blocks(spark):
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(120)]
    table = []
    for k in range(400):  # near copies of one text, most pairs linked, and two chains with links from one to the next alone
        words = list(base)
        for x in rng.choice(120, 2 if k % 3 else 1, replace=False):
            words[x] = f"v{k}x{x}"
        table.append((k, " ".join(words)))
    for start in (1000, 2000):
        words = [f"c{start}x{i}" for i in range(100)]
        for k in range(12):
            words = [*words[10:], *(f"c{start}n{k}x{i}" for i in range(10))]
            table.append((start + k, " ".join(words)))
    sets = [shingles(t) for _, t in table]
    root = components(sets)
    want = {i: table[root[k]][0] for k, (i, _) in enumerate(table)}
    d = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    for block in (2500,):
        got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(d, crowded=48, block=block).collect()}
        assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)
        assert all(want[i] == want[got[i]] for i in want)


@pytest.mark.parametrize("block", [4000, 1500])
def test_op5_chain_is_one_component_whatever_the_block(spark, block):
    """300 texts, each linked to the next alone, at about 0.81; and two families that share most words but no link."""
    chain = [(i, " ".join(f"c{w}" for w in range(14 * i, 14 * i + 140))) for i in range(300)]
    rng = np.random.default_rng(4)
    near = [(1000 + i, " ".join(f"b{w}" if rng.random() > 0.04 else f"x{i}y{w}" for w in range(150))) for i in range(60)]
    d = spark.createDataFrame(chain + near, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(d, block=block).collect()}
    sets = [{tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for _, t in chain + near]
    want = components(sets)
    ids = [i for i, _ in chain + near]
    assert {i: ids[want[k]] for k, i in enumerate(ids)} == got and len(set(want[:300])) == 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1), min_size=1, max_size=14))
def test_op5_confirm_is_exact(sets):
    got = minhash_forest.confirm([np.array(sorted(s), np.uint64) for s in sets])
    want = components(sets)
    assert [[a == b for b in got] for a in got] == [[a == b for b in want] for a in want]


def test_op6_is_additive_and_idempotent(docs, spark):
    ledger = token_ledger.TokenLedger(spark)
    assert ledger.totals().count() == 0
    assert ledger.commit("b1", token_ledger.signed(inserts=docs)) and not ledger.commit("b1", token_ledger.signed(inserts=docs))
    tok = bpe.loaded(bpe.default_path()).whole
    want = Counter()
    for r in docs.collect():
        want[r["source"], r["lang"]] += len(tok.encode(r["text"] or "", add_special_tokens=False).ids)
    got = {(r["source"], r["lang"]): r["n_tokens"] for r in ledger.totals().where("tokenizer_version <> 'words-1'").collect()}
    assert got == want
    old, new = docs.where("doc_id = 11"), docs.where("doc_id = 11").replace({"one two": "one two three"})
    ledger.commit("b2", token_ledger.signed(deletes=docs.where("doc_id in (6, 7)"), revisions=(old, new)))
    words = {(r["source"], r["lang"]): r["n_tokens"] for r in ledger.totals().where("tokenizer_version = 'words-1'").collect()}
    assert sum(words.values()) == sum(len(shwords(t)) for i, t in TEXTS if i not in (6, 7)) + 1


def test_op6_folds_batches_and_keeps_their_ids(docs, nothing, spark, monkeypatch):
    monkeypatch.setattr(token_ledger, "FOLD_AFTER", 2)
    ledger = token_ledger.TokenLedger(spark)
    some = docs.where("doc_id in (1, 11)")
    for k in range(4):
        assert ledger.commit(f"b{k}", token_ledger.signed(inserts=some if k else nothing))
    ledger.commit("b4", token_ledger.signed(deletes=some))
    assert len(ledger._seen()[3]) <= 2 and len(ledger._names("batch=")) <= 5 and len(ledger._names("snapshot=")) == 1
    assert not any(ledger.commit(f"b{k}", token_ledger.signed(inserts=some)) for k in range(5))
    assert {r["n_docs"] for r in ledger.totals().collect()} == {4}
    # of two writers that have both begun one takes effect
    late = token_ledger.TokenLedger(spark, ledger.root)
    monkeypatch.setattr(late, "committed", lambda batch_id: False)
    assert ledger.commit("race", token_ledger.signed(inserts=some)) and not late.commit("race", token_ledger.signed(inserts=some))
    assert {r["n_docs"] for r in ledger.totals().collect()} == {6}


def test_op6_counts_a_batch_once_whatever_comes_between(docs, spark, monkeypatch):
    ledger, one = token_ledger.TokenLedger(spark), docs.where("doc_id = 1")
    ledger.commit("first", token_ledger.signed(inserts=one))
    held = ledger.totals()  # asked for before a fold, read after it
    plain = ledger._sums

    def meanwhile(sums, batches):
        if not ledger.committed("between"):
            ledger.commit("between", token_ledger.signed(inserts=one))
        return plain(sums, batches)

    monkeypatch.setattr(ledger, "_sums", meanwhile)
    ledger.fold()
    monkeypatch.undo()
    assert {r["n_docs"] for r in held.collect()} == {1} and {r["n_docs"] for r in ledger.totals().collect()} == {2}
    ledger.fold()
    ledger.fold()
    assert {r["n_docs"] for r in ledger.totals().collect()} == {2} and not ledger.commit("between", token_ledger.signed(inserts=one))
    assert len(ledger._names("snapshot=")) == 2 and ledger._names("batch=") == ["between"]


def test_op6_query_equals_brute_force(spark, tmp_path):
    table = [(i, f"Word {i} AND more" * (i % 3 + 1) if i != 5 else None, f"s{i % 2}", "en") for i in range(30)]
    marks = [(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(0, 30, 2)]
    spark.createDataFrame(table, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tok, toxic, low = bpe.loaded(bpe.default_path()).whole, {i for i, _, t in marks if t}, {i for i, q, _ in marks if not q}
    want = Counter()
    for i, t, source, _ in table:
        if i not in toxic:
            t = (t or "").lower() if i in low else t or ""
            want[source, "words-1"] += len(shwords(t))
            want[source, "byte_bpe_50k"] += len(tok.encode(t, add_special_tokens=False).ids)
    assert {(r["source"], r["tokenizer_version"]): r["n_tokens"] for r in queries.op6_token_rollup(spark, str(tmp_path)).collect()} == want


def shwords(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_op7_equals_brute_force(docs):
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in TEXTS]
    want = []
    for (i, _), b in zip(TEXTS, low, strict=True):
        same = [TEXTS[k][0] for k in range(len(low)) if low[k] == b]
        keep = max((x for x in same if x is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256(b.encode()).hexdigest()))
    assert rows(exact_dedup.deduplicate(docs).drop("locator")) == sorted(want, key=repr)


def test_op7_settles_texts_that_share_a_digest(docs):
    want = rows(exact_dedup.deduplicate(docs).drop("locator"))
    assert rows(exact_dedup.deduplicate(docs, key="substring(sha, 1, 0)").drop("locator")) == want
    kept = exact_dedup.distinct_rows(docs, key="substring(sha, 1, 0)")
    assert kept.columns == docs.columns and rows(kept) == rows(exact_dedup.distinct_rows(docs))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(w[0] for w in {w[4]: w for w in want if w[3]}.values())


def test_op7_state_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FOLD_AFTER", 2)
    store, root = f"{tmp_path}/store", f"{tmp_path}/root"
    stream = exact_dedup.DedupStream(spark, store, root)
    seen = []
    for batch in ([(1, "a"), (2, "b")], [(5, "A")], [(3, "a"), (9, "c")], [(4, "b")]):
        exact_dedup.arrive(spark.createDataFrame(batch, "doc_id long, text string"), store)
        seen.append({bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in stream.advance().collect()})
    a, b, c = (hashlib.sha256(x).digest() for x in (b"a", b"b", b"c"))
    assert [s[a] for s in seen] == [(1, 1), (5, 2), (5, 3), (5, 3)]
    assert seen[-1] == {a: (5, 3), b: (4, 2), c: (9, 1)}
    assert len(stream._written("state/batch=")) <= 2 and stream.clashes().count() == 0
    assert {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in stream.advance().collect()} == seen[-1]


def test_op8_targets_fill_up(spark):
    sizes = [("a", 100)] * 3 + [("b", 1000)] * 3 + [("c", 5000)] + [(None, 700)] * 2 + [("z", 0)]
    got = {r["source"]: r for r in mixture.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    weight = {"a": 5, "b": 2, "c": 1, "z": 5, None: 2}
    size = Counter()
    for s, n in sizes:
        size[s] += n
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        free = [s for s in size if s not in capped]
        left = total - sum(2.0 * size[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    for s in size:
        assert got[s]["target"] == pytest.approx(2.0 * size[s] if s in capped else share[s])


def test_op8_emits_what_it_reports(docs):
    report = mixture.report(docs)
    emitted = mixture.emit(docs)
    assert emitted.columns == docs.columns
    got = Counter(r["doc_id"] for r in emitted.collect())
    for r in report.collect():
        if r["size"] and r["doc_id"] not in (3,):
            assert r["taken"] == got[r["doc_id"]] * r["size"] and r["taken"] <= 2 * r["size"]


def test_op8_equal_and_nameless_rows_draw_each(spark):
    """Sources whose rows have no id, one id, or are copies come near their targets like any other."""
    rows = [(None, f"w{i} " * 5, "a") for i in range(400)] + [(7, f"v{i} " * 5, "b") for i in range(400)] + [(None, "same five words of text", "c")] * 400 + [(i, f"u{i} " * 5, None) for i in range(400)]
    d = spark.createDataFrame([(*r, k % 3) for k, r in enumerate(rows)], "doc_id long, text string, source string, other int").repartition(5)
    got = mixture.report(d, share=1.25).toPandas()
    for target, part in got.groupby("target"):
        sources = max(1, round(part["size"].sum() / 2000))
        assert abs(part["taken"].sum() / sources - target) < 0.08 * 2000 and (part["taken"] <= 2 * part["size"]).all()
    assert len(got) == 1600 and got["taken"].sum() == 5 * mixture.emit(d, share=1.25).count()


def test_op8_blocks_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK", 7)
    d = spark.createDataFrame([(1, "a b", "x", k % 2) for k in range(60)] + [(2, "c d", "x", 0)], "doc_id long, text string, source string, other int")
    got = mixture.report(d)
    assert got.count() == 61 and got.agg({"taken": "sum"}).first()[0] == 2 * mixture.emit(d).count()


def test_op8_takes_clashing_names(spark):
    names = ["doc_id", "text", "source", "target", "rate", "source_size", "size", "copies", "row", "name", "weight"]
    d = spark.createDataFrame([(i, "one two three", f"s{i % 2}", 1, 2, 3, 4, 5, 6, 7, 8) for i in range(20)], ", ".join(f"{n} {'string' if n in ('text', 'source') else 'long'}" for n in names))
    assert mixture.emit(d).columns == names and mixture.emit(d, cap=1.5).count() == 30
    assert {r["taken"] for r in mixture.report(d, cap=1.0).collect()} == {3}


def test_samples_never_round_to_nothing():
    for wanted, total in ((20_000, 5 * 10**10), (8_000, 10**15), (1, 3)):
        assert (sampling.threshold(wanted, total) + 2**63) / 2**64 == pytest.approx(wanted / total)


def test_op9_round_trip(docs):
    tok = bpe.loaded(bpe.default_path()).whole
    got = packing.pack(docs).toPandas()
    ids = Counter()
    for i, t in TEXTS:
        x = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for a in range(0, len(x), 2048):
            part = x[a : a + 2048]
            ids[i, a, len(part), zlib.crc32(part.tobytes()), len(x)] += 1
    have = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples())
    assert have == ids
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 2048


def test_op9_pads_little(spark):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(i, " ".join(rng.choice(["one", "two", "three"], int(n)))) for i, n in enumerate(rng.pareto(1.1, 1500) * 60 + 1)], "doc_id long, text string")
    packed = packing.pack(d).cache()
    got = packing.padding(packed).toPandas()
    assert (got["used"] <= 2048).all() and set(got["padding"][got["used"].isin([1 << k for k in range(12)])]) <= {0}
    assert got["padding"].sum() <= 0.02 * packed.agg({"length": "sum"}).first()[0]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_op9_places_every_piece(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    assert all(sum(p) <= 64 for p, _ in patterns)
    placed = Counter()
    for p, n in patterns:
        for size in p:
            placed[size] += n
    assert placed == Counter(histogram)


def test_op10_held_out(spark):
    parts = {"en": "the of and ing tion er th", "de": "der und ung heit sch ein ß", "fr": "le et eau tion é oux"}
    rng = np.random.default_rng(1)
    d = [(i, " ".join(rng.choice(parts[x].split(), 30)), x) for i in range(300) for x in [list(parts)[i % 3]]]
    odd = [(900, None, "en"), (901, "12 !!", "de"), (902, "", None)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(d + odd, "doc_id long, text string, lang string")).collect()}
    held = [i for i, _, _ in d if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i, _, _ in d)
    assert sum(got[i]["lang_pred"] == d[i][2] for i in held) >= 0.98 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))


def test_empty_tables(nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        suffix_merge.remove_repeats(nothing), personal_data.find(nothing), toxicity.score(nothing, labels), minhash_forest.near_duplicates(nothing), exact_dedup.deduplicate(nothing), mixture.report(nothing),
        packing.pack(nothing), language_id.identify(nothing), embedding_pq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    ):
        assert df.count() == 0


def test_empty_ledger_and_pipeline(nothing, spark, tmp_path):
    import corpus_pipeline

    ledger = token_ledger.TokenLedger(spark)
    assert ledger.commit("none", token_ledger.signed(inserts=nothing)) and ledger.totals().count() == 0
    ledger.fold()
    assert ledger.totals().count() == 0 and not ledger.commit("none", token_ledger.signed(inserts=nothing))
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).columns == empty.columns


CLASHES = "rank salt length held_out score predicted size rate target copies row name region comp node keys sig packed grp bucket base off weight label cell digest sha locator body start toxic key".split()


def test_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    table = [(i, f"{BASE} number {i} alone" if i % 2 else " ".join(f"w{i}x{k}" for k in range(50)), "en", "s", *([i] * len(CLASHES))) for i in range(12)]
    d = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} long" for c in CLASHES))
    labels = spark.createDataFrame([(i, 1, int(i == 1)) for i in range(12)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for df in (suffix_merge.remove_repeats(d), personal_data.find(d), toxicity.score(d, labels), minhash_forest.near_duplicates(d), exact_dedup.deduplicate(d), mixture.report(d), packing.pack(d), language_id.identify(d)):
        assert df.count() == 12
    ledger = token_ledger.TokenLedger(spark)
    assert ledger.commit("a", token_ledger.signed(inserts=d)) and ledger.totals().first()["n_docs"] == 12
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns[:4] == ["doc_id", "text", "lang", "source"] and d.columns[4:] == CLASHES
    assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() > 0


@pytest.mark.parametrize("text", [t or "" for _, t in TEXTS] + [" a", "a ", "\n", "a\nb c\td", "é ü’s 東京 x", "don't  stop"])
def test_bpe_ids_are_those_of_tokenizers(text):
    b = bpe.loaded(bpe.default_path())
    assert list(b.ids(text)) == b.whole.encode(text, add_special_tokens=False).ids


def test_pipeline_keeps_and_drops(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"{BASE} copy" if i < 5 else " ".join(f"w{i}x{k}" for k in range(40)), "en", f"s{i % 3}", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    d = docs
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns
    assert sorted(r["doc_id"] for r in d.collect()) == list(range(4, 40))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.agg({"length": "sum"}).first()[0] > 0


def test_pipeline_near_copies_with_repeated_doc_ids(spark):
    import corpus_pipeline

    words = [[f"{x}{i}" for i in range(40)] for x in "abc"]
    texts = [" ".join(w) for w in words]
    near = [" ".join([*w[:-1], "end"]) for w in words]
    # 2 is a near copy of 1 and an own text; both of 3 are near copies of each other; the null id is kept
    table = [(1, texts[0]), (2, near[0]), (2, texts[1]), (3, texts[2]), (3, near[2]), (4, None), (None, near[1])]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(table, "doc_id long, text string"), "")
    first = min(texts[2], near[2], key=lambda t: hashlib.sha256(t.encode()).digest())
    assert rows(kept) == sorted([(1, texts[0]), (2, texts[1]), (3, first), (4, None), (None, near[1])], key=repr)


def test_pipeline_run_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    insults = ["idiot", "disgusting", "pathetic", "worthless"]
    table = []
    for i in range(400):
        if i % 5 == 0:
            text = f"you {insults[i // 5 % 4]} and {insults[i // 25 % 4]} about things {i}"
        else:
            text = {1: BASE, 2: BASE.upper(), 3: BASE.replace("term59", "other")}.get(i, f"plain text number {i} about things")
        table.append((i, text, "en", f"s{i % 3}", 1))
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = [r for r in table if r[0] % 5]
    largest = {r[1].lower(): r for r in clean}  # ascending, so the largest doc_id stays
    left = sorted(largest.values())
    comps = components([shingles(r[1]) for r in left])
    kept = [r for k, r in enumerate(left) if comps.index(comps[k]) == k]
    size, weight = Counter(), {"s0": 5, "s1": 2, "s2": 1}
    for _, text, _, source, _ in kept:
        size[source] += len(shwords(text))
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        free = [s for s in size if s not in capped]
        rest = total - sum(2.0 * size[s] for s in capped)
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free} | {s: 2.0 * size[s] for s in capped}
        if not (over := {s for s in free if target[s] > 2 * size[s] + 1e-9}):
            break
        capped |= over
    tok, want = bpe.loaded(bpe.default_path()).whole, Counter()
    for i, text, _, source, _ in kept:
        rate = target[source] / size[source]
        draw = int(hashlib.sha256(f"{i}:{hashlib.sha256((text or '').encode()).hexdigest()}:0:mix-1".encode()).hexdigest()[:13], 16) / 2**52
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [1], "<u4")
        want[i, 0, len(ids), zlib.crc32(ids.tobytes()), len(ids)] += int(rate) + (draw < rate - int(rate))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert Counter((int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples()) == +want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 2048
