"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned from labelled documents: whole words, and beginnings of words for languages that
compound, that toxic documents hold and others do not.  It is kept as a trie.  A word is looked up in
the product of that trie and the Levenshtein automaton, so a misspelled term is found in one walk over
its letters and without listing its variants.  Beginnings stand in the same trie, and so do the forms in
which they were learned, as longer beginnings: after one within its budget of edits any rest is accepted.
Words that clean documents hold are no misspellings of them.  Around each hit a window is scored: quotation marks and words of
reporting speak for quotation, address in the second person and further hits for abuse.  The score is
a logistic model over hits (exact, by beginning, misspelled), their density and these windows.

Lexicon and weights are fitted on at most about ``SAMPLE_DOCS`` labelled documents outside the held-out
quarter.  Their texts stay on the executors, which count terms, note the candidate terms that each toxic
document holds, and work out features; the driver gets the terms of the sample that can matter and numbers.
Nothing but the sample bounds them: every term is weighed, words of any length among them, and terms are taken as
long as they gain, which is to say as ``least`` toxic documents hold them and fewer than ``COVER`` better terms.
A term is learned from three toxic documents or more, so with fewer than some hundred toxic labels
rare terms, and the documents that hold no others, are missed.

Defined results: null and empty texts, and all others without a hit, get the model's score for no hits, but no
more than ``NO_HIT``, which is under the threshold: without evidence a text is not called toxic, however common
toxic labels are; a text of any length is scored whole; with nothing to learn from, or no term learned, every score is 0; several labels of one doc_id count as toxic if any
is; repeated rows score alike; terms that cover as many documents are taken longest beginning first, then
by code point; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.sampling import sampled
from quarry.llm.textkernel import release, releasing
from quarry.scratch import staged

#: Labelled rows that lexicon and weights are fitted on, about; all where there are fewer.
SAMPLE_DOCS = 8_000
THRESHOLD, NO_HIT = 0.3, 0.29
WORD = re.compile(r"[^\W_]+")
BEGINNINGS = (4, 5, 6)
COVER = 4
WINDOW = 60
QUOTES = re.compile("[\"“”„«»‘’]")
REPORTING = re.compile(r"\b(?:said|says|quote[ds]?|called|wrote|reported|sagte|dit|dijo)\b")
ADDRESS = re.compile(r"\b(?:you|your|youre|du|ihr|dich|tu|vous|toi|usted|tú)\b")
FEATURES = 7
CACHE_WORDS = 200_000
FLUSH_TERMS = 200_000


def budget(term: str) -> int:
    """Edits within which a term is met, be it a word or a beginning: none in short ones, two in long ones."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The product of a lexicon trie and the Levenshtein automaton, made deterministic as it is used.

    A state is a set of (trie node, edits so far), with the least edits of each node, and the best beginning
    met so far, which any rest leaves standing.  Transitions are
    kept by (state, letter), all letters outside the lexicon being one, so that a word costs a look-up
    for each letter once its states are known.
    """

    STATES = 50_000

    def __init__(self, terms: Iterable[str], beginnings: Iterable[str] = ()):
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.start: list[str | None] = [None]
        self.limit = [0]  # the largest budget below a node
        for term, ends in [*((t, self.term) for t in terms), *((t, self.start) for t in beginnings)]:
            node, path = 0, [0]
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                    self.start.append(None)
                    self.limit.append(0)
                node = self.next[node][c]
                path.append(node)
            ends[node] = term
            for n in path:
                self.limit[n] = max(self.limit[n], budget(term))
        self.letters = {c for by in self.next for c in by}
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.found: list[tuple[int, str] | None] = []
        self.moves: list[dict[str, int]] = []
        self._number({0: 0}, None)

    def _number(self, reached: dict[int, int], begun: tuple[int, str] | None) -> int:
        work = list(reached.items())
        for node, e in work:  # letters of the term that the word leaves out
            for child in self.next[node].values():
                if e + 1 <= self.limit[child] and reached.get(child, 99) > e + 1:
                    reached[child] = e + 1
                    work.append((child, e + 1))
        met = [(e, t) for n, e in reached.items() if (t := self.start[n]) is not None and e <= budget(t)]
        begun = min(met + [begun] if begun else met, default=None)
        key = tuple(sorted(reached.items())), begun
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            whole = [(e, t) for n, e in reached.items() if (t := self.term[n]) is not None and e <= budget(t)]
            self.found.append(min(whole + [begun] if begun else whole, default=None))
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.limit[node] and reached.get(node, 99) > e:
                reached[node] = e

        nodes, begun = self.states[state]
        for node, e in nodes:
            reach(node, e + 1)
            for letter, child in self.next[node].items():
                reach(child, e + (letter != c))
        self.moves[state][c] = self._number(reached, begun)
        return self.moves[state][c]

    def look(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its budget of edits of the word, and the edits."""
        if len(self.states) > self.STATES:
            self._reset()
        state = 0
        for c in word:
            c = c if c in self.letters else ""
            new = self.moves[state].get(c)
            state = self._move(state, c) if new is None else new
            if not self.states[state][0]:
                break
        got = self.found[state]
        return (got[1], got[0]) if got else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("next", "term", "start", "limit", "letters")}

    def __setstate__(self, kept: dict) -> None:
        self.__dict__.update(kept)
        self._reset()


class Lexicon:
    """``forms`` are words by which beginnings were learned; ``known`` are words that are no misspellings."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], forms: dict[str, float] | None = None, known: frozenset[str] = frozenset()):
        self.words, self.beginnings, self.known = words, beginnings, known
        self.misspelled = {**(forms or {}), **beginnings, **words}
        self.automaton = Automaton(words, {**beginnings, **(forms or {})})
        self.clean: set[str] = set()

    def look(self, word: str) -> tuple[int, float] | None:
        """(kind, weight) of a word: 0 exact, 1 by its beginning, 2 misspelled; None for other words."""
        if word in self.words:
            return 0, self.words[word]
        if len(word) >= BEGINNINGS[0]:
            for n in BEGINNINGS:
                if word[:n] in self.beginnings:
                    return 1, self.beginnings[word[:n]]
            if word not in self.known and (found := self.automaton.look(word)):
                return 2, self.misspelled[found[0]]
        if len(self.clean) > CACHE_WORDS:
            self.clean.clear()
        self.clean.add(word)
        return None

    def features(self, text: str | None) -> list[float]:
        """Exact, beginning and misspelled hits (logarithms of their weights' sums), density, windows."""
        low = (text or "").lower()
        words = WORD.findall(low)
        look = self.look
        hits = {w: got for w in set(words) - self.clean if (got := look(w))}
        if not hits:
            return [0.0] * FEATURES
        sums, distinct = [0.0, 0.0, 0.0], [0, 0, 0]
        for kind, _ in hits.values():
            distinct[kind] += 1
        spots = [m for m in WORD.finditer(low) if m[0] in hits]
        quoted = abusive = 0.0
        last = -1_000
        for m in spots:
            kind, weight = hits[m[0]]
            sums[kind] += weight
            a, b = low[max(0, m.start() - WINDOW) : m.start()], low[m.end() : m.end() + WINDOW]
            quotes = bool(QUOTES.search(a[-20:])) + bool(QUOTES.search(b[:20])) + bool(REPORTING.search(a))
            quoted += weight * (quotes >= 2)
            abusive += weight * (bool(ADDRESS.search(a[-25:])) or m.start() - last < WINDOW)
            last = m.end()
        return [*(math.log1p(s) + 0.5 * min(d, 6) for s, d in zip(sums, distinct, strict=True)), math.log1p(100 * len(spots) / len(words)), math.log1p(quoted), math.log1p(abusive), float(len(hits) >= 2)]


def bag_of(text: str | None) -> set[str]:
    """The words of a text, and the beginnings of longer ones, marked by a star."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean): documents of either kind that hold a term."""
    names = ["term", "toxic", "clean"]
    counts: dict[str, list[int]] = {}

    def taken() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([n[k] for n in counts.values()], pa.int64()) for k in (0, 1))], names=names)
        counts.clear()
        return got

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            for term in bag_of(text.as_py()):
                counts.setdefault(sys.intern(term), [0, 0])[not toxic] += 1
            if len(counts) > FLUSH_TERMS:
                yield taken()
    yield taken()


def _holders(terms: list[str]):
    """The numbers of those of ``terms`` that each text holds."""
    number = {t: k for k, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(number[t] for t in bag_of(text.as_py()) if t in number) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32()))], names=["held"])

    return run


def cover(terms: list[str], toxic: np.ndarray, clean: np.ndarray, held: list[np.ndarray], n_toxic: int, n_clean: int, least: float) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings with their weights: greedily the term that most toxic documents with fewer than
    COVER terms hold, until none gains ``least`` of them.

    held: for each toxic document the numbers of the terms that it holds.
    """
    row = {t: k for k, t in enumerate(terms)}
    which, doc = np.concatenate([[], *held]).astype(np.int64), np.repeat(np.arange(len(held)), [len(h) for h in held])
    doc = doc[np.argsort(which, kind="stable")]
    ends = np.searchsorted(np.sort(which), np.arange(len(terms) + 1))
    where = {t: doc[ends[k] : ends[k + 1]] for t, k in row.items()}
    open_, words, starts = np.full(len(held), COVER), {}, {}
    gain_of = lambda t: int(np.count_nonzero(open_[where[t]] > 0))
    family: dict[str, list[str]] = {}  # words and beginnings by their beginnings
    for t in terms:
        for n in BEGINNINGS:
            if len(t.rstrip("*")) >= n:
                family.setdefault(t[:n], []).append(t)
    # gains only fall, so a term whose gain still stands is the best one
    queue = [(-len(at), not t.endswith("*"), len(t), t) for t, at in where.items()]
    heapq.heapify(queue)
    while queue:
        was, *_, term = heapq.heappop(queue)
        if term not in where:
            continue
        gain = gain_of(term)
        if gain < least:
            continue
        if -was > gain:
            heapq.heappush(queue, (-gain, not term.endswith("*"), len(term), term))
            continue
        if term.endswith("*"):  # one word that accounts for nearly all of it says more than its beginning
            whole = [(g, t) for t in family[term[:-1]] if t in where and not t.endswith("*") and (g := gain_of(t)) >= 0.8 * gain]
            if whole:
                heapq.heappush(queue, (-gain, False, len(term), term))  # what else it covers is seen later
                term = max(whole)[1]
        at, k = where.pop(term), row[term]
        weight = math.log((toxic[k] + 0.5) / n_toxic) - math.log((clean[k] + 0.5) / n_clean)
        (starts if term.endswith("*") else words)[term.rstrip("*")] = max(weight, 0.1)
        open_[at] -= 1
        if term.endswith("*"):  # what the beginning covers is no news any more
            for t in family[term[:-1]]:
                where.pop(t, None)
        else:  # beginnings that hold little else are no news either
            for n in BEGINNINGS:
                b = term[:n] + "*"
                if len(term) > n and b in where and toxic[row[b]] <= 1.25 * toxic[k]:
                    where.pop(b)
    return words, starts


def _alike(lexicon: Lexicon):
    """Of the words of a count table those that the lexicon takes for misspellings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Automaton(lexicon.words)
        for batch in batches:
            yield batch.filter(pa.array([not whole.look(w) and (hit := lexicon.look(w)) is not None and hit[0] == 2 for w in batch.column(0).to_pylist()], pa.bool_()))

    return run


def learn_lexicon(sample: DataFrame) -> Lexicon | None:
    """The lexicon of a staged sample (text, toxic); None where one kind is missing or no term tells them apart."""
    spark = sample.sparkSession
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return None
    least = max(3, 0.004 * n_toxic)
    counts = staged(sample.mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-terms")
    rare = F.col("clean") * n_toxic <= F.col("toxic") * (0.02 * n_clean)
    often = counts.where((F.col("toxic") >= least) & rare).toArrow().sort_by("term")
    terms, toxic, clean = often.column("term").to_pylist(), often.column("toxic").to_numpy(), often.column("clean").to_numpy()
    held = [np.array(r["held"], np.int64) for r in sample.where("toxic = 1").select("text").mapInArrow(_holders(terms), "held array<int>").orderBy("held").collect()]
    words, starts = cover(terms, toxic, clean, held, n_toxic, n_clean, least)
    if not words and not starts:
        return None
    plain = counts.where("term not like '%*'")
    forms: dict[str, float] = {}
    if starts:
        begun = spark.createDataFrame([(t, w) for t, w in starts.items()], "start string, weight double")
        longer = plain.where("toxic > 0").select("term", F.explode(F.array(*(F.substring("term", 1, n) for n in BEGINNINGS))).alias("start")).where("length(term) > length(start)")
        found = longer.join(begun, "start").groupBy("term").agg(F.expr("min_by(weight, length(start))").alias("weight")).collect()
        forms = {r["term"]: r["weight"] for r in sorted(found)}
    # a word that clean documents hold, by the rule for terms, is no misspelling
    known = plain.where(~rare).mapInArrow(_alike(Lexicon(words, starts, forms)), counts.schema).select("term").collect()
    return Lexicon(words, starts, forms, frozenset(r["term"] for r in known))


def learn_weights(x: np.ndarray, y: np.ndarray, times: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Logistic regression over rows that occur ``times`` often, with a small ridge, by Newton steps; the
    last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, ridge = np.zeros(x.shape[1]), np.diag([0.5] * (x.shape[1] - 1) + [0.01])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (times * p * (1 - p))[:, None]) + ridge, x.T @ (times * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _featured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.features(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    return run


def _scores(lexicon: Lexicon | None, weights: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if lexicon is not None:
                x = np.array([[*lexicon.features(t.as_py()), 1.0] for t in batch.column(2)]).reshape(-1, FEATURES + 1)
                score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                score = np.where(x[:, :-1].any(axis=1), score, np.minimum(score, NO_HIT))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[Lexicon | None, np.ndarray | None]:
    known = labels.where("doc_id is not null and toxic is not null and pmod(crc32(cast(doc_id as string)), 4) <> 2").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.expr("cast(toxic <> 0 as int)")).alias("toxic"))
    # about sample_docs rows of two numbers at most
    picked = F.broadcast(sampled(known, "doc_id", "toxicity", sample_docs, known.count()))
    sample = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id").select("text", "toxic"), "toxicity-sample")
    lexicon = learn_lexicon(sample)
    if lexicon is None:
        return None, None
    rows = sample.mapInArrow(_featured(lexicon), "x array<double>, toxic int").groupBy("x", "toxic").agg(F.count("*").alias("n")).toArrow()
    order = np.lexsort((rows.column("toxic").to_numpy(), *np.array(rows.column("x").to_pylist()).T))
    x, y, n = (np.array(rows.column(c).to_pylist(), float)[order] for c in ("x", "toxic", "n"))
    return lexicon, learn_weights(x, y, n)


def score(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    lexicon, weights = fit(docs, labels, sample_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("coalesce(pmod(crc32(cast(doc_id as string)), 4) = 2, false)").alias("held_out"), "text")
    return rows.mapInArrow(releasing(_scores(lexicon, weights)), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    lexicon, weights = fit(docs, labels, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = _scores(lexicon, weights)
        for batch in batches:
            n = batch.num_rows
            slim = pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), batch.column("text")], names=["doc_id", "held_out", "text"])
            (got,) = rate(iter([slim]))
            yield batch.filter(pa.compute.equal(got.column("predicted"), 0))
        release()

    return docs.mapInArrow(run, docs.schema)
