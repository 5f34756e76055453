"""Toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learnt from a bounded sample of labelled documents (``per_class`` of each
class): terms, and stems that many different words begin with, whose document odds are far
higher among toxic documents. The trie of the lexicon is intersected with the automaton of one
edit for long terms; the product is determinised as words are read. Words that clean training
documents use are no misspellings. A hit inside quotation marks or after a word of reporting
within a context window counts by ``QUOTED`` only. A logistic model turns the counts into a score.

Defined cases: null text is the empty text and scores as a text without hits; without toxic
documents in the sample every score is 0; repeated rows each get a row; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_batches, stored

EXACT, STEM, FUZZY = 1, 2, 3
#: What a hit in a quotation counts.
QUOTED = 0.2
WINDOW = 5
REPORTING = frozenset("said says wrote writes quoted quote called calls word term".split())
_MARKS = "\"“”„«»‘’"
_TRIM = _MARKS + "'.,;:!?()[]{}<>*_-…|#$%&/\\"
_LEAST_FUZZY = 5
_STEM_LENGTHS = (4, 5, 6, 7, 8)
_CACHE = 100_000


def normal(token: str) -> str:
    return token.strip(_TRIM).lower()


@dataclass
class Matcher:
    """``match`` gives EXACT, STEM, FUZZY or 0 for a normalised word."""

    terms: list[str]
    stems: list[str]
    plain: frozenset[str] = frozenset()  # words that are never misspellings
    edits: int = 1

    def __post_init__(self) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.length = [0]
        self.term, self.stem = [False], [False]
        for words, flags in ((self.terms, self.term), (self.stems, self.stem)):
            for w in words:
                at = 0
                for c in w:
                    if c not in self.child[at]:
                        self.child[at][c] = len(self.child)
                        self.child.append({})
                        self.length.append(self.length[at] + 1)
                        self.term.append(False)
                        self.stem.append(False)
                    at = self.child[at][c]
                flags[at] = True
        self.states: list[frozenset[tuple[int, int]]] = []
        self.number: dict[frozenset[tuple[int, int]], int] = {}
        self.moves: dict[tuple[int, str], int] = {}
        self.kind: list[int] = []  # what a word that ends here is; STEM wherever one has been read
        self.start = self._named({(0, self.edits)})
        self.cache: dict[str, int] = {}

    def _named(self, pairs: set[tuple[int, int]]) -> int:
        todo = list(pairs)
        while todo:  # a character of the term that the word lacks
            node, left = todo.pop()
            if left:
                for x in self.child[node].values():
                    if (x, left - 1) not in pairs:
                        pairs.add((x, left - 1))
                        todo.append((x, left - 1))
        key = frozenset(pairs)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            whole = {n for n, left in key if left == self.edits}
            if any(self.stem[n] for n in whole):
                kind = STEM
            elif any(self.term[n] for n in whole):
                kind = EXACT
            else:
                kind = FUZZY * any(self.term[n] and self.length[n] >= _LEAST_FUZZY for n, _ in key)
            self.kind.append(kind)
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        pairs = set()
        for node, left in self.states[state]:
            x = self.child[node].get(c)
            if x is not None:
                pairs.add((x, left))
            if left:
                pairs.add((node, left - 1))
                pairs.update((y, left - 1) for y in self.child[node].values())
        self.moves[state, c] = to = self._named(pairs) if pairs else -1
        return to

    def match(self, word: str) -> int:
        state, moves, kind = self.start, self.moves, self.kind
        for c in word:
            to = moves.get((state, c))
            state = self._move(state, c) if to is None else to
            if state < 0:
                return 0
            if kind[state] == STEM:
                return STEM
        found = kind[state]
        return 0 if found == FUZZY and word in self.plain else found

    def of_token(self, token: str) -> int:
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) > _CACHE:
                self.cache.clear()
            found = self.cache[token] = self.match(normal(token))
        return found

    def __getstate__(self):
        return self.terms, self.stems, self.plain, self.edits

    def __setstate__(self, state):
        self.terms, self.stems, self.plain, self.edits = state
        self.__post_init__()


def _quoted(tokens: list[str], at: int) -> bool:
    own = tokens[at]
    if own[0] in _MARKS and own.rstrip(".,;:!?")[-1:] in _MARKS:
        return True
    before, after = tokens[max(0, at - WINDOW) : at], tokens[at + 1 : at + 1 + WINDOW]
    opened = own[0] in _MARKS or any(t[0] in _MARKS for t in before)
    closed = own.rstrip(".,;:!?")[-1:] in _MARKS or any(t.rstrip(".,;:!?")[-1:] in _MARKS for t in after)
    return (opened and closed) or any(normal(t) in REPORTING for t in before[-2:])


def counts(text: str | None, matcher: Matcher) -> list[float]:
    """log(1 + hits) by kind, different terms hit, and hits by hundred words."""
    tokens = (text or "").split()
    of = matcher.of_token
    hits = [(i, k) for i, k in enumerate(map(of, tokens)) if k]
    if not hits:
        return [0.0] * 5
    sums, words = [0.0] * 4, set()
    for i, k in hits:
        weight = QUOTED if _quoted(tokens, i) else 1.0
        sums[k] += weight
        if weight == 1.0:
            words.add(normal(tokens[i]))
    return [*np.log1p(sums[1:]).tolist(), float(np.log1p(len(words))), min(5.0, 100 * sum(sums) / len(tokens))]


@dataclass(frozen=True)
class ToxicityModel:
    matcher: Matcher
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(rows))
        x = np.array(rows).reshape(-1, len(self.weights) - 1)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def fit_logistic(rows: list[list[float]], y: np.ndarray, rounds: int = 300, decay: float = 1e-3) -> np.ndarray:
    """Newton steps on the penalised likelihood; slopes stay at or above zero."""
    x = np.c_[np.ones(len(rows)), np.array(rows)]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = decay * np.r_[0, w[1:]]
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x / len(y) + decay * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) / len(y) - pull)
        w = w + np.clip(step, -1, 1)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _table(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): documents of each class with the word."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tally = (Counter(), Counter())
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tally[y].update({w for w in map(normal, set(text.split())) if w})
        words = [*(tally[0] | tally[1])]
        return pa.RecordBatch.from_pydict(
            {"word": pa.array(words, pa.string()), "toxic": pa.array([tally[1][w] for w in words], pa.int64()), "clean": pa.array([tally[0][w] for w in words], pa.int64())}
        )

    partial = map_batches(sample.select("text", "y"), run, "word string, toxic long, clean long")
    return partial.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(table: DataFrame, n_toxic: int, n_clean: int, least_odds: float = 20.0) -> tuple[list[str], list[str]]:
    """(terms, stems) whose document odds ratio is ``least_odds`` or more."""
    least = max(3, round(0.003 * n_toxic))
    odds = ((F.col("toxic") + 0.5) / (n_toxic + 1.0)) / ((F.col("clean") + 0.5) / (n_clean + 1.0))
    prefixes = F.explode(F.array(*[F.substring("word", 1, n) for n in _STEM_LENGTHS]))
    grown = (
        table.select("word", "toxic", "clean", F.length("word").alias("n"), prefixes.alias("stem"))
        .where(F.length("stem") < F.col("n"))
        .groupBy("stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > 0).alias("words"))
        .where((F.col("words") >= 8) & (F.col("toxic") >= 3 * least) & (odds >= 5 * least_odds))
    )
    found = {r.stem: r.toxic for r in grown.collect()}
    stems = []
    for s in sorted(found, key=lambda s: (len(s), s)):
        if any(s.startswith(x) for x in stems) or s[:-1] in found:
            continue
        while True:  # the longest stem that keeps nearly all
            longer = [x for x in found if len(x) == len(s) + 1 and x.startswith(s) and found[x] >= 0.95 * found[s]]
            if not longer:
                break
            s = longer[0]
        stems.append(s)
    words = table.where((F.col("toxic") >= least) & (odds >= least_odds) & (F.length("word") >= 3)).select("word").collect()
    terms = sorted(r.word for r in words if not any(r.word.startswith(s) for s in stems))
    return terms, stems


def train(documents: DataFrame, labels: DataFrame, may_learn: Column, per_class: int = 4000) -> ToxicityModel:
    """``may_learn`` (of doc_id) selects the label rows that may be learnt from."""
    sample = stored(labelled_sample(documents, labels, "toxic", per_class, may_learn).dropDuplicates(["text"]))
    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1):
        return ToxicityModel(Matcher([], []))
    table = stored(_table(sample))
    terms, stems = learn_lexicon(table, n[1], n.get(0, 0))
    rough = Matcher(terms, stems)

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([rough.match(w) == FUZZY for w in batch.column(0).to_pylist()], pa.bool_()))

    plain = map_batches(table.where("clean > 0").select("word"), near, "word string").collect()
    matcher = Matcher(terms, stems, frozenset(r.word for r in plain))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [counts(t, matcher) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = sorted((r.x, r.y) for r in map_batches(sample.select("text", "y"), measure, "x array<double>, y int").collect())
    return ToxicityModel(matcher, fit_logistic([x for x, _ in rows], np.array([y for _, y in rows], float)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = model.scores([counts(t, model.matcher) for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores), pa.array((scores >= least).astype(np.int32))], ["doc_id", "score", "predicted"]
        )

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``least``; columns are those of ``docs``."""
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = model.scores([counts(t, model.matcher) for t in batch.column(at).to_pylist()])
        return batch.filter(pa.array(scores < least))

    return map_batches(docs, run, docs.schema)
