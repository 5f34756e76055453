"""Quality rules with a linear-chain conditional random field over the lines of a text.

Every line that has a word is labelled content or boilerplate by Viterbi decoding; the share
of word characters on content lines decides whether a document stays.

Lines have no labels of their own, so training infers them. Whatever the document, lines that
many documents of the corpus share, repeats inside a document, and lines of links or of columns are
boilerplate. Other lines of good documents are content. Other lines of bad documents are hidden:
they start as boilerplate; then, twice, those that the model so far takes for content become
content, the surest first, as long as most of the document stays boilerplate, and the model is
fitted again. So training texts hold changes of label. The weights maximise the conditional
likelihood of a bounded sample of labelled documents (``per_class`` of each class), all of whose
lines are used: long documents in successive segments of ``SEGMENT`` lines.

A line is shared if at least ``SHARED_LEAST`` documents and one in ``SHARED_ONE_IN`` have it. As
that many documents have each, there are at most ``SHARED_ONE_IN`` times as many shared lines as
a document has lines on average, so their hashes can be sent to all executors.

Defined cases: null text is the empty text; a text without a word has no line, share 0 and is
not kept; a tie between labels goes to content; without labelled documents of both classes every
line is content; very long texts are read whole; repeated rows each get a row, though their lines
count as shared by as many documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_batches
from .textstats import N_CLASSES, base_counts, base_failed, classes, code_points

_BLANK = " \t\n\x0b\x0c\r"
_ENDS = ".!?…:;\"'»”)"
FEATURES = ("bias", "words", "upper", "digits", "symbols", "other", "word_length", "ends", "exclaims", "repeated", "distinct", "pipes", "links", "stutter", "short", "shared")
SHARED_LEAST, SHARED_ONE_IN = 25, 400
SEGMENT = 64
#: A hidden line whose own log odds are above this may become content.
HIDDEN_GAIN = 1.0
NO_LINES = frozenset()


def line_hash(line: str) -> int:
    """As Spark's ``xxhash64``."""
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)


def line_features(text: str, shared: frozenset[int] = NO_LINES) -> tuple[np.ndarray, np.ndarray]:
    """(features, word characters) of every line that has a word, in order."""
    lines = text.split("\n")
    points = code_points(text)
    line_of = np.cumsum(points == 10)
    cell = classes(points) + line_of * N_CLASSES
    per = np.bincount(cell, minlength=len(lines) * N_CLASSES).reshape(-1, N_CLASSES).T.astype(float)
    chars = per[1:].sum(0)
    has = np.flatnonzero(chars > 0)
    out = np.zeros((len(has), len(FEATURES)))
    if not len(has):
        return out, chars[has]
    per, chars = per[:, has], chars[has]
    seen: set[str] = set()
    for row, i in enumerate(has.tolist()):
        line = lines[i]
        words = line.split()
        n = max(1, len(words))
        out[row, 1] = np.log1p(n) / 4
        out[row, 6] = min(chars[row] / n / 10, 3)
        out[row, 7] = line.rstrip(_BLANK)[-1:] in _ENDS
        out[row, 8] = min(1.0, line.count("!") / n)
        out[row, 9] = line in seen
        out[row, 10] = len(set(words)) / n
        out[row, 11] = min(1.0, line.count("|") * 2 / n)
        out[row, 12] = "http" in line or "www." in line or "@" in line
        out[row, 13] = sum(a == b for a, b in zip(words, words[1:])) / n
        out[row, 14] = n <= 3
        out[row, 15] = bool(shared) and line_hash(line) in shared
        seen.add(line)
    out[:, 0] = 1
    out[:, 2] = per[2] / np.maximum(per[1] + per[2], 1)
    out[:, 3] = per[3] / chars
    out[:, 4] = np.minimum(1, per[4] * 4 / chars)
    out[:, 5] = np.minimum(1, per[5] * 2 / chars)
    return out, chars


@dataclass(frozen=True)
class LineCrf:
    """Scores of the label content against boilerplate, and of label pairs (0: boilerplate)."""

    weights: np.ndarray
    pairs: np.ndarray
    shared: frozenset[int] = NO_LINES

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The best label of every line; a tie goes to content."""
        gain = (features @ self.weights).tolist()
        (t00, t01), (t10, t11) = self.pairs.tolist()
        s0, s1, back = 0.0, gain[0], []
        for g in gain[1:]:
            from1 = (s1 + t10 >= s0 + t00, s1 + t11 >= s0 + t01)
            s0, s1 = (s1 + t10 if from1[0] else s0 + t00), g + (s1 + t11 if from1[1] else s0 + t01)
            back.append(from1)
        label = s1 >= s0
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return np.array(out[::-1], bool)

    def labelled(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(content, word characters) of every line that has a word."""
        features, chars = line_features(text or "", self.shared)
        return self.viterbi(features) if len(features) else np.zeros(0, bool), chars

    def content_share(self, text: str | None) -> float:
        content, chars = self.labelled(text)
        return float(chars[content].sum() / chars.sum()) if len(content) else 0.0


def all_content() -> LineCrf:
    w = np.zeros(len(FEATURES))
    w[0] = 1.0
    return LineCrf(w, np.zeros((2, 2)))


def _marginals(gain: np.ndarray, pairs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For padded documents (document by line): P(content) and the pair marginals of lines."""
    e = np.exp(np.clip(gain, -30, 30))
    e = np.stack([1 / (1 + e), e / (1 + e)], 2)
    e[~inside] = 1.0
    t = np.exp(pairs - pairs.max())
    n, longest = gain.shape
    a, b = np.empty((n, longest, 2)), np.ones((n, longest, 2))
    a[:, 0] = e[:, 0]
    for i in range(1, longest):
        v = (a[:, i - 1] @ t) * e[:, i]
        a[:, i] = v / v.sum(1, keepdims=True)
    for i in range(longest - 2, -1, -1):
        v = (e[:, i + 1] * b[:, i + 1]) @ t.T
        v = v / v.sum(1, keepdims=True)
        b[:, i] = np.where(inside[:, i + 1, None], v, 1.0)
    p = a * b
    p /= p.sum(2, keepdims=True)
    two = a[:, :-1, :, None] * t * (e[:, 1:] * b[:, 1:])[:, :, None, :]
    two /= two.sum((2, 3), keepdims=True)
    return p[:, :, 1], two


def _ascend(docs: list[tuple[np.ndarray, np.ndarray]], good: list[int], rounds: int, rate: float, decay: float, good_share: float) -> LineCrf:
    """Gradient ascent (Adagrad) on the conditional likelihood of (features, labels) of documents.

    Every document weighs the same within its class; good ones have ``good_share`` of the
    weight, as losing content costs more.
    """
    counts = [sum(y == k for y in good) for k in (0, 1)]
    cut = [(x[i : i + SEGMENT], t[i : i + SEGMENT], (good_share if y else 1 - good_share) / counts[y] / len(x)) for (x, t), y in zip(docs, good) for i in range(0, len(x), SEGMENT)]
    longest = max(len(x) for x, _, _ in cut)
    feats = np.zeros((len(cut), longest, len(FEATURES)))
    inside, label = np.zeros((len(cut), longest), bool), np.zeros((len(cut), longest), int)
    share = np.array([[w] for _, _, w in cut])
    for i, (x, t, _) in enumerate(cut):
        feats[i, : len(x)], inside[i, : len(x)], label[i, : len(x)] = x, True, t
    linked = inside[:, 1:] * share
    seen = np.array([[linked[(label[:, :-1] == a) & (label[:, 1:] == b)].sum() for b in (0, 1)] for a in (0, 1)])
    w, pairs = np.zeros(len(FEATURES)), np.zeros((2, 2))
    mw, mp = np.full(len(FEATURES), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        p, two = _marginals(feats @ w, pairs, inside)
        gw = np.einsum("nl,nlf->f", (label - p) * inside * share, feats) - decay * w
        gp = seen - np.einsum("nl,nlab->ab", linked, two) - decay * pairs
        mw, mp = mw + gw**2, mp + gp**2
        w, pairs = w + rate * gw / np.sqrt(mw), pairs + rate * gp / np.sqrt(mp)
    return LineCrf(w, pairs)


def surely_boilerplate(features: np.ndarray) -> np.ndarray:
    """Shared lines, repeats, short lines with a link, and lines of columns."""
    of = {name: features[:, i] for i, name in enumerate(FEATURES)}
    short = of["words"] * 4 <= np.log1p(12)
    return (of["shared"] > 0) | (of["repeated"] > 0) | ((of["links"] > 0) & short) | (of["pipes"] > 0.3)


def fit(
    texts: list[str], good: list[int], shared: frozenset[int] = NO_LINES, rounds: int = 200, rate: float = 0.3, decay: float = 1e-4,
    good_share: float = 0.8, hidden_rounds: int = 2,
) -> LineCrf:
    """Fits the weights to whole documents, inferring what is hidden in the bad ones."""
    read = [(*line_features(t, shared), y) for t, y in zip(texts, good) if t]
    read = [r for r in read if len(r[0])]
    classes_ = [y for _, _, y in read]
    if len(set(classes_)) < 2:
        return LineCrf(all_content().weights, np.zeros((2, 2)), shared)
    bad_lines = [surely_boilerplate(x) for x, _, _ in read]
    labels = [np.where(sure, 0, y) for sure, y in zip(bad_lines, classes_)]
    model = _ascend([(x, t) for (x, _, _), t in zip(read, labels)], classes_, rounds, rate, decay, good_share)
    for _ in range(hidden_rounds):
        for k, (x, chars, y) in enumerate(read):
            if y:
                continue
            gain = x @ model.weights
            room = chars.sum() / 2
            labels[k] = np.zeros(len(x), int)
            for i in np.argsort(-gain, kind="stable"):
                if gain[i] < HIDDEN_GAIN or chars[i] > room:
                    break
                if not bad_lines[k][i]:
                    labels[k][i] = 1
                    room -= chars[i]
        model = _ascend([(x, t) for (x, _, _), t in zip(read, labels)], classes_, rounds, rate, decay, good_share)
    return LineCrf(model.weights, model.pairs, shared)


def shared_lines(documents: DataFrame) -> frozenset[int]:
    """Hashes of the lines that many documents share; their number is bounded, see above."""
    least = max(SHARED_LEAST, -(-documents.count() // SHARED_ONE_IN))
    lines = documents.select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("trim(line) != ''")
    counts = lines.groupBy(F.xxhash64("line").alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return frozenset(r.h % (1 << 64) for r in counts.select("h").collect())


def train(documents: DataFrame, labels: DataFrame, per_class: int = 300) -> LineCrf:
    """Fits on at most ``per_class`` labelled documents of each class, chosen by a hash."""
    rows = labelled_sample(documents, labels, "quality", per_class, F.lit(True)).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in rows], [r.y for r in rows], shared_lines(documents))


def apply_rules(docs: DataFrame, crf: LineCrf, least_share: float = 0.5) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, content_share) for every row."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: dict[str, list] = {k: [] for k in (*names, "base_failed", "kept", "content_share")}
        for text in batch.column(1).to_pylist():
            base = base_counts(text)
            failed = base_failed(base["n_words"], base["n_repeat_words"])
            share = crf.content_share(text)
            for k in names:
                cols[k].append(base[k])
            cols["base_failed"].append(failed)
            cols["content_share"].append(share)
            cols["kept"].append(not failed and share >= least_share)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **cols})

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean, content_share double"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, schema)
