"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good, at most ``sample`` of them; unlabelled are all
documents that may be learnt from, whatever their label. No label of a bad document is read.
Features of all texts are measured once and stored; from then on all passes read these.

With the logistic loss the unbiased risk is convex: the mean of log(1 + e^z) over the
unlabelled less the class prior times the mean of z over the positives. It is minimised by Newton
steps whose sums over the unlabelled Spark adds up; a step is halved while it would make the part
of the risk that stands for the negatives negative, so the minimum is that of the non-negative
risk. The prior is estimated from the same two sets: a first model, fitted with a prior of one
half on half of the positives, gives scores; at any threshold the share of the unlabelled above it
is at least the prior times that of the positives, and the threshold at which this bound is tightest,
with an allowance for the size of the samples, gives the prior.

Defined cases: null text is the empty text, which has a score like any other; without positives
every score is the prior of one half; ties play no part; very long texts are measured whole;
repeated rows each get a row and count as often; of positives that share an id the one with the
smallest features is taken; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chosen_labels, map_batches
from .textstats import N_CLASSES, base_counts, classes, code_points

_KNOTS = 6
N_FEATURES = 17
#: Allowance of the prior's bound, in deviations of a share among the held-back positives.
_ALLOW = 1.0
_BINS = 1000


def features(text: str | None) -> np.ndarray:
    text = text or ""
    base = base_counts(text)
    n = max(1, base["n_words"])
    chars = max(1, base["word_chars"])
    kinds = np.bincount(classes(code_points(text)), minlength=N_CLASSES) if text else np.zeros(N_CLASSES)
    words = text.split()
    lines = max(1, text.count("\n") + 1)
    stops = text.count(". ") + text.count(".\n") + text.endswith(".")
    return np.array(
        [
            np.log1p(base["n_words"]),
            base["word_chars"] / n,
            base["n_symbols"] / chars,
            base["n_dup_lines"] / lines,
            base["n_repeat_words"] / n,
            kinds[2] / max(1, kinds[1] + kinds[2]),
            kinds[3] / chars,
            kinds[5] / chars,
            len(set(words)) / n,
            text.count("!") / n,
            text.count("|") / n,
            stops / n,
            np.log1p(n / lines),
            max((len(w) for w in words), default=0) ** 0.5,
            sum(w[:1].isupper() for w in words) / n,
            (text.count("http") + text.count("@")) / n,
            text.count(",") / n,
        ]
    )


@dataclass(frozen=True)
class PuModel:
    knots: np.ndarray  # feature by knot
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        """A constant, and each feature's hinges at its knots: a piecewise linear function."""
        hinge = np.maximum(0, x[:, :, None] - self.knots[None]) / self.scale[None, :, None]
        return np.concatenate([np.ones((len(x), 1)), np.minimum(hinge, 8).reshape(len(x), -1)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights, -30, 30)))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t) for t in batch.column(1).to_pylist()]
        flat = pa.array(np.concatenate(x))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), flat)], ["doc_id", "x"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, x array<double>")


def _rows(col: pa.ListArray) -> np.ndarray:
    return col.flatten().to_numpy().reshape(-1, N_FEATURES)


class Unlabelled:
    """Sums over all unlabelled rows, made by Spark."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("x")

    def knots(self) -> tuple[np.ndarray, np.ndarray, int]:
        """(quantiles: feature by knot, the last the 99th percentile; minima; rows)."""
        at = [*np.linspace(0, 1, _KNOTS + 1)[:-1].tolist(), 0.99]
        x = [F.col("x")[i] for i in range(N_FEATURES)]
        got = self.rows.agg(F.count(F.lit(1)), *[F.percentile_approx(c, F.array(*[F.lit(a) for a in at]), F.lit(10_000)) for c in x], *[F.min(c) for c in x]).first()
        if not got[0]:
            return np.zeros((N_FEATURES, len(at))), np.zeros(N_FEATURES), 0
        return np.array(got[1 : 1 + N_FEATURES], float), np.array(got[1 + N_FEATURES :], float), got[0]

    def sums(self, model: PuModel) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient, Hessian and loss of log(1 + e^z), summed."""
        k = len(model.weights)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = model.expand(_rows(batch.column(0)))
            z = np.clip(x @ model.weights, -30, 30)
            s = 1 / (1 + np.exp(-z))
            out = np.concatenate([(s @ x)[None], (x * (s * (1 - s))[:, None]).T @ x, np.full((1, k), np.logaddexp(0, z).sum())])
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), *[pa.array(out[:, j]) for j in range(k)]], ["row", *[f"s{j}" for j in range(k)]])

        schema = "row int, " + ", ".join(f"s{j} double" for j in range(k))
        got = map_batches(self.rows, run, schema, rows=8192).groupBy("row").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).orderBy("row").toArrow()
        total = np.stack([got[f"s{j}"].to_numpy() for j in range(k)], 1)
        return total[0], total[1:-1], float(total[-1, 0])

    def above(self, model: PuModel) -> np.ndarray:
        """How many rows score at or above each of ``_BINS`` thresholds."""

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = np.bincount((model.score(_rows(batch.column(0))) * _BINS).astype(int).clip(0, _BINS - 1), minlength=_BINS)
            return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0], pa.int64())], ["bin", "n"])

        out = np.zeros(_BINS)
        for r in map_batches(self.rows, run, "bin int, n long", rows=8192).groupBy("bin").agg(F.sum("n").alias("n")).collect():
            out[r.bin] = r.n
        return out[::-1].cumsum()[::-1]


def fit(positive: np.ndarray, unlabelled: Unlabelled, prior: float, rounds: int = 15, decay: float = 1e-4) -> PuModel:
    """Newton steps on the non-negative unbiased risk."""
    prior = min(max(prior, 0.01), 0.99)
    quantiles, least, n = unlabelled.knots()
    if not len(positive) or not n:
        return PuModel(np.zeros((0, 0)), np.zeros(0), np.zeros(0), prior)
    knots = quantiles[:, :-1].copy()
    knots[:, 0] = np.minimum(least, positive.min(0)) - 1e-9
    scale = np.maximum(quantiles[:, -1] - knots[:, 0], 1e-3) / 2
    model = PuModel(knots, scale, np.zeros(1 + knots.size), prior)
    p = model.expand(positive)
    w = np.zeros(p.shape[1])
    w[0] = np.log(prior / (1 - prior))
    own = np.r_[0, np.full(len(w) - 1, decay)]

    def at(w: np.ndarray):
        g, h, loss = unlabelled.sums(PuModel(knots, scale, w, prior))
        z = p @ w
        negative = loss / n - prior * np.logaddexp(0, z).mean()
        risk = loss / n - prior * z.mean() + (own * w * w).sum() / 2
        return g / n - prior * p.mean(0) + own * w, h / n + np.diag(own + 1e-9), negative, risk

    g, h, negative, risk = at(w)
    for _ in range(rounds):
        step = np.linalg.solve(h, g)
        for _ in range(6):
            g2, h2, negative, risk2 = at(w - step)
            if negative >= 0 and risk2 <= risk:
                break
            step = step / 2
        else:
            break
        w, g, h, settled, risk = w - step, g2, h2, risk - risk2 < 1e-5, risk2
        if settled:
            break
    return PuModel(knots, scale, w, prior)


def estimate_prior(positive: np.ndarray, unlabelled: Unlabelled) -> float:
    """The tightest bound of the unlabelled share above a threshold over that of the positives."""
    _, _, n = unlabelled.knots()
    if len(positive) < 4 or not n:
        return 0.5
    model = fit(positive[::2], unlabelled, 0.5)
    held = np.sort(model.score(positive[1::2]))
    of_p = 1 - np.searchsorted(held, np.arange(_BINS) / _BINS, side="left") / len(held)
    of_u = unlabelled.above(model) / n
    slack = _ALLOW * np.sqrt(np.maximum(of_p * (1 - of_p), 1 / len(held)) / len(held))
    use = of_p > 0.1
    return float(np.min((of_u[use] + slack[use]) / of_p[use])) if use.any() else 0.5


def train(rows: DataFrame, labels: DataFrame, may_learn: Column, sample: int = 3000) -> PuModel:
    """``rows`` of ``measure``, stored; ``may_learn`` (of doc_id) selects those to learn from."""
    trusted = chosen_labels(labels.where("quality = 1"), "quality", sample, may_learn)
    got = rows.join(F.broadcast(trusted), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").collect()
    positive = np.array([r.x for r in got]) if got else np.zeros((0, N_FEATURES))
    web = Unlabelled(rows.where(may_learn))
    return fit(positive, web, estimate_prior(positive, web))


def score_rows(rows: DataFrame, model: PuModel, least: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of measured rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = model.score(_rows(batch.column(1)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores), pa.array((scores >= least).astype(np.int32))], ["doc_id", "score", "predicted"]
        )

    return map_batches(rows, run, "doc_id long, score double, predicted int", rows=8192)


def score_quality(docs: DataFrame, model: PuModel, least: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row of texts."""
    return score_rows(measure(docs), model, least)
