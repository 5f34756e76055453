"""Hidden Markov language model.

Tokens are lower-cased words and one end for each text. The ``head`` most frequent words are
symbols of their own; every other word is emitted as one of ``CLASSES`` classes (by its last two
bytes) and then, by its share of the class, as itself. The head grows with the vocabulary, one
word in ``HEAD_ONE_IN``, between ``LEAST_HEAD`` and ``MOST_HEAD`` words: the upper bound is that
of the tables held in memory, of ``MOST_HEAD`` times ``states`` numbers.

Baum-Welch runs over all training texts: expected counts are computed in each partition, summed by
Spark, and normalised on the driver; their number depends on the head alone. A long text is
computed in windows of ``CORE`` tokens, each run in over ``RUN_IN`` tokens on both sides, so that
its messages are those of the whole text but for what such a chain remembers over that distance.
Rounds end when the likelihood of a token grows by less than ``SETTLED``, at ``rounds`` at the
latest. The scaled forward recursion then gives the exact log10 likelihood of every whole text.
Beside it stands the score of additively smoothed word frequencies.

Counts of words outside the head are joined by a shuffle on the word, so nothing that is
broadcast grows with the corpus beyond the bound of the head.

Defined cases: null text is the empty text, which is one end; words of equal counts enter the
head in the order of their bytes; very long texts are read whole; repeated rows each get a row; a
null id counts as remainder 0, so as held out; an empty table gives no rows; without a training
text all counts are 0; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, gathered, map_batches, sliced, stored, word_bytes

CLASSES = 64
CORE, RUN_IN = 512, 64
LEAST_HEAD, MOST_HEAD, HEAD_ONE_IN = 4096, 32_768, 64
SETTLED = 1e-3
#: Window tokens computed at once.
_STEPS = 1 << 17
_ADD = 0.1
_PRIOR = 0.01
_BATCH = 4096
_TALLY = 200_000
LOG10 = np.log(10.0)


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def class_column(word: str = "word") -> Column:
    """The same class for a binary column."""
    return (F.crc32(F.expr(f"substring({word}, -2, 2)")) % CLASSES).cast("int")


def word_counts(docs: DataFrame, training: Column) -> DataFrame:
    """(word binary, c) over the texts where ``training`` holds; no row for the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], ["word", "c"])
            tally.clear()
            return batch

        for part in (x for batch in batches for x in sliced(batch)):
            for text in part.column(0).to_pylist():
                tally.update(word_bytes(text, lower=True))
                if len(tally) > _TALLY:
                    yield out()
        if tally:
            yield out()

    partial = arrow_map(docs.where(training).select("text"), run, "word binary, c long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"))


class Symbols:
    """Symbols of tokens: the head words, then the classes, then the end."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.words, self.counts = words, np.array(counts, np.int64)
        self.index = {w: i for i, w in enumerate(words)}
        self.end = len(words) + CLASSES
        self.size = self.end + 1

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The symbols with the end, and the words outside the head."""
        get, first = self.index.get, len(self.words)
        out, rest = np.empty(len(words) + 1, np.int32), []
        for i, w in enumerate(words):
            k = get(w)
            if k is None:
                rest.append(w)
                k = first + word_class(w)
            out[i] = k
        out[-1] = self.end
        return out, rest


def encode_texts(docs: DataFrame, symbols: Symbols, training: Column) -> DataFrame:
    """(rid, doc_id, training, seq, rest): ``rest`` holds the words outside the head."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, rest, at, rest_at = [], [], [0], [0]
        for text in batch.column(2).to_pylist():
            seq, outside = symbols.encode(word_bytes(text, lower=True))
            flat.append(seq)
            rest += outside
            at.append(at[-1] + len(seq))
            rest_at.append(len(rest))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(flat))),
                pa.ListArray.from_arrays(pa.array(rest_at, pa.int32()), pa.array(rest, pa.binary())),
            ],
            ["doc_id", "training", "seq", "rest"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), training.alias("training"), "text")
    coded = map_batches(rows, run, "doc_id long, training boolean, seq array<int>, rest array<binary>")
    return coded.withColumn("rid", F.monotonically_increasing_id())


class Hmm:
    """Start, transition and emission probabilities (emission: symbol by state)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def log_likelihoods(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Natural logarithms, by the scaled forward recursion; longest first, all in step."""
        out = np.zeros(len(seqs))
        lens = np.array([len(s) for s in seqs])
        order = np.argsort(-lens, kind="stable")
        for lo in range(0, len(order), _BATCH):
            part = order[lo : lo + _BATCH]
            part = part[lens[part] > 0]
            if not len(part):
                continue
            n = lens[part]
            offset = np.concatenate([[0], np.cumsum(n)[:-1]])
            flat = np.concatenate([seqs[i] for i in part])
            a = self.start * self.emit[flat[offset]]
            s = a.sum(1)
            a /= s[:, None]
            total = np.log(s)
            alive = np.searchsorted(-n, -np.arange(1, n[0]), side="left")  # texts longer than t
            for t, k in enumerate(alive.tolist(), 1):
                a = (a[:k] @ self.move) * self.emit[flat[offset[:k] + t]]
                s = a.sum(1)
                a /= s[:, None]
                total[:k] += np.log(s)
            out[part] = total
        return out

    def expected(self, windows: np.ndarray, first: np.ndarray, core: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts (start, move, emit) and log likelihood over the core of windows.

        ``windows``: row by step, padded by ``pad``; ``first`` marks windows that begin a text,
        others start from the uniform state; ``core``: (begin, end) of each row's counted steps.
        """
        n, steps = windows.shape
        k = len(self.start)
        at = np.arange(steps)
        inside = windows != pad
        counted = (at >= core[:, :1]) & (at < core[:, 1:])
        e = np.concatenate([self.emit, np.ones((1, k), self.emit.dtype)])[windows.T]  # step, row, state
        alpha, scale = np.empty((steps, n, k), e.dtype), np.ones((steps, n), e.dtype)
        a = np.where(first[:, None], self.start, np.full(k, 1 / k, e.dtype)).astype(e.dtype) * e[0]
        for t in range(steps):
            if t:
                a = (a @ self.move) * e[t]
            s = a.sum(1)
            a = a / s[:, None]
            alpha[t], scale[t] = a, s
        b = np.ones((n, k), e.dtype)
        move = np.zeros((k, k))
        gamma = np.empty_like(alpha)
        gamma[-1] = alpha[-1]
        for t in range(steps - 1, 0, -1):
            eb = e[t] * b / scale[t][:, None]
            live = inside[:, t, None]
            move += (alpha[t - 1] * counted[:, t, None]).T @ eb
            b = np.where(live, eb @ self.move.T, 1.0).astype(e.dtype)
            gamma[t - 1] = alpha[t - 1] * b
        move *= self.move
        emit = np.empty((pad + 1, k))
        gamma *= counted.T[:, :, None]
        flat = windows.T.ravel()
        for j in range(k):
            emit[:, j] = np.bincount(flat, weights=gamma[:, :, j].ravel(), minlength=pad + 1)
        start = (gamma[0] * first[:, None]).sum(0)
        return start, move, emit[:pad], float(np.log(scale[counted.T]).sum())


def first_guess(counts: np.ndarray, states: int, seed: int) -> Hmm:
    """Symbol frequencies, tilted at random for every state; states tend to stay."""
    rng = np.random.default_rng(seed)
    emit = (counts[:, None] + _PRIOR) * np.exp(rng.normal(0, 1.0, (len(counts), states)))
    move = np.full((states, states), 0.5 / states) + 0.5 * np.eye(states)
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(0))


def _windows(seqs: list[np.ndarray], pad: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, first, core) of all texts, windows of like length together."""
    cut = []
    for s in seqs:
        for at in range(0, len(s), CORE):
            lo, hi = max(0, at - RUN_IN), min(len(s), at + CORE + RUN_IN)
            cut.append((s[lo:hi], at == 0, at - lo, min(at + CORE, len(s)) - lo))
    cut.sort(key=lambda c: len(c[0]))
    while cut:
        take = max(1, _STEPS // len(cut[-1][0]))
        part, cut = cut[-take:], cut[:-take]
        out = np.full((len(part), len(part[-1][0])), pad, np.int32)
        for row, (s, *_) in zip(out, part):
            row[: len(s)] = s
        yield out, np.array([c[1] for c in part]), np.array([c[2:] for c in part])


def baum_welch(coded: DataFrame, symbols: Symbols, counts: np.ndarray, states: int, rounds: int, seed: int = 7) -> Hmm:
    """``counts``: training tokens by symbol. Every round reads all training sequences."""
    before = -np.inf
    model = first_guess(counts.astype(float), states, seed)
    pad = symbols.size
    spark = coded.sparkSession
    seqs = coded.where("training").select("seq")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(pa.py_buffer(np.concatenate([model.start[None], model.move, model.emit]).astype("<f4").tobytes()).to_pybytes())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = np.frombuffer(sent.value, "<f4").reshape(-1, states)
            own = Hmm(x[0], x[1 : states + 1], x[states + 1 :])
            start, move, emit, gain = np.zeros(states), np.zeros((states, states)), np.zeros((pad, states)), np.zeros((1, states))
            some = False
            for part in (x for batch in batches for x in sliced(batch, 4096, 8 << 20)):
                col = part.column(0)
                at, flat = col.offsets.to_numpy(), col.values.to_numpy()
                for rows, first, core in _windows([flat[a:b] for a, b in zip(at[:-1], at[1:])], pad):
                    s, m, e, g = own.expected(rows, first, core, pad)
                    start, move, emit, some = start + s, move + m, emit + e, True
                    gain[0, 0] += g
            if some:
                every = np.concatenate([start[None], move, emit, gain])
                at = np.flatnonzero(every.any(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), *[pa.array(every[at, j]) for j in range(states)]], ["row", *[f"s{j}" for j in range(states)]]
                )

        schema = "row int, " + ", ".join(f"s{j} double" for j in range(states))
        summed = arrow_map(seqs, run, schema).groupBy("row").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(states)])
        got = summed.toArrow()
        sent.destroy()
        total = np.zeros((2 + states + pad, states))
        if got.num_rows:
            total[got["row"].to_numpy()] = np.stack([got[f"s{j}"].to_numpy() for j in range(states)], 1)
        gain, total = total[-1, 0] / max(1, counts.sum()), total[:-1]
        start, move, emit = total[0] + _PRIOR, total[1 : states + 1] + _PRIOR, total[states + 1 :]
        emit = emit + _PRIOR * (counts[:, None] + 1) / (counts.sum() + len(counts)) * emit.sum(0) + 1e-6
        model = Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        if gain - before < SETTLED:
            break
        before = gain
    return model


def _log_score(c: Column, total: Column, distinct: Column) -> Column:
    return F.log10((c + _ADD) / (total + _ADD * (distinct + 1)))


def score_texts(docs: DataFrame, held_out: Column, states: int = 8, rounds: int = 4, head: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark: SparkSession = docs.sparkSession
    counts = stored(word_counts(docs, ~held_out))
    n_ends = docs.where(~held_out).count()
    by_class = counts.groupBy(class_column().alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    if head is None:
        head = min(MOST_HEAD, max(LEAST_HEAD, sum(r.v for r in by_class) // HEAD_ONE_IN))
    # the head is the model's feature set; the words outside are joined from ``counts``
    top = counts.orderBy(F.desc("c"), "word").limit(head).collect()
    symbols = Symbols([bytes(r.word) for r in top], [r.c for r in top])
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in by_class:
        n[r.k], v[r.k] = r.n, r.v
    total, distinct = int(n.sum()) + n_ends, int(v.sum()) + (n_ends > 0)
    for w, c in zip(symbols.words, symbols.counts):  # what is left of each class
        k = word_class(w)
        n[k], v[k] = n[k] - c, v[k] - 1
    coded = stored(encode_texts(docs, symbols, ~held_out))
    model = baum_welch(coded, symbols, np.concatenate([symbols.counts, n, [n_ends]]), states, rounds)

    denominator = total + _ADD * (distinct + 1)
    own = np.concatenate([np.log10((symbols.counts + _ADD) / denominator), np.zeros(CLASSES), [np.log10((n_ends + _ADD) / denominator)]])
    known = np.concatenate([np.ones(len(symbols.words), np.int64), np.zeros(CLASSES, np.int64), [int(n_ends > 0)]])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):  # the longest text of a table decides its steps
            col = t["seq"].combine_chunks()
            at, flat = col.offsets.to_numpy(), col.values.to_numpy()
            texts = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    t["rid"].combine_chunks(), t["doc_id"].combine_chunks(), pa.array(np.diff(at).astype(np.int64)),
                    pa.array(np.array([known[s].sum() for s in texts], np.int64)), pa.array(np.array([own[s].sum() for s in texts])),
                    pa.array(model.log_likelihoods(texts) / LOG10),
                ],
                ["rid", "doc_id", "n_tokens", "n_head", "head_base", "head_score"],
            )

    scored = arrow_map(
        coded.select("rid", "doc_id", "seq"), forward, "rid long, doc_id long, n_tokens long, n_head long, head_base double, head_score double"
    )

    def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        rids, words, times = [], [], []
        for rid, rest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tally = Counter(rest)
            rids += [rid] * len(tally)
            words += tally.keys()
            times += tally.values()
        return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int32())], ["rid", "word", "times"])

    outside = map_batches(coded.select("rid", "rest"), pairs, "rid long, word binary, times int")
    joined = outside.join(counts.hint("merge"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    k = class_column() + 1
    pick = lambda x: F.element_at(F.array(*[F.lit(int(i)) for i in x]), k)
    rest = joined.groupBy("rid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_rest"),
        F.sum(F.col("times") * _log_score(c, F.lit(total), F.lit(distinct))).alias("rest_base"),
        F.sum(F.col("times") * _log_score(c, pick(n), pick(v))).alias("rest_score"),
    )
    zero = F.lit(0.0)
    return (
        scored.join(rest, "rid", "left")
        .select(
            "doc_id", "n_tokens",
            (F.col("n_head") + F.coalesce("n_rest", F.lit(0))).cast("long").alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("head_base") + F.coalesce("rest_base", zero)).alias("base_score"),
            (F.col("head_score") + F.coalesce("rest_score", zero)).alias("score"),
        )
        .withColumn("held_out", held_out)
        .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    )
