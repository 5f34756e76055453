"""Nearest neighbours by shifted space-filling curves, completed by an exact check.

Vectors are projected by a random rotation, shifted, quantised and ordered along a Hilbert
curve, once for each of ``orders`` orderings. Spark range-partitions every ordering; the curve
is cut into blocks of ``window`` rows, and a query is ranked against its own and the two
neighbouring blocks. The best of all orderings give each query a radius. On data without
low-dimensional structure the windows alone miss neighbours, so an exact check follows: the
query set, in blocks of ``query_block`` rows, is compared with all rows, and what lies within
the query's radius is merged with what the windows found.

Defined cases: vectors that are null, zero, or hold null or non-finite components, or whose
length is not the most frequent one (the smaller of two), and rows with a null id take no part;
rows that share an id are one candidate, at its nearest, and never a neighbour of that id; of
queries that share an id the smallest vector asks; fewer candidates than k give fewer rows; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, stored, whole_groups

FOUND = "query_id long, vec_id long, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of integer cells (row by dimension, ``bits`` each)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the rotations of the sub-cubes
        low = (1 << level) - 1
        for i in range(dims):
            high = (x[i] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual.n if usual else 1))


def _nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, radius: np.ndarray | None = None):
    """For each query the k nearest rows with another id, ties to the smaller id, within a radius."""
    out_q, out_v, out_s = [], [], []
    if not len(ids) or not len(query_ids):
        return out_q, out_v, out_s
    norm = (x * x).sum(1)
    square = np.maximum(norm[None] + (q * q).sum(1)[:, None] - 2 * q @ x.T, 0)
    slack = 1e-9 * (norm.max() + (q * q).sum(1))
    for i, qid in enumerate(query_ids.tolist()):
        row = square[i]
        if radius is not None:
            near = np.flatnonzero(row <= radius[i] ** 2 + slack[i])
        elif len(row) > 2 * k:
            near = np.flatnonzero(row <= np.partition(row, 2 * k)[2 * k] + slack[i])
        else:
            near = np.arange(len(row))
        near = near[ids[near] != qid]
        if not len(near):
            continue
        d = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
        order = np.lexsort((d, ids[near]))
        once = np.ones(len(order), bool)
        once[1:] = ids[near][order][1:] != ids[near][order][:-1]
        near, d = near[order[once]], d[order[once]]
        best = np.lexsort((ids[near], d))[:k]
        out_q += [qid] * len(best)
        out_v += ids[near[best]].tolist()
        out_s += d[best].tolist()
    return out_q, out_v, out_s


def _found(parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.float64())], ["query_id", "vec_id", "score"])


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best pairs of each query; a pair found several times counts once."""
    one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _keyed(rows: DataFrame, orders: int, dims: int, bits: int, seed: int) -> DataFrame:
    """Every row once for each ordering, with its key; scaled by the spread of all rows."""
    n = rows.select(F.size("v").alias("n")).first()
    n = n.n if n else 1
    moments = rows.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()
    mean = np.array([r.m for r in moments]) if moments else np.zeros(n)
    spread = np.sqrt(np.mean([r.s**2 for r in moments])) if moments else 1.0
    dims = min(dims, n)
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.normal(size=(n, n)))[0][:, :dims] for _ in range(orders)]
    shifts = rng.random((orders, dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = (_matrix(batch.column(1)) - mean) / max(spread, 1e-12)
            for o in range(orders):
                unit = (x @ turns[o] + 4 + shifts[o]) / 9  # four deviations either way, and the shift
                cells = np.clip(unit * (1 << bits), 0, (1 << bits) - 1)
                key = hilbert_keys(cells, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), o, np.int32)), pa.array(key), batch.column(0), batch.column(1)], ["o", "key", "vec_id", "v"]
                )

    return arrow_map(rows, run, "o int, key long, vec_id long, v array<double>")


def window_search(rows: DataFrame, is_query: Column, k: int, orders: int = 4, window: int = 64, dims: int = 6, bits: int = 10, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the best of the windows of all orderings."""
    keyed = _keyed(rows, orders, dims, bits, seed)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, "o", "key", "vec_id").sortWithinPartitions("o", "key", "vec_id")
    # an id's lower bits count the rows of its partition, its upper bits the partition
    placed = stored(dealt.withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")
    placed = placed.select("vec_id", "v", part, place)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row a partition
    held = np.zeros(sizes[-1].part + 1 if sizes else 1, np.int64)
    for r in sizes:
        held[r.part] = r.n
    offset = F.array(*[F.lit(int(x)) for x in np.cumsum(held) - held])
    rank = F.element_at(offset, (F.col("part") + 1).cast("int")) + F.col("place")
    blocked = placed.select("vec_id", "v", F.floor(rank / window).cast("long").alias("block"))
    asks = blocked.where(is_query).select("vec_id", "v", F.explode(F.array(*[F.col("block") + i for i in (-1, 0, 1)])).alias("block"))
    both = blocked.select("block", F.lit(0).alias("ask"), "vec_id", "v").unionByName(asks.select("block", F.lit(1).alias("ask"), "vec_id", "v"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "block"):
            block, ask = t["block"].to_numpy(), t["ask"].to_numpy()
            ids, x = t["vec_id"].to_numpy(), _matrix(t["v"].combine_chunks())
            cut = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            got = ([], [], [])
            for a, b in zip(cut[:-1], cut[1:]):
                m = a + int(np.searchsorted(ask[a:b], 1))
                if a < m < b:
                    for all_, new in zip(got, _nearest(ids[a:m], x[a:m], ids[m:b], x[m:b], k)):
                        all_ += new
            if got[0]:
                yield _found(got)

    found = arrow_map(both.repartition("block").sortWithinPartitions("block", "ask"), rerank, FOUND)
    return best(found, k)


def exact_check(rows: DataFrame, queries: DataFrame, found: DataFrame, k: int, query_block: int = 8192) -> DataFrame:
    """``found`` with every row that lies within the radius the windows gave its query.

    A query with fewer than k finds has no radius. A pass over all rows serves one block of
    queries, which is of a fixed size, so what is sent to the executors does not grow.
    """
    radius = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("radius"))
    asks = stored(queries.join(radius, queries.vec_id == radius.query_id, "left").select("vec_id", "v", F.coalesce("radius", F.lit(float("inf"))).alias("radius")))
    blocks = max(1, -(-asks.count() // query_block))
    out = found.select("query_id", "vec_id", "score")
    for b in range(blocks):
        mine = asks.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow().combine_chunks()
        if not mine.num_rows:
            continue
        ids, q, r = mine["vec_id"].to_numpy(), _matrix(mine["v"].combine_chunks()), mine["radius"].to_numpy()

        def check(batches: Iterator[pa.RecordBatch], ids=ids, q=q, r=r) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, own = _matrix(batch.column(1)), batch.column(0).to_numpy()
                for lo in range(0, len(own), 2048):
                    for at in range(0, len(ids), 1024):
                        s = slice(at, at + 1024)
                        got = _nearest(own[lo : lo + 2048], x[lo : lo + 2048], ids[s], q[s], k, r[s])
                        if got[0]:
                            yield _found(got)

        checked = arrow_map(rows.select("vec_id", "v"), check, FOUND)
        out = out.unionByName(stored(checked) if blocks > 1 else checked)
    return best(out, k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, **windows) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query; ``is_query`` reads ``vec_id``."""
    rows = stored(usable(vectors))
    found = stored(window_search(rows, is_query, k, **windows))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    return exact_check(rows, queries, found, k)
