"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A fingerprint has 64 bits. Every bit position gets a non-zero vector of radius + 1 bits; for
each non-zero vector v the mask of v keeps the positions whose vector has an odd inner
product with v. Any ``radius`` differing positions impose at most ``radius`` linear conditions
on v, so some mask avoids all of them: every pair within the radius agrees under some mask.

Equal fingerprints are one node. Nodes that agree under a mask form a bucket; inside a bucket
linked nodes are joined by a union-find whose output has fewer edges than nodes. A bucket of
more than ``bucket_rows`` nodes is dealt again under a second and a third, independent family
of masks, which keeps all links and bounds what one task holds: after three families fewer
than a dozen free bits are left.

Defined cases: null or empty text has fingerprint zero and is linked like any other; a text of
fewer than ``shingle`` words is one shingle of all its words; a null id counts as no id for
the component's label unless the whole component has none; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, map_batches, stored, whole_groups, word_bytes

SEED = 42
BITS = 64
#: Up to so many edges are joined in one task, which holds 16 bytes for each; more by rounds of joins.
TASK_EDGES = 1 << 19
_STEP = 1 << 15


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """Hashes of the text's word shingles in order, ASCII letters in lower case."""
    words = word_bytes(text, lower=True)
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    stop = (start + lens)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(start.tolist(), stop)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return fingerprint_of(np.array(shingle_hashes(text, shingle), dtype="<u8"))


def fingerprint_of(packed: np.ndarray) -> int:
    """Of the hashes of a text's shingles, repeats included."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(packed), _STEP):
        part = packed[at : at + _STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(packed)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long; one row per input row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter(
            (fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows
        )
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col(text)), run, "doc_id long, fp long")


def covering_masks(radius: int, family: int) -> list[int]:
    """2**(radius + 1) - 1 masks as signed longs; another family deals positions otherwise."""
    vectors = np.arange(BITS) % (2 ** (radius + 1) - 1) + 1
    vectors = np.random.default_rng(977 + family).permutation(vectors)
    out = []
    for v in range(1, 2 ** (radius + 1)):
        odd = np.array([bin(int(x) & v).count("1") % 2 == 1 for x in vectors])
        out.append(int(np.packbits(odd, bitorder="little").view("<i8")[0]))
    return out


def _keys(nodes: DataFrame, radius: int, family: int, prior: list[Column]) -> DataFrame:
    """One row for each node and mask of the family; the key extends the prior one."""
    masks = covering_masks(radius, family)
    table = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(x)).alias("k")) for i, x in enumerate(masks)])
    exploded = nodes.select("fp", *prior, F.explode(table).alias("e"))
    key = F.xxhash64(*[F.col(c) for c in ["key"] if c in nodes.columns], "e.m", "e.k")
    return exploded.select("fp", key.alias("key"))


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of one bucket's links, breadth first; never more edges than nodes."""
    n = len(fp)
    root = np.arange(n)
    todo = np.arange(n)
    while len(todo):
        seed, todo = todo[0], todo[1:]
        front = [seed]
        while front and len(todo):
            near = np.bitwise_count(fp[todo] ^ fp[front.pop()]) <= radius
            if near.any():
                got = todo[near]
                root[got] = seed
                front.extend(got.tolist())
                todo = todo[~near]
    child = np.flatnonzero(root != np.arange(n))
    return fp[root[child]], fp[child]


def _bucket_edges(radius: int):
    """Arrow map over partitions that hold whole buckets, sorted by key and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            key = t["key"].to_numpy()
            fp = t["fp"].to_numpy().view(np.uint64)
            at = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            size = np.diff(np.append(at, len(key)))
            two = at[size == 2]  # most buckets: all compared at once
            hit = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            src, dst = [fp[hit]], [fp[hit + 1]]
            for a, n in zip(at[size > 2].tolist(), size[size > 2].tolist()):
                s, d = _forest(fp[a : a + n], radius)
                src.append(s)
                dst.append(d)
            s, d = np.concatenate(src).view(np.int64), np.concatenate(dst).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(d)], ["src", "dst"])

    return run


def links(nodes: DataFrame, radius: int = 3, bucket_rows: int = 2048) -> DataFrame:
    """(src, dst) edges whose connected components are those of all pairs within the radius."""
    edges = None
    for family in range(3):
        keyed = _keys(nodes, radius, family, [F.col("key")] if family else [])
        if family < 2:
            keyed = stored(keyed)
            sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
            small = sizes.where(F.col("n").between(2, bucket_rows)).select("key")
            large = sizes.where(F.col("n") > bucket_rows).select("key")
        else:
            small, large = None, None
        part = keyed if small is None else keyed.join(small, "key")
        # an explicit exchange: unlike a skewed join's output it never splits a key
        dealt = part.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
        found = arrow_map(dealt, _bucket_edges(radius), "src long, dst long")
        edges = found if edges is None else edges.unionByName(found)
        if large is None:
            break
        nodes = keyed.join(large, "key")
        if nodes.isEmpty():
            break
    return edges.distinct()


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of all nodes of the edges but the roots themselves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    child = np.flatnonzero(root != np.arange(len(root)))
    return nodes[child], nodes[root[child]]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        node, root = smallest_reachable(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable; roots and nodes without an edge are left out.

    Few edges are joined in one task. More take alternating large-star and small-star steps, each written
    to the shared folder: every step is several jobs, whose plans and figures the driver keeps.
    """
    e = stored(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u != v").distinct())
    if e.count() <= TASK_EDGES:
        return stored(arrow_map(e.coalesce(1), _joined, "node long, root long"))
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.where("u != v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        e2 = star.join(low, "u")
        e2 = e2.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = stored(e2.where("u != v").distinct())
        seen = e.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")),
        ).first()
        if tuple(seen) == before:
            break
        before = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def dedup_groups(
    docs: DataFrame, shingle: int = 3, radius: int = 3, bucket_rows: int = 2048
) -> DataFrame:
    """(doc_id, fp, component_id) for every input row; component_id is the smallest id reachable."""
    rows = stored(with_fingerprint(docs, shingle))
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(links(nodes.select("fp"), radius, bucket_rows))
    labelled = nodes.join(found, nodes.fp == found.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    best = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = labelled.join(best, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` less all but one of each near-duplicate group.

    The row with the smallest id stays, a row without an id only where none has one; each row
    is told from the others by a stored number of its own. Columns are those of ``docs``.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), whole.alias("whole")))
    # the groups of row numbers: each component is named by its smallest row
    by_row = dedup_groups(rows.select(F.col("row").alias("doc_id"), "whole.text"), shingle, radius)
    ids = rows.select("row", F.col("whole.doc_id").alias("doc_id"))
    named = by_row.select(F.col("doc_id").alias("row"), "component_id").join(ids, "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    winners = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(winners, "row", "left_semi").select("whole.*")
