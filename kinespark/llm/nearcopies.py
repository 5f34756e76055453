"""Near copies by word shingles: every pair of a Jaccard similarity of at least ``least``.

Fingerprints that lie within ``radius`` bits are found by covering masks (``simhash.links``) and lead
to the first candidates. Few differing bits promise no similarity, nor does similarity promise few
differing bits, so shingle sets decide, and a prefix filter finds the pairs that are left.

A text's shingles, without repeats, are put in one order that all texts share, the rarest
first. Two sets of the wanted similarity share a shingle among the first
``n - ceil(least * n) + 1`` of each (prefix filter), so texts are dealt by these shingles alone
and no pair is lost. How common a shingle is comes from a sample of the rows: the sample shapes
the order, hence the cost, never the result. A pair that shares such a shingle, and whose sizes
and places in the order leave room for the similarity, is a candidate. Bit maps of shingle parities,
which differ in no more bits than the sets differ in shingles, drop most candidates: short maps
inside the bucket, so that it gives no pair that they rule out, then long ones. Whole shingle sets
decide. Candidates that hang together meet in one task, where each set goes once; what hangs
together in larger clusters is joined pair by pair. Equal sets are one node. A bucket first gives
pairs that make a forest, fewer than it has nodes, of nodes that fingerprints have not linked. Then it gives a few possible pairs for any two
groups not linked by then, and at last, where these did not link them, all.

Defined cases: texts without a word are copies of each other; a text of fewer words than
``shingle`` is one shingle of all its words; ids play no part in who is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, map_batches, scratch, stored, whole_groups
from .simhash import components, fingerprint_of, links, shingle_hashes

#: Similarity as numerator and denominator, so that no rounding decides.
LEAST = (4, 5)
#: Fingerprints that differ in so many bits are linked; twice as many masks for each bit more.
RADIUS = 3
#: The sample that orders shingles: one row in so many, but not fewer rows than that; and the most
#: shingles it names.
SAMPLE_ONE_IN, SAMPLE_ROWS = 16, 4_000
COMMON = 200_000
#: Buckets of up to so many nodes are compared pair by pair at first; of a larger one so many
#: nodes with all behind them, and the others with their neighbours.
PIVOTS = 32
#: Pairs that a bucket gives for any two groups before it keeps others back.
PER_GROUPS = 2
#: Bits of the short map of a set, and of one that is larger than that.
BRIEF = (256, 512)
#: Up to so many row ids go to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Clusters of candidates up to this size are checked in one task each.
CLUSTER_ROWS, CLUSTER_SHINGLES = 256, 1 << 20
_PAIRS = 1 << 16
_SKETCH = 1024


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Hashes of the text's shingles, sorted, each once."""
    return _set_of(np.array(shingle_hashes(text, shingle), dtype="<u8"))


def _set_of(packed: np.ndarray) -> np.ndarray:
    return np.unique(packed).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """One bit for each class of hashes: whether an odd number of them is in the set.

    Long sets have more classes, a power of two, so that the map of one folds onto another's.
    """
    size = max(_SKETCH, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else _SKETCH
    odd = np.bincount(hashes.view(np.uint64) % np.uint64(size), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def brief(sketched: bytes, n: int) -> bytes:
    """The bit map folded to the size that goes into buckets."""
    size = BRIEF[n > BRIEF[0]] // 64
    return np.bitwise_xor.reduce(np.frombuffer(sketched, np.uint64).reshape(-1, size), axis=0).tobytes()


def apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """For pairs of sketches the number of classes in which they differ."""
    sizes = np.array([(len(a), len(b)) for a, b in zip(x, y)], np.int64).reshape(-1, 2)
    out = np.zeros(len(x), np.int64)
    for m, n in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes[:, 0] == m) & (sizes[:, 1] == n))
        least = min(m, n)
        both = []
        for col, size in ((x, m), (y, n)):
            bits = np.frombuffer(b"".join([col[i] for i in at]), np.uint64).reshape(len(at), size // least, least // 8)
            both.append(np.bitwise_xor.reduce(bits, axis=1))
        out[at] = np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int64)
    return out


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles that several rows of the sample have, sorted by hash."""
    step = max(1, min(SAMPLE_ONE_IN, docs.count() // SAMPLE_ROWS))
    sample = docs.where(F.pmod(F.xxhash64("row"), F.lit(step)) == 0)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["h"])

    counts = map_batches(sample.select("text"), run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    got = counts.where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, n = np.array([r.h for r in got], np.int64), np.array([r.n for r in got], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _with_prefix(docs: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """(row, doc_id, node, n, prefix, sketch, brief, fp): node stands for the set, n is its size."""
    hashes, counts = _common(docs, shingle)
    p, q = least

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, prefixes, sketches, briefs, fps = [], [], [], [], [], []
        for text in batch.column(2).to_pylist():
            packed = np.array(shingle_hashes(text, shingle), dtype="<u8")
            fps.append(fingerprint_of(packed))
            have = _set_of(packed)
            n = len(have)
            seen = np.zeros(n, np.int64)
            if len(hashes) and n:
                at = np.minimum(np.searchsorted(hashes, have), len(hashes) - 1)
                seen = np.where(hashes[at] == have, counts[at], 0)
            nodes.append(xxhash.xxh64_intdigest(np.sort(have).tobytes(), n))
            sizes.append(n)
            sketches.append(sketch(have))
            briefs.append(brief(sketches[-1], n))
            prefixes.append(have[np.lexsort((have, seen))[: n + (-p * n) // q + 1 if n else 0]])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(briefs, pa.binary()),
                pa.array(np.array(fps, np.uint64).view(np.int64)),
            ],
            ["row", "doc_id", "node", "n", "prefix", "sketch", "brief", "fp"],
        )

    columns = docs.select("row", F.col("doc_id").cast("long"), "text")
    return map_batches(columns, run, "row long, doc_id long, node long, n long, prefix array<long>, sketch binary, brief binary, fp long")


def by_fingerprint(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b) of rows (node, fp): the pairs to which fingerprints within the radius lead.

    Nodes of one fingerprint go with the smallest of them, and these with each other along the links
    that covering masks find.
    """
    with scratch(rows.sparkSession):
        of = stored(rows.select("fp", "node").distinct())
        first = stored(of.groupBy("fp").agg(F.min("node").alias("a")))
        near = links(first.select("fp"), radius)
        near = near.join(first.select(F.col("fp").alias("src"), "a"), "src").join(first.select(F.col("fp").alias("dst"), F.col("a").alias("b")), "dst")
        same = of.join(first, "fp").select("a", F.col("node").alias("b"))
        both = near.select("a", "b").unionByName(same).where("a != b")
        return stored(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), apart=True)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of buckets that hold more than one node."""
    for t in whole_groups(batches, "key"):
        key = t["key"].to_numpy()
        same = key[1:] == key[:-1]
        keep = np.append(same, False) | np.append(False, same)
        yield from t.filter(pa.array(keep)).to_batches()


class _Buckets:
    """Nodes by bucket and size: which pairs inside a bucket are possible."""

    def __init__(self, n: np.ndarray, at: np.ndarray, briefs: list[bytes], least: tuple[int, int]):
        self.n, self.at, self.least = n, at, least
        long = n > BRIEF[0]
        wide = np.zeros((len(n), BRIEF[1] // 64), np.uint64)
        if long.any():
            wide[long] = np.frombuffer(b"".join([b for b, x in zip(briefs, long) if x]), np.uint64).reshape(-1, BRIEF[1] // 64)
        slim = wide[:, : BRIEF[0] // 64] ^ wide[:, BRIEF[0] // 64 :]
        if not long.all():
            slim[~long] = np.frombuffer(b"".join([b for b, x in zip(briefs, long) if not x]), np.uint64).reshape(-1, BRIEF[0] // 64)
        self.wide, self.slim = wide, slim

    def possible(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs, the larger node second, that may be similar enough."""
        p, q = self.least
        need = p * (self.n[i] + self.n[j])  # (p + q) times the overlap that two such sets need
        ok = (q * self.n[i] >= p * self.n[j]) & ((p + q) * (self.n[i] - self.at[i]) >= need) & ((p + q) * (self.n[j] - self.at[j]) >= need)
        i, j = i[ok], j[ok]
        long = self.n[i] > BRIEF[0]
        apart_ = np.empty(len(i), np.int64)
        for bits, these in ((self.wide, long), (self.slim, ~long)):
            apart_[these] = np.bitwise_count(bits[i[these]] ^ bits[j[these]]).sum(axis=1, dtype=np.int64)
        ok = (p + q) * apart_ <= (q - p) * (self.n[i] + self.n[j])
        return i[ok], j[ok]

    def forest(self, a: int, b: int, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Possible pairs of the bucket [a, b), fewer than it has nodes, without those of one root."""

        def fresh(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            new = root[i] != root[j]
            return i[new], j[new]

        todo = np.arange(a, b)
        for _ in range(PIVOTS):
            if len(todo) < 2:
                return
            i, todo = todo[:1], todo[1:]
            pairs = self.possible(np.repeat(i, len(todo)), todo)
            yield fresh(*pairs)
            todo = np.setdiff1d(todo, pairs[1], assume_unique=True)
        yield fresh(*self.possible(todo[:-1], todo[1:]))

    def across(self, a: int, b: int, root: np.ndarray, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Possible pairs of the bucket whose nodes have different roots, ``most`` for two roots.

        ``held_back`` then has the pairs of roots of which more were left unread.
        """
        self.held_back: set[tuple[int, int]] = set()
        given: dict[tuple[int, int], int] = {}
        full: dict[int, list[int]] = {}
        for i in range(a, b - 1):
            mine = int(root[i])
            j = np.flatnonzero(root[i + 1 : b] != mine) + i + 1
            if done := full.get(mine):
                skip = np.isin(root[j], done)
                self.held_back.update((min(mine, x), max(mine, x)) for x in np.unique(root[j[skip]]).tolist())
                j = j[~skip]
            if not len(j):
                continue
            i_, j_ = self.possible(np.full(len(j), i), j)
            if most is not None and len(j_):
                keep = np.ones(len(j_), bool)
                for k, other in enumerate(root[j_].tolist()):
                    two = (min(mine, other), max(mine, other))
                    given[two] = given.get(two, 0) + 1
                    if given[two] > most:
                        keep[k] = False
                        self.held_back.add(two)
                    elif given[two] == most:
                        full.setdefault(mine, []).append(other)
                        full.setdefault(other, []).append(mine)
                i_, j_ = i_[keep], j_[keep]
            yield i_, j_


def _candidates(least: tuple[int, int], across: bool = False, most: int | None = None):
    """Arrow map over whole buckets (key, n, node, at, brief, root) sorted by key, n, node.

    Gives (a, b, more): possible pairs, or with ``more`` two roots of which pairs were kept back.
    ``across``: pairs of different roots; else those of a forest of each bucket's pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(x: np.ndarray, y: np.ndarray, more: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.full(len(x), more))], ["a", "b", "more"])

        def batch(held: list, node: np.ndarray) -> pa.RecordBatch:
            return rows_of(*(node[np.concatenate([h[k] for h in held])] for k in (0, 1)), False)

        for t in whole_groups(batches, "key"):
            key, n, node, at, root = (t[c].to_numpy() for c in ("key", "n", "node", "at", "root"))
            buckets = _Buckets(n, at, t["brief"].to_pylist(), least)
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            size = np.diff(starts)
            two = starts[:-1][size == 2]  # most buckets: all compared at once
            two = two[root[two] != root[two + 1]]
            held, back = [buckets.possible(two, two + 1)], set()
            rows = len(held[0][0])
            for a, b in zip(starts[:-1][size > 2].tolist(), starts[1:][size > 2].tolist()):
                if (root[a:b] == root[a]).all():
                    continue
                for pairs in buckets.across(a, b, root, most) if across else buckets.forest(a, b, root):
                    held.append(pairs)
                    rows += len(pairs[0])
                    if rows >= _PAIRS:
                        yield batch(held, node)
                        held, rows = [], 0
                if across:
                    back |= buckets.held_back
            if rows:
                yield batch(held, node)
            if back:
                x = np.array(sorted(back), np.int64)
                yield rows_of(x[:, 0], x[:, 1], True)

    return run


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "n", "node")


def _of_both(pairs: DataFrame, nodes: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b) with the columns ``cols`` of both nodes behind, those of b with a 2."""
    x = nodes.select(F.col("node").alias("a"), *cols)
    y = nodes.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}2") for c in cols])
    return pairs.join(x, "a").join(y, "b").select("a", "b", *cols, *[f"{c}2" for c in cols])


def _possible(pairs: DataFrame, nodes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b): the pairs whose bit maps do not rule the similarity out."""
    p, q = least

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, x, n2, y = (batch.column(k) for k in range(2, 6))
        keep = (p + q) * apart(x.to_pylist(), y.to_pylist()) <= (q - p) * (n.to_numpy() + n2.to_numpy())
        return batch.select([0, 1]).filter(pa.array(keep))

    return map_batches(_of_both(pairs, nodes, ["n", "sketch"]), run, "a long, b long")


def alike(x: bytes, y: bytes, least: tuple[int, int]) -> bool:
    """Whether two sets of hashes are similar enough."""
    p, q = least
    both = np.concatenate([np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return q * common >= p * (len(both) - common)


def _linked(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(src, dst): the pairs whose sets are similar enough, by joins."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [alike(x, y, least) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        out = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        return out.rename_columns(["src", "dst"])

    return map_batches(_of_both(pairs, sets, ["hashes"]), run, "src long, dst long")


def _linked_within(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The same for pairs (root, a, b) and sets (root, node, hashes) of small clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "root"):
            a, b, hashes = t["a"].to_pylist(), t["b"].to_pylist(), t["hashes"].to_pylist()
            of = {node: h for node, h in zip(a, hashes) if h is not None}
            keep = [(x, y) for x, y, h in zip(a, b, hashes) if h is None and alike(of[x], of[y], least)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keep], pa.int64()), pa.array([y for _, y in keep], pa.int64())], ["src", "dst"])

    asks = pairs.select("root", "a", "b", F.lit(None).cast("binary").alias("hashes"))
    both = sets.select("root", F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), "hashes").unionByName(asks)
    return arrow_map(both.repartition("root").sortWithinPartitions("root"), run, "src long, dst long")


def few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def groups(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = LEAST, radius: int = RADIUS) -> DataFrame:
    """(row, doc_id, root) of every row of ``docs`` (row, doc_id, text), which must be stored."""
    rows = stored(_with_prefix(docs, shingle, least))
    near = by_fingerprint(rows, radius)
    one = F.min(F.struct("row", "n", "prefix")).alias("s")
    nodes = rows.groupBy("node").agg(one).select("node", "s.n", "s.prefix")
    keyed = nodes.select("node", "n", F.posexplode("prefix").alias("at", "key")).select("key", "n", "node", "at")
    shared = stored(arrow_map(_by_key(keyed), _shared, "key long, n long, node long, at int"))
    # one row stands for each node that some bucket shares
    likely = rows.join(shared.select("node").distinct(), "node", "left_semi").select("node", "row", "n", "sketch", "brief")
    likely = stored(likely.groupBy("node").agg(F.min(F.struct("row", "n", "sketch", "brief")).alias("s")).select("node", "s.*"))
    known = shared.join(likely.select("node", "brief"), "node")

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [shingle_set(t, shingle).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary()), batch.column(2)], ["node", "hashes", "root"])

    def sets(wanted: DataFrame) -> DataFrame:
        texts = docs.select("row", "text").join(few(wanted), "row").select("node", "text", "root")
        return map_batches(texts, sets_of, "node long, hashes binary, root long")

    def checked(pairs: DataFrame) -> DataFrame:
        tree = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        tree = tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())
        wanted = stored(likely.join(tree, "node").select("node", "row", "n", "root"))
        size = wanted.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
        small = (F.col("rows") <= CLUSTER_ROWS) & (F.col("shingles") <= CLUSTER_SHINGLES)
        wanted = stored(wanted.join(size.select("root", small.alias("small")), "root").select("node", "row", "root", "small"))
        asked = stored(pairs.join(wanted.select(F.col("node").alias("a"), "root", "small"), "a"))
        out = _linked_within(asked.where("small"), sets(wanted.where("small").drop("small")), least)
        if not (large := asked.where("NOT small")).isEmpty():
            whole = stored(sets(wanted.where("NOT small").drop("small")).select("node", "hashes"))
            out = out.unionByName(_linked(large.select("a", "b"), whole, least))
        return stored(out)

    def rooted(found: DataFrame) -> DataFrame:
        of = known.join(found, known.node == found.node, "left")
        return of.select("key", "n", known.node, "at", "brief", F.coalesce("root", known.node).alias("root"))

    def candidates(found: DataFrame, *how) -> DataFrame:
        return stored(arrow_map(_by_key(rooted(found)), _candidates(least, *how), "a long, b long, more boolean").distinct())

    # similar sets share a bucket, so pairs of other nodes go here
    tested = stored(_possible(near, likely, least))
    linked = checked(tested)
    found = components(linked)
    for how in ((), (True, PER_GROUPS), (True, None)):
        given = candidates(found, *how)
        new = stored(_possible(given.where("NOT more").select("a", "b").join(tested, ["a", "b"], "left_anti"), likely, least))
        if not new.isEmpty():
            linked, tested = linked.unionByName(checked(new)), tested.unionByName(new)
            found = components(linked)
        if not how:
            continue
        a, b = found.select(F.col("node").alias("a"), F.col("root").alias("r")), found.select(F.col("node").alias("b"), F.col("root").alias("s"))
        back = given.where("more").join(a, "a", "left").join(b, "b", "left")
        if back.where(F.coalesce("r", "a") != F.coalesce("s", "b")).isEmpty():
            break
    return rows.join(found, rows.node == found.node, "left").select("row", "doc_id", F.coalesce("root", rows.node).alias("root"))


def keep_one(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = LEAST, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near copies.

    The row with the smallest id stays, a row without an id only where none has one; each row
    is told from the others by a stored number of its own. Columns are those of ``docs``.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), whole.alias("whole")))
    with scratch(docs.sparkSession):
        found = stored(groups(rows.select("row", "whole.doc_id", "whole.text"), shingle, least, radius))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
        winners = found.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias("row"))
        losers = stored(found.select("row").join(winners, "row", "left_anti"), apart=True)
    return rows.join(few(losers), "row", "left_anti").select("whole.*")
