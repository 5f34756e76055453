"""SentencePiece encoding and decoding over a relational lattice.

A text becomes units: runs of blanks with the word behind them, and line ends. No piece crosses
a unit, so units are encoded on their own, over a lattice: the unit's substrings of bounded
length that are pieces are its edges, and a fold over the edges gives the segmentation.

For the ``table_units`` most frequent units the lattice is relational: substrings are exploded,
equi-joined to the piece table, grouped by unit, and folded by a Spark higher-order
``aggregate``. Their ids go to the executors as one table of bounded size. All other units get
the same lattice where they are met, column by column (``Lattice``): substrings are joined to the
piece table by the pieces' trie, edges are grouped by unit, and all units are folded in step. So
a text needs no shuffle and no unit is left out.

Two kinds of model: ``unigram`` pieces are folded by Viterbi over positions (best sum of
scores); ``bpe`` pieces by merges in the order of rank, over a bit mask of unit boundaries,
which is what such a model defines. A piece that one pass in rank order does not build, though the
merge loop does, is late: inside a piece merges go on as if it stood alone, so one pass is
exact for units without a late piece. Other units, and units longer than the mask, take the
merge loop instead.

Defined cases: null text is the empty text and has no ids; U+2581 counts as a blank and is
decoded as one; characters without a piece become byte pieces; very long texts and units are
encoded whole; repeated rows each get a row; an empty table gives no rows; other columns of the
input stay, but a column named like the result gives way to it.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, map_batches, sliced, stored

#: where the public tokenizer lies by default; a parameter everywhere
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MASK_CHARS = 60
_UNIT = re.compile(r" *[^ \n]+|\n| +")
_MEMO = 100_000
_TALLY = 200_000


@dataclass
class PieceTable:
    """Pieces of a model: text -> (id, score); byte pieces by byte; text of every id."""

    pieces: dict[str, tuple[int, float]]
    bytes_: list[int]
    texts: list[bytes]
    kind: str = "bpe"
    late: set[str] = field(default_factory=set)
    longest: int = 1

    def __post_init__(self) -> None:
        for p in self.pieces:
            if "\n" in p and len(p) > 1 or " " in p.lstrip(" "):
                raise ValueError(f"piece {p!r} crosses a unit")
        self.longest = max(map(len, self.pieces), default=1)
        if self.kind == "bpe":
            self.late = {p for p in self.pieces if len(p) > 2 and len(self._in_order(p)) > 1 and len(self._merge(p)) == 1}

    def _in_order(self, unit: str) -> list[str]:
        """One pass over the edges in the order of rank, as the relational fold makes it."""
        n = len(unit)
        edges = []
        for s in range(n):
            for e in range(s + 2, min(n, s + self.longest) + 1):
                got = self.pieces.get(unit[s:e])
                if got:
                    edges.append((-got[1], s, e))
        mask = (1 << (n + 1)) - 1
        for _, s, e in sorted(edges):
            inner = mask & ((1 << e) - (1 << (s + 1)))
            if mask >> s & 1 and mask >> e & 1 and inner.bit_count() == 1:
                mask ^= inner
        cuts = [i for i in range(n + 1) if mask >> i & 1]
        return [unit[a:b] for a, b in zip(cuts, cuts[1:])]

    def byte_ids(self, c: str) -> list[int]:
        return [self.bytes_[b] for b in c.encode("utf-8", "surrogatepass")]

    def ids_of(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            got = self.pieces.get(p)
            out += [got[0]] if got else self.byte_ids(p)
        return out

    def encode_unit(self, unit: str) -> list[int]:
        return self.ids_of(self._merge(unit) if self.kind == "bpe" else self._viterbi(unit))

    def _merge(self, unit: str) -> list[str]:
        """The adjacent pair of the best score is joined first, the leftmost of equal ones."""
        parts: list[str] = list(unit)
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []
        pieces = self.pieces

        def offer(a: int, b: int) -> None:
            got = pieces.get(both := parts[a] + parts[b])
            if got:
                heapq.heappush(heap, (-got[1], a, b, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if after[a] != b or parts[a] + parts[b] != both or not parts[a] or not parts[b]:
                continue
            parts[a], parts[b] = both, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        return [p for p in parts if p]

    def _viterbi(self, unit: str) -> list[str]:
        n = len(unit)
        worst = min((s for _, s in self.pieces.values()), default=0.0) - 10
        best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                got = self.pieces.get(unit[start:end])
                s = got[1] if got else worst if end - start == 1 else None
                if s is not None and best[start] + s > best[end]:
                    best[end], back[end] = best[start] + s, start
        out, at = [], n
        while at:
            out.append(unit[back[at] : at])
            at = back[at]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.texts.__getitem__, ids))
        return raw.decode("utf-8", "replace")[1:]


def load(path: str = MODEL) -> PieceTable:
    """The normal pieces of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, texts, bytes_ = {}, [], [model.unk_id()] * 256
    for i in range(model.vocab_size()):
        text = model.id_to_piece(i)
        texts.append(b"")
        if model.is_byte(i):
            bytes_[int(text[3:5], 16)] = i
            texts[i] = bytes([int(text[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            plain = text.replace(SPACE, " ")
            pieces[plain] = (i, model.get_score(i))
            texts[i] = plain.encode()
    return PieceTable(pieces, bytes_, texts)


def units_of(text: str | None) -> list[str]:
    return _UNIT.findall(" " + text.replace(SPACE, " ")) if text else []


def count_units(docs: DataFrame) -> DataFrame:
    """(unit, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["unit", "n"])
            tally.clear()
            return batch

        for part in itertools.chain.from_iterable(map(sliced, batches)):
            for text in part.column(0).to_pylist():
                tally.update(units_of(text))
                if len(tally) > _TALLY:
                    yield out()
        if tally:
            yield out()

    return arrow_map(docs.select("text"), run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def lattice(units: DataFrame, table: PieceTable) -> DataFrame:
    """(unit, edges): edges are the pieces found in the unit, by start and length.

    ``units`` holds a column ``unit`` without repeats. The piece table is broadcast: its size is
    that of the model's vocabulary.
    """
    spark = units.sparkSession
    rows = [(p, i, float(-s), p in table.late) for p, (i, s) in table.pieces.items()]
    pieces = spark.createDataFrame(rows, "piece string, id int, rank double, late boolean")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: small, but dear to fold
    dealt = units.where("unit != ''").select("unit").repartition(parts, "unit")
    starts = F.explode(F.expr("sequence(0, char_length(unit) - 1)"))
    lengths = F.explode(F.expr(f"sequence(1, least({table.longest}, char_length(unit) - s))"))
    edges = (
        dealt.select("unit", starts.alias("s"))
        .select("unit", "s", lengths.alias("l"))
        .select("unit", "s", "l", F.expr("substring(unit, s + 1, l)").alias("piece"))
        .join(F.broadcast(pieces), "piece")
        .groupBy("unit")
        .agg(F.collect_list(F.struct("rank", "s", "l", "id", "late")).alias("edges"))
    )
    none = F.array().cast(edges.schema["edges"].dataType)
    return dealt.join(edges, "unit", "left").select("unit", F.coalesce("edges", none).alias("edges"))


def encode_units(units: DataFrame, table: PieceTable) -> DataFrame:
    """(unit, ids) by the relational lattice.

    Units that need the merge loop, or byte pieces, have null ids here.
    """
    spans = lattice(units, table).select("unit", F.sort_array("edges").alias("edges"), F.char_length("unit").alias("n"))
    if table.kind == "bpe":
        # bit p of the mask: a part begins at p; a merge takes exactly one bit out
        inner = "(m & (shiftleft(1L, e.s + e.l) - shiftleft(1L, e.s + 1)))"
        fold = f"""aggregate(filter(edges, e -> e.l > 1), shiftleft(1L, n + 1) - 1L, (m, e) ->
            CASE WHEN (shiftright(m, e.s) & 1L) = 1L AND (shiftright(m, e.s + e.l) & 1L) = 1L AND bit_count({inner}) = 1
                 THEN m ^ {inner} ELSE m END)"""
        fits = f"n <= {MASK_CHARS} AND NOT exists(edges, e -> e.late)"
        masked = spans.withColumn("mask", F.expr(f"CASE WHEN {fits} THEN {fold} END"))
        parts = masked.withColumn("cuts", F.expr("CASE WHEN mask IS NOT NULL THEN filter(sequence(0, n), p -> (shiftright(mask, p) & 1L) = 1L) END"))
    else:
        worst = min((s for _, s in table.pieces.values()), default=0.0) - 10
        unknown = f"transform(filter(sequence(0, n - 1), s -> NOT exists(edges, e -> e.s = s AND e.l = 1)), s -> named_struct('rank', {-worst}D, 's', s, 'l', 1, 'id', -1, 'late', false))"
        ordered = f"array_sort(concat(edges, {unknown}), (a, b) -> CASE WHEN a.s + a.l != b.s + b.l THEN a.s + a.l - b.s - b.l ELSE a.s - b.s END)"
        first = "transform(sequence(0, n), p -> named_struct('best', CASE WHEN p = 0 THEN 0D ELSE -1e300D END, 'back', 0))"
        step = "transform(a, (x, p) -> CASE WHEN p = e.s + e.l AND a[e.s].best - e.rank > x.best THEN named_struct('best', a[e.s].best - e.rank, 'back', e.s) ELSE x END)"
        walk = "aggregate(sequence(1, n), array(n), (c, i) -> CASE WHEN element_at(c, -1) > 0 THEN concat(c, array(best[element_at(c, -1)].back)) ELSE c END)"
        parts = spans.withColumn("best", F.expr(f"aggregate({ordered}, {first}, (a, e) -> {step})")).withColumn("cuts", F.expr(f"reverse({walk})"))
    # the map is bound by a lambda, so that it is built once for a unit and not for every part
    of = "map_from_entries(transform(edges, e -> struct(e.s * 65536 + e.l, e.id)))"
    found = f"transform(array({of}), of -> transform(sequence(1, size(cuts) - 1), k -> element_at(of, cuts[k - 1] * 65536 + cuts[k] - cuts[k - 1])))[0]"
    ids = parts.withColumn("ids", F.expr(f"CASE WHEN cuts IS NOT NULL THEN {found} END"))
    return ids.select("unit", F.expr("CASE WHEN NOT exists(ids, i -> i IS NULL) THEN ids END").alias("ids"))


class Lattice:
    """The lattice of many units at once. Exact: the trie compares whole pieces."""

    def __init__(self, table: PieceTable):
        self.table = table
        child: dict[int, int] = {}
        ends = {}
        for p in table.pieces:
            at = 0
            for c in p:
                at = child.setdefault(at << 21 | ord(c), len(child) + 1)
            ends[at] = p
        self.keys = np.array(sorted(child), np.int64)
        self.next = np.array([child[k] for k in self.keys.tolist()], np.int64)
        self.id = np.full(len(child) + 1, -1, np.int64)
        self.rank = np.zeros(len(child) + 1)
        self.is_late = np.zeros(len(child) + 1, bool)
        for at, p in ends.items():
            self.id[at], self.rank[at], self.is_late[at] = table.pieces[p][0], -table.pieces[p][1], p in table.late

    def edges(self, chars: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, node) of all pieces in ``chars``; ``stop``: where each one's unit ends."""
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        found = []
        for length in range(1, self.table.longest + 1):
            inside = at + length <= stop[at]
            at, node = at[inside], node[inside]
            if not len(at) or not len(self.keys):
                break
            key = node << 21 | chars[at + length - 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            at, node = at[hit], self.next[place[hit]]
            piece = self.id[node] >= 0
            found.append((at[piece], np.full(piece.sum(), length), node[piece]))
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))

    def encode(self, units: list[str]) -> list[bytes]:
        """The ids of every unit as 32-bit integers; units that need the merge loop take it."""
        own = self.table
        if own.kind != "bpe":
            return [np.array(own.encode_unit(u), "<i4").tobytes() for u in units]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        long_ones = [k for k in np.flatnonzero(sizes > MASK_CHARS).tolist()]
        fits = units if not long_ones else [u if len(u) <= MASK_CHARS else "" for u in units]
        n = np.where(sizes <= MASK_CHARS, sizes, 0)
        chars = np.frombuffer("".join(fits).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(n) - n
        unit = np.repeat(np.arange(len(units)), n)
        start, length, node = self.edges(chars, (begin + n)[unit])
        # grouped by unit, in the order of rank
        long = np.flatnonzero(length > 1)
        owner = unit[start[long]]
        long = long[np.lexsort((length[long], start[long], self.rank[node[long]], owner))]
        owner = unit[start[long]]
        count = np.bincount(owner, minlength=len(units))
        first = np.cumsum(count) - count
        order = np.argsort(-count, kind="stable")
        one = np.uint64(1)
        mask = (one << (n + 1).astype(np.uint64)) - one
        s, e = (start[long] - begin[owner]).astype(np.uint64), (start[long] - begin[owner] + length[long]).astype(np.uint64)
        between = (one << e) - (one << (s + one))
        both = (one << s) | (one << e)
        falling = -count[order]
        for k in range(int(count.max()) if len(count) else 0):  # the k-th edge of every unit that has one
            who = order[: np.searchsorted(falling, -k, side="left")]
            edge = first[who] + k
            m = mask[who]
            inner = m & between[edge]
            join = ((m & both[edge]) == both[edge]) & (np.bitwise_count(inner) == 1)
            mask[who] = np.where(join, m ^ inner, m)
        place = (np.arange(len(chars)) - begin[unit]).astype(np.uint64)
        cut = np.flatnonzero((mask[unit] >> place) & one)
        size = np.diff(np.append(cut, len(chars)))
        size = np.minimum(size, (begin + n)[unit[cut]] - cut)
        known = start * 64 + length
        by = np.argsort(known)
        want = cut * 64 + size
        got = by[np.minimum(np.searchsorted(known[by], want), len(by) - 1)] if len(by) else np.zeros(len(cut), np.int64)
        is_piece = known[got] == want if len(by) else np.zeros(len(cut), bool)
        spelt = {int(k): own.byte_ids(chr(chars[cut[k]])) for k in np.flatnonzero(~is_piece)}
        times = np.ones(len(cut), np.int64)
        for k, ids in spelt.items():
            times[k] = len(ids)
        to = np.cumsum(times) - times
        ids = np.zeros(int(times.sum()), "<i4")
        if len(by):
            ids[to[is_piece]] = self.id[node[got[is_piece]]]
        for k, spelling in spelt.items():
            ids[to[k] : to[k] + len(spelling)] = spelling
        per = np.bincount(unit[cut], weights=times, minlength=len(units)).astype(np.int64) * 4
        raw, ends = ids.tobytes(), np.cumsum(per).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        late = set(unit[start[self.is_late[node]]].tolist())
        for k in [*late, *long_ones]:
            out[k] = np.array(own.encode_unit(units[k]), "<i4").tobytes()
        return out


def unit_table(docs: DataFrame, table: PieceTable, table_units: int = 1 << 16) -> dict[str, bytes]:
    """Ids of the most frequent units, by the relational lattice; bounded by ``table_units``."""
    counted = count_units(docs).where(F.char_length("unit") <= MASK_CHARS)
    top = stored(counted.orderBy(F.desc("n"), "unit").limit(table_units))
    got = encode_units(top, table).where("ids IS NOT NULL").toArrow().combine_chunks()
    if not got.num_rows:
        return {}
    ids = got["ids"].combine_chunks()
    raw, at = ids.flatten().to_numpy().astype("<i4").tobytes(), (ids.offsets.to_numpy() - ids.offsets[0].as_py()).tolist()
    return {u: raw[4 * a : 4 * b] for u, a, b in zip(got["unit"].to_pylist(), at, at[1:])}


class Encoder:
    """Texts to ids, with the table of frequent units and a bounded memory of others."""

    def __init__(self, table: PieceTable, known: dict[str, bytes]):
        self.table, self.lattice, self.known, self.of = table, Lattice(table), known, dict(known)

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text as 32-bit integers."""
        if len(self.of) > len(self.known) + _MEMO:
            self.of = dict(self.known)
        of = self.of
        units = [units_of(t) for t in texts]
        new = list(set(itertools.chain.from_iterable(units)).difference(of))
        of.update(zip(new, self.lattice.encode(new)))
        return [b"".join(map(of.__getitem__, us)) for us in units]

    def lists(self, texts: list[str | None]) -> pa.ListArray:
        rows = self.texts(texts)
        at = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def encoder(docs: DataFrame, table: PieceTable, table_units: int = 1 << 16):
    """A function for executors that makes the encoder of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast((table, unit_table(docs, table, table_units)))
    return lambda: Encoder(*sent.value)


def encode(docs: DataFrame, table: PieceTable, table_units: int = 1 << 16) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of the whole text, in place of ``text``."""
    make = encoder(docs, table, table_units)
    others = [c for c in docs.columns if c.lower() not in ("text", "ids")]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for part in itertools.chain.from_iterable(map(sliced, batches)):
            ids = own.lists(part.column(len(others)).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], ids], [*others, "ids"])

    schema = rows.select(*[F.col(f"`{c}`") for c in others], F.array(F.lit(0)).alias("ids")).schema
    return arrow_map(rows, run, schema)


def decode(coded: DataFrame, table: PieceTable) -> DataFrame:
    """``coded`` with ``text`` decoded from ``ids`` in place of ``ids``."""
    at = coded.columns.index("ids")
    others = [c for c in coded.columns if c.lower() not in ("text", "ids")]
    sent = coded.sparkSession.sparkContext.broadcast(table)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [sent.value.decode(ids or []) for ids in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(texts, pa.string())], [*others, "text"])

    schema = coded.select(*[F.col(f"`{c}`") for c in others], F.lit("").alias("text")).schema
    return map_batches(coded, run, schema)
