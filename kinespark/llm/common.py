"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; ``bytes.split()`` splits at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}
#: What one Arrow batch may hold on its way to Python, unless the application sets it itself.
ARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: What a function of a batch gets at once; one longer row is a batch of its own.
SLICE_ROWS, SLICE_BYTES = 256, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids count as remainder 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % F.lit(modulus), F.lit(0))


def lower_ascii(text: str) -> str:
    return text.translate(_UPPER_TO_LOWER)


def word_bytes(text: str | None, lower: bool = False) -> list[bytes]:
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def count_word_chars(text: str | None) -> int:
    return len(text) - sum(text.count(c) for c in _SPACES) if text else 0


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master gets one made where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    jsc_dir = sc._jsc.sc().getCheckpointDir()
    if jsc_dir.isDefined():
        return named or jsc_dir.get()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kinespark-ckpt-")
    sc.setCheckpointDir(named)
    return named


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``stored`` or the pipeline has written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is ``stored`` inside is deleted at the end, so results must be written by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            dropped(spark, path)


def stored(df: DataFrame, apart: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    ``apart``: it outlives the innermost ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kinespark-{uuid.uuid4().hex}"
    lists = _open[:-1] if apart else _open
    if lists:
        lists[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released() -> None:
    """Gives memory that a task has freed back to the system; idle workers then hold little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About how many bytes each row takes, by its longest kinds of columns."""
    out = np.full(batch.num_rows, 64, np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
            out += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_nested(col.type):
            out += col.nbytes // max(1, len(col))
    return out


def sliced(batch: pa.RecordBatch, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in order, in slices of at most ``rows`` rows and about ``most`` bytes."""
    if not batch.num_rows:
        return
    ends = np.cumsum(_row_bytes(batch))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over small batches; a worker gives its memory back when a task ends."""
    spark = df.sparkSession
    named = spark.sparkContext.getConf()
    for key, value in ARROW.items():
        if not named.contains(key):
            spark.conf.set(key, value)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return df.mapInArrow(task, schema)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = SLICE_ROWS
) -> DataFrame:
    """Arrow map over the columns of ``df``; ``fn`` sees one small slice of a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, rows):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return arrow_map(df, run, schema)


def gathered(batches: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.Table]:
    """Batches put together until they hold about ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches in which equal keys are neighbours."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        ids = t[key].combine_chunks()
        last = ids[len(ids) - 1]
        same = pc.is_null(ids) if not last.is_valid else pc.fill_null(pc.equal(ids, last), False)
        other = pc.indices_nonzero(pc.invert(same))
        at = other[len(other) - 1].as_py() + 1 if len(other) else 0
        if at:
            yield pa.concat_tables([*held, t.slice(0, at)])
            held = []
        elif held and held[-1][key][-1].as_py() != last.as_py():
            yield pa.concat_tables(held)
            held = []
        held.append(t.slice(at))
    if held:
        yield pa.concat_tables(held)


def chosen_labels(labels: DataFrame, label: str, per_class: int, keep: Column) -> DataFrame:
    """At most ``per_class`` labelled ids of each class: (doc_id, y), one row an id.

    ``keep`` selects the label rows that may be learnt from. They are chosen by a hash of the id,
    so reruns agree, and their number bounds what is broadcast and collected.
    """
    rows = (
        labels.where(keep & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).cast("int").alias("y"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return rows.where("y = 1").orderBy(*order).limit(per_class).unionByName(rows.where("y = 0").orderBy(*order).limit(per_class))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int, keep: Column) -> DataFrame:
    """At most ``per_class`` labelled documents of each class: (doc_id, text, y).

    Of documents that share an id only the one with the smallest text is taken.
    """
    chosen = chosen_labels(labels, label, per_class, keep)
    return (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
        .select("doc_id", "text", "y")
    )
