"""Windows over ordered samples that the rules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import checkpointed


def along(key: str, order: str):
    return W.partitionBy(key).orderBy(order)


def row_pos(key: str, order: str) -> Column:
    """Place of a row in its episode's stored order, from 0."""
    return (F.row_number().over(along(key, order)) - 1).cast("long")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone; the session's zone has no say."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def islands(rows: DataFrame, key: list[str], pos: str, *aggregates: Column) -> DataFrame:
    """One row for each run of neighbouring positions: start, end, count and the aggregates."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(pos))
    return (
        rows.withColumn("_run", F.col(pos) - rank)
        .groupBy(*key, "_run")
        .agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("count"), *aggregates)
        .drop("_run")
    )


def long_form(df: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """(key, order, dim, x): one row for each component of a vector column."""
    return df.select(key, order, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))


def numbered(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """``df`` with each row's place in a total order from 0, and ``_part``, the part that holds it.

    Rows are dealt by ranges and sorted inside a range; the ranges' sizes are summed up, so no
    task sees all rows. The result is cut from its lineage, for ranges are drawn from samples.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = checkpointed(dealt.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # a row for each part
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_at", "_before")


def last_before(df: DataFrame, value: str, pos: str, name: str) -> DataFrame:
    """``df`` of ``numbered`` with the last value before each row that is not null.

    A part looks back at its own rows; what it finds none for comes from the parts before it.
    """
    own = F.last(value, ignorenulls=True).over(W.partitionBy("_part").orderBy(pos).rowsBetween(W.unboundedPreceding, -1))
    ends = df.groupBy("_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(pos))).alias("_end"))
    carried = F.last("_end", ignorenulls=True).over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    carried = ends.select("_part", carried.alias("_carried"))
    return df.withColumn(name, own).join(F.broadcast(carried), "_part").withColumn(name, F.coalesce(name, "_carried")).drop("_carried")


def population(per: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """``per`` joined to aggregates over all its rows by ``key``: few rows, sent to all executors."""
    return per.join(F.broadcast(per.groupBy(key).agg(*aggregates)), key)
