"""Rules on metadata: what is declared against what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import last_before, numbered


def missing_from(wanted: DataFrame, there: DataFrame, on: list[str]) -> DataFrame:
    """Set containment: required files, orphan files, streams, tasks and topics."""
    return wanted.select(*on).distinct().join(there.select(*on).distinct(), on, "left_anti")


def unique_ids(df: DataFrame, identifier: str, order: str) -> DataFrame:
    """Every repeat of an identifier after its first row."""
    n = F.row_number().over(W.partitionBy(identifier).orderBy(order))
    return df.select(identifier, order, n.cast("long").alias("occurrence")).where("occurrence > 1")


def shape_consistency(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """Episodes with rows of another width than declared, or without a value."""
    n = F.coalesce(F.size(vector), F.lit(-1))
    return df.groupBy(key).agg(F.min(n).alias("least"), F.max(n).alias("most"), F.count_if(n != width).alias("rows")).where("rows > 0")


def declared_totals(declared: DataFrame, stored: DataFrame, key: str, count: str) -> DataFrame:
    """Declared counts that differ from what is stored; absent means 0."""
    there = stored.groupBy(key).agg(F.count(F.lit(1)).alias("stored"))
    both = declared.select(key, F.col(count).cast("long").alias("declared")).join(there, key, "left")
    return both.select(key, "declared", F.coalesce("stored", F.lit(0)).alias("stored")).where("declared != stored")


def valid_boundaries(episodes: DataFrame, pos: str, start: str, end: str, length: str) -> DataFrame:
    """Empty or inconsistent ranges, and ranges that begin before the last known end."""
    ordered = last_before(numbered(episodes, pos, name="_place"), end, "_place", "_before")
    reasons = F.concat_ws(
        "; ",
        F.when(F.col(length) < 1, "empty"),
        F.when(F.col(end) <= F.col(start), "end before start"),
        F.when(F.col(end) - F.col(start) != F.col(length), "length differs"),
        F.when(F.col(start) < F.col("_before"), "overlaps the last"),
    )
    return ordered.select(pos, reasons.alias("reasons")).where("reasons != ''")


def dtype_mismatches(declared: DataFrame, stored: DataFrame) -> DataFrame:
    """(name, reason) of declared columns (name, type, names) that are absent or stored as another type.

    A stored type fits if it holds one of ``names``, so aliases and wider names of a type pass.
    """
    both = declared.join(stored, "name", "left")
    fits = F.exists("names", lambda x: F.contains(F.col("stored"), x))
    return both.where(F.col("stored").isNull() | ~fits).select("name", F.when(F.col("stored").isNull(), "missing").otherwise("type").alias("reason"))


def task_references(rows: DataFrame, key: str, task: str, known: DataFrame, most: int = 20) -> DataFrame:
    """(key, unknown): the first ``most`` tasks of each episode that are not known, in order, joined by commas."""
    used = rows.select(key, task).distinct().join(known.select(task).distinct(), task, "left_anti")
    first = F.slice(F.sort_array(F.collect_set(task)), 1, most)
    return used.groupBy(key).agg(F.array_join(F.transform(first, lambda x: x.cast("string")), ",").alias("unknown"))


def index_columns(df: DataFrame, key: str, order: str, index: str, expected: Column | None = None) -> DataFrame:
    """(key, first, value, mismatches): where an index column is not its row's position."""
    rows = df.withColumn("_pos", (F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).cast("long"))
    want = F.col("_pos") if expected is None else expected
    bad = rows.where(F.col(index).isNull() | (F.col(index) != want))
    return bad.groupBy(key).agg(F.min("_pos").alias("first"), F.min_by(index, "_pos").alias("value"), F.count(F.lit(1)).alias("mismatches"))
