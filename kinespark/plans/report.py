"""Findings in one schema, and what is computed on them: suppression, comparison, coverage, capping."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANKS = {"critical": 3, "error": 2, "warning": 1, "notice": 0}


def findings(rows: DataFrame, rule: str, severity: str, episode: str, sample: str | None, observed: list[str], stream: str = "", expected: str = "") -> DataFrame:
    """(rule_id, severity, episode, sample_index, observed, fingerprint).

    The fingerprint names rule, place, stream and both values, as JSON, so no two of them run together.
    """
    at = F.col(sample).cast("long") if sample else F.lit(None).cast("long")
    seen = F.to_json(F.struct(*observed))
    out = rows.select(
        F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col(episode).cast("string").alias("episode"), at.alias("sample_index"), seen.alias("observed")
    )
    mark = F.to_json(F.array("rule_id", "episode", F.lit(stream), F.col("sample_index").cast("string"), "observed", F.lit(expected)))
    return out.withColumn("fingerprint", F.sha2(mark, 256))


def capped(found: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` findings of each rule, a feature of reports, with how many there were."""
    ordered = W.partitionBy("rule_id").orderBy("episode", F.col("sample_index").asc_nulls_first(), "fingerprint")
    first = found.withColumn("n", F.row_number().over(ordered)).where(F.col("n") <= most).drop("n")  # cut before the shuffle, too
    return first.join(F.broadcast(found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("total"))), "rule_id")


def suppressed(found: DataFrame, baseline: DataFrame, today: datetime.date) -> DataFrame:
    """``found`` with ``suppressed``: a reviewed entry that has not expired covers it."""
    live = baseline.where(F.coalesce(F.col("expires_at") >= F.lit(today), F.lit(True))).select("fingerprint", "rule_id").distinct()
    return found.join(live.withColumn("suppressed", F.lit(True)), ["fingerprint", "rule_id"], "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def compared(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status): new, resolved or persistent."""
    b, a = before.select(*keys).distinct().withColumn("_b", F.lit(1)), after.select(*keys).distinct().withColumn("_a", F.lit(1))
    both = b.join(a, keys, "full_outer")
    return both.select(*keys, F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "resolved").otherwise("persistent").alias("status"))


def coverage(df: DataFrame, episode: str, task: Column) -> DataFrame:
    """One row: episodes, frames, shortest and longest episode, tasks."""
    per = df.groupBy(episode).agg(F.count(F.lit(1)).alias("n"))
    tasks = df.agg(F.count_distinct(task).alias("tasks"))
    sums = per.agg(F.count(F.lit(1)).alias("episodes"), F.sum("n").alias("frames"), F.min("n").alias("shortest"), F.max("n").alias("longest"))
    return sums.join(F.broadcast(tasks))
