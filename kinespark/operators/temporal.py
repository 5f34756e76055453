"""Rules on the order and spacing of timestamps; every ``t`` is a number, neighbours are stored neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import along, finite, islands, row_pos


def monotonic(df: DataFrame, key: str, order: str, t: str) -> DataFrame:
    """Rows whose time is not finite or does not exceed the last finite one before it."""
    good = F.when(finite(F.col(t).cast("double")), F.col(t))
    before = F.last(good, ignorenulls=True).over(along(key, order).rowsBetween(W.unboundedPreceding, -1))
    rows = df.select(key, row_pos(key, order).alias("row_pos"), good.alias("_t"), (good - before).alias("delta"))
    return rows.where(F.col("_t").isNull() | (F.col("delta") <= 0)).drop("_t")


def deltas(df: DataFrame, key: str, order: str, t: str) -> DataFrame:
    """(key, row_pos, delta) of every row but each episode's first."""
    rows = df.select(key, row_pos(key, order).alias("row_pos"), (F.col(t) - F.lag(t).over(along(key, order))).alias("delta"))
    return rows.where(F.col("delta").isNotNull())


def sampling_interval(df: DataFrame, key: str, order: str, t: str, interval: float, tolerance: float = 0.2) -> DataFrame:
    """Positive intervals that are off the nominal one by more than the tolerated fraction."""
    return deltas(df, key, order, t).where((F.col("delta") > 0) & (F.abs(F.col("delta") - interval) > tolerance * interval))


def max_gap(df: DataFrame, key: str, order: str, t: str, limit: float) -> DataFrame:
    """Runs of neighbouring intervals over the limit."""
    return islands(deltas(df, key, order, t).where(F.col("delta") > limit), [key], "row_pos", F.max("delta").alias("longest"))


def stream_overlap(df: DataFrame, key: str, order: str, streams: list[str]) -> DataFrame:
    """Rows in which a required stream is missing: null or empty, not NaN."""
    rows = df.select(key, row_pos(key, order).alias("row_pos"), *streams)

    def empty(s: str) -> Column:
        kind = df.schema[s].dataType.typeName()
        return F.size(s) == 0 if kind in ("array", "map") else F.length(s) == 0 if kind in ("string", "binary") else F.lit(False)

    missing = F.filter(F.array(*[F.when(F.col(s).isNull() | empty(s), F.lit(s)) for s in streams]), lambda x: x.isNotNull())
    return rows.select(key, "row_pos", F.explode(missing).alias("stream"))


def delay(df: DataFrame, key: str, order: str, first: str, second: str, limit: float) -> DataFrame:
    """Rows whose two clocks are further apart than the limit."""
    rows = df.select(key, row_pos(key, order).alias("row_pos"), (F.col(second) - F.col(first)).alias("delay"))
    return rows.where(F.abs("delay") > limit)


def episode_start(df: DataFrame, key: str, order: str, t: str, limit: float) -> DataFrame:
    """Episodes whose first time is off the median first time by more than the limit."""
    first = df.groupBy(key).agg(F.min_by(t, order).cast("double").alias("first"))
    usual = first.agg(F.median("first").alias("usual"))
    return first.crossJoin(F.broadcast(usual)).where(F.abs(F.col("first") - F.col("usual")) > limit)  # one row of usual


def clock_drift(df: DataFrame, key: str, order: str, t: str, interval: float, most: float = 1.0) -> DataFrame:
    """Episodes whose duration differs from (n - 1) intervals by more than ``most`` intervals."""
    ends = df.groupBy(key).agg(
        F.min_by(t, order).alias("first"), F.max_by(t, order).alias("last"), F.count(F.lit(1)).alias("n"),
        F.bool_and(finite(F.col(t).cast("double"))).alias("fine"),
    )
    drift = (F.col("last") - F.col("first")) - (F.col("n") - 1) * interval
    return ends.where("fine AND n >= 2").select(key, "n", drift.cast("double").alias("drift")).where(F.abs("drift") > most * interval)


def signal_alignment(df: DataFrame, key: str, order: str, action: str, state: str, most_lag: int = 10) -> DataFrame:
    """(key, lag, strength): the lag, of either sign, at which two speeds correlate best.

    Every lag is one more pair of samples for a row, so a long episode stays many rows.
    """
    speed = lambda c: F.abs(F.col(c) - F.lag(c).over(along(key, order)))
    rows = df.select(key, F.col(order).alias("_o"), speed(action).alias("a"), speed(state).alias("s")).where("a IS NOT NULL")
    w = W.partitionBy(key).orderBy("_o")
    lags = range(-most_lag, most_lag + 1)
    moved = rows.select(key, "a", *[(F.lag("s", k) if k >= 0 else F.lead("s", -k)).over(w).alias(f"_s{i}") for i, k in enumerate(lags)])
    pairs = F.array(*[F.struct(F.lit(-k).alias("lag"), F.col(f"_s{i}").alias("s")) for i, k in enumerate(lags)])
    long = moved.select(key, "a", F.explode(pairs).alias("p")).select(key, "a", "p.lag", "p.s").where("s IS NOT NULL")
    m = long.groupBy(key, "lag").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("a") * F.col("s")).alias("as"), F.avg("a").alias("ma"), F.avg("s").alias("ms"),
        F.avg(F.col("a") * F.col("a")).alias("aa"), F.avg(F.col("s") * F.col("s")).alias("ss"),
    )
    spread = F.sqrt(F.greatest((F.col("aa") - F.col("ma") ** 2) * (F.col("ss") - F.col("ms") ** 2), F.lit(0.0)))
    strength = F.try_divide(F.col("as") - F.col("ma") * F.col("ms"), spread)
    best = m.select(key, "lag", F.round(strength, 8).alias("strength")).where("strength IS NOT NULL")  # so that rounding decides no tie
    top = best.groupBy(key).agg(F.max(F.struct("strength", -F.abs("lag"), "lag")).alias("b"))
    return top.select(key, F.col("b.lag").alias("lag"), F.col("b.strength").alias("strength"))
