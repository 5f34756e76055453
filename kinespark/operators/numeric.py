"""Rules on values, and on episodes against the population of episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import finite, population, row_pos

_X = "x"


def finite_values(df: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """Rows with components that are not finite, and which."""
    v = F.col(vector).cast("array<double>")
    bad = F.filter(F.transform(v, lambda x, i: F.when(~finite(x), i)), lambda i: i.isNotNull())
    rows = df.select(key, row_pos(key, order).alias("row_pos"), bad.alias("dims"))
    return rows.where(F.size("dims") > 0)


def configured_bounds(df: DataFrame, key: str, order: str, vector: str, low: float, high: float) -> DataFrame:
    """Rows with a component outside the limits; NaN is inside."""
    out = F.filter(F.col(vector).cast("array<double>"), lambda x: ~F.isnan(x) & ((x < low) | (x > high)))
    rows = df.select(key, row_pos(key, order).alias("row_pos"), F.size(out).alias("outside"), F.array_max(F.transform(out, F.abs)).alias("largest"))
    return rows.where("outside > 0")


def discontinuity(df: DataFrame, key: str, order: str, vector: str, limit: float) -> DataFrame:
    """Rows a component of which moved by more than the limit."""
    rows = df.select(key, row_pos(key, order).alias("row_pos"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("p", F.lag("v").over(W.partitionBy(key).orderBy("row_pos")))
    step = F.array_max(F.zip_with("v", "p", lambda a, b: F.abs(a - b)))
    return rows.select(key, "row_pos", step.alias("step")).where(F.col("step") > limit)


def clean(long: DataFrame, key: str) -> DataFrame:
    """The rows of episodes whose values are all finite, at least three for each component."""
    per = long.groupBy(key, "dim").agg(F.bool_and(F.coalesce(finite(F.col(_X)), F.lit(False))).alias("fine"), F.count(F.lit(1)).alias("n"))
    bad = per.where("NOT fine OR n < 3").select(key).distinct()
    return long.join(bad, key, "left_anti")


def _few(bad: DataFrame, episodes: Column) -> DataFrame:
    """Rows of components in which few episodes stand out; ``episodes`` reads their number."""
    flagged = bad.groupBy("dim").agg(F.count(F.lit(1)).alias("_f"))
    return bad.join(F.broadcast(flagged), "dim").where(F.col("_f") <= F.greatest(F.lit(1), F.ceil(episodes * 0.1))).drop("_f")


def _per_dim(long: DataFrame, key: str, order: str) -> DataFrame:
    """Steps of every component, along stored order."""
    return long.withColumn("step", F.abs(F.col(_X) - F.lag(_X).over(W.partitionBy(key, "dim").orderBy(order))))


def outlier_jumps(long: DataFrame, key: str, order: str, factor: float = 5.0, least_range: float = 0.05) -> DataFrame:
    """(key, first, jumps, largest): rows with a step over the usual largest one times ``factor``.

    ``largest`` is the largest step of any component at the first such row. Components of eight or
    fewer different values, or without a usual range, do not count; nor do episodes that are not clean.
    """
    rows = clean(long, key)
    steps = _per_dim(rows, key, order)
    per = steps.groupBy(key, "dim").agg(F.max("step").alias("most"), (F.max(_X) - F.min(_X)).alias("span"), F.slice(F.collect_set(_X), 1, 9).alias("some"))
    varied = per.select("dim", F.explode("some").alias("v")).groupBy("dim").agg(F.count_distinct("v").alias("values")).where("values > 8").select("dim")
    usual = per.groupBy("dim").agg(F.median("most").alias("usual"), F.median("span").alias("range"))
    limit = usual.join(varied, "dim").where("range > 0").select("dim", F.greatest(F.col("usual") * factor, F.col("range") * least_range).alias("limit"))
    over = steps.join(F.broadcast(limit), "dim", "left").groupBy(key, order).agg(F.max("step").alias("step"), F.max(F.coalesce(F.col("step") > F.col("limit"), F.lit(False))).alias("bad")).where("bad")
    return over.groupBy(key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("jumps"), F.min_by("step", order).alias("largest"))


def episode_envelope(long: DataFrame, key: str, spread: float = 1.0, least_episodes: int = 5) -> DataFrame:
    """Clean episodes whose extremes lie outside the usual envelope, where few do so."""
    per = clean(long, key).groupBy(key, "dim").agg(F.max(_X).alias("hi"), F.min(_X).alias("lo"))
    out = population(per, "dim", F.percentile("hi", F.lit(0.9)).alias("top"), F.percentile("lo", F.lit(0.1)).alias("bottom"), F.count(F.lit(1)).alias("n"))
    margin = F.greatest(F.col("top") - F.col("bottom"), F.lit(1e-9)) * spread
    bad = out.where((F.col("n") >= least_episodes) & ((F.col("hi") > F.col("top") + margin) | (F.col("lo") < F.col("bottom") - margin)))
    return _few(bad, F.col("n")).select(key, "dim", "hi", "lo")


def stuck_channels(long: DataFrame, key: str, least_episodes: int = 5, varying: float = 0.9) -> DataFrame:
    """Components that stand still in a clean episode though they move in most others."""
    per = clean(long, key).groupBy(key, "dim").agg((F.max(_X) == F.min(_X)).alias("still"))
    per = population(per, "dim", F.count(F.lit(1)).alias("n"), F.count_if(~F.col("still")).alias("moving"))
    return per.where(F.col("still") & (F.col("n") >= least_episodes) & (F.col("moving") >= varying * (F.col("n") - 1))).select(key, "dim")


def noise_level(long: DataFrame, key: str, order: str, ratio: float = 5.0, least_episodes: int = 5) -> DataFrame:
    """Components of clean episodes whose second differences are far noisier than usual."""
    w = W.partitionBy(key, "dim").orderBy(order)
    second = F.abs(F.col(_X) - 2 * F.lag(_X).over(w) + F.lag(_X, 2).over(w))
    per = clean(long, key).withColumn("d2", second).groupBy(key, "dim").agg(
        (F.median("d2") * 1.4826 / 6**0.5).alias("noise"), F.max(_X).alias("hi"), F.min(_X).alias("lo")
    )
    per = population(per, "dim", F.count(F.lit(1)).alias("n"), F.median("noise").alias("usual"), (F.max("hi") - F.min("lo")).alias("range"))
    floor = F.greatest("usual", F.col("range") * 1e-3)
    bad = per.where((F.col("n") >= least_episodes) & (F.col("noise") > floor * ratio) & (F.col("range") > 0))
    return _few(bad, F.col("n")).select(key, "dim", "noise")


def coupling(df: DataFrame, key: str, action: str, state: str, least_episodes: int = 5, usual_least: float = 0.7, drop: float = 0.5) -> DataFrame:
    """Episodes whose action and state correlate far less than is usual."""
    a, s = F.col(action).cast("double"), F.col(state).cast("double")
    m = df.groupBy(key).agg(F.avg(a * s).alias("as"), F.avg(a).alias("ma"), F.avg(s).alias("ms"), F.avg(a * a).alias("aa"), F.avg(s * s).alias("ss"))
    spread = F.sqrt(F.greatest((F.col("aa") - F.col("ma") ** 2) * (F.col("ss") - F.col("ms") ** 2), F.lit(0.0)))
    r = m.select(key, F.try_divide(F.col("as") - F.col("ma") * F.col("ms"), spread).alias("r"))
    r = r.crossJoin(F.broadcast(r.agg(F.median("r").alias("usual"), F.count("r").alias("n"))))  # one row of aggregates
    return r.where((F.col("n") >= least_episodes) & (F.col("usual") >= usual_least) & (F.col("r") < F.col("usual") - drop)).select(key, "r", "usual")
