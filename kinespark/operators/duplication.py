"""Exact and near duplicates of episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def digests(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, digest) over an episode's values in stored order.

    Rows are hashed with their place and the hashes summed, so what tasks hold does not grow with an
    episode; values are told apart from each other and from null by a JSON text.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy(order))
    values = F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))
    rows = df.select(key, place.alias("_p"), values.alias("_v"))
    sums = rows.groupBy(key).agg(
        F.sum(F.xxhash64("_p", "_v").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("_v", "_p", F.lit(1))).alias("b"), F.count(F.lit(1)).alias("n")
    )
    return sums.select(key, F.sha2(F.concat_ws(":", "a", "b", "n"), 256).alias("digest"))


def exact_episodes(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, first): episodes whose values equal those of an earlier one."""
    found = digests(df, key, order, columns)
    return found.join(found.groupBy("digest").agg(F.min(key).alias("first")), "digest").where(F.col(key) > F.col("first")).select(key, "first")


def closest_earlier(vectors: DataFrame, key: str, vector: str, group: str, limit: float) -> DataFrame:
    """(key, closest, distance, group): the closest earlier vector of the group within the limit, if not equal.

    Distance is the root mean square of differences. The means of a quarter of the components
    differ by at most twice the distance, so vectors are dealt by the cell of one such mean, and
    the means of the other quarters rule out most pairs; vectors themselves are compared last.
    """
    v = vectors.select(F.col(key), F.col(group).alias("_g"), F.col(vector).cast("array<double>").alias("_v"))
    n = F.size("_v")
    quarter = F.greatest(F.ceil(n / 4).cast("int"), F.lit(1))
    mean = lambda i: F.aggregate(F.slice("_v", F.least(i * quarter, n - quarter) + 1, quarter), F.lit(0.0), lambda a, x: a + x) / quarter
    wide = 2 * limit * (1 + 1e-9) + 1e-12
    v = v.select(key, "_g", "_v", *[mean(F.lit(i)).alias(f"_m{i}") for i in range(4)]).withColumn("_c", F.floor(F.col("_m0") / wide))
    a = v.select(key, "_g", "_v", *[f"_m{i}" for i in range(4)], F.explode(F.array(*[F.col("_c") + i for i in (-1, 0, 1)])).alias("_c"))
    b = v.select(F.col(key).alias("closest"), F.col("_g").alias("_h"), F.col("_v").alias("_u"), *[F.col(f"_m{i}").alias(f"_k{i}") for i in range(4)], F.col("_c").alias("_d"))
    near = (F.col("_g") == F.col("_h")) & (F.col("_c") == F.col("_d")) & (F.col(key) > F.col("closest")) & (F.size("_v") == F.size("_u"))
    for i in range(4):
        near = near & (F.abs(F.col(f"_m{i}") - F.col(f"_k{i}")) <= wide)
    square = F.aggregate(F.zip_with("_v", "_u", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("_v")
    pairs = a.join(b, near).withColumn("distance", F.sqrt(square)).where((F.col("distance") > 0) & (F.col("distance") <= limit))
    best = pairs.groupBy(key, F.col("_g").alias(group)).agg(F.min(F.struct("distance", "closest")).alias("m"))
    return best.select(key, F.col("m.closest").alias("closest"), F.col("m.distance").alias("distance"), group)


def near_episodes(vectors: DataFrame, key: str, vector: str, group: str, limit: float) -> DataFrame:
    """(key, closest, distance): the closest earlier episode of the same shape within the limit.

    Distance is the root mean square of differences in units of the population's deviation.
    """
    v = vectors.select(F.col(key), F.col(group), F.col(vector).cast("array<double>").alias("v"))
    spread = v.select(F.explode("v").alias("x")).agg(F.greatest(F.stddev_pop("x"), F.lit(1e-9)).alias("sd")).first().sd or 1e-9
    found = closest_earlier(v.withColumn("v", F.transform("v", lambda x: x / F.lit(spread))), key, "v", group, limit)
    return found.select(key, "closest", "distance")
