"""Rules on per-frame statistics of video streams; decoding happens elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import islands


def black_frames(frames: DataFrame, key: str, pos: str, mean: str, sd: str, dark: float = 3.0, bright: float = 245.0, most_sd: float = 3.0) -> DataFrame:
    """Runs of frames that are all dark or all bright."""
    flat = frames.where(((F.col(mean) <= dark) | (F.col(mean) >= bright)) & (F.col(sd) <= most_sd))
    return islands(flat, [key], pos, F.max(mean).alias("mean"), F.max(sd).alias("sd"))


def frozen_frames(frames: DataFrame, key: str, pos: str, change: str, most: float = 2.0, longest: int = 5) -> DataFrame:
    """Runs of unchanged frames longer than ``longest`` frames."""
    return islands(frames.where(F.col(change) <= most), [key], pos).withColumn("count", F.col("count") + 1).where(F.col("count") > longest)


def repeated_frames(frames: DataFrame, key: str, change: str, most: float = 2.0, share: float = 0.35, ratio: float = 3.0, least: int = 20) -> DataFrame:
    """Streams many of whose frames repeat though the others change clearly."""
    same = F.col(change) <= most
    per = frames.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(same.cast("double")).alias("share"), F.median(F.when(~same, F.col(change))).alias("fresh"))
    return per.where((F.col("n") >= least) & (F.col("share") >= share) & (F.col("fresh") >= ratio * most))


def decode_counts(declared: DataFrame, frames: DataFrame, key: str, length: str, tolerance: int = 1) -> DataFrame:
    """Streams whose frames differ from the declared length."""
    got = frames.groupBy(key).agg(F.count(F.lit(1)).alias("decoded"))
    both = declared.select(key, F.col(length).cast("long").alias("length")).join(got, key, "left")
    both = both.select(key, "length", F.coalesce("decoded", F.lit(0)).alias("decoded"))
    return both.where(F.abs(F.col("decoded") - F.col("length")) > tolerance)


def bitstream(probe: DataFrame, ranges: DataFrame, file: str, error_time: str, start: str, end: str) -> DataFrame:
    """The range of each file in which its first error lies."""
    return probe.join(ranges, file).where((F.col(start) <= F.col(error_time)) & (F.col(error_time) < F.col(end)))


def timeline(ranges: DataFrame, file: str, start: str, end: str, tolerance: float) -> DataFrame:
    """Ranges that do not begin where the last one of their file ended."""
    before = F.lag(end).over(W.partitionBy(file).orderBy(start, end))
    return ranges.select(file, start, (F.col(start) - before).alias("gap")).where(F.abs("gap") > tolerance)


def camera_identity(means: DataFrame, key: str, stream: str, cells: str, least: int = 5) -> DataFrame:
    """(key, stream, looks_like, own, other): mean frames far closer to another stream's centre.

    Centres are medians cell by cell, one row for each stream and cell.
    """
    long = means.select(key, stream, F.posexplode(F.col(cells).cast("array<double>")).alias("cell", "x"))
    centre = long.groupBy(stream, "cell").agg(F.median("x").alias("c"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    apart = long.join(centre.select(F.col(stream).alias("centre"), "cell", "c"), "cell").groupBy(key, stream, "centre").agg(F.avg(F.abs(F.col("x") - F.col("c"))).alias("d"))
    own = apart.where(F.col(stream) == F.col("centre")).select(key, F.col("d").alias("own"))
    other = apart.where(F.col(stream) != F.col("centre")).groupBy(key, stream).agg(F.min(F.struct("d", "centre")).alias("m"))
    return other.join(own, key).where(F.col("m.d") < 0.5 * F.col("own")).select(key, stream, F.col("m.centre").alias("looks_like"), "own", F.col("m.d").alias("other"))
