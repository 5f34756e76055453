"""Rules on values by themselves, and exact copies."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import NotApplicable
from ..functions.series import finite
from .base import Found, nothing, record, rule, text, union


@rule("numeric.finite_values", "Values are finite", "error", "sample", needs="episodes numeric", streams=[])
def finite_values(rec, o):
    """One NaN or infinite value can spoil a whole training run.

    Repair or leave out the samples named."""
    parts = []
    for n, s in enumerate(o["streams"] or rec.numeric_streams()):
        if not rec.is_stored(s):
            continue
        dims = F.filter(F.transform("v", lambda x, i: F.when(x.isNotNull() & ~finite(x), i)), lambda i: i.isNotNull())
        bad = rec.vectors(s).withColumn("dims", dims).where(F.size("dims") > 0)
        parts.append(bad.select("pos", F.lit(n).alias("n"), "row_pos", "episode", F.lit(s).alias("stream"), F.col("row_pos").alias("sample_index"), F.lit(f"Value of {s} is not finite").alias("message"), record(non_finite_dimensions=F.col("dims")).alias("observed")))
    return Found(union(parts), ("pos", "n", "row_pos"), "all values finite") if parts else nothing(rec)


def _limit(rec, stream: str, value: Any, what: str) -> list[float] | float | None:
    """A limit for all dimensions, or one each, whose number must be the stream's."""
    if value is None or isinstance(value, (int, float)):
        return value
    widths = {r.w for r in rec.vectors(stream).where("v IS NOT NULL").select(F.size("v").alias("w")).distinct().limit(3).collect()}
    if widths - {len(value)} and len(value) != 1:
        raise ValueError(f"{what} for {stream} do not match its shape")
    return [float(x) for x in value] if len(value) != 1 else float(value[0])


def _at(limit, i):
    return F.get(F.array(*[F.lit(x) for x in limit]), i) if isinstance(limit, list) else F.lit(float(limit))


def _outside(low, high):
    def test(x, i):
        bad = F.lit(False)
        if low is not None:
            bad = bad | (x < _at(low, i))
        if high is not None:
            bad = bad | (x > _at(high, i))
        return x.isNotNull() & ~F.isnan(x) & bad

    return test


@rule("numeric.configured_bounds", "Values keep to their limits", "error", "sample", needs="episodes numeric", limits={}, note="Needs limits of the robot or the task.")
def configured_bounds(rec, o):
    """Values beyond a limit are corrupt or unsafe.

    Check units and calibration."""
    if not o["limits"]:
        raise NotApplicable("no limits are configured")
    parts = []
    for n, (s, of) in enumerate(o["limits"].items()):
        if not rec.is_stored(s):
            continue
        low, high = _limit(rec, s, of.get("min"), "limits"), _limit(rec, s, of.get("max"), "limits")

        bad = rec.vectors(s).where(F.exists(F.transform("v", _outside(low, high)), lambda b: b))
        shown = record(min=F.lit(str(low) if low is not None else "-inf"), max=F.lit(str(high) if high is not None else "inf"))
        parts.append(bad.select("pos", F.lit(n).alias("n"), "row_pos", "episode", F.lit(s).alias("stream"), F.col("row_pos").alias("sample_index"), F.lit(f"{s} is beyond its limits").alias("message"), F.col("v").alias("observed"), shown.alias("expected")))
    return Found(union(parts), ("pos", "n", "row_pos")) if parts else nothing(rec)


@rule("numeric.discontinuity", "Values move without jumps", "error", "sample", needs="episodes numeric", max_delta={}, note="Needs the largest step of each stream.")
def discontinuity(rec, o):
    """A jump in one sample is a reset encoder, another unit, or corrupt data.

    Check encoders and units, and split the recording at the jump."""
    if not o["max_delta"]:
        raise NotApplicable("no largest steps are configured")
    parts = []
    for n, (s, value) in enumerate(o["max_delta"].items()):
        if not rec.is_stored(s):
            continue
        limit = _limit(rec, s, value, "max_delta")
        rows = rec.vectors(s).withColumn("p", F.lag("v").over(W.partitionBy("pos").orderBy("row_pos")))
        rows = rows.withColumn("d", F.zip_with("v", "p", lambda a, b: F.abs(a - b)))
        bad = rows.where(F.exists(F.transform("d", _outside(None, limit)), lambda b: b))
        shown = record(max_delta=F.lit(limit) if not isinstance(limit, list) else F.array(*[F.lit(x) for x in limit]))
        parts.append(bad.select("pos", F.lit(n).alias("n"), "row_pos", "episode", F.lit(s).alias("stream"), F.col("row_pos").alias("sample_index"), F.lit(f"{s} jumps in one sample").alias("message"), record(absolute_delta=F.col("d")).alias("observed"), shown.alias("expected")))
    return Found(union(parts), ("pos", "n", "row_pos")) if parts else nothing(rec)


@rule("duplication.exact_episodes", "Episodes are not exact copies", "error", "dataset", needs="episodes numeric", streams=[], note="Compares numeric streams alone.")
def exact_episodes(rec, o):
    """A copy of a demonstration counts twice in training and leaks into evaluation.

    Keep one of the copies."""
    streams = o["streams"] or rec.numeric_streams()
    if not streams:
        return nothing(rec)
    per = rec.episodes.select("pos", "episode")
    names = []
    for n, s in enumerate(streams):
        if not rec.is_stored(s):
            continue
        # sums of hashes over (place, value): what tasks hold does not grow with an episode
        value = F.col("v").cast("string")
        rows = rec.vectors(s).select("pos", F.xxhash64("row_pos", value).alias("a"), F.xxhash64(value, "row_pos", F.lit(n)).alias("b"))
        sums = rows.groupBy("pos").agg(F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.bit_xor("b").alias("b"), F.count(F.lit(1)).alias("c"))
        per = per.join(sums.select("pos", F.concat_ws(":", "a", "b", "c").alias(f"s{n}")), "pos", "left")
        names.append(F.coalesce(F.col(f"s{n}"), F.lit("missing")))
    digest = F.sha2(F.to_json(F.array(*names)), 256) if names else F.sha2(F.lit("missing"), 256)
    per = per.select("pos", "episode", digest.alias("digest"))
    first = per.groupBy("digest").agg(F.min(F.struct("pos", "episode")).alias("f"))
    bad = per.join(first, "digest").where(F.col("pos") > F.col("f.pos"))
    seen = record(duplicate_of=F.col("f.episode"), digest=F.substring("digest", 1, 16))
    return Found(bad.select("pos", "episode", text("{} is an exact copy of {}", F.col("episode"), F.col("f.episode")).alias("message"), seen.alias("observed")), expected="unique numeric trajectory")
