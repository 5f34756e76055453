"""Rules on timestamps. Neighbours are stored neighbours, whatever their times say."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import finite, islands
from .base import Found, nothing, record, rule, text, union

def along_rows():
    return W.partitionBy("pos").orderBy("row_pos")


def steps(rec):
    """(pos, episode, row_pos, t, delta): finite steps between stored neighbours."""
    rows = rec.times().withColumn("delta", F.col("t") - F.lag("t").over(along_rows()))
    return rows.where(finite(F.col("delta")))


@rule("temporal.monotonic", "Timestamps increase", "error", "episode", needs="episodes timestamps", version="1.1.0")
def monotonic(rec, o):
    """Times that are not finite, repeat or fall back break the order of a sequence.

    Repair the clock's order, or record the episode again."""
    good = F.when(finite(F.col("t")), F.col("t"))
    before = F.last(good, ignorenulls=True).over(along_rows().rowsBetween(W.unboundedPreceding, -1))
    rows = rec.times().withColumn("good", good).withColumn("before", before)
    at = ["pos", "row_pos", "episode", F.lit("timestamp").alias("stream"), F.col("row_pos").alias("sample_index"), "source"]
    seen = F.when(F.isnan("t"), "nan").when(F.col("t") > 0, "inf").when(F.col("t") < 0, "-inf").otherwise("nan")
    odd = rows.where("good IS NULL").select(*at, F.lit(0).alias("step"), text("Timestamp is not finite at sample {}", "row_pos").alias("message"), F.lit(None).cast("double").alias("timestamp"), record(text=seen, number=F.lit(None).cast("double")).alias("observed"), F.lit("finite timestamp in seconds").alias("expected"))
    back = rows.where(F.col("good") - F.col("before") <= 0)
    back = back.select(*at, F.lit(1).alias("step"), text("Timestamp did not increase at sample {}", "row_pos").alias("message"), F.col("good").alias("timestamp"), record(text=F.lit(None).cast("string"), number=F.col("good") - F.col("before")).alias("observed"), F.lit("delta > 0 seconds").alias("expected"))
    return Found(odd.unionByName(back), ("pos", "step", "row_pos"))


@rule("temporal.sampling_interval", "Samples keep their interval", "warning", "episode", needs="episodes timestamps", tolerance_fraction=0.2)
def sampling_interval(rec, o):
    """An uneven interval shifts samples against what they were taken from.

    Look for a clock or a recorder that could not keep up."""
    want = rec.interval()
    off = want * float(o["tolerance_fraction"])
    bad = steps(rec).where((F.col("delta") > 0) & (F.abs(F.col("delta") - want) > off))
    rows = bad.select("pos", "row_pos", "episode", F.lit("timestamp").alias("stream"), F.col("row_pos").alias("sample_index"), F.col("t").alias("timestamp"), text("Unexpected interval in {}", "episode").alias("message"), record(interval_ms=F.col("delta") * 1000).alias("observed"))
    return Found(rows, ("pos", "row_pos"), {"interval_ms": want * 1000, "tolerance_ms": off * 1000})


@rule("temporal.max_gap", "Gaps stay below their limit", "error", "episode", needs="episodes timestamps", version="1.1.0", max_gap_ms=None, max_gap_multiplier=2.0)
def max_gap(rec, o):
    """A large gap is a stalled recorder or lost samples.

    Look for losses in transport, and record the range again."""
    set_ = o["max_gap_ms"]
    limit_ms = float(set_) if set_ is not None else 1000.0 * rec.interval() * float(o["max_gap_multiplier"])
    runs = islands(steps(rec).where(F.col("delta") > limit_ms / 1000.0), ["pos", "episode"], "row_pos", F.max("delta").alias("longest"), F.min_by("t", "row_pos").alias("timestamp"))
    seen = record(count=F.col("count"), start_sample=F.col("start"), end_sample=F.col("end"), max_gap_ms=F.col("longest") * 1000)
    rows = runs.select("pos", "start", "episode", F.lit("timestamp").alias("stream"), F.col("start").alias("sample_index"), "timestamp", text(f"{{}} gap(s) over {limit_ms:.1f} ms", "count").alias("message"), seen.alias("observed"))
    return Found(rows, ("pos", "start"), {"max_gap_ms": limit_ms, "basis": "configured" if set_ is not None else "declared_fps"})


@rule("temporal.stream_overlap", "Required streams have a value in every row", "error", "episode", required_streams=["observation.state", "action"])
def stream_overlap(rec, o):
    """Where a value is missing, an observation has no action, or an action no observation.

    Recover what was dropped, or leave incomplete episodes out."""
    parts = []
    for n, s in enumerate(o["required_streams"]):
        if not rec.is_stored(s):
            continue
        rows = rec.with_columns(s)
        kind = rows.schema[s].dataType
        empty = F.size(F.col(f"`{s}`")) == 0 if isinstance(kind, T.ArrayType) else F.length(F.col(f"`{s}`")) == 0 if isinstance(kind, T.StringType) else F.lit(False)
        parts.append(rows.where(F.col(f"`{s}`").isNull() | empty).select("pos", F.lit(n).alias("n"), "row_pos", "episode", F.lit(s).alias("stream"), F.col("row_pos").alias("sample_index"), F.lit(f"{s} has no value at a sample").alias("message"), F.lit("null or empty").alias("observed")))
    return Found(union(parts), ("pos", "n", "row_pos"), "value present for every episode sample") if parts else nothing(rec)


@rule("temporal.observation_action_delay", "Observations and actions are close in time", "error", "episode", needs="episodes stream_timestamps", of=("observation.timestamp", "action.timestamp"), max_delay_ms=100.0, note="Needs a time column of its own for each.")
def observation_action_delay(rec, o):
    """A long delay teaches wrong causes and effects.

    Synchronise the recorder's clocks."""
    from ..sources.recording import flat

    a, b = "observation.timestamp", "action.timestamp"
    rows = rec.with_columns(a, b)
    rows = rows.select("pos", "row_pos", "episode", *[flat(F.col(f"`{c}`"), rows.schema[c].dataType)[0].alias(n) for c, n in ((a, "a"), (b, "b"))]).withColumn("delay", F.col("b") - F.col("a"))
    bad = rows.where(~F.isnan("delay") & (F.abs("delay") > float(o["max_delay_ms"]) / 1000.0))
    out = bad.select("pos", "row_pos", "episode", F.lit("action").alias("stream"), F.col("row_pos").alias("sample_index"), F.col("b").alias("timestamp"), text("Action is {} ms from its observation", F.round(F.col("delay") * 1000, 1)).alias("message"), record(delay_ms=F.col("delay") * 1000).alias("observed"))
    return Found(out, ("pos", "row_pos"), {"absolute_max_delay_ms": o["max_delay_ms"]})


@rule("temporal.episode_start", "Episodes start at their usual time", "error", "episode", needs="episodes timestamps", note="A shift that all episodes share is not seen.")
def episode_start(rec, o):
    """A shifted clock makes lookups in a video return other frames.

    Shift the episode's times to where the others start."""
    limit = rec.interval()
    first = rec.times().groupBy("pos", "episode").agg(F.min_by("t", "row_pos").alias("t")).where(finite(F.col("t")))
    usual = first.agg(F.median("t").alias("usual"))
    bad = first.crossJoin(F.broadcast(usual)).where(F.abs(F.col("t") - F.col("usual")) > limit)
    rows = bad.select("pos", "episode", F.lit("timestamp").alias("stream"), F.lit(0).alias("sample_index"), text("{} starts {} s off the usual time", F.col("episode"), F.round(F.col("t") - F.col("usual"), 3)).alias("message"), F.col("t").alias("observed"), record(start_seconds=F.col("usual"), tolerance_seconds=limit).alias("expected"))
    return Found(rows)


@rule("temporal.clock_drift", "Duration fits the number of samples", "error", "episode", needs="episodes timestamps", max_drift_frames=1.0)
def clock_drift(rec, o):
    """A clock that runs fast or slow moves samples away from their video.

    Correct the clock or the declared rate."""
    interval = rec.interval()
    limit = interval * float(o["max_drift_frames"])
    ends = rec.times().groupBy("pos", "episode").agg(F.min_by("t", "row_pos").alias("a"), F.max_by("t", "row_pos").alias("b"), F.count(F.lit(1)).alias("n"), F.bool_and(finite(F.col("t"))).alias("fine"))
    ends = ends.where("fine AND n >= 2").withColumn("lasts", F.col("b") - F.col("a")).withColumn("want", (F.col("n") - 1) * F.lit(interval))
    bad = ends.where(F.abs(F.col("lasts") - F.col("want")) > limit)
    rows = bad.select("pos", "episode", F.lit("timestamp").alias("stream"), text("{} lasts {} s; {} samples make {} s", F.col("episode"), F.round("lasts", 3), F.col("n"), F.round("want", 3)).alias("message"), record(duration_seconds=F.col("lasts")).alias("observed"), record(duration_seconds=F.col("want"), tolerance_seconds=limit).alias("expected"))
    return Found(rows)
