"""Rules on decoded frames and on video files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import NotApplicable
from ..functions.series import finite, islands
from ..operators import frames as kernels
from .base import Found, record, rule, text, union

_VIDEO = "episodes video"
#: Motion counts where it exceeds so many times a dimension's own noise.
NOISE_FACTOR = 6.0
_REACH = 10


def _located(rows: DataFrame, *more) -> list:
    return ["pos", "episode", "stream", "source", *more]


def _order(rec) -> DataFrame:
    return F.broadcast(rec.spark.createDataFrame([(s, n) for n, s in enumerate(rec.video_streams())], "stream string, n int"))


@rule("video.decode", "All frames decode", "error", "episode", "video", _VIDEO, version="1.1.0", frame_count_tolerance=1)
def decode(rec, o):
    """Frames that are missing or do not decode leave samples without their picture.

    Encode or copy the video again from its source."""
    tolerance = int(o["frame_count_tolerance"])
    wanted = rec.episodes.crossJoin(_order(rec)).select("pos", "n", "episode", "stream", "length", F.col("video_files")[F.col("stream")].alias("source"))
    got = rec.frames().groupBy("pos", "stream").agg(F.count(F.lit(1)).alias("decoded"))
    both = wanted.join(got, ["pos", "stream"], "left").withColumn("decoded", F.coalesce("decoded", F.lit(0)))
    bad = both.where(F.col("source").isNull() | (F.abs(F.col("decoded") - F.col("length")) > tolerance))
    gone = F.col("source").isNull()
    message = F.when(gone, text("{} has no video reference", "stream")).otherwise(text("Decoded {} of {} frames", "decoded", "length"))
    return Found(bad.select("pos", "n", "episode", "stream", "source", message.alias("message"), F.when(~gone, record(decoded_frames=F.col("decoded"))).alias("observed"), record(episode_frames=F.col("length"), tolerance=tolerance).alias("expected")), ("pos", "n"))


def motion(rec, o) -> DataFrame | None:
    """(pos, stream, dim, row_pos, s, noise, scale, n): smoothed values of streams that show motion."""
    parts = []
    for m in o["motion_streams"]:
        if not rec.is_stored(m):
            continue
        rows = rec.vectors(m)
        even = rows.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b"), F.bool_and(F.col("v").isNotNull()).alias("fine")).where("fine AND a = b AND n >= 2")
        long = rows.join(even.select("pos", "n"), "pos").select("pos", "n", "row_pos", F.posexplode("v").alias("dim", "x")).withColumn("x", F.when(finite(F.col("x")), F.col("x")).otherwise(0.0))
        by = W.partitionBy("pos", "dim").orderBy("row_pos")
        whole = W.partitionBy("pos", "dim")
        # a mean over up to five samples; beyond the ends the first and the last value stand in
        k = F.least(F.lit(5), F.col("n"))
        left, right = F.floor(k / 2), k - 1 - F.floor(k / 2)
        inside = F.lit(0.0)
        for j in range(-2, 3):
            value = F.lag("x", -j).over(by) if j < 0 else F.lead("x", j).over(by)
            value = F.coalesce(value, F.col("x0") if j < 0 else F.col("x1"))
            inside = inside + F.when((j >= -left) & (j <= right), value).otherwise(0.0)
        long = long.withColumn("x0", F.first("x").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).withColumn("x1", F.last("x").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        second = F.abs(F.col("x") - 2 * F.lag("x").over(by) + F.lag("x", 2).over(by))
        long = long.withColumn("s", inside / k).withColumn("d2", second)
        per = long.groupBy("pos", "dim").agg(F.coalesce(F.median("d2") * 1.4826 / 6**0.5, F.lit(0.0)).alias("noise"), F.greatest(F.max("x") - F.min("x"), F.lit(1e-9)).alias("scale"))
        parts.append(long.select("pos", "n", F.lit(m).alias("motion"), "dim", "row_pos", "s").join(per, ["pos", "dim"]))
        del whole
    return union(parts)


@rule(
    "video.frozen_frames", "Video moves while the robot does", "warning", "sample", "video", _VIDEO, version="2.0.0", max_consecutive_frames=5, max_cell_difference=2.0, stride=1,
    motion_streams=["action", "observation.state"], motion_delta_threshold=0.001, min_run_displacement=0.05, note="Needs a stream of motion; a still scene is no finding.",
)
def frozen_frames(rec, o):
    """A camera that froze shows a robot that moves where it no longer is.

    Check the camera and its link, and leave the range out."""
    stride, limit = int(o["stride"]), float(o["max_cell_difference"])
    moves = motion(rec, o)
    if moves is None:
        return Found(rec.spark.createDataFrame([], "pos long, message string"))
    steps = rec.frames().where("cell_change IS NOT NULL").withColumn("at", F.col("frame") - 1).where(F.col("at") % stride == 0).withColumn("k", F.expr(f"at div {stride}"))
    runs = islands(steps.where(F.col("cell_change") <= limit), ["pos", "episode", "stream", "source"], "k")
    runs = runs.select("pos", "episode", "stream", "source", (F.col("start") * stride).alias("a"), (F.col("end") * stride + 1).alias("b")).where(F.col("b") - F.col("a") + 1 > int(o["max_consecutive_frames"]))
    last = F.col("n") - 1
    at = runs.join(moves.select("pos", "motion", F.col("n")).distinct(), "pos").withColumn("e", F.least("b", last)).withColumn("f", F.least("a", F.col("e")))
    start = moves.select("pos", "motion", "dim", F.col("row_pos").alias("f"), F.col("s").alias("s0"), "noise", "scale")
    end = moves.select("pos", "motion", "dim", F.col("row_pos").alias("e"), F.col("s").alias("s1"))
    moved = at.join(start, ["pos", "motion", "f"]).join(end, ["pos", "motion", "dim", "e"]).withColumn("m", F.abs(F.col("s1") - F.col("s0")))
    means = F.col("m") > F.greatest(F.col("noise") * NOISE_FACTOR, F.lit(float(o["motion_delta_threshold"])))
    keys = ["pos", "episode", "stream", "source", "a", "b"]
    by_stream = moved.groupBy(*keys, "motion").agg(F.sqrt(F.avg(F.when(means, (F.col("m") / F.col("scale")) ** 2).otherwise(0.0))).alias("d"))
    bad = by_stream.groupBy(*keys).agg(F.min("d").alias("d")).where(F.col("d") >= float(o["min_run_displacement"])).join(_order(rec), "stream")
    count = F.col("b") - F.col("a") + 1
    seen = record(start_frame=F.col("a"), end_frame=F.col("b"), consecutive_frames=count, run_displacement=F.col("d"))
    rows = bad.select("pos", "n", "a", "episode", "stream", "source", F.col("a").alias("sample_index"), (F.col("a") / float(rec.fps or 1.0)).alias("timestamp"), text("{} froze for {} frames while the robot moved", F.col("stream"), count).alias("message"), seen.alias("observed"))
    return Found(rows, ("pos", "n", "a"), {"max_cell_difference_above": limit})


@rule(
    "video.repeated_frames", "Frames do not repeat while the robot moves", "warning", "episode", "video", _VIDEO, max_cell_difference=2.0, min_repeat_fraction=0.35, min_changed_ratio=3.0,
    min_moving_transitions=20, motion_streams=["action", "observation.state"], motion_delta_threshold=0.001,
)
def repeated_frames(rec, o):
    """A camera at half the rate shows every picture twice.

    Check the camera's rate and how it was resampled."""
    moves = motion(rec, o)
    if moves is None:
        return Found(rec.spark.createDataFrame([], "pos long, message string"))
    limit = float(o["max_cell_difference"])
    reach = F.greatest(F.lit(1), F.least(F.lit(_REACH), F.col("n") - 1))
    by = W.partitionBy("pos", "motion", "dim").orderBy("row_pos")
    ahead = F.lit(None).cast("double")
    for k in range(1, _REACH + 1):
        ahead = F.when(reach == k, F.lead("s", k).over(by)).otherwise(ahead)
    above = F.abs(ahead - F.col("s")) > F.greatest(F.col("noise") * NOISE_FACTOR, F.lit(float(o["motion_delta_threshold"])))
    starts = moves.withColumn("above", F.coalesce(above, F.lit(False))).groupBy("pos", "motion", "n", "row_pos").agg(F.bool_or("above").alias("above"))
    spans = W.partitionBy("pos", "motion").orderBy("row_pos").rowsBetween(-(_REACH - 1), 0)
    since = F.max(F.when(F.col("above"), F.col("row_pos"))).over(spans)
    moving = starts.withColumn("moving", F.coalesce(F.col("row_pos") - since < reach, F.lit(False))).groupBy("pos", "row_pos").agg(F.bool_and("moving").alias("moving"))
    steps = rec.frames().where("cell_change IS NOT NULL").withColumn("row_pos", F.col("frame") - 1).join(moving.where("moving"), ["pos", "row_pos"])
    same = F.col("cell_change") <= limit
    per = steps.groupBy("pos", "episode", "stream", "source").agg(F.count(F.lit(1)).alias("m"), F.avg(same.cast("double")).alias("share"), F.median(F.when(~same, F.col("cell_change"))).alias("fresh"))
    bad = per.where((F.col("m") >= int(o["min_moving_transitions"])) & (F.col("share") >= float(o["min_repeat_fraction"])) & (F.col("fresh") >= limit * float(o["min_changed_ratio"]))).join(_order(rec), "stream")
    rows = bad.select("pos", "n", "episode", "stream", "source", text("{} repeated {} percent of frames while the robot moved", F.col("stream"), F.round(F.col("share") * 100).cast("int")).alias("message"), record(repeat_fraction=F.col("share"), moving_transitions=F.col("m")).alias("observed"))
    return Found(rows, ("pos", "n"), {"repeat_fraction_below": o["min_repeat_fraction"]})


@rule("video.black_frames", "Frames are neither black nor blank", "error", "sample", "video", _VIDEO, version="1.2.0", max_mean_intensity=3.0, min_saturated_intensity=245.0, max_stddev=3.0, stride=1)
def black_frames(rec, o):
    """Frames all dark or all bright carry no picture.

    Check exposure, covers and the video's encoding."""
    stride = int(o["stride"])
    rows = rec.frames().where(F.col("frame") % stride == 0).withColumn("k", F.expr(f"frame div {stride}"))
    flat = ((F.col("mean") <= float(o["max_mean_intensity"])) | (F.col("mean") >= float(o["min_saturated_intensity"]))) & (F.col("sd") <= float(o["max_stddev"]))
    runs = islands(rows.where(flat), ["pos", "episode", "stream", "source"], "k", F.max("mean").alias("mean"), F.max("sd").alias("sd"), F.min("ts").alias("timestamp")).join(_order(rec), "stream")
    a, b = F.col("start") * stride, F.col("end") * stride
    seen = record(start_frame=a, end_frame=b, count=F.col("count"), max_mean_intensity=F.col("mean"), max_stddev=F.col("sd"))
    out = runs.select("pos", "n", "start", "episode", "stream", "source", a.alias("sample_index"), "timestamp", text("{} black or blank frame(s) from {} to {}", F.col("count"), a, b).alias("message"), seen.alias("observed"))
    return Found(out, ("pos", "n", "start"), {"mean_or_stddev_above": [o["max_mean_intensity"], o["max_stddev"]]})


def _ranges(rec) -> DataFrame:
    """(pos, episode, stream, source, length, a, b) of every episode's range in a video file."""
    e = rec.episodes.select("pos", "episode", "length", F.explode("video_files").alias("stream", "source"), "video_ranges")
    r = F.col("video_ranges")[F.col("stream")]
    return e.select("pos", "episode", "stream", "source", "length", F.coalesce(r["start"], F.lit(0.0)).alias("a"), F.coalesce(r["end"], F.lit(0.0)).alias("b"))


def _probes(rec) -> DataFrame:
    """(source, frame_times, decode_errors, first_error_time) of video files."""
    if rec.probes is None:
        raise NotApplicable("container checks need a prober of video files, and none is there")
    return rec.probes


@rule("video.bitstream", "Video streams decode without errors", "error", "episode", "video", _VIDEO)
def bitstream(rec, o):
    """An error in a stream makes frames wrong that look as if they decoded.

    Encode or copy the video again from its source."""
    bad = _probes(rec).where("decode_errors > 0")
    files = _ranges(rec).join(_order(rec), "stream")
    hit = files.join(bad, "source").withColumn("inside", (F.col("a") <= F.col("first_error_time")) & (F.col("first_error_time") < F.col("b")))
    per = hit.groupBy("n", "stream", "source", "decode_errors", "first_error_time").agg(F.min(F.when(F.col("inside"), F.struct("pos", "episode"))).alias("e"))
    rows = per.select("n", F.col("e.episode").alias("episode"), "stream", "source", F.col("first_error_time").alias("timestamp"), text("{} decode error(s) in {}", "decode_errors", "source").alias("message"), record(decode_errors=F.col("decode_errors")).alias("observed"))
    return Found(rows, ("n", "source"), "no decode errors")


@rule("video.timeline", "Ranges fit the stored frame times", "error", "episode", "video", _VIDEO, tolerance_frames=0.5, note="A shift of all ranges of a file is not seen.")
def timeline(rec, o):
    """Ranges that do not fit make lookups return other frames.

    Build the ranges again from the stored frame times."""
    interval = rec.interval()
    off = interval * float(o["tolerance_frames"])
    probes = _probes(rec)
    ranges = _ranges(rec).join(probes.select("source"), "source", "left_semi").join(_order(rec), "stream")
    by = W.partitionBy("stream", "source").orderBy("a", "pos")
    r = ranges.withColumn("before", F.lag("b").over(by)).withColumn("place", F.row_number().over(by))
    times = probes.select("source", F.explode("frame_times").alias("t"))
    held = r.join(times, "source").where((F.col("t") >= F.col("a") - off) & (F.col("t") < F.col("b") - off)).groupBy("stream", "pos").agg(F.count(F.lit(1)).alias("held"))
    r = r.join(held, ["stream", "pos"], "left").withColumn("held", F.coalesce("held", F.lit(0)))
    at = ["n", "source", "place", "episode", "stream"]
    gap = r.where(F.abs(F.col("a") - F.col("before")) > off).select(*at, F.lit(0).alias("step"), text("The range of {} does not follow the one before", "episode").alias("message"), F.to_json(record(from_timestamp=F.col("a"))).alias("observed"), F.to_json(record(from_timestamp=F.col("before"))).alias("expected"))
    count = r.where(F.col("held") != F.col("length")).select(*at, F.lit(1).alias("step"), text("The range of {} holds {} frames for {} samples", "episode", "held", "length").alias("message"), F.to_json(record(frames=F.col("held"))).alias("observed"), F.to_json(record(frames=F.col("length"))).alias("expected"))
    ends = ranges.groupBy("n", "stream", "source").agg(F.max_by("b", F.struct("a", "pos")).alias("end")).join(probes.where(F.size("frame_times") > 0).select("source", (F.array_max("frame_times") + interval).alias("file_end")), "source")
    ends = ends.where(F.abs(F.col("file_end") - F.col("end")) > off)
    ends = ends.select("n", "source", F.lit((1 << 31) - 1).alias("place"), F.lit(None).cast("string").alias("episode"), "stream", F.lit(2).alias("step"), text("{} ends at {} s, its last range at {} s", F.col("source"), F.round("file_end", 3), F.round("end", 3)).alias("message"), F.to_json(record(file_end_seconds=F.col("file_end"))).alias("observed"), F.to_json(record(file_end_seconds=F.col("end"))).alias("expected"))
    return Found(gap.unionByName(count).unionByName(ends), ("n", "source", "place", "step"))


@rule("video.camera_identity", "Cameras are those of their stream", "warning", "episode", "video", _VIDEO, min_episodes=5, note="A swap in all episodes is not seen.")
def camera_identity(rec, o):
    """A view that looks like another camera's gives a policy the wrong viewpoint.

    Check which camera is which in the episodes named."""
    if len(rec.video_streams()) < 2 or rec.n_episodes < int(o["min_episodes"]):
        raise NotApplicable("needs two cameras and several episodes")
    means = rec.frames().where("cells IS NOT NULL").select("pos", "episode", "stream", "cells")
    if means.groupBy("stream").agg(F.count_distinct(F.size("cells")).alias("k")).where("k > 1").limit(1).count():
        raise NotApplicable("the frames of a camera differ in size")
    found = kernels.camera_identity(means, "pos", "stream", "cells", 1)
    found = found.join(means.select("pos", "episode").distinct(), "pos").join(_order(rec), "stream")
    seen = record(distance_to_own=F.col("own"), distance_to_other=F.col("other"), other=F.col("looks_like"))
    return Found(found.select("n", "pos", "episode", "stream", text("{} in {} looks like {}", "stream", "episode", "looks_like").alias("message"), seen.alias("observed")), ("n", "pos"), "closest to its own stream")
