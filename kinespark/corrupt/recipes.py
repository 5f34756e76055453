"""Recipes as transforms of DataFrames: one episode of a recording gets one defect of a given strength.

A recipe sees the canonical tables (samples, episodes, frames or messages) and changes rows of the target
alone. ``level`` is 1, 2 or 3; a larger one is a stronger defect. Recipes whose category is ``benign`` change
nothing that a rule may report.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.recording import Recording, Stream

#: How strong a defect is, by level: as a share of an episode, and as a factor.
SHARE, FACTOR = (0.05, 0.15, 0.4), (2.0, 5.0, 20.0)


@dataclass(frozen=True)
class Recipe:
    name: str
    category: str
    table: str  # samples, episodes, frames, messages, streams, info or files
    change: Callable[..., Any]
    rule: str = ""  # one that should find it
    needs: tuple[str, ...] = ()


RECIPES: dict[str, Recipe] = {}


def recipe(category: str, table: str, rule: str = "", needs: tuple[str, ...] = ()):
    def keep(fn):
        RECIPES[fn.__name__] = Recipe(fn.__name__, category, table, fn, rule, needs)
        return fn

    return keep


@dataclass(frozen=True)
class Target:
    """One episode, its length, and columns that pick rows of it."""

    pos: int
    length: int
    level: int = 2
    other: int = 0  # another episode

    @property
    def here(self) -> Column:
        return F.col("pos") == self.pos

    @property
    def middle(self) -> int:
        return self.length // 2

    @property
    def span(self) -> int:
        return max(2, int(self.length * SHARE[self.level - 1]))

    @property
    def part(self) -> Column:
        return self.here & F.col("row_pos").between(self.middle, self.middle + self.span - 1)

    def row(self, at: int) -> Column:
        return self.here & (F.col("row_pos") == at)


def _set(df: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    kind = df.schema[column].dataType
    return df.withColumn(column, F.when(where, value.cast(kind)).otherwise(F.col(f"`{column}`")))


def _dim(df: DataFrame, where: Column, stream: str, dim: int, value: Callable[[Column], Column]) -> DataFrame:
    return _set(df, where, stream, F.transform(f"`{stream}`", lambda x, i: F.when(i == dim, value(x)).otherwise(x)))


def _by() -> W:
    return W.partitionBy("pos").orderBy("row_pos")


def _renumbered(df: DataFrame) -> DataFrame:
    return df.withColumn("row_pos", (F.row_number().over(_by()) - 1).cast("long"))


# --- values ------------------------------------------------------------------------------------


@recipe("numeric", "samples", "numeric.finite_values")
def nan_action(df, t):
    return _dim(df, t.row(t.middle), "action", 0, lambda x: F.lit(float("nan")))


@recipe("numeric", "samples", "numeric.finite_values")
def inf_state(df, t):
    return _dim(df, t.row(t.middle), "observation.state", 0, lambda x: F.lit(float("inf")))


@recipe("numeric", "samples", "temporal.stream_overlap")
def null_action_row(df, t):
    return _set(df, t.row(t.middle), "action", F.lit(None))


@recipe("numeric", "samples", "numeric.outlier_jumps")
def action_spike(df, t):
    return _dim(df, t.row(t.middle), "action", 0, lambda x: x + 50.0 * FACTOR[t.level - 1])


@recipe("numeric", "samples", "numeric.episode_envelope")
def unit_flip(df, t):
    return _set(df, t.here, "observation.state", F.transform("`observation.state`", lambda x: x * 57.29577951308232))


@recipe("numeric", "samples", "numeric.action_state_coupling")
def sign_flip_joint(df, t):
    return _dim(df, t.here, "observation.state", 0, lambda x: -x)


@recipe("numeric", "samples", "numeric.stuck_channels")
def stuck_joint(df, t):
    first = F.first("`observation.state`").over(_by().rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("_first", first[0])
    return _dim(df, t.here, "observation.state", 0, lambda x: F.col("_first")).drop("_first")


@recipe("numeric", "samples", "numeric.stuck_channels")
def dead_action(df, t):
    return _set(df, t.here, "action", F.transform("action", lambda x: x * 0))


@recipe("numeric", "samples", "temporal.signal_alignment")
def action_state_swap(df, t):
    both = df.withColumn("_s", F.col("`observation.state`")).withColumn("_a", F.col("action"))
    return _set(_set(both, t.here, "observation.state", F.col("_a")), t.here, "action", F.col("_s")).drop("_s", "_a")


@recipe("numeric", "samples", "temporal.signal_alignment")
def action_shift(df, t):
    """Rolled by some rows; what leaves at the end comes in at the start."""
    k = min(t.length - 1, (3, 8, 15)[t.level - 1])
    old = df.where(t.here).select("pos", ((F.col("row_pos") + k) % t.length).alias("row_pos"), F.col("action").alias("_a"))
    return _set(df.join(F.broadcast(old), ["pos", "row_pos"], "left"), t.here, "action", F.col("_a")).drop("_a")


@recipe("numeric", "samples", "numeric.action_state_coupling")
def joint_permutation(df, t):
    return _set(df, t.here, "observation.state", F.reverse("`observation.state`"))


@recipe("numeric", "samples", "numeric.noise_level")
def sensor_noise(df, t):
    noise = F.when(F.col("row_pos") % 2 == 0, 1.0).otherwise(-1.0) * FACTOR[t.level - 1]
    return _dim(df, t.here, "observation.state", 0, lambda x: x + noise)


def _copied(df, t, shift):
    """The target's values are another episode's, a little shifted."""
    names = [c for c in ("action", "observation.state") if c in df.columns]
    old = df.where(F.col("pos") == t.other).select(F.lit(t.pos).cast("long").alias("pos"), "row_pos", *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)])
    df = df.join(F.broadcast(old), ["pos", "row_pos"], "left")
    for i, c in enumerate(names):
        df = _set(df, t.here & F.col(f"_{i}").isNotNull(), c, F.transform(f"_{i}", lambda x: x + shift)).drop(f"_{i}")
    return df


@recipe("numeric", "samples", "duplication.exact_episodes")
def exact_duplicate(df, t):
    return _copied(df, t, 0.0)


@recipe("numeric", "samples", "duplication.near_episodes")
def near_duplicate(df, t):
    return _copied(df, t, 1e-4)


# --- times and rows ----------------------------------------------------------------------------


@recipe("temporal", "samples", "temporal.monotonic")
def nan_timestamp(df, t):
    return _set(df, t.row(t.middle), "timestamp", F.lit(float("nan")))


@recipe("temporal", "samples", "temporal.monotonic")
def swapped_timestamps(df, t):
    df = df.withColumn("_n", F.lead("timestamp").over(_by())).withColumn("_p", F.lag("timestamp").over(_by()))
    return _set(_set(df, t.row(t.middle), "timestamp", F.col("_n")), t.row(t.middle + 1), "timestamp", F.col("_p")).drop("_n", "_p")


@recipe("temporal", "samples", "temporal.monotonic")
def repeated_timestamp(df, t):
    df = df.withColumn("_p", F.lag("timestamp").over(_by()))
    return _set(df, t.row(t.middle), "timestamp", F.col("_p")).drop("_p")


@recipe("temporal", "samples", "temporal.max_gap")
def timestamp_gap(df, t):
    return _set(df, t.here & (F.col("row_pos") >= t.middle), "timestamp", F.col("timestamp") + (0.1, 0.5, 2.0)[t.level - 1])


@recipe("temporal", "samples", "temporal.sampling_interval")
def timestamp_jitter(df, t):
    sign = F.when(F.col("row_pos") % 2 == 0, 1).otherwise(-1)
    return _set(df, t.here, "timestamp", F.col("timestamp") + sign * (0.004, 0.008, 0.015)[t.level - 1])


@recipe("temporal", "samples", "temporal.clock_drift")
def clock_scale(df, t):
    return _set(df, t.here, "timestamp", F.col("timestamp") * (1.02, 1.05, 1.2)[t.level - 1])


@recipe("temporal", "samples", "temporal.episode_start")
def timestamp_offset(df, t):
    return _set(df, t.here, "timestamp", F.col("timestamp") + (0.1, 1.0, 10.0)[t.level - 1])


@recipe("temporal", "samples", "episode.valid_boundaries")
def deleted_rows(df, t):
    return _renumbered(df.where(~t.part))


@recipe("temporal", "samples", "episode.valid_boundaries")
def duplicated_rows(df, t):
    again = df.where(t.part).withColumn("_k", F.lit(1))
    both = df.withColumn("_k", F.lit(0)).unionByName(again)
    place = F.row_number().over(W.partitionBy("pos").orderBy("row_pos", "_k")) - 1
    return both.withColumn("row_pos", place.cast("long")).drop("_k")


@recipe("index", "samples", "episode.index_columns")
def frame_index_reset(df, t):
    return _set(df, t.here & (F.col("row_pos") >= t.middle), "frame_index", F.col("row_pos") - t.middle)


@recipe("index", "samples", "episode.index_columns")
def global_index_shift(df, t):
    return _set(df, t.here, "index", F.col("index") + 1)


@recipe("index", "samples", "episode.valid_boundaries")
def episode_label_bleed(df, t):
    """The first rows count as another episode's."""
    moved = F.when(t.here & (F.col("row_pos") < t.span), t.other).otherwise(F.col("pos"))
    df = df.withColumn("_r", F.when(t.here & (F.col("row_pos") < t.span), 1 << 40).otherwise(0) + F.col("row_pos"))
    df = df.withColumn("pos", moved.cast("long")).withColumn("row_pos", F.col("_r").cast("long")).drop("_r")
    return _renumbered(df)


@recipe("index", "samples", "episode.task_references", ("task_index",))
def unknown_task(df, t):
    return _set(df, t.here, "task_index", F.lit(9999))


# --- metadata ----------------------------------------------------------------------------------


@recipe("metadata", "info", "manifest.declared_totals")
def wrong_totals(info, t):
    return info | {"total_frames": int(info.get("total_frames", 0)) + 7}


@recipe("metadata", "episodes", "episode.valid_boundaries")
def wrong_length(df, t):
    return _set(df, t.here, "length", F.col("length") + t.level)


@recipe("metadata", "episodes", "episode.valid_boundaries")
def overlapping_range(df, t):
    return _set(_set(df, t.here, "from_index", F.col("from_index") - t.level), t.here, "to_index", F.col("to_index") - t.level)


@recipe("metadata", "episodes", "manifest.required_files")
def stale_file_pointer(df, t):
    return _set(df, t.here, "data_file", F.concat(F.lit("moved/"), F.col("data_file")))


@recipe("metadata", "files", "manifest.required_files")
def missing_data_file(files, t):
    return files[1:]


@recipe("metadata", "files", "manifest.orphan_files")
def orphan_parquet(files, t):
    return [*files, replace(files[0], path="data/chunk-000/left-over.parquet")]


@recipe("metadata", "footers", "manifest.schema_matches")
def dropped_column(footers, t):
    return {f: {k: v for k, v in have.items() if k != "action"} for f, have in footers.items()}


@recipe("metadata", "streams", "manifest.shape_consistency")
def wrong_declared_shape(streams, t):
    return [replace(s, shape=(s.shape[0] + 1,)) if s.key == "action" else s for s in streams]


@recipe("metadata", "streams", "manifest.schema_matches")
def wrong_declared_dtype(streams, t):
    return [replace(s, dtype="int64") if s.key == "action" else s for s in streams]


@recipe("metadata", "fps", "temporal.sampling_interval")
def wrong_declared_fps(fps, t):
    return fps * (1.5, 2.0, 4.0)[t.level - 1]


# --- frames ------------------------------------------------------------------------------------

_FRAMES = ("video",)


def _span(t) -> Column:
    return t.here & F.col("frame").between(t.middle, t.middle + max(t.span, 8) - 1)


@recipe("video", "frames", "video.frozen_frames", _FRAMES)
def frozen_camera(df, t):
    return _set(_set(df, _span(t), "cell_change", F.lit(0.0)), _span(t), "change", F.lit(0.0))


@recipe("video", "frames", "video.black_frames", _FRAMES)
def black_frames(df, t):
    return _set(_set(df, _span(t), "mean", F.lit(0.0)), _span(t), "sd", F.lit(0.0))


@recipe("video", "frames", "video.black_frames", _FRAMES)
def saturated_frames(df, t):
    return _set(_set(df, _span(t), "mean", F.lit(255.0)), _span(t), "sd", F.lit(0.0))


@recipe("video", "frames", "video.decode", _FRAMES)
def dropped_frames(df, t):
    return df.where(~_span(t))


@recipe("video", "frames", "video.decode", _FRAMES)
def video_truncated(df, t):
    return df.where(~(t.here & (F.col("frame") >= t.length - t.span)))


@recipe("video", "frames", "video.decode", _FRAMES)
def video_missing(df, t):
    return df.where(~t.here)


@recipe("video", "frames", "video.repeated_frames", _FRAMES)
def half_rate_camera(df, t):
    again = t.here & (F.col("frame") % 2 == 1)
    return _set(_set(df, again, "cell_change", F.lit(0.0)), again, "change", F.lit(0.0))


@recipe("video", "frames", "temporal.signal_alignment", _FRAMES)
def reversed_episode(df, t):
    last = F.max("frame").over(W.partitionBy("pos", "stream"))
    return df.withColumn("_l", last).withColumn("frame", F.when(t.here, F.col("_l") - F.col("frame")).otherwise(F.col("frame"))).drop("_l")


@recipe("video", "frames", "video.camera_identity", ("two cameras",))
def swapped_cameras(df, t):
    streams = sorted(r.stream for r in df.select("stream").distinct().collect())
    a, b = streams[:2]
    other = F.when(F.col("stream") == a, b).when(F.col("stream") == b, a).otherwise(F.col("stream"))
    return df.withColumn("stream", F.when(t.here, other).otherwise(F.col("stream")))


@recipe("video", "episodes", "video.timeline", _FRAMES)
def video_range_drift(df, t):
    move = 0.1 * t.level
    moved = F.transform_values("video_ranges", lambda k, r: F.struct((r["start"] + move).alias("start"), (r["end"] + move).alias("end")))
    return df.withColumn("video_ranges", F.when(t.here, moved).otherwise(F.col("video_ranges")))


@recipe("video", "probes", "video.bitstream", _FRAMES)
def video_bitflips(df, t):
    return df.withColumn("decode_errors", F.lit(t.level)).withColumn("first_error_time", F.col("frame_times")[t.pos * t.length + t.middle])


# --- messages ----------------------------------------------------------------------------------


@recipe("messages", "messages", "mcap.timestamp_order")
def log_rollback(df, t):
    return _set(df, F.col("pos") == t.middle, "log_time", F.col("log_time") - 10**9 * t.level)


@recipe("messages", "messages", "mcap.duplicate_timestamps")
def duplicate_log_time(df, t):
    df = df.withColumn("_p", F.lag("log_time").over(W.partitionBy("channel_id").orderBy("pos")))
    return _set(df, F.col("pos") == t.middle, "log_time", F.col("_p")).drop("_p")


@recipe("messages", "messages", "ros2.topic_gaps")
def cadence_gap(df, t):
    return _set(df, F.col("pos") >= t.middle, "log_time", F.col("log_time") + 10**9 * t.level)


@recipe("messages", "messages", "mcap.sequence_continuity")
def lost_message(df, t):
    return df.where(F.col("pos") != t.middle)


@recipe("messages", "messages", "ros2.required_topics")
def missing_topic(df, t):
    return df.where(F.lit(False))


@recipe("messages", "messages", "ros2.semantic_consistency")
def nan_joint(df, t):
    return _set(df, F.col("pos") == t.middle, "semantic", F.array(F.lit("JointState position contains a non-finite value")))


@recipe("messages", "messages", "ros2.semantic_consistency")
def joint_dimension(df, t):
    return _set(df, F.col("pos") == t.middle, "semantic", F.array(F.lit("position has 1 values but name has 2 entries")))


@recipe("messages", "bytes", "mcap.readable")
def chunk_byte_flip(raw, t):
    at = len(raw) // 3
    return raw[:at] + bytes([raw[at] ^ 255]) + raw[at + 1 :]


@recipe("messages", "bytes", "mcap.readable")
def truncated_5pct(raw, t):
    return raw[: int(len(raw) * 0.95)]


@recipe("messages", "bytes", "mcap.readable")
def truncated_50pct(raw, t):
    return raw[: len(raw) // 2]


# --- changes that are no defect ------------------------------------------------------------------


@recipe("benign", "samples")
def benign_row_groups(df, t):
    return df.repartition(7)


@recipe("benign", "samples")
def benign_column_order(df, t):
    return df.select(*[F.col(f"`{c}`") for c in sorted(df.columns, reverse=True)])


@recipe("benign", "samples")
def benign_compression(df, t):
    return df.coalesce(1)


@recipe("benign", "frames", "", _FRAMES)
def benign_reencode(df, t):
    return df.withColumn("mean", F.col("mean") + 0.25).withColumn("sd", F.col("sd") + 0.1)


@recipe("benign", "messages")
def benign_arrival_reorder(df, t):
    return _set(df, F.col("pos") == t.middle, "log_time", F.col("log_time") - 2_000_000)


@recipe("benign", "messages")
def benign_two_publishers(df, t):
    return _set(df, F.col("pos") % 2 == 1, "publish_time", F.col("publish_time") - 1_000_000)


# --- plain tables --------------------------------------------------------------------------------


def drop_rows(df: DataFrame, key: str, pos: str, first: int, n: int) -> DataFrame:
    return df.where(~F.col(pos).between(first, first + n - 1))


def reorder(df: DataFrame, key: str, pos: str, a: int, b: int) -> DataFrame:
    """Rows a and b of every episode change places."""
    p = F.col(pos)
    return df.withColumn(pos, F.when(p == a, b).when(p == b, a).otherwise(p))


def offset(df: DataFrame, column: str, by: float) -> DataFrame:
    return df.withColumn(column, F.col(column) + by)


def freeze(df: DataFrame, key: str, pos: str, column: str, first: int, n: int) -> DataFrame:
    """A column keeps the value that it has at row ``first`` for ``n`` rows."""
    held = F.max(F.when(F.col(pos) == first, F.col(column))).over(W.partitionBy(key))
    return df.withColumn(column, F.when(F.col(pos).between(first, first + n - 1), held).otherwise(F.col(column)))


def insert_non_finite(df: DataFrame, pos: str, column: str, at: int, value: float = float("nan")) -> DataFrame:
    return df.withColumn(column, F.when(F.col(pos) == at, F.lit(value)).otherwise(F.col(column)))


def violate_limit(df: DataFrame, pos: str, column: str, at: int, limit: float) -> DataFrame:
    return df.withColumn(column, F.when(F.col(pos) == at, F.lit(limit * 2 + 1)).otherwise(F.col(column)))


def truncate(df: DataFrame, pos: str, n: int) -> DataFrame:
    return df.where(F.col(pos) < n)


def apply_recipe(recording: Recording, name: str, target: Target) -> Recording:
    """The recording with the defect; the tables of ``recording`` stay as they are."""
    r = RECIPES[name]
    out = replace(recording, _kept=[])
    if r.table == "samples":
        out._samples = r.change(recording.samples(), target)
    elif r.table == "frames":
        out.frames_table = r.change(recording.frames(), target)
    elif r.table == "messages":
        from copy import copy

        out.messages = copy(recording.messages)
        out.messages.messages = r.change(recording.messages.messages, target)
    elif r.table in ("episodes", "info", "files", "streams", "fps", "probes", "footers"):
        setattr(out, r.table, r.change(getattr(recording, r.table), target))
        if r.table == "footers":
            out._samples = recording.samples()
    else:
        raise ValueError(f"{name} changes files, not tables")
    return out


__all__ = ["RECIPES", "Recipe", "Stream", "Target", "apply_recipe"]
