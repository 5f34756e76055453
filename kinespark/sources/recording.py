"""A recording: what its metadata says, and lazily its samples, frames and messages as DataFrames."""

from __future__ import annotations

import re
import threading
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotApplicable, SourceError
from ..functions.series import finite
from ..functions.storage import FileInfo, Store

#: Columns that are not streams of their own.
INDEX_COLUMNS = ("timestamp", "frame_index", "episode_index", "index", "task_index")
EPISODES = """pos long, index long, episode string, length long, data_file string, from_index long, to_index long,
    tasks array<string>, video_files map<string,string>, video_ranges map<string,struct<start:double,end:double>>"""
FRAMES = "pos long, episode string, stream string, source string, frame long, ts double, mean double, sd double, change double, cell_change double, cells array<double>"


@dataclass(frozen=True)
class Stream:
    key: str
    dtype: str
    shape: tuple[int, ...] = ()
    kind: str = "numeric"
    names: list[str] | dict[str, list[str]] | None = None
    units: str | None = None


@dataclass
class Recording:
    """``episodes`` has the columns of EPISODES; ``pos`` is an episode's place by index."""

    spark: SparkSession
    store: Store
    name: str
    adapter: str
    format_version: str
    streams: list[Stream]
    capabilities: frozenset[str]
    episodes: DataFrame
    n_episodes: int
    profile: str = "generic"
    robot_type: str | None = None
    fps: float | None = None
    total_frames: int | None = None
    total_messages: int | None = None
    revision: str | None = None
    info: dict[str, Any] = field(default_factory=dict)
    files: list[FileInfo] = field(default_factory=list)
    footers: dict[str, dict[str, str]] = field(default_factory=dict)  # data file -> column -> stored type
    messages: Any = None  # of message files: see sources.mcap
    frames_table: DataFrame | None = None
    probes: DataFrame | None = None
    _samples: DataFrame | None = None
    _kept: list[DataFrame] = field(default_factory=list)
    _lock: Any = field(default_factory=threading.RLock, repr=False, compare=False)  # rules run side by side

    # --- streams ---------------------------------------------------------------------------

    def stream(self, key: str) -> Stream | None:
        return next((s for s in self.streams if s.key == key), None)

    def numeric_streams(self) -> list[str]:
        return [s.key for s in self.streams if s.kind == "numeric" and s.key not in INDEX_COLUMNS]

    def float_streams(self, wanted: list[str]) -> list[str]:
        declared = {s.key: s.dtype.lower() for s in self.streams}
        return [k for k in wanted or self.numeric_streams() if "float" in declared.get(k, "")]

    def video_streams(self) -> list[str]:
        return [s.key for s in self.streams if s.kind == "video"]

    def interval(self) -> float:
        if not self.fps or self.fps <= 0:
            raise NotApplicable("the source declares no positive rate of frames")
        return 1.0 / self.fps

    # --- samples ---------------------------------------------------------------------------

    def missing_files(self) -> list[str]:
        there = {f.path for f in self.files}
        wanted = self.episodes.where("data_file IS NOT NULL").select("data_file").distinct()
        absent = wanted.join(self.spark.createDataFrame([(f,) for f in sorted(there)] or [("",)], "data_file string"), "data_file", "left_anti")
        return sorted(r.data_file for r in absent.limit(20).collect())

    def samples(self) -> DataFrame:
        """(pos, episode, source, row_pos, stored columns...) of all episodes, kept for later rules.

        A row belongs to an episode if it lies in the file that the episode's metadata names and
        carries its index; ``row_pos`` counts stored rows, in the order of the file.
        """
        with self._lock:
            if self._samples is None:
                self._samples = self.keep(self._read_samples())
            return self._samples

    def _read_samples(self) -> DataFrame:
        if missing := self.missing_files():
            raise SourceError(f"data files are missing: {', '.join(missing)}")
        groups: dict[tuple, list[str]] = {}
        uris = {f.path: f.uri for f in self.files}
        for path, columns in self.footers.items():
            groups.setdefault(tuple(sorted(columns.items())), []).append(path)
        parts = []
        for columns, paths in groups.items():
            part = self.spark.read.parquet(*[uris[p] for p in paths])
            keep = [c for c in part.columns if c not in ("pos", "episode", "source", "row_pos")]
            parts.append(part.select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_uri"), F.col("_metadata.row_index").alias("_row"), *[F.col(f"`{c}`") for c in keep]))
        if not parts:
            raise SourceError("there are no data files")
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part, allowMissingColumns=True)
        names = self.spark.createDataFrame([(re.sub("^file:/+", "file:/", uris[p]), p) for p in self.footers], "_uri string, source string")
        rows = rows.join(F.broadcast(names), "_uri").drop("_uri")
        of = self.episodes.select("pos", "episode", F.col("data_file").alias("source"), F.col("index").alias("_index"), F.col("from_index").alias("_from"), F.col("to_index").alias("_to"))
        if "episode_index" in rows.columns:
            rows = rows.join(of, (rows.source == of.source) & (rows.episode_index == of._index))
        elif "index" in rows.columns:
            ranged = of._from.isNull() | of._to.isNull() | ((rows["index"] >= of._from) & (rows["index"] < of._to))
            rows = rows.join(of, (rows.source == of.source) & ranged)
        else:
            raise SourceError("samples have neither episode_index nor index")
        rows = rows.drop(of.source).drop("_index", "_from", "_to")
        place = F.row_number().over(W.partitionBy("pos").orderBy("_row")) - 1
        return rows.withColumn("row_pos", place.cast("long")).drop("_row")

    def stored_in(self, *columns: str) -> Column:
        """Of a sample: whether its file stores all of these columns."""
        lacking = [p for p, have in self.footers.items() if not set(columns) <= set(have)]
        return ~F.col("source").isin(lacking) if lacking else F.lit(True)

    def is_stored(self, column: str) -> bool:
        return any(column in have for have in self.footers.values())

    def with_columns(self, *columns: str) -> DataFrame:
        """The samples of files that store ``columns``, with these alone."""
        base = ["pos", "episode", "source", "row_pos"]
        if not all(self.is_stored(c) for c in columns):
            return self.samples().select(*base, *[F.lit(None).cast("double").alias(c) for c in columns]).limit(0)
        return self.samples().where(self.stored_in(*columns)).select(*base, *[F.col(f"`{c}`").alias(c) for c in columns])

    def times(self) -> DataFrame:
        """(pos, episode, source, row_pos, t) of files that store timestamps."""
        rows = self.with_columns("timestamp")
        return rows.select("pos", "episode", "source", "row_pos", flat(F.col("timestamp"), rows.schema["timestamp"].dataType)[0].alias("t"))

    def vectors(self, stream: str) -> DataFrame:
        """(pos, episode, source, row_pos, v): the stream's values as flat arrays; null where missing."""
        rows = self.with_columns(stream)
        return rows.select("pos", "episode", "source", "row_pos", flat(F.col(f"`{stream}`"), rows.schema[stream].dataType).alias("v"))

    def clean_vectors(self, stream: str) -> DataFrame:
        """The vectors of episodes of at least three rows, all finite and of one width."""
        rows = self.vectors(stream)
        whole = F.col("v").isNotNull() & F.forall("v", lambda x: finite(x))
        per = rows.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(whole, F.lit(False))).alias("fine"), F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b"))
        return rows.join(per.where("n >= 3 AND fine AND a = b AND a > 0").select("pos"), "pos", "left_semi")

    # --- frames ----------------------------------------------------------------------------

    def frames(self) -> DataFrame:
        """Statistics of all decoded frames, with the columns of FRAMES."""
        with self._lock:
            if self.frames_table is None:
                from .video import decoded

                self.frames_table = self.keep(decoded(self))
            return self.frames_table

    # --- lifetime --------------------------------------------------------------------------

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` persisted until ``close``; lost parts are made again from their source."""
        self._kept.append(df.persist())
        return df

    def close(self) -> None:
        for df in self._kept:
            df.unpersist()
        self._kept.clear()
        self._samples = None

    def inventory(self) -> dict[str, Any]:
        return {
            "name": self.name, "path": self.store.root, "adapter": self.adapter, "format_version": self.format_version, "profile": self.profile,
            "source_revision": self.revision, "robot_type": self.robot_type, "fps": self.fps, "total_frames": self.total_frames,
            "total_messages": self.total_messages, "episodes": self.n_episodes, "capabilities": sorted(self.capabilities),
            "streams": [{"key": s.key, "dtype": s.dtype, "shape": list(s.shape), "kind": s.kind, "names": s.names, "units": s.units} for s in self.streams],
        }


def flat(column: Column, kind: T.DataType) -> Column:
    """A stored value as one array of doubles; what is not numeric is null."""
    depth = 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    if not isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.lit(None).cast("array<double>")
    if not depth:
        return F.when(column.isNotNull(), F.array(column.cast("double")))
    for _ in range(depth - 1):
        column = F.flatten(column)
    return F.transform(column, lambda x: x.cast("double"))
