"""Episode directories of versions 2.0, 2.1 and 3: JSON and Parquet metadata, Parquet samples."""

from __future__ import annotations

import json
import math
import re
import string
import threading
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import SourceError
from ..functions.series import numbered
from ..functions.storage import Store
from .recording import Recording, Stream

#: Where the formats put their files unless the metadata says otherwise.
PATHS = {
    "v3": ("data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet", "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4"),
    "v2": ("data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4"),
}


def is_directory_recording(store: Store) -> bool:
    try:
        info = json.loads(store.read("meta/info.json")) if store.is_file("meta/info.json") else None
    except ValueError:
        return False
    return isinstance(info, dict) and "features" in info and "fps" in info


def read_info(store: Store) -> dict[str, Any]:
    if not store.is_file("meta/info.json"):
        raise SourceError("missing metadata: meta/info.json")
    try:
        info = json.loads(store.read("meta/info.json"))
    except ValueError as e:
        raise SourceError(f"meta/info.json cannot be read: {e}") from e
    if not isinstance(info, dict):
        raise SourceError("meta/info.json must be an object")
    version = str(info.get("codebase_version", ""))
    if not re.fullmatch(r"v3\.\d+|v2\.[01]", version):
        raise SourceError(f"unsupported version {version or 'missing'}; expected v2.0, v2.1 or v3.x")
    if not isinstance(info.get("features"), dict) or "fps" not in info:
        raise SourceError("meta/info.json lacks features or fps")
    try:
        fps = float(info["fps"])
    except (TypeError, ValueError):
        fps = math.nan
    if not math.isfinite(fps) or fps <= 0:
        raise SourceError("fps must be finite and positive")
    return info


def read_streams(info: dict[str, Any]) -> list[Stream]:
    out = []
    for key, raw in info["features"].items():
        if not isinstance(raw, dict):
            raise SourceError(f"the declaration of {key!r} must be an object")
        dtype, names = str(raw.get("dtype", "unknown")), raw.get("names")
        if isinstance(names, str):
            names = [names]
        elif isinstance(names, list):
            names = [str(n) for n in names]
        elif not (names is None or isinstance(names, dict)):
            raise SourceError(f"the names of {key!r} must be text, a list or a mapping")
        try:
            shape = tuple(int(n) for n in raw.get("shape") or ())
        except (TypeError, ValueError) as e:
            raise SourceError(f"the shape of {key!r} is not valid") from e
        out.append(Stream(key, dtype, shape, dtype if dtype in ("video", "image") else "numeric", names, raw.get("unit") or raw.get("units")))
    return out


def path_column(template: str, values: dict[str, Column | str]) -> Column:
    """A path template with fields like ``{file_index:03d}`` as an expression."""
    parts = []
    try:
        for text, name, spec, _ in string.Formatter().parse(template):
            if text:
                parts.append(F.lit(text))
            if name is None:
                continue
            value = values[name]
            if isinstance(value, str):
                parts.append(F.lit(value))
            else:
                width = re.fullmatch(r"0?(\d*)d?", spec or "")
                if width is None:
                    raise ValueError(spec)
                digits = value.cast("long").cast("string")
                parts.append(F.lpad(digits, F.greatest(F.length(digits), F.lit(int(width[1] or 1))), F.lit("0")))
    except (KeyError, ValueError) as e:
        raise SourceError(f"invalid path template: {template}") from e
    return F.concat(*parts)


def _maps(pairs: list[tuple[str, Column]], value: str) -> Column:
    """A map without the entries whose value is null."""
    if not pairs:
        return F.lit(None).cast(f"map<string,{value}>")
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast(value).alias("value")) for k, v in pairs]), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)


def _episodes_v3(spark: SparkSession, store: Store, info: dict[str, Any], streams: list[Stream]) -> DataFrame:
    files = store.files("meta/episodes", ".parquet")
    if not files:
        raise SourceError("meta/episodes holds no Parquet files")
    rows = spark.read.option("mergeSchema", "true").parquet(*[f.uri for f in files])
    have = set(rows.columns)
    if not {"episode_index", "length"} <= have:
        raise SourceError("episode metadata lacks episode_index or length")
    col = lambda c, kind="long": F.col(f"`{c}`").cast(kind) if c in have else F.lit(None).cast(kind)
    index, length = col("episode_index"), col("length")
    data = F.lit(None).cast("string")
    if {"data/chunk_index", "data/file_index"} <= have:
        data = path_column(str(info.get("data_path", PATHS["v3"][0])), {"chunk_index": col("data/chunk_index"), "file_index": col("data/file_index")})
    videos, ranges = [], []
    for s in streams:
        at = f"videos/{s.key}"
        if s.kind == "video" and {f"{at}/chunk_index", f"{at}/file_index"} <= have:
            videos.append((s.key, path_column(str(info.get("video_path", PATHS["v3"][1])), {"video_key": s.key, "chunk_index": col(f"{at}/chunk_index"), "file_index": col(f"{at}/file_index")})))
            start = F.coalesce(col(f"{at}/from_timestamp", "double"), F.lit(0.0))
            end = F.coalesce(col(f"{at}/to_timestamp", "double"), start + length / float(info["fps"]))
            ranges.append((s.key, F.struct(start.alias("start"), end.alias("end"))))
    tasks = F.lit(None).cast("array<string>")
    if "tasks" in have:
        tasks = F.array(F.col("tasks")) if rows.schema["tasks"].dataType.typeName() == "string" else F.col("tasks").cast("array<string>")
    named = F.concat(F.lit("episode_"), F.lpad(index.cast("string"), F.greatest(F.length(index.cast("string")), F.lit(6)), F.lit("0")))
    return rows.select(
        index.alias("index"), F.coalesce(col("episode_id", "string"), named).alias("episode"), length.alias("length"), data.alias("data_file"),
        col("dataset_from_index").alias("from_index"), col("dataset_to_index").alias("to_index"), F.coalesce(tasks, F.array().cast("array<string>")).alias("tasks"),
        _maps(videos, "string").alias("video_files"), _maps(ranges, "struct<start:double,end:double>").alias("video_ranges"),
    )


def _episodes_v2(spark: SparkSession, store: Store, info: dict[str, Any], streams: list[Stream]) -> DataFrame:
    if not store.is_file("meta/episodes.jsonl"):
        raise SourceError("missing metadata: meta/episodes.jsonl")
    size = info.get("chunks_size", 1000)
    if not isinstance(size, int) or size <= 0:
        raise SourceError("chunks_size must be a positive number")
    lines = spark.read.text(f"{store.root}/meta/episodes.jsonl").where("trim(value) != ''")
    index, length = F.get_json_object("value", "$.episode_index").cast("string"), F.get_json_object("value", "$.length").cast("string")
    whole = lambda c: F.expr("try_cast(" + c + " AS bigint)")
    tasks = F.coalesce(F.from_json(F.get_json_object("value", "$.tasks"), "array<string>"), F.when(F.get_json_object("value", "$.tasks").isNotNull(), F.array(F.get_json_object("value", "$.tasks"))), F.array().cast("array<string>"))
    rows = lines.select(index.alias("i"), length.alias("l"), tasks.alias("tasks")).select(whole("i").alias("index"), whole("l").alias("length"), "tasks")
    bad = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("index").isNull() | F.col("length").isNull() | (F.col("index") < 0)).alias("bad")).first()
    if not bad.n or bad.bad:
        raise SourceError("meta/episodes.jsonl must hold objects with episode_index and length")
    values = {"episode_chunk": F.expr(f"index div {size}"), "episode_index": F.col("index")}
    videos = [(s.key, path_column(str(info.get("video_path") or PATHS["v2"][1]), {"video_key": s.key, **values})) for s in streams if s.kind == "video"]
    ends = F.struct(F.lit(0.0).alias("start"), (F.col("length") / float(info["fps"])).alias("end"))
    named = F.concat(F.lit("episode_"), F.lpad(F.col("index").cast("string"), F.greatest(F.length(F.col("index").cast("string")), F.lit(6)), F.lit("0")))
    return rows.select(
        "index", named.alias("episode"), "length", path_column(str(info.get("data_path") or PATHS["v2"][0]), values).alias("data_file"), F.lit(None).cast("long").alias("from_index"), F.lit(None).cast("long").alias("to_index"),
        "tasks", _maps(videos, "string").alias("video_files"), _maps([(k, ends) for k, _ in videos], "struct<start:double,end:double>").alias("video_ranges"),
    )


def _running_ranges(episodes: DataFrame) -> DataFrame:
    """from_index and to_index as running sums of lengths: inside parts, and over the parts' sums."""
    own = F.sum("length").over(W.partitionBy("_part").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    sums = episodes.groupBy("_part").agg(F.sum("length").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = episodes.join(F.broadcast(sums.select("_part", before.alias("_before"))), "_part")
    return out.withColumn("to_index", own + F.col("_before")).withColumn("from_index", F.col("to_index") - F.col("length")).drop("_before")


def _footer(batches):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for batch in batches:
        out = []
        for path, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                fs, at = pa.fs.FileSystem.from_uri(uri)
                out += [(path, f.name, str(f.type), None) for f in pq.read_schema(at, filesystem=fs)]
            except Exception as e:  # noqa: BLE001 - any reason a footer cannot be read is reported
                out.append((path, None, None, f"{type(e).__name__}: {e}"))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 4, ["path", "name", "type", "error"])


def read_footers(spark: SparkSession, files: list) -> dict[str, dict[str, str]]:
    """Stored types by column of every data file, read from the footers in parallel."""
    if not files:
        return {}
    listed = spark.createDataFrame([(f.path, f.uri) for f in files], "path string, uri string").repartition(min(len(files), 64))
    rows = listed.mapInArrow(_footer, "path string, name string, type string, error string").collect()
    if broken := [r for r in rows if r.error]:
        raise SourceError(f"{broken[0].path} cannot be read: {broken[0].error}")
    out: dict[str, dict[str, str]] = {f.path: {} for f in files}
    for r in rows:
        out[r.path][r.name] = r.type
    return out


def open_directory(spark: SparkSession, store: Store) -> Recording:
    info = read_info(store)
    streams = read_streams(info)
    second = info["codebase_version"].startswith("v2")
    rows = (_episodes_v2 if second else _episodes_v3)(spark, store, info, streams)
    if rows.where("index IS NULL OR length IS NULL").limit(1).count():
        raise SourceError("episode metadata lacks a valid episode_index or length")
    episodes = numbered(rows, "index", "episode")
    if second:
        episodes = _running_ranges(episodes)
    size = episodes.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("frames")).first()
    data = store.files("data", ".parquet")
    capabilities = {"metadata", "episodes", "timestamps", "numeric"}
    if any(s.kind == "video" for s in streams):
        capabilities.add("video")
    if any(s.key.endswith(".timestamp") for s in streams):
        capabilities.add("stream_timestamps")
    snapshot = re.search(r"/datasets--(.+?)--([^/]+)/snapshots/([^/]+)$", store.root)
    name = info.get("repo_id") or (f"{snapshot[1]}/{snapshot[2]}" if snapshot else store.name)
    return Recording(
        spark, store, str(name), "lerobot", str(info["codebase_version"]), streams, frozenset(capabilities), episodes, size.n, robot_type=info.get("robot_type"),
        fps=float(info["fps"]), total_frames=int(info.get("total_frames", size.frames or 0)), revision=snapshot[3] if snapshot else None, info=info, files=data, footers=_Lazy(spark, data),
    )


class _Lazy(dict):
    """Footers, read when first asked for: metadata rules need none."""

    def __init__(self, spark: SparkSession, files: list):
        super().__init__()
        self._load, self._lock = lambda: self.update(read_footers(spark, files)), threading.Lock()

    def _loaded(self) -> None:
        with self._lock:
            if self._load:
                self._load()
                self._load = None

    def items(self):
        self._loaded()
        return super().items()

    def values(self):
        self._loaded()
        return super().values()

    def __iter__(self):
        self._loaded()
        return super().__iter__()

    def __len__(self):
        self._loaded()
        return super().__len__()


def known_tasks(recording: Recording) -> DataFrame | None:
    """(task_index) of the task metadata; None where there is none that can be read."""
    spark, store = recording.spark, recording.store
    try:
        if store.is_file("meta/tasks.jsonl"):
            rows = [int(json.loads(line)["task_index"]) for line in store.read("meta/tasks.jsonl").decode().splitlines() if line.strip()]
            return spark.createDataFrame([(r,) for r in rows], "task_index long")
        if store.is_file("meta/tasks.parquet"):
            return spark.read.parquet(f"{store.root}/meta/tasks.parquet").select(F.col("task_index").cast("long").alias("task_index"))
    except Exception:  # noqa: BLE001 - task metadata that cannot be read counts as absent
        return None
    return None
