"""Rules on metadata against what is stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import NotApplicable, SourceError
from ..functions.series import last_before
from ..operators.manifest import missing_from
from ..sources.lerobot import known_tasks
from ..sources.recording import flat
from .base import Found, nothing, record, rule, text, union

#: How the stored types of a declared one are written.
STORED_NAMES = {"float16": ["halffloat", "float16"], "float32": ["float", "float32"], "float64": ["double", "float64"], "bool": ["bool"], "string": ["string"]}


def referenced(rec):
    """(source) of all files that episodes name."""
    e = rec.episodes
    videos = e.select(F.explode(F.map_values("video_files")).alias("source"))
    return e.where("data_file IS NOT NULL").select(F.col("data_file").alias("source")).union(videos).distinct()


def listed(rec, paths):
    return rec.spark.createDataFrame([(p,) for p in paths], "source string")


@rule("manifest.required_files", "Required files are there", "error", "dataset", "metadata", "episodes metadata")
def required_files(rec, o):
    """Without its metadata, sample or video files a recording cannot be checked as a whole.

    Restore the missing files, or finish the recording."""
    meta = ["meta/info.json", "meta/episodes.jsonl" if rec.format_version in ("v2.0", "v2.1") else "meta/episodes"]
    wanted = referenced(rec).union(listed(rec, meta))
    there = [f.path for f in [*rec.files, *rec.store.files("videos")]] + [m for m in meta if rec.store.exists(m)]
    missing = missing_from(wanted, listed(rec, there), ["source"])
    return Found(missing.select("source", text("Required file is missing: {}", "source").alias("message"), F.lit("missing").alias("observed")), ("source",), "file or directory exists")


@rule("manifest.schema_matches", "Stored columns are as declared", "error", "dataset", "metadata", "episodes metadata")
def schema_matches(rec, o):
    """A declared stream that is not stored, or stored as another type, cannot be relied on.

    Export the recording again so that metadata and samples agree."""
    if missing := rec.missing_files():
        raise SourceError(f"data files are missing: {', '.join(missing)}")
    first = rec.episodes.where("data_file IS NOT NULL").groupBy(F.col("data_file").alias("source")).agg(F.min("pos").alias("pos"))
    stored = rec.spark.createDataFrame([(f, c, t.lower()) for f, have in rec.footers.items() for c, t in have.items()], "source string, stream string, stored string")
    declared = [(s.key, n, s.dtype, s.kind, STORED_NAMES.get(s.dtype.lower(), [s.dtype.lower()])) for n, s in enumerate(rec.streams) if s.kind != "video"]
    declared = F.broadcast(rec.spark.createDataFrame(declared, "stream string, n int, dtype string, kind string, names array<string>"))
    both = first.crossJoin(declared).join(stored, ["source", "stream"], "left")  # one row for each file and declared stream
    absent = both.where("stored IS NULL").select("pos", F.lit(0).alias("step"), F.lit(0).alias("n"), "stream", "source", text("Declared stream {} is not stored", "stream").alias("message"), F.lit("absent").alias("observed"), F.lit("declared column exists").alias("expected"))
    other = both.where((F.col("kind") == "numeric") & F.col("stored").isNotNull() & ~F.exists("names", lambda x: F.contains(F.col("stored"), x)))
    other = other.select("pos", F.lit(1).alias("step"), "n", "stream", "source", text("Declared type {} of {} is stored as {}", "dtype", "stream", "stored").alias("message"), F.col("stored").alias("observed"), F.col("dtype").alias("expected"))
    return Found(absent.unionByName(other), ("pos", "step", "n", "stream"))


@rule("manifest.required_streams", "Required streams are declared", "error", "dataset", "linear", "metadata", cap=False, required_streams=["observation.state", "action"])
def required_streams(rec, o):
    """Training cannot use inputs or targets that a recording lacks.

    Collect or export the recording with all streams of its contract."""
    have = {s.key for s in rec.streams}
    rows = [(n, s, f"Required stream {s!r} is missing", "absent") for n, s in enumerate(o["required_streams"]) if s not in have]
    return Found(rec.spark.createDataFrame(rows, "n int, stream string, message string, observed string"), ("n",), "present")


@rule("episode.unique_ids", "Episode identifiers are unique", "error", "dataset", "metadata", cap=False)
def unique_ids(rec, o):
    """Findings and splits cannot name an episode whose identifier another one has too.

    Give every episode an identifier of its own."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("episode").orderBy("pos"))
    rows = rec.episodes.select("pos", "episode", n.alias("n")).where("n > 1")
    return Found(rows.select("pos", "episode", text("Episode identifier {} is repeated", "episode").alias("message"), F.col("episode").alias("observed")), expected="unique identifier")


@rule("episode.valid_boundaries", "Episode ranges fit their length", "error", "episode", "metadata", cap=False, allow_empty=False)
def valid_boundaries(rec, o):
    """Empty, overlapping or inconsistent ranges point to incomplete data.

    Finish the recording, or build the episode metadata again."""
    if rec.files and not rec.is_stored("episode_index"):
        raise SourceError("samples lack episode_index")
    ranged = F.col("from_index").isNotNull() & F.col("to_index").isNotNull()
    e = last_before(rec.episodes.withColumn("_to", F.when(ranged, F.col("to_index"))), "_to", "pos", "before")
    e = e.join(rec.samples().groupBy("pos").agg(F.count(F.lit(1)).alias("n")), "pos", "left")
    stored = F.when(F.col("data_file").isNotNull(), F.coalesce("n", F.lit(0)))
    bad = (F.col("length") < (0 if o["allow_empty"] else 1)) | F.coalesce(stored != F.col("length"), F.lit(False))
    length = F.col("to_index") - F.col("from_index")
    bad = bad | (ranged & ((length <= 0) | (length != F.col("length")) | F.coalesce(F.col("from_index") < F.col("before"), F.lit(False))))
    seen = record(length=F.col("length"), from_index=F.col("from_index"), to_index=F.col("to_index"), stored_rows=stored)
    rows = e.where(bad).select("pos", "episode", F.col("data_file").alias("source"), text("Range of {} does not fit", "episode").alias("message"), seen.alias("observed"))
    return Found(rows, expected="positive length, ordered non-overlapping range matching length")


@rule("manifest.shape_consistency", "Values have their declared shape", "error", "stream", needs="episodes numeric")
def shape_consistency(rec, o):
    """A changed number of joints corrupts batches without an error.

    Split recordings of different robots, or export values in the declared shape."""
    from pyspark.sql import types as T

    rows, parts = rec.samples(), []
    for n, s in enumerate(s for s in rec.streams if s.kind == "numeric"):
        if not rec.is_stored(s.key):
            continue
        kind, column, sizes = rows.schema[s.key].dataType, F.col(f"`{s.key}`"), []
        while isinstance(kind, T.ArrayType):
            sizes.append(column)
            column, kind = F.get(column, F.lit(0)), kind.elementType
        of = rec.with_columns(s.key)
        gone = F.lit(False)
        if sizes:
            gone = F.col(f"`{s.key}`").isNull()
        tops = [F.struct(F.min(F.size(c)).alias("a"), F.max(F.size(c)).alias("b")).alias(f"d{i}") for i, c in enumerate(sizes)]
        per = of.groupBy("pos", "episode", "source").agg(F.count_if(gone).alias("gone"), *tops)
        even = F.col("gone") == 0
        for i in range(len(sizes)):
            even = even & (F.col(f"d{i}.a") == F.col(f"d{i}.b"))
        actual = F.when(even, F.array(*[F.col(f"d{i}.a").cast("long") for i in range(len(sizes))]) if sizes else F.array().cast("array<long>")).otherwise(F.array().cast("array<long>"))
        want = F.array(*[F.lit(x).cast("long") for x in s.shape]) if s.shape and not (s.shape == (1,) and not sizes) else F.array().cast("array<long>")
        bad = per.withColumn("actual", actual).where(F.col("actual") != want)
        shown = F.array(*[F.lit(x).cast("long") for x in s.shape]) if s.shape else F.array().cast("array<long>")
        parts.append(bad.select("pos", F.lit(n).alias("n"), "episode", F.lit(s.key).alias("stream"), "source", text(f"{s.key} is stored in another shape than declared in {{}}", "episode").alias("message"), F.col("actual").alias("observed"), shown.alias("expected")))
    return Found(union(parts), ("pos", "n")) if parts else nothing(rec)


@rule("episode.index_columns", "Indexes follow the order of rows", "error", "episode")
def index_columns(rec, o):
    """Samplers load wrong frames, silently, where frame or data set indexes are wrong.

    Build the index columns again from the order of rows."""
    parts = []
    starts = rec.episodes.select("pos", F.col("from_index").alias("start"))
    for n, column in enumerate(("frame_index", "index")):
        if not rec.is_stored(column):
            continue
        rows = rec.with_columns(column)
        value = flat(F.col(column), rows.schema[column].dataType)[0].cast("long")
        rows = rows.withColumn("start", F.lit(0).cast("long")) if n == 0 else rows.join(starts, "pos").where("start IS NOT NULL")
        bad = rows.withColumn("want", F.col("start") + F.col("row_pos")).withColumn("value", value).where(~F.col("value").eqNullSafe(F.col("want")))
        first = bad.groupBy("pos", "episode", "source").agg(F.min(F.struct("row_pos", "value", "want")).alias("f"), F.count(F.lit(1)).alias("bad"))
        parts.append(first.select("pos", F.lit(n).alias("n"), "episode", F.lit(column).alias("stream"), F.col("f.row_pos").alias("sample_index"), "source", text(f"{column} does not follow the order of rows in {{}}", "episode").alias("message"), record(value=F.col("f.value"), mismatched_in_batch=F.col("bad")).alias("observed"), F.col("f.want").alias("expected")))
    return Found(union(parts), ("pos", "n")) if parts else nothing(rec)


@rule("manifest.declared_totals", "Declared totals are those of the episodes", "error", "dataset", "metadata", "episodes metadata", cap=False)
def declared_totals(rec, o):
    """Totals that are out of date show an incomplete export or copy.

    Write meta/info.json again from the finished episode metadata."""
    sums = rec.episodes.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total_frames"), F.count(F.lit(1)).alias("total_episodes")).first()
    rows = []
    for n, name in enumerate(("total_frames", "total_episodes")):
        if name in rec.info and rec.info[name] != sums[name]:
            rows.append((n, "meta/info.json", f"meta/info.json declares {name} = {rec.info[name]}, the episodes have {sums[name]}", int(rec.info[name]), sums[name]))
    return Found(rec.spark.createDataFrame(rows, "n int, source string, message string, observed long, expected long"), ("n",))


@rule("episode.task_references", "Task indexes are declared", "error", "episode", needs="episodes metadata", note="Needs task metadata and a stored task_index.")
def task_references(rec, o):
    """An unknown task index gives an episode the wrong instruction, or none.

    Build the task metadata again, or correct task_index."""
    known = known_tasks(rec)
    if known is None:
        raise NotApplicable("the source has no task metadata that can be read")
    if not rec.is_stored("task_index"):
        return nothing(rec)
    rows = rec.with_columns("task_index")
    used = rows.select("pos", "episode", flat(F.col("task_index"), rows.schema["task_index"].dataType)[0].cast("long").alias("task_index")).where("task_index IS NOT NULL").distinct()
    bad = used.join(known.distinct(), "task_index", "left_anti").groupBy("pos", "episode").agg(F.slice(F.sort_array(F.collect_set("task_index")), 1, 20).alias("observed"))
    return Found(bad.select("pos", "episode", F.lit("task_index").alias("stream"), text("{} has task indexes that are not declared", "episode").alias("message"), "observed"), expected="task_index declared in task metadata")


@rule("manifest.orphan_files", "Stored files belong to episodes", "warning", "dataset", "metadata", "episodes metadata")
def orphan_files(rec, o):
    """Files that no episode names can mean that episodes were lost from the metadata.

    Restore the episodes' metadata, or remove what is left over."""
    stored = listed(rec, [f.path for f in [*rec.files, *rec.store.files("videos", ".mp4")]])
    rows = missing_from(stored, referenced(rec), ["source"])
    return Found(rows.select("source", text("No episode names the stored file {}", "source").alias("message"), F.lit("unreferenced").alias("observed")), ("source",), "referenced by at least one episode")
