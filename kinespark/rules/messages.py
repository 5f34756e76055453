"""Rules on message recordings and on robot messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import NotApplicable
from .base import Found, record, rule, text, union

_FILE = ("mcap",)
NANO = 1_000_000_000


def _steps(rec, *columns: str) -> DataFrame:
    """Messages with their place in their channel and each column's value before them."""
    by = W.partitionBy("channel_id").orderBy("pos")
    rows = rec.messages.messages.withColumn("place", F.row_number().over(by) - 1)
    for c in columns:
        rows = rows.withColumn(f"{c}_before", F.lag(c).over(by))
    return rows


def _one(rec, message: str, observed, schema: str) -> Found:
    return Found(rec.spark.createDataFrame([(0, rec.store.name, message, observed)], f"n int, source string, message string, observed {schema}"), ("n",))


@rule("mcap.readable", "The file reads to its end", "error", "recording", needs="mcap", adapters=_FILE, cap=False)
def readable(rec, o):
    """A truncated or corrupt file loses a part, or all, of a recording.

    Recover the original, or finish and convert it again."""
    error = rec.messages.facts["error"]
    if error is None:
        return Found(rec.spark.createDataFrame([], "n int, message string"), ("n",))
    found = _one(rec, "Reading stopped before the end of the recording", error, "string")
    return Found(found.rows, ("n",), "all records readable and every available CRC valid")


@rule("mcap.summary_consistency", "The summary is that of the records", "error", "recording", needs="mcap", adapters=_FILE)
def summary_consistency(rec, o):
    """Statistics that are out of date hide messages that are missing.

    Finish or write the file again."""
    facts = rec.messages.facts
    if not facts["summary"]:
        raise NotApplicable("the recording has no summary")
    expected = facts["expected"]
    if expected is None:
        return Found(rec.spark.createDataFrame([], "n int, message string"), ("n",))
    seen = {"message_count": facts["messages"], "channel_count": facts["data_channels"], "schema_count": facts["data_schemas"], "attachment_count": facts["attachments"], "metadata_count": facts["metadata"]}
    wanted = rec.spark.createDataFrame([(int(k), v, n) for n, (k, v) in enumerate(expected["channels"].items())], "channel_id int, expected long, n int")
    got = rec.messages.messages.groupBy("channel_id").agg(F.count(F.lit(1)).alias("observed"))
    per = wanted.join(got, "channel_id", "left").withColumn("observed", F.coalesce("observed", F.lit(0))).where("observed != expected")
    per = per.select((F.col("n") + 10).alias("n"), F.concat(F.lit("channel["), F.col("channel_id"), F.lit("].message_count")).alias("name"), "observed", "expected")
    whole = rec.spark.createDataFrame([(n, k, v, expected[k]) for n, (k, v) in enumerate(seen.items()) if v != expected[k]], "n int, name string, observed long, expected long")
    rows = whole.unionByName(per)
    return Found(rows.select("n", F.lit(rec.store.name).alias("source"), text("Summary field {} is not that of the records", "name").alias("message"), "observed", "expected"), ("n",))


@rule("mcap.index_coverage", "The file has a summary and indexes", "notice", "recording", "metadata", "mcap", adapters=_FILE, cap=False, note="Fast writers leave indexes out on purpose.")
def index_coverage(rec, o):
    """Without indexes a part of a recording cannot be read by itself.

    Compress or convert recordings that are kept for long."""
    facts = rec.messages.facts
    why = [] if facts["summary"] else ["summary section is absent"]
    if facts["messages"] and not facts["chunk_indexes"]:
        why.append("chunk indexes are absent")
    rows = [(0, rec.store.name, "; ".join(why), (facts["summary"], facts["chunk_indexes"]))] if why else []
    return Found(rec.spark.createDataFrame(rows, "n int, source string, message string, observed struct<summary:boolean,chunk_indexes:int>"), ("n",), "summary and indexes for efficient long-term access")


@rule("mcap.channel_schema", "Channels and schemas fit together", "error", "channel", "metadata", "mcap", adapters=_FILE)
def channel_schema(rec, o):
    """A schema that is missing, or two for one topic, leaves messages that cannot be decoded.

    Write channels again with one schema each."""
    c = rec.messages.channels
    gone = c.where("schema_id != 0 AND schema_name IS NULL").select(F.lit(0).alias("step"), F.col("channel_id").alias("n"), F.col("topic").alias("stream"), text("Channel {} names schema {}, which is missing", "channel_id", "schema_id").alias("message"), F.to_json(record(schema_id=F.col("schema_id"))).alias("observed"), F.lit("referenced schema exists").alias("expected"))
    kinds = c.groupBy("topic").agg(F.sort_array(F.collect_set(F.array(F.coalesce("message_encoding", F.lit("")), F.coalesce("schema_name", F.lit("")), F.coalesce("schema_encoding", F.lit(""))))).alias("k"), F.min("channel_id").alias("n"))
    mixed = kinds.where(F.size("k") > 1).select(F.lit(1).alias("step"), "n", F.col("topic").alias("stream"), text("Topic {} is declared in several ways", "topic").alias("message"), F.to_json("k").alias("observed"), F.lit("one stable encoding and schema per topic").alias("expected"))
    return Found(gone.unionByName(mixed).withColumn("source", F.lit(rec.store.name)), ("step", "n"))


@rule("mcap.timestamp_order", "Clocks do not fall back", "error", "channel", needs="mcap", adapters=_FILE, version="2.0.0", max_reorder_ms=100.0, check_publish_time=False, note="Small changes of order are no error in this format.")
def timestamp_order(rec, o):
    """A long step back is a clock that was reset.

    Fix the recorder's clock, or split the recording there."""
    limit = float(o["max_reorder_ms"]) * 1_000_000
    parts = []
    for n, c in enumerate(["log_time"] + ["publish_time"] * bool(o["check_publish_time"])):
        rows = _steps(rec, c).withColumn("delta", F.col(c) - F.col(f"{c}_before")).where("delta < 0")
        total = F.count(F.lit(1)).over(W.partitionBy("channel_id"))
        bad = rows.withColumn("total", total).where(-F.col("delta") > limit)
        parts.append(bad.select("channel_id", F.lit(n).alias("n"), "place", F.col("topic").alias("stream"), F.col("place").alias("sample_index"), (F.col(c) / NANO).alias("timestamp"), text(f"{c} of {{}} falls back ({{}} step(s) back in all)", "topic", "total").alias("message"), record(delta_ns=F.col("delta"), transition_count=F.col("total")).alias("observed")))
    return Found(union(parts).withColumn("source", F.lit(rec.store.name)), ("channel_id", "n", "place"), {"max_backward_step_ms": o["max_reorder_ms"]})


@rule("mcap.duplicate_timestamps", "Times tell messages apart", "warning", "channel", needs="mcap", adapters=_FILE)
def duplicate_timestamps(rec, o):
    """Messages at one time have no order of their own.

    Record finer times, or a sequence number."""
    rows = _steps(rec, "log_time").groupBy("channel_id", "topic").agg(F.count_if(F.col("log_time") == F.col("log_time_before")).alias("k")).where("k > 0")
    return Found(rows.select("channel_id", F.col("topic").alias("stream"), F.lit(rec.store.name).alias("source"), text("{} has {} repeated log time(s)", "topic", "k").alias("message"), record(duplicate_transitions=F.col("k")).alias("observed")), ("channel_id",), "unique log time or an explicit sequence contract")


@rule("mcap.sequence_continuity", "Sequence numbers have no gaps", "warning", "channel", needs="mcap", adapters=_FILE, note="Numbers that are all zero count as not given.")
def sequence_continuity(rec, o):
    """A gap in the sequence is a lost message that times may not show.

    Look for losses in transport."""
    rows = _steps(rec, "sequence").where("sequence_before IS NOT NULL AND NOT (sequence = 0 AND sequence_before = 0) AND sequence - sequence_before != 1")
    per = rows.groupBy("channel_id", "topic").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("place", F.col("sequence_before").alias("p"), "sequence")).alias("f"))
    seen = record(previous=F.col("f.p"), current=F.col("f.sequence"), transition_count=F.col("k"))
    return Found(per.select("channel_id", F.col("topic").alias("stream"), F.col("f.place").alias("sample_index"), F.lit(rec.store.name).alias("source"), text("{} has {} break(s) in its sequence", "topic", "k").alias("message"), seen.alias("observed")), ("channel_id",), "sequence delta == 1")


@rule("ros2.encoding", "Channels are CDR with a definition", "error", "topic", "metadata", "ros2", adapters=_FILE)
def encoding(rec, o):
    """Other encodings, or no definition, cannot be decoded elsewhere.

    Record with CDR and embedded definitions."""
    bad = rec.messages.channels.where(~(F.col("message_encoding").eqNullSafe("cdr") & F.col("schema_encoding").eqNullSafe("ros2msg")))
    seen = record(message_encoding=F.col("message_encoding"), schema_encoding=F.col("schema_encoding"), schema=F.col("schema_name"))
    return Found(bad.select("channel_id", F.col("topic").alias("stream"), F.lit(rec.store.name).alias("source"), text("Topic {} is not CDR with a definition", "topic").alias("message"), seen.alias("observed")), ("channel_id",), {"message_encoding": "cdr", "schema_encoding": "ros2msg"})


@rule("ros2.decode", "Messages decode", "error", "topic", needs="ros2_decode", adapters=_FILE)
def decode(rec, o):
    """A payload that does not decode is lost.

    Restore the definition, or record again."""
    bad = _steps(rec).where("decode_error IS NOT NULL")
    first = F.row_number().over(W.partitionBy("channel_id").orderBy("pos"))
    per = bad.withColumn("k", first).groupBy("channel_id", "topic").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "decode_error")))).alias("e"))
    return Found(per.select("channel_id", F.col("topic").alias("stream"), F.lit(rec.store.name).alias("source"), text("{} message(s) of {} do not decode", "n", "topic").alias("message"), record(examples=F.transform("e", lambda x: x["decode_error"])).alias("observed")), ("channel_id",), "all CDR payloads decode with the embedded schema")


@rule("ros2.required_topics", "Required topics are there", "error", "recording", "metadata", "ros2", adapters=_FILE, cap=False, required_topics=[])
def required_topics(rec, o):
    """A recording without a topic of its contract is incomplete.

    Fix the selection of topics, and record again."""
    if not o["required_topics"]:
        raise NotApplicable("no required topics are configured")
    wanted = rec.spark.createDataFrame([(n, t) for n, t in enumerate(o["required_topics"])], "n int, topic string")
    gone = wanted.join(rec.messages.messages.select("topic").distinct(), "topic", "left_anti")
    return Found(gone.select("n", F.col("topic").alias("stream"), F.lit(rec.store.name).alias("source"), text("Required topic {} is missing", "topic").alias("message"), F.lit("absent").alias("observed")), ("n",), "present")


@rule("ros2.topic_gaps", "Topics keep their rate", "warning", "topic", needs="ros2", adapters=_FILE, topic_rates_hz={}, max_gap_multiplier=5.0, min_messages=3, note="Only topics with a configured rate are read.")
def topic_gaps(rec, o):
    """A long gap is a lost message or a sensor that stalled.

    Look at the publisher and the recorder around the gap."""
    if not o["topic_rates_hz"]:
        raise NotApplicable("no rates of topics are configured")
    rates = F.broadcast(rec.spark.createDataFrame([(t, 1e9 / float(r) * float(o["max_gap_multiplier"])) for t, r in o["topic_rates_hz"].items()], "topic string, most double"))
    rows = _steps(rec, "log_time").withColumn("gap", F.col("log_time") - F.col("log_time_before"))
    per = rows.groupBy("channel_id", "topic").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("gap") > 0, F.struct("gap", (-F.col("place")).alias("p"), "log_time"))).alias("g"))
    bad = per.join(rates, "topic").where((F.col("n") >= int(o["min_messages"])) & (F.col("g.gap") > F.col("most")))
    return Found(bad.select("channel_id", F.col("topic").alias("stream"), (-F.col("g.p")).alias("sample_index"), (F.col("g.log_time") / NANO).alias("timestamp"), F.lit(rec.store.name).alias("source"), text("{} has a gap over {} ms", F.col("topic"), F.round(F.col("most") / 1e6, 1)).alias("message"), record(max_gap_ms=F.col("g.gap") / 1e6).alias("observed"), record(max_gap_ms=F.col("most") / 1e6).alias("expected")), ("channel_id",))


@rule("ros2.header_clock_skew", "Header and log times are close", "warning", "topic", needs="ros2_decode", adapters=_FILE, max_header_skew_ms=None, note="Needs a limit: the two clocks may be of different kinds.")
def header_clock_skew(rec, o):
    """Clocks far apart shift sensors against each other.

    Synchronise the clocks, or convert one to the other."""
    if o["max_header_skew_ms"] is None:
        raise NotApplicable("no largest difference of header and log times is configured")
    rows = _steps(rec).where("header_stamp IS NOT NULL").withColumn("skew", F.abs(F.col("header_stamp") - F.col("log_time")))
    per = rows.groupBy("channel_id", "topic").agg(F.max(F.struct("skew", (-F.col("place")).alias("p"))).alias("w")).where(F.col("w.skew") > float(o["max_header_skew_ms"]) * 1_000_000)
    return Found(per.select("channel_id", F.col("topic").alias("stream"), (-F.col("w.p")).alias("sample_index"), F.lit(rec.store.name).alias("source"), text(f"Header and log times of {{}} differ by over {o['max_header_skew_ms']} ms", "topic").alias("message"), record(maximum_absolute_skew_ms=F.col("w.skew") / 1e6).alias("observed")), ("channel_id",), {"max_header_skew_ms": o["max_header_skew_ms"]})


@rule("ros2.semantic_consistency", "Known messages keep their invariants", "error", "topic", needs="ros2_decode", adapters=_FILE, version="1.1.0")
def semantic_consistency(rec, o):
    """Joint states, transforms and images that contradict themselves corrupt what reads them.

    Fix the publisher."""
    long = rec.messages.messages.where(F.size("semantic") > 0).select("channel_id", "topic", "pos", F.posexplode("semantic").alias("k", "what"))
    total = long.groupBy("channel_id").agg(F.count(F.lit(1)).alias("total"))
    rows = long.join(F.broadcast(total), "channel_id")
    seen = record(inconsistent_message=F.col("what"), total_semantic_errors=F.col("total"))
    return Found(rows.select("channel_id", "pos", "k", F.col("topic").alias("stream"), F.lit(rec.store.name).alias("source"), F.col("what").alias("message"), seen.alias("observed")), ("channel_id", "pos", "k"), "ROS message invariants satisfied")


@rule("ros2.tf_tree", "Frames have one parent", "warning", "recording", needs="ros2_decode", adapters=_FILE, note="A frame may change its parent on purpose.")
def tf_tree(rec, o):
    """Two parents of one frame make its place ambiguous.

    Correct the frames' names, or split the recording."""
    edges = rec.messages.messages.where(F.size("children") > 0).select(F.explode(F.arrays_zip("parents", "children")).alias("e")).select("e.parents", "e.children").distinct()
    fine = edges.where("parents != '' AND children != '' AND parents != children")
    per = fine.groupBy(F.col("children").alias("child")).agg(F.sort_array(F.collect_set("parents")).alias("p")).where(F.size("p") > 1)
    return Found(per.select("child", F.lit("/tf").alias("stream"), F.lit(rec.store.name).alias("source"), text("Frame {} has several parents", "child").alias("message"), record(parents=F.col("p")).alias("observed")), ("child",), "one stable parent per child frame")
