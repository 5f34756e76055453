"""Rules on recorded messages and their channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import row_pos


def rollbacks(m: DataFrame, channel: str, order: str, t: str, limit: float) -> DataFrame:
    """Messages whose time falls back by more than the limit."""
    d = F.col(t) - F.lag(t).over(W.partitionBy(channel).orderBy(order))
    return m.select(channel, row_pos(channel, order).alias("row_pos"), d.alias("delta")).where((F.col("delta") < 0) & (-F.col("delta") > limit))


def duplicate_timestamps(m: DataFrame, channel: str, order: str, t: str) -> DataFrame:
    """Neighbouring messages of a channel at the same time."""
    same = F.col(t) == F.lag(t).over(W.partitionBy(channel).orderBy(order))
    return m.select(channel, same.alias("same")).groupBy(channel).agg(F.count_if("same").alias("repeats")).where("repeats > 0")


def sequence_continuity(m: DataFrame, channel: str, order: str, sequence: str) -> DataFrame:
    """(channel, first, breaks): steps other than 1, unless both numbers are 0."""
    before = F.lag(sequence).over(W.partitionBy(channel).orderBy(order))
    rows = m.select(channel, F.col(order).alias("_o"), F.col(sequence).alias("s"), before.alias("p")).where("p IS NOT NULL")
    bad = rows.where((F.col("s") - F.col("p") != 1) & ~((F.col("s") == 0) & (F.col("p") == 0)))
    return bad.groupBy(channel).agg(F.min("_o").alias("first"), F.count(F.lit(1)).alias("breaks"))


def topic_gaps(m: DataFrame, topic: str, order: str, t: str, rates: DataFrame, multiplier: float = 5.0, least: int = 3) -> DataFrame:
    """Topics whose largest gap exceeds ``multiplier`` periods; ``rates``: (topic, period)."""
    d = F.col(t) - F.lag(t).over(W.partitionBy(topic).orderBy(order))
    per = m.select(topic, d.alias("gap")).groupBy(topic).agg(F.max("gap").alias("gap"), F.count(F.lit(1)).alias("n"))
    return per.join(rates, topic).where((F.col("n") >= least) & (F.col("gap") > multiplier * F.col("period"))).select(topic, "gap", "n")


def header_skew(m: DataFrame, topic: str, order: str, stamp: str, log: str, limit: float) -> DataFrame:
    """(topic, skew, at): the earliest largest difference of a header's clock from the log's."""
    d = F.abs(F.col(stamp) - F.col(log))
    per = m.groupBy(topic).agg(F.max(F.struct(d.alias("skew"), (-F.col(order)).alias("o"))).alias("w"))
    return per.select(topic, F.col("w.skew").alias("skew"), (-F.col("w.o")).alias("at")).where(F.col("skew") > limit)


def channel_schema(channels: DataFrame, topic: str, parts: list[str]) -> DataFrame:
    """Topics with more than one combination of encoding and schema."""
    return channels.select(topic, *parts).distinct().groupBy(topic).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")


def summary_consistency(expected: DataFrame, m: DataFrame, channel: str, count: str) -> DataFrame:
    """Channels whose messages differ from the recorded statistics; null is unknown."""
    got = m.groupBy(channel).agg(F.count(F.lit(1)).alias("messages"))
    both = expected.select(channel, F.col(count).cast("long").alias("expected")).where("expected IS NOT NULL").join(got, channel, "left")
    return both.select(channel, "expected", F.coalesce("messages", F.lit(0)).alias("messages")).where("expected != messages")


def decode_errors(m: DataFrame, channel: str, order: str, error: str) -> DataFrame:
    """(channel, errors, first): messages that did not decode."""
    return m.where(F.col(error).isNotNull()).groupBy(channel).agg(F.count(F.lit(1)).alias("errors"), F.min_by(error, order).alias("first"))


def encoding(channels: DataFrame, channel: str, message: str, schema: str, want: tuple[str, str] = ("cdr", "ros2msg")) -> DataFrame:
    """Channels of another encoding than wanted; null is another."""
    return channels.where(~(F.col(message).eqNullSafe(want[0]) & F.col(schema).eqNullSafe(want[1]))).select(channel, message, schema)


def tf_tree(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """(child, parents): frames with more than one parent, joined by commas; empty names do not count."""
    p, c = F.col(parent).cast("string"), F.col(child).cast("string")
    fine = edges.where((p != "") & (c != "") & (p != c)).select(parent, child).distinct()
    per = fine.groupBy(child).agg(F.sort_array(F.collect_set(parent)).alias("_p")).where(F.size("_p") > 1)
    return per.select(child, F.array_join(F.transform("_p", lambda x: x.cast("string")), ",").alias("parents"))


def joint_errors(m: DataFrame, channel: str, order: str, names: str, fields: list[str]) -> DataFrame:
    """(channel, row_pos, error): fields of joint states of another size than the names, or not finite."""
    def wrong(f: str) -> list[Column]:
        v = F.col(f).cast("array<double>")
        size = F.when((F.size(v) > 0) & (F.size(v) != F.size(names)), F.concat(F.lit(f"{f} has "), F.size(v), F.lit(" values but name has "), F.size(names), F.lit(" entries")))
        odd = F.when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(f"JointState {f} contains a non-finite value"))
        return [size, odd]

    errors = F.filter(F.array(*[e for f in fields for e in wrong(f)]), lambda e: e.isNotNull())
    return m.select(channel, row_pos(channel, order).alias("row_pos"), errors.alias("_e")).select(channel, "row_pos", F.explode("_e").alias("error"))
