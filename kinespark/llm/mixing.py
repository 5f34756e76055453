"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential variate divided by its quality weight, so small keys are
drawn first. Within a source the documents are taken in key order up to the source's word
budget; budgets beyond the source's size first take complete epochs, then a fraction of one
more. Nothing is sorted as one whole source: keys fall into ``bins`` ranges, range totals are
prefix-summed by source, and only inside the range that holds the budget's edge are documents
sorted, after equal ones have been counted together. So a source, or copies of one document,
may be a third of all rows.

Defined cases: null text has size 0 and is never taken in a fraction; the null source is a
source of its own and comes last; the key reads id and text, so rows that share an id only have
keys of their own; of rows equal in both, as many are taken as the budget has room for, row by
row; a null id counts as an empty one; very long texts are counted whole; an empty table gives
no rows; a total of 0 takes nothing; other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored

#: No document is taken more often.
MOST_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: More sources than this are joined by a shuffle.
BROADCAST_SOURCES = 20_000
#: ASCII digits and signs.
MARK = r"[!-@\[-`{-~]"
_HEX = 13  # of md5, so the variate's 52 bits are exact in a double


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text", size: str = "size") -> Column:
    """From 0.1 for junk up to 1.1: few digits and signs in the text, and more than a few words."""
    s = F.col(size).cast("double")
    chars = F.greatest(F.char_length(F.col(text)), F.lit(1)).cast("double")
    marks = F.coalesce(F.regexp_count(F.col(text), F.lit(MARK)).cast("double") / chars, F.lit(0.0))
    return F.lit(0.1) + s / (s + F.lit(20.0)) / (F.lit(1.0) + F.lit(100.0) * marks * marks)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> the same with ``target``.

    Weights repeat over the sources in code point order, null last. A source is held at
    MOST_EPOCHS times its size and the excess is shared again by weight: sources in the order
    of size / weight fill up first, so prefix sums decide who is held.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    at = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at + 1).cast("int"))
    cap = F.col("source_size").cast("double") * MOST_EPOCHS
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    below = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    ranked = (
        sizes.withColumn("w", w)
        .withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("held_cap", F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("held_cap")) / F.col("left_w"))
        .withColumn("held", F.col("level") * F.col("w") >= F.col("cap"))
    )
    # the first source that is not held gives the level of all that are not held
    level = F.min(F.when(~F.col("held"), F.struct(F.col("cap") / F.col("w"), "level"))).over(whole)["level"]
    return ranked.withColumn(
        "target",
        F.when(F.col("held"), F.col("cap")).otherwise(F.least(level * F.col("w"), F.col("cap"))),
    ).select("source", "source_size", "target")


def sampling_key(seed: str = "mix") -> Column:
    """-ln(u) / quality; u comes from md5 of the seed, the id and the text, so reruns agree."""
    named = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    digest = F.md5(named.cast("binary"))
    u = (F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("long").cast("double") + 0.5) / float(16**_HEX)
    return -F.log(u) / quality_weight()


def _sized(docs: DataFrame, bins: int, seed: str) -> DataFrame:
    """``docs`` with size, key, the key's range, and a source key without nulls."""
    return (
        docs.withColumn("size", words())
        .withColumn("key", sampling_key(seed))
        .withColumn("bin", F.floor(F.lit(bins) * (1 - F.exp(-F.col("key")))).cast("int"))
        .withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    )


def _with_plan(rows: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """Joins the plan by source: broadcast only if it is known to be small."""
    plan = plan.drop("source")
    return rows.join(F.broadcast(plan) if sources <= BROADCAST_SOURCES else plan, "skey")


def _planned(sized: DataFrame, weights: tuple[int, ...]) -> tuple[DataFrame, int, bool]:
    """The plan, one row for each source; its rows; whether some source takes a part of equal rows."""
    by_bin = stored(sized.groupBy("source", "skey", "bin").agg(F.sum("size").alias("bin_size")))
    by_source = by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    plan = (
        targets(by_source, weights)
        .withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
        .withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    )
    before = W.partitionBy("skey").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    edge = (
        by_bin.withColumn("offset", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
        .join(plan.select("skey", "rest"), "skey")
        .where(F.col("offset") + F.col("bin_size") > F.col("rest"))
        .groupBy("skey")
        .agg(F.min("bin").alias("edge_bin"), F.min_by("offset", "bin").alias("edge_offset"))
    )
    plan = stored(plan.join(edge, "skey", "left"))
    sources = plan.count()
    # documents are ordered only inside the one range that holds the budget's edge, equal ones as one
    inside = _with_plan(sized, plan.select("source", "skey", "edge_bin", "edge_offset", "rest"), sources).where("bin = edge_bin")
    alike = inside.groupBy("skey", "key", "doc_id", "size", "edge_offset", "rest").agg(F.count(F.lit(1)).alias("m"))
    order = W.partitionBy("skey").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    room = F.col("rest") - F.col("edge_offset") - F.coalesce(F.sum(F.col("size") * F.col("m")).over(order), F.lit(0)) - F.col("size") / 2
    fit = F.when(F.col("size") > 0, F.floor(room / F.col("size")) + 1).otherwise(F.col("m"))
    last = (
        alike.withColumn("room", room)
        .where("room >= 0")
        .withColumn("r", F.least(fit, F.col("m")).cast("long"))
        .groupBy("skey")
        .agg(F.max(F.struct("key", "doc_id", "size", "r", "m")).alias("last"))
    )
    plan = stored(plan.join(last, "skey", "left"))
    return plan, sources, not plan.where("last.r < last.m").isEmpty()


def _taken(rows: DataFrame, plan: DataFrame, sources: int, parted: bool) -> DataFrame:
    """``rows`` of ``_sized`` with the plan's columns and ``copies``, the whole takes of each row.

    ``last`` is the last document taken inside the edge's range; where only ``r`` of ``m``
    rows equal to it fit, they are numbered: inside a partition by a window, across partitions by
    prefix sums of their counts.
    """
    joined = _with_plan(rows, plan, sources)
    mine, last = F.struct("key", "doc_id", "size"), F.struct("last.key", "last.doc_id", "last.size")
    at_edge = F.coalesce((F.col("bin") == F.col("edge_bin")) & F.col("last").isNotNull(), F.lit(False))
    inside = F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin"))

    def with_copies(df: DataFrame, more: Column) -> DataFrame:
        part = (F.col("size") > 0) & (F.col("rest") > 0) & F.coalesce(more, F.lit(False))
        return df.withColumn("copies", (F.col("full") + F.when(part, 1).otherwise(0)).cast("long"))

    if not parted:
        return with_copies(joined, inside | (at_edge & (mine <= last)))
    tied = at_edge & (mine == last) & F.coalesce(F.expr("last.r < last.m"), F.lit(False))
    ties = stored(joined.where(tied).withColumn("pid", F.spark_partition_id()).withColumn("rid", F.monotonically_increasing_id()))
    counts = ties.groupBy("skey", "pid").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(W.partitionBy("skey").orderBy("pid").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("skey", "pid", F.coalesce(before, F.lit(0)).alias("ahead"))
    number = F.col("ahead") + F.row_number().over(W.partitionBy("skey", "pid").orderBy("rid"))
    numbered = ties.join(offsets, ["skey", "pid"]).withColumn("number", number)
    others = with_copies(joined.where(~tied), inside | (at_edge & (mine <= last)))
    return others.unionByName(with_copies(numbered, F.col("number") <= F.col("last.r")).select(*others.columns))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, bins: int = 4096, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row.

    ``copies`` counts whole takes of the document, complete epochs first. The document at the
    edge of the budget is taken if at least half of it fits. Texts are read once.
    """
    sized = stored(_sized(docs.select("doc_id", "source", "text"), bins, seed).drop("text"))
    rows = _taken(sized, *_planned(sized, weights))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, bins: int = 4096, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns are those of ``docs``.

    Texts stay where they are: the plan, one row for each source, goes to the documents.
    """
    plan = _planned(stored(_sized(docs.select("doc_id", "source", "text"), bins, seed).drop("text")), weights)
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text")
    taken = _taken(_sized(base, bins, seed).drop("text"), *plan).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
