"""Trials of recipes against rules, as DataFrames: outcomes, rates with their intervals, and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The normal deviate of a two-sided 95 percent interval.
Z = 1.959963984540054
TRIALS = "trial string, recipe string, category string, split string, level int, rule string, target string, benign boolean"


def new_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings (trial, rule, episode, effect) that the defect brought: those of the trial less those of the clean run."""
    return after.join(before.select("rule", "episode", "effect").distinct(), [after.rule.eqNullSafe(before.rule), after.episode.eqNullSafe(before.episode), after.effect == before.effect], "left_anti").distinct()


def outcomes(trials: DataFrame, found: DataFrame) -> DataFrame:
    """``trials`` with ``outcome``: localized, dataset_level, failed_closed or missed; and ``blocking``.

    Localized: some rule names the target. Dataset level: findings name no episode, or others alone.
    Failed closed: nothing is found, but a rule ended in an error.
    """
    per = found.join(trials.select("trial", "target"), "trial").groupBy("trial").agg(
        F.bool_or((F.col("episode") == F.col("target")) & (F.col("effect") != "errored")).alias("named"),
        F.bool_or(F.col("effect") != "errored").alias("any"), F.bool_or(F.col("effect") == "errored").alias("errored"), F.bool_or(F.col("effect") == "blocking").alias("blocking"),
    )
    no = F.lit(False)
    out = trials.join(per, "trial", "left")
    kind = F.when(F.coalesce("named", no), "localized").when(F.coalesce("any", no), "dataset_level").when(F.coalesce("errored", no), "failed_closed").otherwise("missed")
    return out.select(*trials.columns, kind.alias("outcome"), F.coalesce("blocking", no).alias("blocking"))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """The interval of a share at 95 percent."""
    p = hits / n
    centre, half = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    return (centre - half) / (1 + Z * Z / n), (centre + half) / (1 + Z * Z / n)


def rates(scored: DataFrame) -> DataFrame:
    """Rates over all, and by split, category, recipe and level, in one pass by grouping sets.

    ``macro`` is the mean over recipes of each recipe's rate, so that many trials of one defect do
    not outweigh the others.
    """
    hit = scored.withColumn("hit", (F.col("outcome") != "missed").cast("int"))
    hit.createOrReplaceTempView("_kinespark_trials")
    spark = scored.sparkSession
    sums = spark.sql("""
        SELECT split, category, recipe, level, CAST(count(*) AS DOUBLE) AS n, CAST(sum(hit) AS DOUBLE) AS hits, avg(CAST(blocking AS INT)) AS blocking_rate,
          CASE grouping_id(split, category, recipe, level) WHEN 15 THEN 'all' WHEN 7 THEN 'split' WHEN 11 THEN 'category' WHEN 13 THEN 'recipe' ELSE 'recipe and level' END AS grouped_by
        FROM _kinespark_trials GROUP BY GROUPING SETS ((), (split), (category), (recipe), (recipe, level))""")
    low, high = wilson(F.col("hits"), F.col("n"))
    by_recipe = hit.groupBy("split", "category", "recipe").agg(F.avg("hit").alias("r"))
    by_recipe.createOrReplaceTempView("_kinespark_recipes")
    macro = spark.sql("SELECT split AS s, category AS c, avg(r) AS macro FROM _kinespark_recipes GROUP BY GROUPING SETS ((), (split), (category))")
    out = sums.withColumns({"rate": F.col("hits") / F.col("n"), "low": low, "high": high})
    wide = F.col("grouped_by").isin("all", "split", "category")
    return out.join(F.broadcast(macro), wide & F.col("split").eqNullSafe(F.col("s")) & F.col("category").eqNullSafe(F.col("c")), "left").drop("s", "c")


def fired(found: DataFrame, trials: DataFrame) -> DataFrame:
    """(recipe, rule, n): which rules find a recipe, the most frequent first, then by name."""
    return found.join(trials.select("trial", "recipe"), "trial").groupBy("recipe", "rule").agg(F.count_distinct("trial").alias("n")).orderBy("recipe", F.desc("n"), "rule")
