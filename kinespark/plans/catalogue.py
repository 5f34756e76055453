"""Every registered query and its DuckDB SQL.

The rules run on recordings; here they run on the driver's tables. Users of ``events`` stand for
episodes and event types for topics; labels of ``embeddings`` stand for episodes of vectors;
suppliers of ``lineitem`` for episodes of a few numeric channels.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import micros, row_pos
from ..operators import duplication, frames, manifest, messages, numeric, temporal
from . import report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HOUR = 3_600_000_000

_E = """e AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row_pos,
  lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS pt FROM events)"""
_C = """c AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row_pos,
  lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id) AS pt FROM events)"""
_L = """l AS (SELECT label, vec_id, i - 1 AS dim, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i))"""


def rule(sql: str):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").withColumn("t", micros("ts"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select("label", "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    """One of 25 suppliers has quantities three times as large; one of 37 has a value that is not a number."""
    first = F.when((F.col("l_suppkey") % 37 == 3) & (F.col("l_linenumber") == 1), float("nan")).when(F.col("l_suppkey") % 25 == 7, F.col("l_quantity") * 3).otherwise(F.col("l_quantity"))
    dims = F.array(first.cast("double"), *[F.col(c).cast("double") for c in ("l_extendedprice", "l_discount", "l_tax")])
    return _t(spark, d, "lineitem").select("l_suppkey", F.posexplode(dims).alias("dim", "x"))


_S = """raw AS (SELECT l_suppkey, i - 1 AS dim, [CASE WHEN l_suppkey % 37 = 3 AND l_linenumber = 1 THEN 'nan'::DOUBLE WHEN l_suppkey % 25 = 7 THEN l_quantity * 3 ELSE l_quantity END,
  l_extendedprice, l_discount, l_tax][i]::DOUBLE AS x FROM lineitem, range(1, 5) r(i)),
odd AS (SELECT DISTINCT l_suppkey FROM (SELECT l_suppkey, dim, count(*) AS n, count_if(isnan(x)) AS k FROM raw GROUP BY 1, 2) WHERE n < 3 OR k > 0),
s AS (SELECT * FROM raw WHERE l_suppkey NOT IN (SELECT l_suppkey FROM odd))"""


# --- temporal --------------------------------------------------------------------------------


@rule("""WITH e AS (SELECT user_id, event_id, row_number() OVER w - 1 AS row_pos, CASE WHEN event_id % 97 = 5 THEN 'nan'::DOUBLE WHEN event_id % 101 = 3 THEN epoch_us(ts)::DOUBLE - 864e9 ELSE epoch_us(ts)::DOUBLE END AS t
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT *, last_value(CASE WHEN NOT isnan(t) THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY row_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e)
SELECT user_id, row_pos, CASE WHEN NOT isnan(t) THEN t - b END AS delta FROM p WHERE isnan(t) OR t - b <= 0""")
def temporal_monotonic(spark, d):
    """Some times are not a number, some fall back by ten days."""
    k = F.col("event_id")
    t = F.when(k % 97 == 5, float("nan")).when(k % 101 == 3, F.col("t").cast("double") - 864e9).otherwise(F.col("t").cast("double"))
    return temporal.monotonic(_events(spark, d).withColumn("t", t), "user_id", "event_id", "t")


@rule(f"WITH {_E} SELECT user_id, row_pos, t - pt AS delta FROM e WHERE t - pt > 0 AND abs(t - pt - {8 * HOUR}) > 0.9 * {8 * HOUR}")
def temporal_sampling_interval(spark, d):
    return temporal.sampling_interval(_events(spark, d), "user_id", "event_id", "t", 8 * HOUR, 0.9)


@rule(f"""WITH {_E}, g AS (SELECT user_id, row_pos, t - pt AS delta, row_pos - row_number() OVER (PARTITION BY user_id ORDER BY row_pos) AS run FROM e WHERE t - pt > {10 * HOUR})
SELECT user_id, min(row_pos) AS "start", max(row_pos) AS "end", count(*) AS "count", max(delta) AS longest FROM g GROUP BY user_id, run""")
def temporal_max_gap(spark, d):
    return temporal.max_gap(_events(spark, d), "user_id", "event_id", "t", 10 * HOUR)


@rule("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row_pos, CASE WHEN value >= 1 THEN value END AS v,
  CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS k FROM events)
SELECT user_id, row_pos, 'k' AS stream FROM e WHERE k IS NULL OR k = '' UNION ALL SELECT user_id, row_pos, 'v' FROM e WHERE v IS NULL""")
def temporal_stream_overlap(spark, d):
    e = _events(spark, d).withColumn("v", F.when(F.col("value") >= 1, F.col("value"))).withColumn("k", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")))
    return temporal.stream_overlap(e, "user_id", "event_id", ["k", "v"])


@rule("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row_pos, (json_extract_string(props, '$.k')::BIGINT - 50) * 1000 AS delay FROM events)
SELECT * FROM e WHERE abs(delay) > 40000""")
def temporal_observation_action_delay(spark, d):
    """The action's clock is off by a property of the event."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = _events(spark, d).withColumn("action_t", F.col("t") + (k - 50) * 1000)
    return temporal.delay(e, "user_id", "event_id", "t", "action_t", 40_000)


@rule(f"""WITH f AS (SELECT user_id, arg_min(epoch_us(ts), event_id)::DOUBLE AS first FROM events GROUP BY user_id)
SELECT user_id, first, (SELECT median(first) FROM f) AS usual FROM f WHERE abs(first - (SELECT median(first) FROM f)) > {6 * HOUR}""")
def temporal_episode_start(spark, d):
    return temporal.episode_start(_events(spark, d), "user_id", "event_id", "t", 6 * HOUR)


@rule(f"""WITH f AS (SELECT user_id, arg_min(epoch_us(ts), event_id) AS a, arg_max(epoch_us(ts), event_id) AS b, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, n, (b - a - (n - 1) * {10 * HOUR})::DOUBLE AS drift FROM f WHERE n >= 2 AND abs(b - a - (n - 1) * {10 * HOUR}) > {50 * HOUR}""")
def temporal_clock_drift(spark, d):
    return temporal.clock_drift(_events(spark, d), "user_id", "event_id", "t", 10 * HOUR, 5.0)


_LAGS = " UNION ALL ".join(
    f"SELECT user_id, {-k} AS lag, a, {'lag' if k >= 0 else 'lead'}(s, {abs(k)}) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM v WHERE a IS NOT NULL" for k in range(-3, 4)
)


@rule(f"""WITH {_E}, v AS (SELECT user_id, event_id, abs(value - lag(value) OVER w) AS a, abs(len(props)::DOUBLE - lag(len(props)::DOUBLE) OVER w) AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS ({_LAGS}), m AS (SELECT user_id, lag, (avg(a * s) - avg(a) * avg(s)) / nullif(sqrt(greatest((avg(a * a) - avg(a) * avg(a)) * (avg(s * s) - avg(s) * avg(s)), 0e0)), 0) AS r FROM p WHERE s IS NOT NULL GROUP BY user_id, lag)
SELECT user_id, lag::INT AS lag, round(r, 8) AS strength FROM m WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(r, 8) DESC, abs(lag), lag DESC) = 1""")
def temporal_signal_alignment(spark, d):
    e = _events(spark, d).withColumn("size", F.length("props").cast("double"))
    return temporal.signal_alignment(e, "user_id", "event_id", "value", "size", 3).select("user_id", "lag", "strength")


# --- numeric ---------------------------------------------------------------------------------


@rule(f"""WITH {_L}, o AS (SELECT vec_id, string_agg(dim, ',' ORDER BY dim) AS dims FROM l WHERE x > 0.35 GROUP BY vec_id)
SELECT label, row_pos, dims FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row_pos FROM embeddings) JOIN o USING (vec_id)""")
def numeric_finite_values(spark, d):
    """Components over 0.35 count as not finite here: the tables hold none that are not."""
    v = F.transform("embedding", lambda x: F.when(x.cast("double") > 0.35, float("inf")).otherwise(x.cast("double")))
    rows = _t(spark, d, "embeddings").withColumn("v", v)
    return numeric.finite_values(rows, "label", "vec_id", "v").select("label", "row_pos", F.array_join("dims", ",").alias("dims"))


@rule(f"""WITH {_L}, o AS (SELECT vec_id, count(*) AS outside, max(abs(x)) AS largest FROM l WHERE x < -0.3 OR x > 0.3 GROUP BY vec_id)
SELECT label, row_pos, outside, largest FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row_pos FROM embeddings) JOIN o USING (vec_id)""")
def numeric_configured_bounds(spark, d):
    return numeric.configured_bounds(_t(spark, d, "embeddings"), "label", "vec_id", "embedding", -0.3, 0.3)


@rule(f"""WITH {_L}, p AS (SELECT label, vec_id, abs(x - lag(x) OVER (PARTITION BY label, dim ORDER BY vec_id)) AS s FROM l), m AS (SELECT vec_id, max(s) AS step FROM p GROUP BY vec_id)
SELECT label, row_pos, step FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row_pos FROM embeddings) JOIN m USING (vec_id) WHERE step > 0.5""")
def numeric_discontinuity(spark, d):
    return numeric.discontinuity(_t(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.5)


@rule(f"""WITH {_L}, p AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY label, dim ORDER BY vec_id)) AS s FROM l),
q AS (SELECT label, dim, max(s) AS most, max(x) - min(x) AS span FROM p GROUP BY label, dim),
k AS (SELECT dim FROM l GROUP BY dim HAVING count(DISTINCT x) > 8),
u AS (SELECT dim, greatest(median(most) * 1.1, median(span) * 0.05) AS lim FROM q WHERE dim IN (SELECT dim FROM k) GROUP BY dim HAVING median(span) > 0),
b AS (SELECT label, vec_id, max(s) AS step FROM p LEFT JOIN u USING (dim) GROUP BY label, vec_id HAVING bool_or(coalesce(s > lim, false)))
SELECT label, min(vec_id) AS first, count(*) AS jumps, arg_min(step, vec_id) AS largest FROM b GROUP BY label""")
def numeric_outlier_jumps(spark, d):
    return numeric.outlier_jumps(_long(spark, d), "label", "vec_id", 1.1)


@rule(f"""WITH {_S}, p AS (SELECT l_suppkey, dim, max(x) AS hi, min(x) AS lo FROM s GROUP BY l_suppkey, dim),
u AS (SELECT dim, quantile_cont(hi, 0.9) AS top, quantile_cont(lo, 0.1) AS bottom, count(*) AS n FROM p GROUP BY dim),
o AS (SELECT p.*, n, count(*) OVER (PARTITION BY p.dim) AS f FROM p JOIN u USING (dim) WHERE n >= 5
  AND (hi > top + greatest(top - bottom, 1e-9) * 0.5 OR lo < bottom - greatest(top - bottom, 1e-9) * 0.5))
SELECT l_suppkey, dim, hi, lo FROM o WHERE f <= greatest(1, ceil(n * 0.1))""")
def numeric_episode_envelope(spark, d):
    return numeric.episode_envelope(_suppliers(spark, d), "l_suppkey", 0.5)


@rule("""WITH s AS (SELECT o_custkey % 40 AS episode, i - 1 AS dim, [CASE WHEN o_custkey % 40 = 7 THEN 1e0 ELSE o_totalprice END, o_totalprice][i] AS x FROM orders, range(1, 3) r(i)),
p AS (SELECT episode, dim, max(x) = min(x) AS still FROM s GROUP BY episode, dim),
q AS (SELECT *, count(*) OVER w AS n, sum(CASE WHEN still THEN 0 ELSE 1 END) OVER w AS moving FROM p WINDOW w AS (PARTITION BY dim))
SELECT episode, dim FROM q WHERE still AND n >= 5 AND moving >= 0.9 * (n - 1)""")
def numeric_stuck_channels(spark, d):
    """One of forty groups of customers has a channel that is held still."""
    episode = F.col("o_custkey") % 40
    pair = F.array(F.when(episode == 7, 1.0).otherwise(F.col("o_totalprice")), F.col("o_totalprice"))
    return numeric.stuck_channels(_t(spark, d, "orders").select(episode.alias("episode"), F.posexplode(pair).alias("dim", "x")), "episode")


@rule(f"""WITH {_E}, s AS (SELECT user_id, event_id, 0 AS dim, value * (CASE WHEN user_id % 50 = 3 THEN 9 ELSE 1 END) AS x FROM e),
d2 AS (SELECT user_id, dim, x, abs(x - 2 * lag(x) OVER w + lag(x, 2) OVER w) AS v FROM s WINDOW w AS (PARTITION BY user_id, dim ORDER BY event_id)),
p AS (SELECT user_id, dim, median(v) * 1.4826 / sqrt(6e0) AS noise, max(x) AS hi, min(x) AS lo FROM d2 GROUP BY user_id, dim),
q AS (SELECT *, count(*) OVER () AS n, (SELECT median(noise) FROM p) AS usual, max(hi) OVER () - min(lo) OVER () AS rng FROM p),
b AS (SELECT *, count(*) OVER (PARTITION BY dim) AS f FROM q WHERE n >= 5 AND noise > greatest(usual, rng * 1e-3) * 5)
SELECT user_id, dim, round(noise, 6) AS noise FROM b WHERE f <= greatest(1, ceil(n * 0.1))""")
def numeric_noise_level(spark, d):
    x = F.col("value") * F.when(F.col("user_id") % 50 == 3, 9).otherwise(1)
    rows = _t(spark, d, "events").select("user_id", "event_id", F.lit(0).alias("dim"), x.alias("x"))
    return numeric.noise_level(rows, "user_id", "event_id").select("user_id", "dim", F.round("noise", 6).alias("noise"))


@rule("""WITH s AS (SELECT o_custkey % 40 AS episode, o_totalprice AS a, CASE WHEN o_custkey % 40 = 7 THEN -o_totalprice ELSE o_totalprice END AS s FROM orders),
m AS (SELECT episode, (avg(a * s) - avg(a) * avg(s)) / sqrt((avg(a * a) - avg(a) * avg(a)) * (avg(s * s) - avg(s) * avg(s))) AS r FROM s GROUP BY episode)
SELECT episode, round(r, 6) AS r, round((SELECT median(r) FROM m), 6) AS usual FROM m WHERE r < (SELECT median(r) FROM m) - 0.5""")
def numeric_action_state_coupling(spark, d):
    o = _t(spark, d, "orders").select((F.col("o_custkey") % 40).alias("episode"), F.col("o_totalprice").alias("a"))
    o = o.withColumn("s", F.when(F.col("episode") == 7, -F.col("a")).otherwise(F.col("a")))
    return numeric.coupling(o, "episode", "a", "s").select("episode", F.round("r", 6).alias("r"), F.round("usual", 6).alias("usual"))


# --- duplication -----------------------------------------------------------------------------


@rule("""WITH f AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand, p_type) AS first FROM part) SELECT p_partkey, first FROM f WHERE p_partkey > first""")
def duplication_exact_episodes(spark, d):
    return duplication.exact_episodes(_t(spark, d, "part"), "p_partkey", "p_partkey", ["p_name", "p_brand", "p_type"])


@rule("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id + 1000000, label, list_transform(embedding::DOUBLE[], lambda x: x + vec_id % 5 * 1e-4) FROM embeddings WHERE vec_id % 3 = 1),
s AS (SELECT greatest(stddev_pop(x), 1e-9) AS sd FROM (SELECT unnest(v) AS x FROM v)),
p AS (SELECT a.vec_id, b.vec_id AS closest, list_distance(a.v, b.v) / sqrt(64e0) / sd AS distance FROM v a JOIN v b ON a.label = b.label AND a.vec_id > b.vec_id, s),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, closest) AS n FROM p WHERE distance > 0 AND distance <= 0.003)
SELECT vec_id, closest, round(distance, 6) AS distance FROM r WHERE n = 1""")
def duplication_near_episodes(spark, d):
    """A third of the vectors has a copy, most of them a little off."""
    v = _t(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    copies = v.where("vec_id % 3 = 1").withColumn("embedding", F.transform("embedding", lambda x: x + F.col("vec_id") % 5 * 1e-4)).withColumn("vec_id", F.col("vec_id") + 1_000_000)
    near = duplication.near_episodes(v.unionByName(copies), "vec_id", "embedding", "label", 0.003)
    return near.select("vec_id", "closest", F.round("distance", 6).alias("distance"))


# --- metadata --------------------------------------------------------------------------------


@rule("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def manifest_required_files(spark, d):
    """Orders stand for referenced files, lines for those that exist."""
    there = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return manifest.missing_from(_t(spark, d, "orders"), there, ["o_orderkey"])


@rule("SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def manifest_orphan_files(spark, d):
    """Parts stand for stored files, large lines for the episodes that name them."""
    there = _t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return manifest.missing_from(_t(spark, d, "part"), there, ["p_partkey"])


@rule("SELECT s AS event_type FROM (VALUES ('click'), ('imu'), ('view')) v(s) WHERE s NOT IN (SELECT event_type FROM events)")
def manifest_required_streams(spark, d):
    want = spark.createDataFrame([("click",), ("imu",), ("view",)], "event_type string")
    return manifest.missing_from(want, _t(spark, d, "events"), ["event_type"])


@rule("""WITH w AS (SELECT * FROM (VALUES ('event_id', 'int64'), ('value', 'float'), ('torque', 'double'), ('props', 'string')) v(name, type)),
s AS (SELECT * FROM (VALUES ('event_id', 'bigint'), ('value', 'double'), ('props', 'string')) v(name, stored))
SELECT name, CASE WHEN stored IS NULL THEN 'missing' ELSE 'type' END AS reason FROM w LEFT JOIN s USING (name) WHERE stored IS NULL OR NOT (contains(stored, type) OR (type = 'int64' AND contains(stored, 'bigint')))""")
def manifest_schema_matches(spark, d):
    """Declared columns against those stored in ``events``."""
    want = spark.createDataFrame([("event_id", ["int64", "bigint"]), ("value", ["float"]), ("torque", ["double"]), ("props", ["string"])], "name string, names array<string>")
    return manifest.dtype_mismatches(want, spark.createDataFrame(_t(spark, d, "events").dtypes, "name string, stored string"))


@rule("SELECT label, min(len(embedding))::INT AS least, max(len(embedding))::INT AS most, count(*) AS \"rows\" FROM embeddings WHERE len(embedding) <> 63 GROUP BY label")
def manifest_shape_consistency(spark, d):
    return manifest.shape_consistency(_t(spark, d, "embeddings"), "label", "embedding", 63)


@rule("""WITH g AS (SELECT o_orderkey, 4 AS declared FROM orders), s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS k, declared::BIGINT AS declared, coalesce(n, 0) AS stored FROM g LEFT JOIN s ON l_orderkey = o_orderkey WHERE coalesce(n, 0) <> declared""")
def manifest_declared_totals(spark, d):
    want = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(4).alias("declared_n"))
    return manifest.declared_totals(want, _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k", "declared_n")


@rule("""WITH n AS (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS occurrence FROM part) SELECT * FROM n WHERE occurrence > 1""")
def episode_unique_ids(spark, d):
    return manifest.unique_ids(_t(spark, d, "part"), "p_name", "p_partkey")


@rule("""WITH r AS (SELECT s_suppkey AS pos, s_suppkey * 10 AS a, CASE WHEN s_suppkey % 9 = 4 THEN s_suppkey * 10 - 2 WHEN s_suppkey % 7 = 5 THEN s_suppkey * 10 + 13 ELSE s_suppkey * 10 + 10 END AS b, 10 AS n FROM supplier),
p AS (SELECT *, lag(b) OVER (ORDER BY pos) AS before FROM r),
q AS (SELECT pos, concat_ws('; ', CASE WHEN b <= a THEN 'end before start' END, CASE WHEN b - a <> n THEN 'length differs' END, CASE WHEN a < before THEN 'overlaps the last' END) AS reasons FROM p)
SELECT * FROM q WHERE reasons <> ''""")
def episode_valid_boundaries(spark, d):
    """Suppliers stand for rows of episode metadata, with some ranges spoiled."""
    k = F.col("s_suppkey")
    ends = F.when(k % 9 == 4, k * 10 - 2).when(k % 7 == 5, k * 10 + 13).otherwise(k * 10 + 10)
    r = _t(spark, d, "supplier").select(k.alias("pos"), (k * 10).alias("a"), ends.alias("b"), F.lit(10).alias("n"))
    return manifest.valid_boundaries(r, "pos", "a", "b", "n")


@rule("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 + CASE WHEN event_id % 97 = 5 THEN 1 ELSE 0 END AS f FROM events)
SELECT user_id, min(p) AS first, arg_min(f, p) AS value, count(*) AS mismatches FROM e WHERE p <> f GROUP BY user_id""")
def episode_index_columns(spark, d):
    e = _t(spark, d, "events")
    spoiled = row_pos("user_id", "event_id") + F.when(F.col("event_id") % 97 == 5, 1).otherwise(0)
    return manifest.index_columns(e.withColumn("f", spoiled), "user_id", "event_id", "f")


@rule("""WITH u AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS k FROM u) SELECT l_partkey, string_agg(l_suppkey, ',' ORDER BY l_suppkey) AS unknown FROM n WHERE k <= 20 GROUP BY l_partkey""")
def episode_task_references(spark, d):
    """Parts stand for episodes, suppliers for tasks, of which one in ten is not declared."""
    known = _t(spark, d, "supplier").where("s_suppkey % 10 <> 3").select(F.col("s_suppkey").alias("l_suppkey"))
    return manifest.task_references(_t(spark, d, "lineitem"), "l_partkey", "l_suppkey", known)


# --- frames ----------------------------------------------------------------------------------


def _frames(spark, d):
    """Events as frames: value as the mean, its step as the change."""
    e = _t(spark, d, "events").withColumn("pos", row_pos("user_id", "event_id"))
    return e.select("user_id", "pos", F.col("value").alias("mean"), (F.col("value") / 4).alias("sd"), F.abs(F.col("value") - 12).alias("change"))


_F = """f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, value AS mean, value / 4 AS sd, abs(value - 12) AS change FROM events)"""


def _runs(where: str, extra: str = "") -> str:
    return f"""g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS run FROM f WHERE {where}),
r AS (SELECT user_id, min(pos) AS "start", max(pos) AS "end", count(*) AS n{extra} FROM g GROUP BY user_id, run)"""


@rule(f"""WITH {_F}, {_runs("(mean <= 3 OR mean >= 245) AND sd <= 3", ", max(mean) AS mean, max(sd) AS sd")} SELECT user_id, "start", "end", n AS "count", mean, sd FROM r""")
def video_black_frames(spark, d):
    return frames.black_frames(_frames(spark, d), "user_id", "pos", "mean", "sd")


@rule(f"""WITH {_F}, {_runs("change <= 8")} SELECT user_id, "start", "end", n + 1 AS "count" FROM r WHERE n + 1 > 3""")
def video_frozen_frames(spark, d):
    return frames.frozen_frames(_frames(spark, d), "user_id", "pos", "change", 8.0, 3)


@rule(f"""WITH {_F}, p AS (SELECT user_id, count(*) AS n, avg((change <= 5)::INT) AS share, median(CASE WHEN change > 5 THEN change END) AS fresh FROM f GROUP BY user_id)
SELECT user_id, n, round(share, 8) AS share, round(fresh, 8) AS fresh FROM p WHERE n >= 20 AND share >= 0.2 AND fresh >= 7.5""")
def video_repeated_frames(spark, d):
    r = frames.repeated_frames(_frames(spark, d), "user_id", "change", 5.0, 0.2, 1.5)
    return r.select("user_id", "n", F.round("share", 8).alias("share"), F.round("fresh", 8).alias("fresh"))


@rule("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT c_custkey AS user_id, 60::BIGINT AS length, coalesce(n, 0) AS decoded
FROM customer LEFT JOIN c ON user_id = c_custkey WHERE abs(coalesce(n, 0) - 60) > 5""")
def video_decode(spark, d):
    want = _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(60).alias("n"))
    return frames.decode_counts(want, _t(spark, d, "events"), "user_id", "n", 5)


@rule("""WITH p AS (SELECT user_id, min(epoch_us(ts)) AS err FROM events WHERE event_type = 'error' GROUP BY user_id),
r AS (SELECT user_id, epoch_us(ts) AS a, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, err, a, b FROM p JOIN r USING (user_id) WHERE a <= err AND err < b""")
def video_bitstream(spark, d):
    e = _events(spark, d)
    probe = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("t").alias("err"))
    w = F.lead("t").over(temporal.along("user_id", "event_id"))
    return frames.bitstream(probe, e.select("user_id", F.col("t").alias("a"), w.alias("b")), "user_id", "err", "a", "b")


@rule(f"""WITH r AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + {5 * HOUR} AS b FROM events), p AS (SELECT user_id, a, a - lag(b) OVER (PARTITION BY user_id ORDER BY a, b) AS gap FROM r)
SELECT * FROM p WHERE abs(gap) > {2 * HOUR}""")
def video_timeline(spark, d):
    r = _events(spark, d).select("user_id", F.col("t").alias("a"), (F.col("t") + 5 * HOUR).alias("b"))
    return frames.timeline(r, "user_id", "a", "b", 2 * HOUR)


@rule("""WITH b AS (SELECT vec_id, vec_id % 2 AS cam, i AS cell, embedding[i]::DOUBLE + CASE WHEN vec_id % 2 = 1 AND vec_id <> 31 THEN 5 ELSE 0 END AS x FROM embeddings, range(1, 65) r(i)),
c AS (SELECT cam, cell, median(x) AS c FROM b GROUP BY cam, cell), a AS (SELECT b.vec_id, b.cam, c.cam AS o, avg(abs(x - c)) AS d FROM b JOIN c USING (cell) GROUP BY 1, 2, 3)
SELECT s.vec_id, s.cam, t.o AS looks_like, round(s.d, 8) AS own, round(t.d, 8) AS other FROM a s JOIN a t ON s.vec_id = t.vec_id AND s.cam = s.o AND t.o <> t.cam WHERE t.d < 0.5 * s.d""")
def video_camera_identity(spark, d):
    """Two cameras five apart; the frames of episode 31 come from the other one."""
    shift = F.when((F.col("vec_id") % 2 == 1) & (F.col("vec_id") != 31), 5.0).otherwise(0.0)
    rows = _t(spark, d, "embeddings").withColumn("s", shift).withColumn("cells", F.transform("embedding", lambda x: x.cast("double") + F.col("s")))
    found = frames.camera_identity(rows.select("vec_id", (F.col("vec_id") % 2).alias("cam"), "cells"), "vec_id", "cam", "cells")
    return found.select("vec_id", "cam", "looks_like", F.round("own", 8).alias("own"), F.round("other", 8).alias("other"))


# --- messages --------------------------------------------------------------------------------


def _messages(spark, d):
    """Events by topic, with a header clock, a sequence number and a channel."""
    e = _events(spark, d)
    return e.withColumn("late", F.when(F.col("event_id") % 50 == 7, F.col("t") - 9 * HOUR).otherwise(F.col("t")))


_M = f"""m AS (SELECT *, epoch_us(ts) AS t, CASE WHEN event_id % 50 = 7 THEN epoch_us(ts) - {9 * HOUR} ELSE epoch_us(ts) END AS late FROM events)"""


@rule(f"""WITH {_M}, p AS (SELECT event_type, row_number() OVER w - 1 AS row_pos, late - lag(late) OVER w AS delta FROM m WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) SELECT * FROM p WHERE delta < 0 AND -delta > {HOUR}""")
def mcap_timestamp_order(spark, d):
    return messages.rollbacks(_messages(spark, d), "event_type", "event_id", "late", HOUR)


@rule("""WITH p AS (SELECT event_type, epoch_us(ts) // 600000000 AS m, lag(epoch_us(ts) // 600000000) OVER (PARTITION BY event_type ORDER BY event_id) AS q FROM events)
SELECT event_type, count(*) AS repeats FROM p WHERE m = q GROUP BY event_type""")
def mcap_duplicate_timestamps(spark, d):
    """Times are cut to ten minutes, so that some are equal."""
    m = _events(spark, d).withColumn("cell", F.expr("t div 600000000"))
    return messages.duplicate_timestamps(m, "event_type", "event_id", "cell")


@rule("""WITH p AS (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) SELECT user_id, min(event_id) AS first, count(*) AS breaks FROM p WHERE d <> 1 GROUP BY user_id""")
def mcap_sequence_continuity(spark, d):
    return messages.sequence_continuity(_events(spark, d), "user_id", "event_id", "event_id")


@rule("SELECT event_type, count(DISTINCT user_id % 3) AS kinds FROM events GROUP BY event_type HAVING count(DISTINCT user_id % 3) > 1")
def mcap_channel_schema(spark, d):
    return messages.channel_schema(_t(spark, d, "events").withColumn("schema", F.col("user_id") % 3), "event_type", ["schema"])


@rule("""WITH x AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 <> 0 THEN 65 END AS expected FROM customer), g AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, expected::BIGINT AS expected, coalesce(n, 0) AS messages FROM x LEFT JOIN g USING (user_id) WHERE expected IS NOT NULL AND expected <> coalesce(n, 0)""")
def mcap_summary_consistency(spark, d):
    want = _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 5 != 0, 65).alias("n"))
    return messages.summary_consistency(want, _t(spark, d, "events"), "user_id", "n")


@rule("SELECT DISTINCT n_name, CASE WHEN n_regionkey = 1 THEN 'cdr' ELSE 'json' END AS me, 'ros2msg' AS se FROM nation WHERE n_regionkey <> 1")
def ros2_encoding(spark, d):
    c = _t(spark, d, "nation").select("n_name", F.when(F.col("n_regionkey") == 1, "cdr").otherwise("json").alias("me"), F.lit("ros2msg").alias("se"))
    return messages.encoding(c, "n_name", "me", "se")


@rule("SELECT user_id, count(*) AS errors, arg_min(props, event_id) AS first FROM events WHERE event_type = 'error' GROUP BY user_id")
def ros2_decode(spark, d):
    m = _t(spark, d, "events").withColumn("err", F.when(F.col("event_type") == "error", F.col("props")))
    return messages.decode_errors(m, "user_id", "event_id", "err")


@rule("SELECT s AS event_type FROM (VALUES ('odom'), ('click')) v(s) WHERE s NOT IN (SELECT event_type FROM events)")
def ros2_required_topics(spark, d):
    want = spark.createDataFrame([("odom",), ("click",)], "event_type string")
    return manifest.missing_from(want, _t(spark, d, "events"), ["event_type"])


@rule(f"""WITH p AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events)
SELECT event_type, max(g) AS gap, count(*) AS n FROM p WHERE event_type IN ('click', 'error') GROUP BY event_type HAVING max(g) > {HOUR} AND count(*) >= 3""")
def ros2_topic_gaps(spark, d):
    rates = spark.createDataFrame([("click", HOUR // 5), ("error", HOUR // 5)], "event_type string, period long")
    return messages.topic_gaps(_events(spark, d), "event_type", "event_id", "t", F.broadcast(rates))


@rule(f"""WITH {_M} SELECT event_type, max(t - late) AS skew, min(event_id) AS "at" FROM m WHERE t - late = {9 * HOUR} GROUP BY event_type""")
def ros2_header_clock_skew(spark, d):
    return messages.header_skew(_messages(spark, d), "event_type", "event_id", "late", "t", HOUR)


@rule("""WITH m AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row_pos, CASE WHEN vec_id % 11 = 2 THEN 63 ELSE 64 END AS n FROM embeddings)
SELECT label, row_pos, 'position has 64 values but name has 63 entries' AS error FROM m WHERE n = 63
UNION ALL SELECT label, row_pos, 'JointState effort contains a non-finite value' FROM m WHERE vec_id % 13 = 4""")
def ros2_semantic_consistency(spark, d):
    """Vectors as positions of joints: some messages lack a name, some efforts are not a number."""
    k = F.col("vec_id")
    names = F.slice(F.transform("embedding", lambda x, i: F.concat(F.lit("j"), i)), 1, F.when(k % 11 == 2, 63).otherwise(64))
    effort = F.when(k % 13 == 4, F.transform("embedding", lambda x, i: F.when(i == 7, float("nan")).otherwise(x.cast("double")))).otherwise(F.array().cast("array<double>"))
    rows = _t(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("position"), names.alias("name"))
    rows = rows.join(_t(spark, d, "embeddings").select("vec_id", effort.alias("effort")), "vec_id")
    cut = F.when((F.size("effort") > 0), F.slice("effort", 1, F.size("name"))).otherwise(F.col("effort"))
    return messages.joint_errors(rows.withColumn("effort", cut), "label", "vec_id", "name", ["position", "effort"])


@rule("""WITH e AS (SELECT DISTINCT l_partkey AS child, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE l_suppkey::VARCHAR END AS parent FROM lineitem)
SELECT child, string_agg(parent, ',' ORDER BY parent) AS parents FROM e WHERE parent <> '' AND parent <> child::VARCHAR GROUP BY child HAVING count(*) > 1""")
def ros2_tf_tree(spark, d):
    """Parts as frames, suppliers as their parents, some without a name."""
    parent = F.when(F.col("l_suppkey") % 7 == 0, "").otherwise(F.col("l_suppkey").cast("string"))
    return messages.tf_tree(_t(spark, d, "lineitem").select(parent.alias("parent"), F.col("l_partkey").alias("child")), "parent", "child")


# --- rules on a recording --------------------------------------------------------------------


def recording_of_events(spark, d):
    """``events`` as a recording: users are episodes, one sample every eight hours is expected."""
    from ..functions.storage import Store
    from ..sources.recording import EPISODES, Recording, Stream

    e = _t(spark, d, "events").withColumn("t", micros("ts"))
    k = F.col("event_id")
    samples = e.select(
        F.col("user_id").alias("pos"), F.concat(F.lit("user_"), "user_id").alias("episode"), F.lit("events").alias("source"), row_pos("user_id", "event_id").alias("row_pos"),
        F.when(k % 97 == 5, float("nan")).when(k % 101 == 3, F.col("t") / 1e6 - 864e3).otherwise(F.col("t") / 1e6).alias("timestamp"),
        (row_pos("user_id", "event_id") + F.when(k % 89 == 7, 1).otherwise(0)).alias("frame_index"),
        F.when(k % 83 == 1, F.lit(None)).otherwise(F.array(F.when(k % 79 == 6, float("inf")).otherwise(F.col("value")))).alias("action"),
    )
    streams = [Stream("timestamp", "float64", (1,)), Stream("frame_index", "int64", (1,)), Stream("action", "float64", (1,))]
    rec = Recording(spark, Store(spark, d), "events", "lerobot", "v3.0", streams, frozenset({"metadata", "episodes", "timestamps", "numeric"}), spark.createDataFrame([], EPISODES), 0, fps=1 / 28800)
    per = samples.groupBy("pos", "episode").agg(F.count(F.lit(1)).alias("length"))
    null = lambda kind: F.lit(None).cast(kind)
    rec.episodes = per.select("pos", F.col("pos").alias("index"), "episode", "length", F.lit("events").alias("data_file"), null("long").alias("from_index"), null("long").alias("to_index"), F.array().cast("array<string>").alias("tasks"), null("map<string,string>").alias("video_files"), null("map<string,struct<start:double,end:double>>").alias("video_ranges"))
    rec._samples, rec.footers = samples, {"events": {"timestamp": "double", "frame_index": "int64", "action": "list<double>", "episode_index": "int64"}}
    return rec


ON_EVENTS = ("temporal.monotonic", "temporal.max_gap", "temporal.stream_overlap", "numeric.finite_values", "episode.index_columns")


@rule("""WITH e AS (SELECT user_id, event_id, 'user_' || user_id AS episode, row_number() OVER w - 1 AS p, CASE WHEN event_id % 97 = 5 THEN 'nan'::DOUBLE WHEN event_id % 101 = 3 THEN epoch_us(ts) / 1e6 - 864e3 ELSE epoch_us(ts) / 1e6 END AS t
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
q AS (SELECT *, last_value(CASE WHEN NOT isnan(t) THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, t - lag(t) OVER (PARTITION BY user_id ORDER BY p) AS s FROM e),
g AS (SELECT episode, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS run FROM q WHERE NOT isnan(s) AND s > 57600),
x AS (SELECT episode, min(p) AS p FROM e WHERE event_id % 89 = 7 GROUP BY episode)
SELECT 'temporal.monotonic' AS rule_id, 'error' AS severity, episode, 'timestamp' AS stream, p AS sample_index FROM q WHERE isnan(t) OR t - b <= 0
UNION ALL SELECT 'temporal.max_gap', 'error', episode, 'timestamp', min(p) FROM g GROUP BY episode, run
UNION ALL SELECT 'temporal.stream_overlap', 'error', episode, 'action', p FROM e WHERE event_id % 83 = 1
UNION ALL SELECT 'numeric.finite_values', 'error', episode, 'action', p FROM e WHERE event_id % 79 = 6 AND event_id % 83 <> 1
UNION ALL SELECT 'episode.index_columns', 'error', episode, 'frame_index', p FROM x""")
def rules_findings(spark, d):
    """Five rules of the engine on one recording, in the one schema of findings."""
    from .. import engine
    from ..config import Config

    rec = recording_of_events(spark, d)
    parts = [engine.findings_frame(p, p.rule.build(rec, p.options)) for p in engine.plan(rec, Config()) if p.rule.id in ON_EVENTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("rule_id", "severity", "episode", "stream", "sample_index")


# --- reports ---------------------------------------------------------------------------------


def _gaps(spark, d, hours):
    found = temporal.sampling_interval(_events(spark, d), "user_id", "event_id", "t", hours * HOUR, 1.0)
    return report.findings(found, "temporal.sampling_interval", "warning", "user_id", "row_pos", ["delta"], "timestamp")


def _gap_sql(hours):
    return f"""SELECT 'temporal.sampling_interval' AS rule_id, user_id::VARCHAR AS episode, row_pos AS sample_index,
  sha256('["temporal.sampling_interval","' || user_id || '","timestamp","' || row_pos || '","{{\\"delta\\":' || (t - pt) || '}}",""]') AS fingerprint, '{{"delta":' || (t - pt) || '}}' AS observed FROM e WHERE t - pt > {2 * hours * HOUR}"""


@rule(f"WITH {_E} {_gap_sql(10)}".replace("AS rule_id,", "AS rule_id, 'warning' AS severity,"))
def report_findings(spark, d):
    return _gaps(spark, d, 10)


@rule(f"""WITH {_E}, g AS ({_gap_sql(5)}), n AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY episode, sample_index, fingerprint) AS n FROM g)
SELECT rule_id, 'warning' AS severity, episode, sample_index, observed, fingerprint, total FROM n WHERE n <= 50""")
def report_capped(spark, d):
    return report.capped(_gaps(spark, d, 5))


@rule(f"""WITH {_E}, g AS ({_gap_sql(10)}) SELECT rule_id, 'warning' AS severity, episode, sample_index, observed, fingerprint, episode::BIGINT % 4 = 1 AS suppressed FROM g""")
def report_baseline(spark, d):
    """Of reviewed entries those of every fourth episode hold; others have expired."""
    found = _gaps(spark, d, 10)
    n = F.col("episode").cast("long") % 4
    entries = found.where(n < 2).select("fingerprint", "rule_id", F.when(n == 0, F.lit(datetime.date(2020, 1, 1))).alias("expires_at"))
    return report.suppressed(found, entries, datetime.date(2026, 1, 1))


@rule(f"""WITH {_E}, a AS ({_gap_sql(10)}), b AS ({_gap_sql(8)}) SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, coalesce(a.fingerprint, b.fingerprint) AS fingerprint,
CASE WHEN a.rule_id IS NULL THEN 'new' WHEN b.rule_id IS NULL THEN 'resolved' ELSE 'persistent' END AS status FROM a FULL OUTER JOIN b ON a.fingerprint = b.fingerprint""")
def report_comparison(spark, d):
    return report.compared(_gaps(spark, d, 10), _gaps(spark, d, 8), ["rule_id", "fingerprint"])


@rule("""WITH p AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT count(*) AS episodes, sum(n)::BIGINT AS frames, min(n) AS shortest, max(n) AS longest, (SELECT count(DISTINCT event_type) FROM events) AS tasks FROM p""")
def report_coverage(spark, d):
    return report.coverage(_t(spark, d, "events"), "user_id", F.col("event_type"))
