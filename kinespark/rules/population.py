"""Rules on episodes against all episodes of a recording.

They read episodes of finite values alone, so one broken episode does not hide another. Aggregates
over the population have one row for each dimension.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import NotApplicable
from ..functions.series import population
from .base import Found, nothing, record, rule, text, union

_BY = ("pos", "n")
#: A pattern that more than this share of episodes has is no outlier.
COMMON = 0.1
_NOISE = 1.4826 / 6**0.5


def _compared(rec, o):
    """(place, stream, long form, episodes) of each stream with enough episodes to compare."""
    out = []
    for n, s in enumerate(rec.float_streams(o["streams"])):
        if not rec.is_stored(s):
            continue
        rows = rec.clean_vectors(s)
        count = rows.select("pos").distinct().count()
        if count >= int(o["min_episodes"]):
            out.append((n, s, rows.select("pos", "episode", "row_pos", F.posexplode("v").alias("dim", "x")), count))
    if not out:
        raise NotApplicable("needs several episodes to compare")
    return out


def _rare(bad: DataFrame, episodes: int) -> DataFrame:
    """Rows of dimensions in which few episodes stand out."""
    flagged = bad.groupBy("dim").agg(F.count(F.lit(1)).alias("_f")).where(F.col("_f") <= max(1, int(np.ceil(episodes * COMMON))))
    return bad.join(F.broadcast(flagged.select("dim")), "dim", "left_semi")


def _dimensions(bad: DataFrame, n: int, stream: str, message: str) -> DataFrame:
    dims = F.sort_array(F.collect_list("dim"))
    rows = bad.groupBy("pos", "episode").agg(dims.alias("dims"))
    return rows.select("pos", F.lit(n).alias("n"), "episode", F.lit(stream).alias("stream"), text(message, "episode").alias("message"), record(dimensions=F.col("dims")).alias("observed"))


@rule("numeric.outlier_jumps", "No jumps far beyond usual steps", "warning", "sample", needs="episodes numeric", streams=[], step_factor=5.0, min_range_fraction=0.05, note="Dimensions of few different values, such as grippers, are left out.")
def outlier_jumps(rec, o):
    """A jump far beyond a stream's usual step is a spike, a reset or another unit.

    Look at the sample for such a cause."""
    parts = []
    for n, s in enumerate(rec.float_streams(o["streams"])):
        if not rec.is_stored(s):
            continue
        rows = rec.clean_vectors(s)
        rows = rows.withColumn("d", F.zip_with("v", F.lag("v").over(W.partitionBy("pos").orderBy("row_pos")), lambda a, b: F.abs(a - b)))
        long = rows.select("pos", F.posexplode(F.arrays_zip("v", "d")).alias("dim", "e")).select("pos", "dim", "e.v", "e.d")
        per = long.groupBy("pos", "dim").agg(F.max("d").alias("most"), (F.max("v") - F.min("v")).alias("span"), F.slice(F.collect_set("v"), 1, 9).alias("some"))
        # up to nine values of each episode tell whether there are more than eight in all
        kinds = per.select("dim", F.explode("some").alias("x")).groupBy("dim").agg(F.count_distinct("x").alias("kinds"))
        usual = per.groupBy("dim").agg(F.median("most").alias("step"), F.median("span").alias("span")).join(kinds, "dim").orderBy("dim").collect()
        if not usual:
            continue
        limit = [max(r.step * float(o["step_factor"]), r.span * float(o["min_range_fraction"])) for r in usual]
        use = [r.kinds > 8 and r.span > 0 for r in usual]
        over = F.exists(F.transform("d", lambda x, i: x.isNotNull() & (x > F.get(F.array(*[F.lit(x) for x in limit]), i)) & F.get(F.array(*[F.lit(x) for x in use]), i)), lambda b: b)
        bad = rows.where(over).groupBy("pos", "episode").agg(F.count(F.lit(1)).alias("jumps"), F.min(F.struct("row_pos", F.array_max("d").alias("largest"))).alias("f"))
        parts.append(bad.select("pos", F.lit(n).alias("n"), "episode", F.lit(s).alias("stream"), F.col("f.row_pos").alias("sample_index"), text(f"{s} jumps far beyond its usual step in {{}}", "episode").alias("message"), record(jumps=F.col("jumps"), largest_step=F.col("f.largest")).alias("observed"), record(step_limit=F.array(*[F.lit(x) for x in limit])).alias("expected")))
    return Found(union(parts), _BY) if parts else nothing(rec)


@rule("numeric.episode_envelope", "Episodes stay in the usual range", "warning", "episode", needs="episodes numeric", streams=[], min_episodes=5, spread_factor=1.0)
def episode_envelope(rec, o):
    """An episode far outside the range of the others has other units, or another task.

    Compare units and calibration with the other episodes."""
    parts = []
    for n, s, long, episodes in _compared(rec, o):
        per = long.groupBy("pos", "episode", "dim").agg(F.max("x").alias("hi"), F.min("x").alias("lo"))
        per = population(per, "dim", F.percentile("hi", F.lit(0.9)).alias("top"), F.percentile("lo", F.lit(0.1)).alias("bottom"))
        margin = F.greatest(F.col("top") - F.col("bottom"), F.lit(1e-9)) * float(o["spread_factor"])
        bad = per.where((F.col("hi") > F.col("top") + margin) | (F.col("lo") < F.col("bottom") - margin))
        parts.append(_dimensions(_rare(bad, episodes), n, s, f"{s} leaves its usual range in {{}}"))
    return Found(union(parts), _BY, "within the range of comparable episodes")


@rule("numeric.stuck_channels", "Channels that vary do not stick", "warning", "episode", needs="episodes numeric", streams=[], min_episodes=5, min_varying_fraction=0.9, note="An idle joint looks the same as a dead sensor.")
def stuck_channels(rec, o):
    """A channel that stands still, though it moves elsewhere, may be a dead sensor.

    Check the sensor or the link."""
    parts = []
    for n, s, long, episodes in _compared(rec, o):
        per = long.groupBy("pos", "episode", "dim").agg((F.max("x") == F.min("x")).alias("still"))
        per = population(per, "dim", F.count_if(~F.col("still")).alias("moving"))
        bad = per.where(F.col("still") & (F.col("moving") >= float(o["min_varying_fraction"]) * (episodes - 1)))
        parts.append(_dimensions(bad, n, s, f"{s} has channels that stand still in {{}}"))
    return Found(union(parts), _BY, "channels vary as in other episodes")


@rule("numeric.noise_level", "Noise is as elsewhere", "warning", "episode", needs="episodes numeric", streams=[], min_episodes=5, noise_ratio=5.0, note="Noise that all episodes share is not seen.")
def noise_level(rec, o):
    """Far more noise than in other episodes comes from a failing sensor or link.

    Look at the sensor and its transport."""
    parts = []
    for n, s, long, episodes in _compared(rec, o):
        w = W.partitionBy("pos", "dim").orderBy("row_pos")
        second = F.abs(F.col("x") - 2 * F.lag("x").over(w) + F.lag("x", 2).over(w))
        per = long.withColumn("d2", second).groupBy("pos", "episode", "dim").agg((F.median("d2") * _NOISE).alias("noise"), F.max("x").alias("hi"), F.min("x").alias("lo"))
        per = population(per, "dim", F.median("noise").alias("usual"), (F.max("hi") - F.min("lo")).alias("span"))
        bad = per.where((F.col("noise") > F.greatest(F.col("usual"), F.col("span") * 1e-3) * float(o["noise_ratio"])) & (F.col("span") > 0))
        parts.append(_dimensions(_rare(bad, episodes), n, s, f"{s} is unusually noisy in {{}}"))
    return Found(union(parts), _BY, {"noise_ratio_below": o["noise_ratio"]})


@rule("numeric.action_state_coupling", "State follows action as elsewhere", "warning", "episode", needs="episodes numeric", of=("action", "observation.state"), min_episodes=5, min_usual_correlation=0.7, max_drop=0.5)
def action_state_coupling(rec, o):
    """A joint whose state no longer follows its action was swapped, or changed its sign.

    Check the order and the signs of joints."""
    a = rec.clean_vectors("action").select("pos", "episode", "row_pos", F.col("v").alias("a"))
    s = rec.clean_vectors("observation.state").select("pos", "row_pos", F.col("v").alias("s"))
    sizes = a.groupBy("pos").agg(F.count(F.lit(1)).alias("na"), F.max(F.size("a")).alias("wa")).join(s.groupBy("pos").agg(F.count(F.lit(1)).alias("ns"), F.max(F.size("s")).alias("ws")), "pos")
    shared = sizes.where("na = ns AND wa = ws")
    widths = [r.wa for r in shared.select("wa").distinct().limit(2).collect()]
    if shared.count() < int(o["min_episodes"]):
        raise NotApplicable("needs several episodes whose actions and states have the same dimensions")
    if len(widths) != 1:
        raise NotApplicable("episodes have different numbers of action dimensions")
    both = a.join(s, ["pos", "row_pos"]).join(shared.select("pos"), "pos", "left_semi")
    long = both.select("pos", "episode", F.posexplode(F.arrays_zip("a", "s")).alias("dim", "e")).select("pos", "episode", "dim", "e.a", "e.s")
    spread = F.sqrt(F.var_pop("a") * F.var_pop("s"))
    per = long.groupBy("pos", "episode", "dim").agg(F.try_divide(F.covar_pop("a", "s"), spread).alias("r"))
    usual = {r.dim: r.u for r in per.groupBy("dim").agg(F.median("r").alias("u")).collect()}  # a row for each dimension
    per = population(per, "dim", F.median("r").alias("usual"))
    bad = per.where((F.col("usual") >= float(o["min_usual_correlation"])) & (F.col("r") < F.col("usual") - float(o["max_drop"])))
    return Found(_dimensions(bad, 0, "observation.state", "State no longer follows action in {}"), _BY, {"usual_correlation": [usual.get(i) for i in range(widths[0])]})


def speed(values: np.ndarray) -> np.ndarray:
    """How fast all dimensions move together, each by its range, smoothed over three samples."""
    span = np.maximum(np.ptp(values, axis=0), 1e-9)
    return np.convolve(np.sqrt((((np.diff(values, axis=0)) / span) ** 2).mean(axis=1)), np.full(3, 1 / 3), mode="same")


def best_lag(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, float]:
    """By how many samples ``b`` trails ``a`` where they correlate best, and how well; ties to the shorter."""
    n = min(len(a), len(b))
    x, y = a[:n] - a[:n].mean() if n else a[:0], b[:n] - b[:n].mean() if n else b[:0]
    scale = float(np.sqrt((x @ x) * (y @ y))) if n else 0.0
    if scale == 0 or n < 8:
        return 0, 0.0
    lags = sorted(range(-most, most + 1), key=abs)
    values = [float(x[: n - k] @ y[k:] if k >= 0 else x[-k:] @ y[: n + k]) / scale if abs(k) < n else -1.0 for k in lags]
    k = int(np.argmax(values))
    return lags[k], values[k]


@rule(
    "temporal.signal_alignment", "Action, state and video keep their alignment", "warning", "episode", "video", needs="episodes numeric", of=("observation.state",), enabled=False,
    min_episodes=5, min_strength=0.5, lag_tolerance_frames=2, note="Only where a configuration names it: some recordings have clean episodes that it flags.",
)
def signal_alignment(rec, o):
    """Signals that are shifted against each other teach wrong timing.

    Look at the recorder's timing and at video ranges."""
    states = rec.clean_vectors("observation.state")
    if states.select("pos").distinct().count() < int(o["min_episodes"]):
        raise NotApplicable("needs several episodes to compare")
    most = max(3, int(round(float(rec.fps or 30.0))))
    rows = states.select("pos", "episode", F.lit("s").alias("kind"), F.lit("").alias("stream"), F.col("row_pos").alias("at"), "v")
    if rec.is_stored("action"):
        rows = rows.unionByName(rec.clean_vectors("action").select("pos", "episode", F.lit("a").alias("kind"), F.lit("action").alias("stream"), F.col("row_pos").alias("at"), "v"))
    if rec.video_streams():
        frames = rec.frames().where("change IS NOT NULL")
        rows = rows.unionByName(frames.select("pos", "episode", F.lit("f").alias("kind"), "stream", F.col("frame").alias("at"), F.array("change").alias("v")))

    def lags(episode: pd.DataFrame) -> pd.DataFrame:
        of = lambda part: np.stack(part.sort_values("at")["v"].to_numpy()) if len(part) else np.zeros((0, 1))
        state, out = of(episode[episode.kind == "s"]), []
        if len(state):
            moves = speed(state)
            for stream, part in episode[episode.kind != "s"].groupby("stream"):
                values = of(part)
                if part.kind.iloc[0] == "a":
                    if len(values) == len(state):
                        out.append((stream, *best_lag(speed(values), moves, most), None))
                elif len(values) >= 8:
                    change = values[:, 0]
                    out.append((stream, *best_lag(moves, change, most), best_lag(moves, change[::-1], most)[1]))
        cols = pd.DataFrame(out, columns=["stream", "lag", "strength", "behind"])
        cols.insert(0, "episode", episode.episode.iloc[0])
        cols.insert(0, "pos", episode.pos.iloc[0])
        return cols.astype({"lag": "int64", "strength": "float64", "behind": "float64"})

    # an episode is one recorded run: its samples meet in one task, and no more
    measured = rows.groupBy("pos").applyInPandas(lags, "pos long, episode string, stream string, lag long, strength double, behind double").persist()
    rec._kept.append(measured)
    least, tolerance = float(o["min_strength"]), int(o["lag_tolerance_frames"])
    strong = measured.where(F.col("strength") >= least)
    usual = strong.groupBy("stream").agg(F.median("lag").alias("usual"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= int(o["min_episodes"]))
    off = strong.join(F.broadcast(usual), "stream").withColumn("off", F.abs(F.col("lag") - F.col("usual")))
    allowed = off.groupBy("stream").agg(F.greatest(F.lit(float(tolerance)), F.lit(4 * 1.4826) * F.median("off")).alias("allowed"))
    bad = off.join(F.broadcast(allowed), "stream").where(F.col("off") > F.col("allowed"))
    order = F.when(F.col("stream") == "action", 0).otherwise(1).alias("n")
    same = ["forward_strength", "reversed_strength"]
    shifted = bad.select(F.lit(0).alias("step"), order, "pos", "episode", "stream", text("{} is {} frames off its usual timing in {}", F.col("stream"), F.round(F.col("lag") - F.col("usual")).cast("int"), F.col("episode")).alias("message"), F.to_json(record(lag_frames=F.col("lag"), strength=F.col("strength"))).alias("observed"), F.to_json(record(lag_frames=F.col("usual"), tolerance_frames=F.col("allowed"))).alias("expected"))
    turned = measured.where("behind IS NOT NULL")
    gain = turned.groupBy("stream").agg(F.median(F.col("strength") - F.col("behind")).alias("gain"), F.count(F.lit(1)).alias("n")).where((F.col("gain") > 0.05) & (F.col("n") >= int(o["min_episodes"])))
    turned = turned.join(F.broadcast(gain.select("stream")), "stream").where((F.col("behind") >= least) & (F.col("behind") - F.col("strength") > 0.15))
    turned = turned.select(F.lit(1).alias("step"), order, "pos", "episode", "stream", text("{} fits the robot's motion better backwards in {}", "stream", "episode").alias("message"), F.to_json(record(**{same[0]: F.col("strength"), same[1]: F.col("behind")})).alias("observed"), F.lit("video follows robot motion forward in time").alias("expected"))
    return Found(shifted.unionByName(turned), ("step", "n", "stream", "pos"))


@rule("duplication.near_episodes", "Episodes are not near copies", "warning", "dataset", needs="episodes numeric", of=("action",), max_relative_distance=0.001, note="Compares actions of equal length; exact copies are another rule's.")
def near_episodes(rec, o):
    """Copies with tiny differences waste training and leak into evaluation.

    Keep one copy."""
    rows = rec.clean_vectors("action")
    long = rows.select(F.posexplode("v").alias("dim", "x"))
    spread = [max(r.sd, 1e-9) for r in long.groupBy("dim").agg(F.stddev_pop("x").alias("sd")).orderBy("dim").collect()]
    if rows.select("pos").distinct().limit(2).count() < 2:
        raise NotApplicable("needs at least two episodes")
    scaled = rows.withColumn("v", F.transform("v", lambda x, i: x / F.get(F.array(*[F.lit(s) for s in spread]), i)))
    # an episode is one vector: it is bounded by one recorded run
    whole = scaled.groupBy("pos", "episode").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("row_pos", "v"))), lambda r: r["v"])).alias("v"), F.count(F.lit(1)).alias("rows"))
    from ..operators.duplication import closest_earlier

    near = closest_earlier(whole.select("pos", F.concat_ws("x", "rows", F.size("v")).alias("shape"), "v"), "pos", "v", "shape", float(o["max_relative_distance"]))
    named = whole.select("pos", "episode")
    near = near.join(named, "pos").join(named.select(F.col("pos").alias("closest"), F.col("episode").alias("other")), "closest")
    seen = record(duplicate_of=F.col("other"), relative_distance=F.col("distance"))
    rows = near.select("shape", "pos", "episode", F.lit("action").alias("stream"), text("{} is a near copy of {}", "episode", "other").alias("message"), seen.alias("observed"))
    return Found(rows.drop("shape"), ("pos",), {"relative_distance_above": float(o["max_relative_distance"])})
