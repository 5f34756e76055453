"""Rules on made recordings: what they find, where, and what they leave alone."""

from __future__ import annotations

import json
import math
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).parent / "recordings"))

import make  # noqa: E402

from kinespark import api, config, engine  # noqa: E402
from kinespark.errors import SourceError, UnsupportedSource  # noqa: E402
from kinespark.rules import REGISTRY  # noqa: E402
from kinespark.sources import discover  # noqa: E402

NAN, INF = math.nan, math.inf


@pytest.fixture
def finds(spark, tmp_path):
    """Runs one rule on a recording and gives its result."""

    def run(root, rule, cap=50, **options):
        rec = discover(spark, str(root))
        settings = config.from_mapping({"cache": {"enabled": False}, "rules": {rule: {"options": options}}})
        if "max_findings" in REGISTRY[rule].defaults:
            settings.rules[rule].options["max_findings"] = cap
        (planned,) = [p for p in engine.plan(rec, settings) if p.rule.id == rule]
        try:
            return engine.run_rule(rec, planned)
        finally:
            rec.close()

    return run


def at(result, *keys):
    return [tuple(f["location"][k] for k in keys) for f in result["findings"]]


def dirs(tmp_path, **how):
    return make.directory(tmp_path / "r", **how)


def test_rules_are_all_there():
    assert len(REGISTRY) == 49 and all(r.title and r.impact and r.remedy for r in REGISTRY.values())


def test_clean_recording_passes(spark, tmp_path):
    report = api.check(spark, str(dirs(tmp_path)), config.from_mapping({"cache": {"enabled": False}}))
    bad = {r["rule_id"]: (r["status"], r["reason"], r["findings"]) for r in report["results"] if r["status"] in ("failed", "errored")}
    assert not bad and report["status"] == "passed" and report["summary"]["passed"] > 15
    assert report["coverage"] == {"episodes": 2, "frames": 12, "messages": None, "streams": report["coverage"]["streams"], "tasks": {"test task": 2}, "length_min": 6, "length_max": 6, "robot_type": "testbot", "fps": 30.0}


def test_monotonic(finds, tmp_path):
    t = [0, 1, 2, 1, 4, 5, 0, 1, 2, 3, 4, 5]
    r = finds(dirs(tmp_path, timestamps=[x / 30 for x in t]), "temporal.monotonic")
    assert at(r, "episode", "sample_index") == [("episode_000000", 3)] and r["findings"][0]["observed"] == 1 / 30 - 2 / 30


def test_monotonic_of_times_that_are_not_finite(finds, tmp_path):
    t = [i / 30 for i in range(6)] * 2
    t[2], t[8] = NAN, INF
    r = finds(dirs(tmp_path, timestamps=t), "temporal.monotonic")
    assert at(r, "sample_index") == [(2,), (2,)] and [f["observed"] for f in r["findings"]] == ["nan", "inf"]


def test_gaps(finds, tmp_path):
    r = finds(dirs(tmp_path, timestamps=[0, 1 / 30, 2 / 30, 0.5, 0.5 + 1 / 30, 0.5 + 2 / 30] + [i / 30 for i in range(6)]), "temporal.max_gap", max_gap_ms=80)
    assert at(r, "sample_index") == [(3,)] and r["findings"][0]["observed"]["count"] == 1
    slow = make.directory(tmp_path / "slow", fps=4.0)
    assert finds(slow, "temporal.max_gap")["status"] == "passed"
    r = finds(slow, "temporal.max_gap", max_gap_ms=80)
    assert len(r["findings"]) == 2 and r["findings"][0]["observed"]["count"] == 5


def test_intervals(finds, tmp_path):
    t = [i / 30 + (0.015 if i >= 3 else 0) for i in range(6)] + [i / 30 for i in range(6)]
    assert at(finds(dirs(tmp_path, timestamps=t), "temporal.sampling_interval"), "sample_index")[0] == (3,)


def test_start_and_drift(finds, tmp_path):
    n = 6
    t = [i / 30 for i in range(n)] * 2 + [0.5 + i / 30 for i in range(n)] + [i / 25 for i in range(n)]
    root = dirs(tmp_path, lengths=(n,) * 4, timestamps=t)
    assert at(finds(root, "temporal.episode_start"), "episode") == [("episode_000002",)]
    assert at(finds(root, "temporal.clock_drift", max_drift_frames=0.5), "episode") == [("episode_000003",)]


def test_values_that_are_not_finite(finds, tmp_path):
    s = [[float(i), i + 1.0] for i in range(12)]
    s[2], s[9] = [NAN, 0.0], [1.0, INF]
    root = dirs(tmp_path, states=s)
    r = finds(root, "numeric.finite_values")
    assert at(r, "episode", "sample_index") == [("episode_000000", 2), ("episode_000001", 3)] and r["findings"][1]["observed"] == {"non_finite_dimensions": [1]}
    assert finds(root, "temporal.stream_overlap")["status"] == "passed"


def test_missing_values(finds, tmp_path):
    a = [[0.1 * i, 0.2] for i in range(12)]
    a[4], a[7] = None, []
    root = dirs(tmp_path, actions=a)
    assert at(finds(root, "temporal.stream_overlap"), "episode", "stream", "sample_index") == [("episode_000000", "action", 4), ("episode_000001", "action", 1)]
    s = [[float(i), 1.0] for i in range(12)]
    s[1], s[4] = None, [NAN, 1.0]
    assert at(finds(make.directory(tmp_path / "n", states=s), "numeric.finite_values"), "sample_index") == [(4,)]


def test_shapes_bounds_and_steps(finds, tmp_path):
    root = dirs(tmp_path, shape=(3,))
    r = finds(root, "manifest.shape_consistency")
    assert at(r, "episode", "stream") == [("episode_000000", "observation.state"), ("episode_000001", "observation.state")] and r["findings"][0]["observed"] == [2] and r["findings"][0]["expected"] == [3]
    r = finds(root, "numeric.configured_bounds", limits={"action": {"max": 0.55}})
    assert r["reason"] is None
    assert at(r, "episode", "sample_index") == [("episode_000000", 5), ("episode_000001", 5)]
    assert finds(root, "numeric.configured_bounds", limits={"action": {"max": [9, 0.35]}})["findings"][0]["location"]["sample_index"] == 3
    assert finds(root, "numeric.configured_bounds", limits={"action": {"max": [1, 2, 3]}})["error_kind"] == "rule"
    assert finds(root, "numeric.configured_bounds")["status"] == "not_run"
    s = [[float(i), i + 1.0] for i in range(12)]
    s[4] = [100.0, 100.0]
    assert at(finds(make.directory(tmp_path / "d", states=s), "numeric.discontinuity", max_delta={"observation.state": 2}), "sample_index") == [(4,), (5,)]


def test_copies(finds, tmp_path):
    rows = [[float(i), i * 2.0] for i in range(6)]
    root = dirs(tmp_path, lengths=(6, 6, 6), states=rows * 2 + [[x, y + 1] for x, y in rows], actions=rows * 2 + [[x, y + 1e-4] for x, y in rows])
    r = finds(root, "duplication.exact_episodes")
    assert at(r, "episode") == [("episode_000001",)] and r["findings"][0]["observed"]["duplicate_of"] == "episode_000000"
    r = finds(root, "duplication.near_episodes")
    assert [(f["location"]["episode"], f["observed"]["duplicate_of"]) for f in r["findings"]] == [("episode_000002", "episode_000000")]


def test_indexes_totals_and_tasks(finds, tmp_path):
    zero = pa.array([0] * 12, pa.int64())
    root = dirs(tmp_path, extra={"frame_index": zero, "index": zero, "task_index": pa.array([0] * 11 + [7], pa.int64())}, total_frames=99)
    pq.write_table(pa.table({"task_index": pa.array([0], pa.int64())}), root / "meta/tasks.parquet")
    (root / "data/chunk-000/file-009.parquet").write_bytes((root / "data/chunk-000/file-000.parquet").read_bytes())
    r = finds(root, "episode.index_columns")
    assert at(r, "episode", "stream", "sample_index") == [("episode_000000", "frame_index", 1), ("episode_000000", "index", 1), ("episode_000001", "frame_index", 1), ("episode_000001", "index", 0)]
    assert r["findings"][0]["observed"] == {"value": 0, "mismatched_in_batch": 5}
    r = finds(root, "manifest.declared_totals")
    assert [(f["observed"], f["expected"]) for f in r["findings"]] == [(99, 12)]
    assert at(finds(root, "manifest.orphan_files"), "source") == [("data/chunk-000/file-009.parquet",)]
    r = finds(root, "episode.task_references")
    assert at(r, "episode") == [("episode_000001",)] and r["findings"][0]["observed"] == [7]


def edit_episodes(root, **columns):
    at_ = root / "meta/episodes/chunk-000/file-000.parquet"
    t = pq.read_table(at_).to_pydict() | columns
    pq.write_table(pa.table(t), at_)


def test_boundaries(finds, tmp_path):
    root = dirs(tmp_path, lengths=(6, 6, 6))
    edit_episodes(root, length=[6, 5, 6], dataset_from_index=[0, 6, 10], episode_id=["a", "b", "a"])
    r = finds(root, "episode.valid_boundaries")
    assert at(r, "episode") == [("b",), ("a",)] and r["findings"][0]["observed"] == {"length": 5, "from_index": 6, "to_index": 12, "stored_rows": 6}
    assert at(finds(root, "episode.unique_ids"), "episode") == [("a",)]


def test_files_and_columns(finds, spark, tmp_path):
    root = dirs(tmp_path)
    edit_episodes(root, **{"data/file_index": [0, 3]})
    assert at(finds(root, "manifest.required_files"), "source") == [("data/chunk-000/file-003.parquet",)]
    assert finds(root, "temporal.monotonic")["error_kind"] == "adapter"
    info = json.loads((root / "meta/info.json").read_text())
    info["features"]["force"] = {"dtype": "float32", "shape": [3]}
    info["features"]["index"]["dtype"] = "float64"
    root2 = make.directory(tmp_path / "c")
    (root2 / "meta/info.json").write_text(json.dumps(info))
    assert at(finds(root2, "manifest.schema_matches"), "stream") == [("force",), ("index",)]
    report = api.check(spark, str(root2), config.from_mapping({"required_streams": ["action", "gripper"], "cache": {"enabled": False}}))
    assert [f["location"]["stream"] for r in report["results"] if r["rule_id"] == "manifest.required_streams" for f in r["findings"]] == ["gripper"]


def many(tmp_path, change, k=12, n=40):
    """Like episodes of smooth motion, changed by ``change(episode, row, values)``."""
    wave = lambda e, i, d: math.sin(i / 6 + d) * 10 + e * 0.01 * math.cos(i + d)
    rows = [change(e, i, [wave(e, i, 0), wave(e, i, 1)]) for e in range(k) for i in range(n)]
    return make.directory(tmp_path / "m", lengths=(n,) * k, states=[s for s, _ in rows], actions=[a for _, a in rows])


def test_population_rules(finds, tmp_path):
    def change(e, i, v):
        s, a = list(v), list(v)
        if e == 3:
            s[0] = 5.0  # stuck
        if e == 4 and i == 20:
            s[1] += 60  # a jump, and out of range
        if e == 5:
            s[0] = -s[0]  # no longer follows
        if e == 6:
            s[1] += 3 if i % 2 else -3  # noise
        if e == 7 and i == 5:
            s[0] = NAN  # left out of all comparisons
        return s, a

    root = many(tmp_path, change)
    assert at(finds(root, "numeric.stuck_channels"), "episode") == [("episode_000003",)]
    r = finds(root, "numeric.outlier_jumps")
    assert ("episode_000004", 20) in at(r, "episode", "sample_index") and r["findings"][0]["observed"]["jumps"] in (1, 2)
    assert ("episode_000004",) in at(finds(root, "numeric.episode_envelope"), "episode")
    assert at(finds(root, "numeric.noise_level"), "episode") == [("episode_000006",)]
    assert at(finds(root, "numeric.action_state_coupling"), "episode")[-1] == ("episode_000005",)
    assert finds(dirs(tmp_path), "numeric.stuck_channels")["status"] == "not_run"


def test_clean_episodes_do_not_hide_an_outlier(finds, tmp_path):
    """Episodes with NaN have no part in percentiles: the one true outlier is found."""

    def change(e, i, v):
        if e == 5 and i == 7:
            v = [500.0, v[1]]
        if e in (8, 9) and i == 3:
            v = [NAN, v[1]]
        return v, v

    assert at(finds(many(tmp_path, change, k=14), "numeric.episode_envelope", streams=["observation.state"]), "episode") == [("episode_000005",)]


def test_alignment(finds, tmp_path):
    import random

    rng = random.Random(2)
    moves = [[rng.gauss(0, 1) for _ in range(90)] for _ in range(8)]
    place = lambda e, i: sum(moves[e][: max(0, i) + 1])
    states = [[place(e, i - (9 if e == 6 else 1)), 0.0] for e in range(8) for i in range(80)]
    actions = [[place(e, i), 0.0] for e in range(8) for i in range(80)]
    r = finds(make.directory(tmp_path / "l", lengths=(80,) * 8, states=states, actions=actions), "temporal.signal_alignment")
    assert at(r, "episode") == [("episode_000006",)] and r["findings"][0]["observed"]["lag_frames"] == 9


def test_second_version_and_bad_metadata(spark, finds, tmp_path):
    root = make.directory(tmp_path / "v2", version="v2.1")
    rec = discover(spark, str(root))
    assert [(r.episode, r.from_index, r.to_index, r.data_file) for r in rec.episodes.orderBy("pos").collect()] == [("episode_000000", 0, 6, "data/chunk-000/episode_000000.parquet"), ("episode_000001", 6, 12, "data/chunk-001/episode_000001.parquet")]
    assert rec.samples().count() == 12
    rec.close()
    for broken in ("{broken", "[]", '{"episode_index": 0}', ""):
        (root / "meta/episodes.jsonl").write_text(broken + "\n")
        with pytest.raises(SourceError):
            discover(spark, str(root))
    root = make.directory(tmp_path / "info")
    info = json.loads((root / "meta/info.json").read_text())
    for change in ({"fps": 0}, {"codebase_version": "v1.0"}, {"features": []}):
        (root / "meta/info.json").write_text(json.dumps(info | change))
        with pytest.raises(SourceError):
            discover(spark, str(root), "lerobot")
    with pytest.raises(SourceError):
        discover(spark, str(tmp_path / "nowhere"))
    (tmp_path / "bag").mkdir()
    (tmp_path / "bag/x.db3").write_bytes(b"")
    with pytest.raises(UnsupportedSource, match="convert"):
        discover(spark, str(tmp_path / "bag"))


def test_video_rules_on_frames(spark, tmp_path):
    """Frames come from any decoder; here from arrays."""
    import numpy as np

    from kinespark.sources import video

    n = 40
    # the robot moves; in episode 1 the camera freezes from frame 10 to 29, in episode 2 all is black
    root = make.directory(tmp_path / "v", lengths=(n,) * 3, video=True, states=[[i * 0.5 + math.sin(i), i * 0.3] for _ in range(3) for i in range(n)], actions=[[i * 0.5, i * 0.3 + math.cos(i)] for _ in range(3) for i in range(n)])

    def decoder(path, first, frames):
        for k in range(first, first + frames):
            e, i = divmod(k, n)
            i = 10 if e == 1 and 10 <= i < 30 else i
            yield np.zeros((48, 64)) if e == 2 else np.full((48, 64), 20.0 + 5 * i)

    rec = discover(spark, str(root))
    rec.frames_table = rec.keep(video.decoded(rec, decoder))
    assert rec.frames().count() == 3 * n
    settings = config.from_mapping({"cache": {"enabled": False}})
    results = {p.rule.id: engine.run_rule(rec, p) for p in engine.plan(rec, settings) if p.rule.id.startswith("video.")}
    assert {k: r["status"] for k, r in results.items()} == {"video.decode": "passed", "video.frozen_frames": "failed", "video.repeated_frames": "passed", "video.black_frames": "failed", "video.bitstream": "not_run", "video.timeline": "not_run", "video.camera_identity": "not_run"}
    found = {f["location"]["episode"]: f["observed"] for f in results["video.frozen_frames"]["findings"]}
    assert found["episode_000001"]["start_frame"] == 10 and found["episode_000001"]["consecutive_frames"] == 20
    (black,) = results["video.black_frames"]["findings"]
    assert black["observed"]["count"] == n and black["location"]["episode"] == "episode_000002"
    times = [k / 30 for k in range(3 * n) if k != 50]
    source = "videos/observation.images.wrist/chunk-000/file-000.mp4"
    rec.probes = spark.createDataFrame([(source, times, 2, 50 / 30)], "source string, frame_times array<double>, decode_errors long, first_error_time double")
    results = {p.rule.id: engine.run_rule(rec, p) for p in engine.plan(rec, settings) if p.rule.id in ("video.bitstream", "video.timeline")}
    assert at(results["video.bitstream"], "episode") == [("episode_000001",)]
    assert [(f["location"]["episode"], f["observed"]) for f in results["video.timeline"]["findings"]] == [("episode_000001", {"frames": n - 1})]
    rec.close()


def test_video_without_a_decoder_is_a_fault_of_the_source(spark, finds, tmp_path):
    r = finds(make.directory(tmp_path / "v", video=True), "video.decode")
    assert r["status"] == "errored" and r["error_kind"] == "adapter"


# --- messages ------------------------------------------------------------------------------------


def plain(tmp_path, times, sequences=None, **how):
    rows = [(1, q, t, t, b"{}") for q, t in zip(sequences or range(1, len(times) + 1), times)]
    return make.message_file(tmp_path / "m.mcap", rows, **how)


def test_message_order_and_sequence(finds, tmp_path):
    path = plain(tmp_path, [10**9, 5 * 10**8, 11 * 10**8, 11 * 10**8], [1, 3, 4, 5])
    r = finds(path, "mcap.timestamp_order")
    assert at(r, "stream", "sample_index") == [("/telemetry", 1)] and r["findings"][0]["observed"] == {"delta_ns": -500000000, "transition_count": 1}
    r = finds(path, "mcap.sequence_continuity")
    assert r["findings"][0]["observed"] == {"previous": 1, "current": 3, "transition_count": 1} and at(r, "sample_index") == [(1,)]
    assert finds(path, "mcap.duplicate_timestamps")["findings"][0]["observed"] == {"duplicate_transitions": 1}
    assert finds(path, "mcap.timestamp_order", max_reorder_ms=600)["status"] == "passed"


@pytest.mark.parametrize("compression", ["", "zstd", "lz4"])
def test_clean_message_file(spark, tmp_path, compression):
    path = plain(tmp_path, [10**9, 11 * 10**8, 12 * 10**8], compression=compression)
    report = api.check(spark, str(path), config.from_mapping({"cache": {"enabled": False}}))
    assert report["status"] == "passed" and report["summary"]["findings"] == 0 and report["summary"]["errored"] == 0
    assert report["coverage"]["messages"] == 3 and report["coverage"]["streams"] == ["/telemetry"]


def test_damaged_message_files(finds, spark, tmp_path):
    times = [10**9 + i * 10**8 for i in range(5)]
    assert finds(plain(tmp_path, times, truncate=24), "mcap.readable")["status"] == "failed"
    raw = bytearray(plain(tmp_path, times).read_bytes())
    raw[150] ^= 255
    (tmp_path / "flip.mcap").write_bytes(bytes(raw))
    assert finds(tmp_path / "flip.mcap", "mcap.readable")["status"] == "failed"
    r = finds(plain(tmp_path, times, claim=9), "mcap.summary_consistency")
    assert [(f["observed"], f["expected"]) for f in r["findings"]] == [(5, 9)]
    path = plain(tmp_path, times, indexed=False)
    r = finds(path, "mcap.index_coverage")
    assert r["findings"][0]["observed"] == {"summary": False, "chunk_indexes": 0} and r["findings"][0]["severity"] == "notice"
    assert finds(path, "mcap.summary_consistency")["status"] == "not_run"
    assert api.check(spark, str(path), config.from_mapping({"cache": {"enabled": False}}))["status"] == "passed"


def test_channels_and_schemas(finds, tmp_path):
    channels = ((1, 1, "/a", "json"), (2, 2, "/a", "cdr"), (3, 9, "/b", "json"))
    path = make.message_file(tmp_path / "c.mcap", [(1, 1, 1, 1, b"")], channels=channels, schemas=((1, "x", "jsonschema", ""), (2, "y", "ros2msg", "")))
    assert [(f["location"]["stream"], f["observed"]) for f in finds(path, "mcap.channel_schema")["findings"]] == [("/b", {"schema_id": 9}), ("/a", [["cdr", "y", "ros2msg"], ["json", "x", "jsonschema"]])]


def test_robot_messages(finds, spark, tmp_path):
    times = [10**9, 11 * 10**8, 2 * 10**9, 21 * 10**8]
    path = make.joints(tmp_path / "j.mcap", times, [{}, {"position": (0.0,)}, {"velocity": (NAN, 1.0)}, {}])
    r = finds(path, "ros2.semantic_consistency")
    assert [f["message"] for f in r["findings"]] == ["position has 1 values but name has 2 entries", "JointState velocity contains a non-finite value"]
    r = finds(path, "ros2.topic_gaps", topic_rates_hz={"/joint_states": 10})
    assert at(r, "sample_index") == [(2,)] and r["findings"][0]["observed"] == {"max_gap_ms": 900.0}
    assert at(finds(path, "ros2.required_topics", required_topics=["/joint_states", "/tf"]), "stream") == [("/tf",)]
    assert finds(path, "ros2.encoding")["status"] == finds(path, "ros2.decode")["status"] == "passed"
    assert finds(path, "ros2.header_clock_skew", max_header_skew_ms=1)["status"] == "passed"
    rows = [(1, 1, 10**9, 10**9, make.joint_state(3 * 10**9)), (1, 2, 11 * 10**8, 11 * 10**8, b"\0\1\0\0\1")]
    bad = make.message_file(tmp_path / "b.mcap", rows, channels=((1, 1, "/joint_states", "cdr"),), schemas=((1, "sensor_msgs/msg/JointState", "ros2msg", make.JOINT_STATE),), profile="ros2")
    r = finds(bad, "ros2.decode")
    assert len(r["findings"][0]["observed"]["examples"]) == 1
    assert finds(bad, "ros2.header_clock_skew", max_header_skew_ms=100)["findings"][0]["observed"] == {"maximum_absolute_skew_ms": 2000.0}


def test_transform_tree(finds, tmp_path):
    text = "geometry_msgs/TransformStamped[] transforms\n" + "=" * 80 + "\nMSG: geometry_msgs/TransformStamped\nstring frame\nstd_msgs/Header header\nstring child_frame_id\n" + "=" * 80 + "\nMSG: std_msgs/Header\nbuiltin_interfaces/Time stamp\nstring frame_id\n"

    def tf(*edges):
        c = make.Cdr().put("I", len(edges))
        for parent, child in edges:
            c.text("").put("i", 1).put("I", 0).text(parent).text(child)
        return c.done()

    rows = [(1, 1, 1, 1, tf(("map", "base"), ("", "x"))), (1, 2, 2, 2, tf(("odom", "base"), ("odom", "odom")))]
    path = make.message_file(tmp_path / "t.mcap", rows, channels=((1, 1, "/tf", "cdr"),), schemas=((1, "tf2_msgs/msg/TFMessage", "ros2msg", text),), profile="ros2")
    r = finds(path, "ros2.tf_tree")
    assert [f["observed"] for f in r["findings"]] == [{"parents": ["map", "odom"]}]
    assert len(finds(path, "ros2.semantic_consistency")["findings"]) == 2
