"""Recordings made for tests: episode directories and message files."""

from __future__ import annotations

import json
import struct
import zlib
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq


def directory(root: Path, lengths=(6, 6), fps=30.0, timestamps=None, states=None, actions=None, shape=(2,), video=False, tasks=True, extra=None, version="v3.0", **info):
    """A version 3 directory: like rows in every episode unless given, one data file."""
    n = sum(lengths)
    ep = [k for k, m in enumerate(lengths) for _ in range(m)]
    fi = [i for m in lengths for i in range(m)]
    vector = pa.list_(pa.float32(), 2)
    actions = actions or [[(k + i) / 10, (i + 1) / 10] for k, i in zip(ep, fi)]
    states = states or [[float(i + k), i + 1.0] for k, i in zip(ep, fi)]
    kind = lambda xs: pa.list_(pa.float32()) if any(x is None or len(x) != 2 for x in xs) else vector
    columns = {
        "timestamp": pa.array(timestamps or [i / fps for i in fi], pa.float64()), "frame_index": pa.array(fi, pa.int64()), "episode_index": pa.array(ep, pa.int64()), "index": pa.array(range(n), pa.int64()),
        "observation.state": pa.array(states, kind(states)), "action": pa.array(actions, kind(actions)),
    } | (extra or {})
    features = {k: {"dtype": "float64" if k == "timestamp" else "int64", "shape": [1]} for k in ("timestamp", "frame_index", "episode_index", "index")}
    features |= {"observation.state": {"dtype": "float32", "shape": list(shape)}, "action": {"dtype": "float32", "shape": [2]}}
    if video:
        features["observation.images.wrist"] = {"dtype": "video", "shape": [48, 64, 3]}
    starts = [sum(lengths[:k]) for k in range(len(lengths))]
    about = {"codebase_version": version, "robot_type": "testbot", "fps": fps, "total_episodes": len(lengths), "total_frames": n, "repo_id": "tests/made", "features": features} | info
    (root / "meta").mkdir(parents=True, exist_ok=True)
    if version.startswith("v2"):
        about["chunks_size"] = 1
        (root / "meta/episodes.jsonl").write_text("".join(json.dumps({"episode_index": k, "length": m, "tasks": ["test task"]}) + "\n" for k, m in enumerate(lengths)))
        table = pa.table(columns)
        for k, (s, m) in enumerate(zip(starts, lengths)):
            at = root / f"data/chunk-{k:03d}/episode_{k:06d}.parquet"
            at.parent.mkdir(parents=True)
            pq.write_table(table.slice(s, m), at)
    else:
        for d in ("meta/episodes/chunk-000", "data/chunk-000"):
            (root / d).mkdir(parents=True)
        pq.write_table(pa.table(columns), root / "data/chunk-000/file-000.parquet")
        k = len(lengths)
        rows = {"episode_index": range(k), "length": lengths, "tasks": [["test task"]] * k, "data/chunk_index": [0] * k, "data/file_index": [0] * k, "dataset_from_index": starts, "dataset_to_index": [s + m for s, m in zip(starts, lengths)]}
        if video:
            at = "videos/observation.images.wrist"
            rows |= {f"{at}/chunk_index": [0] * k, f"{at}/file_index": [0] * k, f"{at}/from_timestamp": [s / fps for s in starts], f"{at}/to_timestamp": [(s + m) / fps for s, m in zip(starts, lengths)]}
        pq.write_table(pa.table({c: pa.array(list(v)) for c, v in rows.items()}), root / "meta/episodes/chunk-000/file-000.parquet")
    (root / "meta/info.json").write_text(json.dumps(about))
    return root


# --- message files -----------------------------------------------------------------------------

MAGIC = b"\x89MCAP0\r\n"
_text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
_record = lambda op, raw: struct.pack("<BQ", op, len(raw)) + raw


def message_file(path: Path, messages, channels=((1, 1, "/telemetry", "json"),), schemas=((1, "example/Telemetry", "jsonschema", "{}"),), profile="", indexed=True, compression="", claim=None, truncate=0):
    """``messages``: (channel, sequence, log time, publish time, payload)."""
    schema = {k: _record(3, struct.pack("<H", k) + _text(n) + _text(e) + struct.pack("<I", len(t.encode())) + t.encode()) for k, n, e, t in schemas}
    channel = {k: _record(4, struct.pack("<HH", k, s) + _text(t) + _text(e) + struct.pack("<I", 0)) for k, s, t, e in channels}
    body = b"".join(schema.values()) + b"".join(channel.values())
    body += b"".join(_record(5, struct.pack("<HIQQ", c, q, a, b) + p) for c, q, a, b, p in messages)
    out = MAGIC + _record(1, _text(profile) + _text("made"))
    summary = b""
    if indexed:
        packed = pa.Codec(compression).compress(body).to_pybytes() if compression else body
        times = [m[2] for m in messages] or [0]
        chunk = struct.pack("<QQQI", min(times), max(times), len(body), zlib.crc32(body)) + _text(compression) + struct.pack("<Q", len(packed)) + packed
        at = len(out)
        out += _record(6, chunk)
        counts = {k: sum(m[0] == k for m in messages) for k in channel}
        per = b"".join(struct.pack("<HQ", k, n) for k, n in counts.items())
        stats = struct.pack("<QHIIII", len(messages) if claim is None else claim, len(schema), len(channel), 0, 0, 1) + struct.pack("<QQ", min(times), max(times)) + struct.pack("<I", len(per)) + per
        index = struct.pack("<QQQQ", min(times), max(times), at, len(out) - at) + struct.pack("<I", 0) + struct.pack("<Q", 0) + _text(compression) + struct.pack("<QQ", len(packed), len(body))
        summary = b"".join(schema.values()) + b"".join(channel.values()) + _record(11, stats) + _record(8, index)
    else:
        out += body
    out += _record(15, struct.pack("<I", zlib.crc32(out)))
    start = len(out) if summary else 0
    foot = struct.pack("<QQ", start, 0)
    head = struct.pack("<BQ", 2, 20)
    crc = zlib.crc32(summary + head + foot) if summary else 0
    out += summary + head + foot + struct.pack("<I", crc) + MAGIC
    path.write_bytes(out[: len(out) - truncate] if truncate else out)
    return path


JOINT_STATE = """std_msgs/Header header
string[] name
float64[] position
float64[] velocity
float64[] effort
================================================================================
MSG: std_msgs/Header
builtin_interfaces/Time stamp
string frame_id
================================================================================
MSG: builtin_interfaces/Time
int32 sec
uint32 nanosec
"""


class Cdr:
    def __init__(self):
        self.raw = b""

    def put(self, code, *values):
        size = struct.calcsize(code)
        self.raw += b"\0" * (-len(self.raw) % size) + struct.pack(f"<{len(values)}{code}", *values)
        return self

    def text(self, s):
        raw = s.encode() + b"\0"
        self.put("I", len(raw))
        self.raw += raw
        return self

    def numbers(self, xs):
        self.put("I", len(xs))
        return self.put("d", *xs) if xs else self

    def done(self):
        return b"\0\1\0\0" + self.raw


def joint_state(at_ns, names=("a", "b"), position=(0.0, 1.0), velocity=(), effort=()):
    c = Cdr().put("i", at_ns // 10**9).put("I", at_ns % 10**9).text("base").put("I", len(names))
    for n in names:
        c.text(n)
    return c.numbers(position).numbers(velocity).numbers(effort).done()


def joints(path: Path, times, states=None, sequences=None, **how):
    states = states or [{} for _ in times]
    rows = [(1, q, t, t, joint_state(t, **s)) for q, t, s in zip(sequences or range(1, len(times) + 1), times, states)]
    return message_file(path, rows, channels=((1, 1, "/joint_states", "cdr"),), schemas=((1, "sensor_msgs/msg/JointState", "ros2msg", JOINT_STATE),), profile="ros2", **how)
