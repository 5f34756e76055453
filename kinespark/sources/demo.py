"""A small recording made up for trying things out."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq


def write_demo(folder: str | Path, corrupt: bool = False) -> Path:
    """One episode of eight rows at 20 frames a second; ``corrupt``: one action is not a number."""
    root = Path(folder)
    if root.exists() and any(root.iterdir()):
        raise ValueError(f"{root} is not empty")
    for d in ("meta/episodes/chunk-000", "data/chunk-000"):
        (root / d).mkdir(parents=True, exist_ok=True)
    n, fps = 8, 20.0
    actions = [[i / 10, i / 20] for i in range(n)]
    if corrupt:
        actions[4][0] = float("nan")
    vector = pa.list_(pa.float32(), 2)
    samples = {
        "timestamp": pa.array([i / fps for i in range(n)]), "frame_index": pa.array(range(n), pa.int64()), "episode_index": pa.array([0] * n, pa.int64()), "index": pa.array(range(n), pa.int64()),
        "observation.state": pa.array([[float(i), i + 1.0] for i in range(n)], vector), "action": pa.array(actions, vector),
    }
    pq.write_table(pa.table(samples), root / "data/chunk-000/file-000.parquet")
    one = {"episode_index": [0], "length": [n], "tasks": [["demo"]], "data/chunk_index": [0], "data/file_index": [0], "dataset_from_index": [0], "dataset_to_index": [n]}
    pq.write_table(pa.table(one), root / "meta/episodes/chunk-000/file-000.parquet")
    numbers = {k: {"dtype": d, "shape": [1]} for k, d in (("timestamp", "float64"), ("frame_index", "int64"), ("episode_index", "int64"), ("index", "int64"))}
    features = numbers | {k: {"dtype": "float32", "shape": [2]} for k in ("observation.state", "action")}
    info = {"codebase_version": "v3.0", "robot_type": "demo", "fps": fps, "total_episodes": 1, "total_frames": n, "repo_id": "demo/recording", "features": features}
    (root / "meta/info.json").write_text(json.dumps(info))
    return root
