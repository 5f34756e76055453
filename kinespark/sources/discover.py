"""Which reader knows a source."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import SparkSession

from ..errors import SourceError, UnsupportedSource
from ..functions.storage import Store
from .lerobot import is_directory_recording, open_directory
from .mcap import MAGIC, open_messages
from .recording import Recording

ADAPTERS, PROFILES = ("auto", "lerobot", "mcap"), ("auto", "generic", "ros2")
_HUB = re.compile(r"hf://datasets/([\w.-]+)/([\w.-]+)@([0-9A-Za-z._/-]+)")


def hub_folder(source: str, cache_dir: str | None = None, offline: bool = True) -> str:
    """The local folder of ``hf://datasets/owner/name@revision``: only what is cached, no network."""
    m = _HUB.fullmatch(source)
    if not m:
        raise SourceError("a hub source is hf://datasets/<owner>/<name>@<revision>, with a revision")
    owner, name, revision = m.groups()
    if not offline:
        raise SourceError("downloads are not supported; fetch the data set first and read it offline")
    base = Path(cache_dir or Path.home() / ".cache/huggingface/hub") / f"datasets--{owner}--{name}"
    ref = base / "refs" / revision
    commit = ref.read_text().strip() if ref.is_file() else revision
    folder = base / "snapshots" / commit
    if not re.fullmatch(r"[0-9a-f]{40}", commit) or not folder.is_dir():
        raise SourceError(f"{source} is not in the cache at {base}")
    return str(folder)


def message_file(store: Store) -> str | None:
    """The one message file that a path means: '' for the path itself; None if there is none."""
    if store.is_file():
        return "" if store.root.lower().endswith(".mcap") or store.read(most=len(MAGIC)) == MAGIC else None
    found = [f.path for f in store.files(suffix=".mcap") if "/" not in f.path] if store.is_dir() else []
    if len(found) > 1:
        raise SourceError(f"{store.root} holds several message files; name one")
    return found[0] if found else None


def discover(spark: SparkSession, path: str, adapter: str = "auto", profile: str = "auto", cache_dir: str | None = None) -> Recording:
    if adapter not in ADAPTERS:
        raise UnsupportedSource(f"unknown adapter: {adapter}")
    if profile not in PROFILES:
        raise UnsupportedSource(f"unknown profile: {profile}")
    store = Store(spark, hub_folder(path, cache_dir) if path.startswith("hf://") else str(path))
    if not store.exists():
        raise SourceError(f"there is no source at {path}")
    if adapter == "lerobot" or (adapter == "auto" and store.is_dir() and is_directory_recording(store)):
        if not store.is_dir():
            raise SourceError(f"{path} must be a directory")
        return open_directory(spark, store)
    found = message_file(store)
    if found is not None:
        return open_messages(spark, Store(spark, f"{store.root}/{found}" if found else store.root), profile)
    if adapter == "mcap":
        raise SourceError(f"there is no message file at {path}")
    if store.root.lower().endswith(".db3") or (store.is_dir() and any(f.path.endswith(".db3") for f in store.files())):
        raise UnsupportedSource("SQLite bags are not supported; convert them with `ros2 bag convert` to MCAP first")
    raise UnsupportedSource(f"no reader knows {path}: expected an episode directory or a message file")
