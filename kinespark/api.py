"""Entry points: look at a source, check it, and compare two."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from . import algebra, engine
from . import config as configs
from .errors import SourceError
from .sources import Recording, discover


def inspect(spark: SparkSession, path: str, adapter: str = "auto", profile: str = "auto") -> dict[str, Any]:
    """What the metadata says; no sample is read."""
    recording = discover(spark, path, adapter, profile)
    try:
        return recording.inventory()
    finally:
        recording.close()


def check(spark: SparkSession, source: str | Recording, config: configs.Config | None = None, config_path: str | None = None, baseline_path: str | None = None, config_plugins: bool = True, cache_dir: str | None = None) -> dict[str, Any]:
    """The report on a source, less what its baseline covers."""
    path = source if isinstance(source, str) else None
    at = configs.find(config_path, path) if config is None else None
    config = config or configs.load(config_path, path)
    recording = discover(spark, source, config.adapter, config.profile, cache_dir) if path else source
    try:
        report = engine.run(recording, config, config_plugins=config_plugins, config_path=str(at) if at else None)
    finally:
        if path:
            recording.close()
    reviewed = baseline_path or config.baseline
    return algebra.apply_baseline(report, algebra.read_baseline(reviewed), config.fail_on) if reviewed else report


def report_of(spark: SparkSession, source: str, **how: Any) -> dict[str, Any]:
    """A report written before, or one made now."""
    if not source.endswith(".json"):
        return check(spark, source, **how)
    try:
        with open(source, encoding="utf-8") as f:
            report = json.load(f)
    except (OSError, ValueError) as e:
        raise SourceError(f"report {source} cannot be read: {e}") from e
    if not isinstance(report, dict) or not isinstance(report.get("results"), list) or "summary" not in report:
        raise SourceError(f"{source} is not a report")
    return report


def compare(spark: SparkSession, before: str, after: str, fail_on: str = "error", **how: Any) -> dict[str, Any]:
    return algebra.compare(report_of(spark, before, **how), report_of(spark, after, **how), fail_on)
