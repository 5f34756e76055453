"""Rules from outside: a class or object with the attributes of a rule, named by ``module:Name`` or ``file.py:Name``."""

from __future__ import annotations

import importlib
import importlib.util
from importlib.metadata import entry_points
from pathlib import Path
from typing import Any

from .errors import ConfigError
from .rules import REGISTRY, Rule

GROUP = "kinespark.rules"


def _loaded(spec: str) -> Any:
    where, _, name = spec.rpartition(":")
    if not where or not name:
        raise ConfigError(f"a plugin is named module:Name or file.py:Name, not {spec!r}")
    try:
        if where.endswith(".py"):
            at = Path(where)
            found = importlib.util.spec_from_file_location(f"kinespark_plugin_{at.stem}", at)
            if found is None or found.loader is None or not at.is_file():
                raise ConfigError(f"there is no plugin file {where}")
            module = importlib.util.module_from_spec(found)
            found.loader.exec_module(module)
        else:
            module = importlib.import_module(where)
        return getattr(module, name)
    except ConfigError:
        raise
    except Exception as e:  # noqa: BLE001 - whatever a plugin raises is a fault of the configuration
        raise ConfigError(f"plugin {spec} cannot be loaded: {type(e).__name__}: {e}") from e


def checked(found: Any, spec: str) -> Rule:
    if isinstance(found, type):
        found = found()
    if not isinstance(found, Rule):
        raise ConfigError(f"plugin {spec} is not a rule")
    if found.id in REGISTRY:
        raise ConfigError(f"plugin {spec} has the id of a built-in rule: {found.id}")
    if "." not in found.id or not callable(found.build):
        raise ConfigError(f"plugin {spec} needs an id with a dot and a build function")
    return found


def load(specs: list[str], configured: bool = True) -> list[Rule]:
    """Installed plugins, and those a configuration names if it may."""
    rules = [checked(e.load(), e.name) for e in entry_points(group=GROUP)]
    rules += [checked(_loaded(s), s) for s in specs] if configured else []
    seen: set[str] = set()
    for r in rules:
        if r.id in seen:
            raise ConfigError(f"two plugins have the id {r.id}")
        seen.add(r.id)
    return rules
