"""What a rule is, and the one schema of what rules find."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.recording import Recording

RANKS = {"critical": 3, "error": 2, "warning": 1, "notice": 0}
LOCATION = ("episode", "stream", "sample_index", "timestamp", "source")


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    severity: str
    scope: str
    cost: str  # metadata, linear or video
    build: Callable[[Recording, dict[str, Any]], Found]
    defaults: dict[str, Any] = field(default_factory=dict)
    capabilities: frozenset[str] = frozenset()
    streams: frozenset[str] = frozenset()
    adapters: tuple[str, ...] = ("lerobot",)
    version: str = "1.0.0"
    enabled: bool = True  # else only where a configuration names it
    impact: str = ""
    remedy: str = ""
    limits: str = ""


@dataclass(frozen=True)
class Found:
    """``rows``: findings in the order of ``by``, with ``message`` and any of LOCATION, ``observed`` and ``expected``.

    ``expected`` is the same for all findings where the rows do not say.
    """

    rows: DataFrame
    by: tuple[str, ...] = ("pos",)
    expected: Any = None


REGISTRY: dict[str, Rule] = {}


def rule(
    id: str, title: str, severity: str, scope: str, cost: str = "linear", needs: str = "episodes", of: tuple[str, ...] = (), adapters: tuple[str, ...] = ("lerobot",),
    version: str = "1.0.0", enabled: bool = True, note: str = "", cap: bool = True, **defaults: Any,
):
    """Registers the function that it decorates as the rule's build."""

    def keep(build: Callable[[Recording, dict[str, Any]], Found]) -> Callable[[Recording, dict[str, Any]], Found]:
        lines = [" ".join(x.split()) for x in (build.__doc__ or "").split("\n\n")]
        REGISTRY[id] = Rule(
            id, title, severity, scope, cost, build, defaults | ({"max_findings": 50} if cap else {}), frozenset(needs.split()), frozenset(of), adapters, version, enabled,
            lines[0], lines[1] if len(lines) > 1 else "", note,
        )
        return build

    return keep


def rules_for(recording: Recording, extra: tuple[Rule, ...] = ()) -> list[Rule]:
    """The rules that know this kind of recording; those on robot messages only for their profile."""
    return [r for r in [*REGISTRY.values(), *extra] if recording.adapter in r.adapters and (not r.id.startswith("ros2.") or recording.profile == "ros2")]


def text(template: str, *parts: Column | str) -> Column:
    """A message with the parts in place of braces."""
    pieces = template.split("{}")
    out = [F.lit(pieces[0])]
    for part, rest in zip(parts, pieces[1:]):
        column = F.col(f"`{part}`") if isinstance(part, str) else part
        out += [F.coalesce(column.cast("string"), F.lit("?")), F.lit(rest)]
    return F.concat(*out)


def record(**fields: Any) -> Column:
    """A struct whose field order is that given."""
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def nothing(recording: Recording) -> Found:
    return Found(recording.spark.createDataFrame([], "pos long, message string"))
