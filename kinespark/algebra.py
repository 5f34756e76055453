"""Reports against reports, and against findings that were reviewed."""

from __future__ import annotations

import datetime
from pathlib import Path
from typing import Any

import yaml

from .engine import fails, summarize
from .errors import ConfigError
from .rules.base import RANKS

_ENTRY = ("fingerprint", "rule_id", "reason", "author", "accepted_at", "expires_at")


def _by_key(report: dict[str, Any]) -> dict[tuple[str, str], dict[str, Any]]:
    return {(f["rule_id"], f["fingerprint"]): f for r in report["results"] for f in r["findings"]}


def _coverage_delta(a: dict[str, Any] | None, b: dict[str, Any] | None) -> dict[str, Any] | None:
    if a is None or b is None:
        return None
    out: dict[str, Any] = {f"{k}_{when}": c[k] for k in ("episodes", "frames", "messages") for when, c in (("before", a), ("after", b))}
    for k in ("streams", "tasks"):
        out[f"added_{k}"], out[f"removed_{k}"] = sorted(set(b[k]) - set(a[k])), sorted(set(a[k]) - set(b[k]))
    both = sorted(set(a["tasks"]) & set(b["tasks"]))
    return out | {"task_count_changes": {t: {"before": a["tasks"][t], "after": b["tasks"][t]} for t in both if a["tasks"][t] != b["tasks"][t]}}


def compare(before: dict[str, Any], after: dict[str, Any], fail_on: str = "error") -> dict[str, Any]:
    """What is new, resolved and persistent, and which way the recording went."""
    old, new = _by_key(before), _by_key(after)
    added, gone = [f for k, f in new.items() if k not in old], [f for k, f in old.items() if k not in new]
    was, now = ({r["rule_id"]: r["status"] for r in x["results"]} for x in (before, after))
    changes = [{"rule_id": k, "before": was.get(k, "absent"), "after": now.get(k, "absent")} for k in sorted(was | now) if was.get(k, "absent") != now.get(k, "absent")]
    delta = _coverage_delta(before.get("coverage"), after.get("coverage"))
    same = delta is None or not any(delta[k] for k in delta if k.startswith(("added", "removed", "task_"))) and all(delta[f"{k}_before"] == delta[f"{k}_after"] for k in ("episodes", "frames", "messages"))
    blocks = lambda found: any(RANKS[f["severity"]] >= RANKS[fail_on] for f in found)
    if blocks(added) or after["summary"]["errored"] > before["summary"]["errored"]:
        status = "regressed"
    elif not added and not gone and not changes and same:
        status = "unchanged"
    elif blocks(gone) or (gone and not added):
        status = "improved"
    else:
        status = "changed"
    return {
        "schema_version": "1.0", "status": status, "baseline_dataset": before["dataset"], "candidate_dataset": after["dataset"], "baseline_fingerprint": before["source_fingerprint"],
        "candidate_fingerprint": after["source_fingerprint"], "baseline_status": before["status"], "candidate_status": after["status"], "new_findings": added, "resolved_findings": gone,
        "persistent_findings": [f for k, f in new.items() if k in old], "rule_changes": changes, "coverage": delta, "baseline_coverage": before.get("coverage"), "candidate_coverage": after.get("coverage"),
    }


def _date(value: Any) -> datetime.date | None:
    if value is None or (isinstance(value, datetime.date) and not isinstance(value, datetime.datetime)):
        return value
    try:
        return datetime.date.fromisoformat(str(value))
    except ValueError as e:
        raise ConfigError(f"{value!r} is not a date") from e


def baseline_of(report: dict[str, Any], author: str, reason: str, expires_at: datetime.date | None = None, today: datetime.date | None = None) -> dict[str, Any]:
    """Every finding of a report, accepted by someone for a reason."""
    if not author.strip() or not reason.strip():
        raise ConfigError("a baseline needs an author and a reason")
    today = today or datetime.datetime.now(datetime.UTC).date()
    said = {"reason": reason, "author": author, "accepted_at": today.isoformat(), "expires_at": expires_at.isoformat() if expires_at else None}
    entries = [{"fingerprint": f["fingerprint"], "rule_id": f["rule_id"], **said} for r in report["results"] for f in r["findings"]]
    return {"baseline_version": 1, "created_at": today.isoformat(), "author": author, "dataset": report["dataset"], "source_fingerprint": report["source_fingerprint"], "reason": reason, "suppressions": entries}


def read_baseline(path: str | Path) -> dict[str, Any]:
    try:
        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(f"baseline {path} cannot be read: {e}") from e
    if not isinstance(raw, dict) or not isinstance(raw.get("suppressions"), list):
        raise ConfigError(f"baseline {path} must be a mapping with suppressions")
    for s in raw["suppressions"]:
        if not isinstance(s, dict) or set(s) - set(_ENTRY) or any(not str(s.get(k) or "").strip() for k in _ENTRY[:5]):
            raise ConfigError(f"baseline {path}: an entry needs {', '.join(_ENTRY[:5])}")
        _date(s["accepted_at"]), _date(s.get("expires_at"))
    return raw


def apply_baseline(report: dict[str, Any], baseline: dict[str, Any], fail_on: str = "error", today: datetime.date | None = None) -> dict[str, Any]:
    """The report without findings that a live entry covers; status and summary are worked out anew."""
    today = today or datetime.datetime.now(datetime.UTC).date()
    live = {(s["fingerprint"], s["rule_id"]): s for s in baseline["suppressions"] if (end := _date(s.get("expires_at"))) is None or end >= today}
    results, covered = [], []
    for r in report["results"]:
        kept = [f for f in r["findings"] if (f["fingerprint"], f["rule_id"]) not in live]
        covered += [{k: str(v) if (v := live[f["fingerprint"], f["rule_id"]].get(k)) is not None else None for k in _ENTRY} for f in r["findings"] if (f["fingerprint"], f["rule_id"]) in live]
        results.append(r | {"findings": kept, "status": "passed" if r["status"] == "failed" and not kept else r["status"]})
    return report | {"results": results, "summary": summarize(results), "status": "failed" if fails(results, fail_on) else "passed", "suppressed": covered}
