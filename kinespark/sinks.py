"""Reports as files and as text."""

from __future__ import annotations

import datetime
import html
import json
import os
import tempfile
from pathlib import Path
from typing import Any
from xml.etree import ElementTree

import yaml

from .config import ReportSettings
from .rules import REGISTRY

#: How the exchange format names severities.
LEVELS = {"critical": "error", "error": "error", "warning": "warning", "notice": "note"}


def write_text(path: str | Path, text: str) -> Path:
    """The whole text or nothing: written beside the target, then moved over it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return path


def to_json(report: dict[str, Any]) -> str:
    return json.dumps(report, indent=2, allow_nan=False) + "\n"


def where(finding: dict[str, Any]) -> str:
    return ", ".join(f"{k} {v}" for k, v in finding["location"].items() if v is not None)


def to_junit(report: dict[str, Any]) -> str:
    s = report["summary"]
    suite = ElementTree.Element("testsuite", name=f"kinespark: {report['dataset']}", tests=str(len(report["results"])), failures=str(s["failed"]), errors=str(s["errored"]), skipped=str(s["not_run"]))
    for r in report["results"]:
        case = ElementTree.SubElement(suite, "testcase", classname=r["rule_id"].split(".")[0], name=r["rule_id"], time=f"{r['duration_ms'] / 1000:.6f}")
        if r["status"] == "failed":
            node = ElementTree.SubElement(case, "failure", message=f"{len(r['findings'])} finding(s)")
            node.text = "\n".join(f"{f['severity']}: {f['message']} ({where(f)})" for f in r["findings"])
        elif r["status"] == "errored":
            ElementTree.SubElement(case, "error", message=r["reason"] or "")
        elif r["status"] == "not_run":
            ElementTree.SubElement(case, "skipped", message=r["reason"] or "")
    return ElementTree.tostring(suite, encoding="unicode", xml_declaration=True) + "\n"


def to_sarif(report: dict[str, Any]) -> str:
    found = [f for r in report["results"] for f in r["findings"]]
    used = sorted({f["rule_id"] for f in found})
    rules = [{"id": k, "shortDescription": {"text": REGISTRY[k].title if k in REGISTRY else k}} for k in used]
    results = []
    for f in found:
        place = {"logicalLocations": [{"fullyQualifiedName": "/".join(str(f["location"][k]) for k in ("episode", "stream") if f["location"][k] is not None) or report["dataset"]}]}
        if f["location"]["source"]:
            place["physicalLocation"] = {"artifactLocation": {"uri": f["location"]["source"]}}
        results.append({"ruleId": f["rule_id"], "level": LEVELS[f["severity"]], "message": {"text": f["message"]}, "locations": [place], "partialFingerprints": {"kinespark/v1": f["fingerprint"]}})
    run = {"tool": {"driver": {"name": "kinespark", "version": report["engine_version"], "rules": rules}}, "results": results, "invocations": [{"executionSuccessful": not report["summary"]["errored"], "exitCode": int(report["status"] == "failed")}]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2) + "\n"


def to_html(report: dict[str, Any]) -> str:
    e = lambda x: html.escape(str(x))
    rows = []
    for r in report["results"]:
        found = "".join(f"<li><b>{e(f['severity'])}</b> {e(f['message'])} <small>{e(where(f))}</small></li>" for f in r["findings"])
        rows.append(f"<tr class={e(r['status'])}><td>{e(r['rule_id'])}</td><td>{e(r['status'])}</td><td>{e(r['reason'] or '')}<ul>{found}</ul></td></tr>")
    s = report["summary"]
    head = f"<h1>{e(report['dataset'])}: {e(report['status'])}</h1><p>{s['passed']} passed, {s['failed']} failed, {s['not_run']} not run, {s['errored']} errored; {s['findings']} findings</p>"
    style = "<style>body{font-family:sans-serif}td{border-top:1px solid #ccc;padding:4px;vertical-align:top}.failed td,.errored td{background:#fee}</style>"
    return f"<!doctype html><html><head><meta charset=utf-8><title>{e(report['dataset'])}</title>{style}</head><body>{head}<table>{''.join(rows)}</table></body></html>\n"


def to_terminal(report: dict[str, Any]) -> str:
    s, lines = report["summary"], [f"{report['dataset']}: {report['status'].upper()}"]
    lines.append(f"{s['passed']} passed, {s['failed']} failed, {s['not_run']} not run, {s['errored']} errored, {s['findings']} findings")
    for level in ("critical", "error", "warning", "notice"):
        for f in (f for r in report["results"] for f in r["findings"] if f["severity"] == level):
            lines.append(f"  {level}: [{f['rule_id']}] {f['message']} ({where(f)})")
    lines += [f"  errored: [{r['rule_id']}] {r['reason']}" for r in report["results"] if r["status"] == "errored"]
    return "\n".join(lines) + "\n"


def comparison_text(c: dict[str, Any]) -> str:
    lines = [f"{c['baseline_dataset']} -> {c['candidate_dataset']}: {c['status'].upper()}"]
    for name in ("new", "resolved", "persistent"):
        lines.append(f"{name}: {len(c[f'{name}_findings'])}")
        lines += [f"  [{f['rule_id']}] {f['message']}" for f in c[f"{name}_findings"][:20] if name != "persistent"]
    lines += [f"  {r['rule_id']}: {r['before']} -> {r['after']}" for r in c["rule_changes"]]
    return "\n".join(lines) + "\n"


def write_baseline(baseline: dict[str, Any], path: str | Path) -> Path:
    return write_text(path, yaml.safe_dump(baseline, sort_keys=False, allow_unicode=True))


def write_all(report: dict[str, Any], settings: ReportSettings, paths: dict[str, str | None] | None = None) -> dict[str, Path]:
    """Every form that is asked for; a path given beats the folder of the settings."""
    forms = {"json": (to_json, "json"), "junit": (to_junit, "xml"), "sarif": (to_sarif, "sarif"), "html": (to_html, "html")}
    stamp, out = datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%SZ"), {}
    for name, (render, suffix) in forms.items():
        at = (paths or {}).get(name) or (f"{settings.output_dir}/{stamp}.{suffix}" if getattr(settings, name) else None)
        if at:
            out[name] = write_text(at, render(report))
    return out
