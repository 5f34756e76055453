"""``python -m kinespark.cli``: exit code 0 passed, 1 findings or a regression, 2 wrong use, 3 source, 4 a fault inside."""

from __future__ import annotations

import argparse
import datetime
import importlib.util
import json
import sys
from pathlib import Path
from typing import Any

from . import algebra, api, sinks
from . import config as configs
from .errors import ConfigError, SourceError
from .rules import REGISTRY
from .sources.demo import write_demo


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()


def doctor() -> list[dict[str, Any]]:
    """What is there to work with."""
    out = [{"name": "python", "ok": sys.version_info >= (3, 11), "detail": sys.version.split()[0]}]
    for name, needed in (("pyspark", True), ("pyarrow", True), ("pandas", True), ("numpy", True), ("yaml", True), ("cv2", False)):
        there = importlib.util.find_spec(name) is not None
        out.append({"name": name, "ok": there or not needed, "detail": "found" if there else "missing" + ("" if needed else "; video is not decoded without it")})
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinespark")
    sub = top.add_subparsers(dest="command", required=True)
    check = sub.add_parser("check", help="run the rules on a source")
    check.add_argument("source")
    for name in ("config", "baseline", "json", "junit", "sarif", "html", "cache-dir"):
        check.add_argument(f"--{name}")
    check.add_argument("--fail-on", choices=configs.SEVERITIES)
    check.add_argument("--no-config-plugins", action="store_true")
    check.add_argument("--format", choices=("text", "json"), default="text")
    look = sub.add_parser("inspect", help="show what the metadata says")
    look.add_argument("source")
    sub.add_parser("rules", help="list the rules")
    explain = sub.add_parser("explain", help="explain a rule")
    explain.add_argument("rule")
    demo = sub.add_parser("demo", help="write a small recording")
    demo.add_argument("folder")
    demo.add_argument("--corrupt", action="store_true")
    init = sub.add_parser("init", help=f"write {configs.NAME}")
    init.add_argument("folder", nargs="?", default=".")
    sub.add_parser("doctor", help="show what is installed")
    diff = sub.add_parser("compare", help="compare two sources or reports")
    diff.add_argument("before")
    diff.add_argument("after")
    diff.add_argument("--config")
    diff.add_argument("--format", choices=("text", "json"), default="text")
    base = sub.add_parser("baseline", help="accept the findings of a report")
    base.add_argument("report")
    base.add_argument("output")
    base.add_argument("--author", required=True)
    base.add_argument("--reason", required=True)
    base.add_argument("--expires")
    return top


def run(args: argparse.Namespace) -> int:
    if args.command == "check":
        config = configs.load(args.config, args.source)
        config.fail_on = args.fail_on or config.fail_on
        report = api.check(session(), args.source, config, baseline_path=args.baseline, config_plugins=not args.no_config_plugins, cache_dir=args.cache_dir)
        sinks.write_all(report, config.reports, {k: getattr(args, k) for k in ("json", "junit", "sarif", "html")})
        sys.stdout.write(sinks.to_json(report) if args.format == "json" else sinks.to_terminal(report))
        return int(report["status"] == "failed")
    if args.command == "inspect":
        print(json.dumps(api.inspect(session(), args.source), indent=2))
    elif args.command == "rules":
        for r in REGISTRY.values():
            print(f"{r.id:36} {r.severity:8} {r.title}{'' if r.enabled else ' (only if configured)'}")
    elif args.command == "explain":
        r = REGISTRY.get(args.rule)
        if r is None:
            raise ConfigError(f"unknown rule: {args.rule}")
        print(f"{r.id} {r.version} ({r.severity}, {r.scope}, {r.cost})\n{r.title}\n{r.impact}\n{r.remedy}\n{r.limits}\noptions: {json.dumps(r.defaults)}")
    elif args.command == "demo":
        print(write_demo(args.folder, args.corrupt))
    elif args.command == "init":
        at = Path(args.folder) / configs.NAME
        if at.exists():
            raise ConfigError(f"{at} is there already")
        print(sinks.write_text(at, configs.DEFAULT))
    elif args.command == "doctor":
        found = doctor()
        for d in found:
            print(f"{'ok ' if d['ok'] else 'BAD'} {d['name']}: {d['detail']}")
        return int(not all(d["ok"] for d in found))
    elif args.command == "compare":
        config = configs.load(args.config)
        c = api.compare(session() if not (args.before.endswith(".json") and args.after.endswith(".json")) else None, args.before, args.after, config.fail_on)
        sys.stdout.write(json.dumps(c, indent=2) + "\n" if args.format == "json" else sinks.comparison_text(c))
        return int(c["status"] == "regressed")
    elif args.command == "baseline":
        ends = datetime.date.fromisoformat(args.expires) if args.expires else None
        print(sinks.write_baseline(algebra.baseline_of(api.report_of(None, args.report), args.author, args.reason, ends), args.output))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except ConfigError as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 2
    except SourceError as e:
        print(f"source: {e}", file=sys.stderr)
        return 3
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001 - the code says that the fault is here
        print(f"fault: {type(e).__name__}: {e}", file=sys.stderr)
        return 4


if __name__ == "__main__":
    sys.exit(main())
