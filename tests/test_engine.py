"""Contracts, reports, comparisons, baselines, plugins and the command line."""

from __future__ import annotations

import datetime
import json
import math
import sys
from pathlib import Path
from xml.etree import ElementTree

import pytest

sys.path.insert(0, str(Path(__file__).parent / "recordings"))

import make  # noqa: E402

from kinespark import algebra, api, cli, config, engine, plugins, sinks  # noqa: E402
from kinespark.errors import ConfigError, SourceError  # noqa: E402
from kinespark.functions.series import last_before, numbered  # noqa: E402
from kinespark.sources import discover  # noqa: E402
from kinespark.sources.demo import write_demo  # noqa: E402
from kinespark.sources.discover import hub_folder  # noqa: E402

OFF = {"cache": {"enabled": False}}


@pytest.fixture(scope="module")
def reports(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("demo")
    return [api.check(spark, str(write_demo(at / f"d{bad}", bad)), config.from_mapping(dict(OFF))) for bad in (False, True)]


def test_contract_is_strict():
    for raw in ({"nonsense": 1}, {"fail_on": "never"}, {"rules": {"a.b": {"wrong": 1}}}, {"required_streams": ["a", "a"]}, {"rules": []}, {"config_version": 2}, [1]):
        with pytest.raises(ConfigError):
            config.from_mapping(raw)
    assert config.from_mapping({}).digest() == config.Config().digest()


@pytest.mark.parametrize("rules", [{"no.rule": {}}, {"temporal.max_gap": {"options": {"other": 1}}}, {"temporal.max_gap": {"options": {"max_findings": 0}}}, {"temporal.max_gap": {"options": {"max_gap_ms": "x"}}}, {"video.black_frames": {"options": {"stride": True}}}, {"numeric.configured_bounds": {"options": {"limits": []}}}])
def test_plan_refuses(spark, tmp_path, rules):
    rec = discover(spark, str(make.directory(tmp_path / "r", video=True)))
    with pytest.raises(ConfigError):
        engine.plan(rec, config.from_mapping({"rules": rules}))


def test_plan_of_rules(spark, tmp_path):
    rec = discover(spark, str(make.directory(tmp_path / "r")))
    usual = {p.rule.id: p for p in engine.plan(rec, config.Config())}
    assert "temporal.signal_alignment" not in usual and usual["video.decode"].reason and usual["temporal.observation_action_delay"].reason
    some = {p.rule.id: p for p in engine.plan(rec, config.from_mapping({"rules": {"temporal.max_gap": {"enabled": False}, "temporal.monotonic": {"severity": "critical"}, "temporal.signal_alignment": {}}}))}
    assert "temporal.max_gap" not in some and some["temporal.monotonic"].severity == "critical" and "temporal.signal_alignment" in some


def test_reports_agree_and_cap(spark, tmp_path):
    actions = [[math.nan, 1.0]] * 12
    root = make.directory(tmp_path / "r", actions=actions)
    settings = {**OFF, "rules": {"numeric.finite_values": {"options": {"max_findings": 2}}}}
    a, b = (api.check(spark, str(root), config.from_mapping(dict(settings))) for _ in range(2))
    prints = lambda r: [f["fingerprint"] for x in r["results"] for f in x["findings"]]
    assert prints(a) == prints(b) and len(set(prints(a))) == len(prints(a))
    (capped,) = [x for x in a["results"] if x["rule_id"] == "numeric.finite_values"]
    assert capped["findings_capped"] and len(capped["findings"]) == 2
    json.loads(sinks.to_json(a))


def test_fingerprint_tells_streams_and_values_apart():
    place = {"episode": "e", "stream": "a", "sample_index": 1}
    base = engine.fingerprint("r.x", place, {"v": 1.0}, "e")
    assert base == engine.fingerprint("r.x", {**place, "source": "f", "timestamp": 2.0}, {"v": 1.0}, "e")
    for other in (engine.fingerprint("r.x", {**place, "stream": "b"}, {"v": 1.0}, "e"), engine.fingerprint("r.x", place, {"v": 2.0}, "e"), engine.fingerprint("r.x", place, {"v": 1.0}, "f")):
        assert other != base


def test_findings_as_a_frame(spark, tmp_path):
    rec = discover(spark, str(make.directory(tmp_path / "r", actions=[[math.nan, 1.0]] * 12)))
    (p,) = [p for p in engine.plan(rec, config.Config()) if p.rule.id == "numeric.finite_values"]
    frame = engine.findings_frame(p, p.rule.build(rec, p.options))
    assert frame.schema.simpleString() == spark.createDataFrame([], engine.FINDINGS).schema.simpleString()
    assert frame.count() == 12 and json.loads(frame.first().observed) == {"value": {"non_finite_dimensions": [0]}}
    rec.close()


def test_comparison(reports):
    clean, bad = reports
    assert clean["status"] == "passed" and bad["status"] == "failed"
    assert algebra.compare(clean, clean)["status"] == "unchanged"
    worse = algebra.compare(clean, bad)
    assert worse["status"] == "regressed" and {f["rule_id"] for f in worse["new_findings"]} == {"numeric.finite_values"} and worse["rule_changes"]
    assert algebra.compare(bad, clean)["status"] == "improved"
    other = {**clean, "coverage": {**clean["coverage"], "frames": 9, "tasks": {"new": 1}}}
    changed = algebra.compare(clean, other)
    assert changed["status"] == "changed" and changed["coverage"]["added_tasks"] == ["new"] and changed["coverage"]["removed_tasks"] == ["demo"]


def test_baseline(reports, tmp_path):
    _, bad = reports
    day = datetime.date(2026, 8, 30)
    base = algebra.baseline_of(bad, "me", "known", today=day)
    at = sinks.write_baseline(base, tmp_path / "b.yaml")
    covered = algebra.apply_baseline(bad, algebra.read_baseline(at), today=day)
    assert covered["status"] == "passed" and covered["summary"]["findings"] == 0 and len(covered["suppressed"]) == 1
    ended = algebra.baseline_of(bad, "me", "known", expires_at=datetime.date(2026, 1, 1), today=day)
    still = algebra.apply_baseline(bad, ended, today=day)
    assert still["status"] == "failed" and not still["suppressed"]
    with pytest.raises(ConfigError):
        algebra.baseline_of(bad, " ", "x")
    (tmp_path / "bad.yaml").write_text("suppressions: [{fingerprint: a}]")
    with pytest.raises(ConfigError):
        algebra.read_baseline(tmp_path / "bad.yaml")


def test_sinks(reports, tmp_path):
    _, bad = reports
    out = sinks.write_all(bad, config.ReportSettings(junit=True, sarif=True, output_dir=str(tmp_path / "out")), {"html": str(tmp_path / "x/report.html")})
    assert set(out) == {"json", "junit", "sarif", "html"} and out["html"].name == "report.html"
    suite = ElementTree.parse(out["junit"]).getroot()
    assert suite.get("failures") == "1" and len(suite) == len(bad["results"])
    sarif = json.loads(out["sarif"].read_text())["runs"][0]
    assert sarif["results"][0]["level"] == "error" and sarif["results"][0]["partialFingerprints"] and sarif["invocations"][0]["exitCode"] == 1
    assert "numeric.finite_values" in out["html"].read_text() and "FAILED" in sinks.to_terminal(bad)


PLUGIN = '''
from pyspark.sql import functions as F
from kinespark.rules import Found, Rule


def build(rec, o):
    """Episodes that begin with many rows near zero."""
    still = F.forall("v", lambda x: F.abs(x) <= float(o["idle_abs_tolerance"]))
    per = rec.vectors("action").groupBy("pos", "episode").agg(F.coalesce(F.min(F.when(~still, F.col("row_pos"))), F.count(F.lit(1))).alias("n"))
    bad = per.where(F.col("n") >= int(o["max_idle_samples"]))
    return Found(bad.select("pos", "episode", F.lit("starts idle").alias("message"), F.col("n").alias("observed")))


Idle = Rule("example.idle_prefix", "No idle start", "warning", "episode", "linear", build, {"max_idle_samples": 3, "idle_abs_tolerance": 0.01, "max_findings": 50})
Clash = Rule("temporal.max_gap", "x", "warning", "episode", "linear", build)
'''


def test_plugins(spark, tmp_path):
    at = tmp_path / "idle.py"
    at.write_text(PLUGIN)
    root = make.directory(tmp_path / "r", actions=[[0.0, 0.0]] * 4 + [[1.0, 1.0]] * 8)
    settings = config.from_mapping({**OFF, "plugins": [f"{at}:Idle"], "rules": {"example.idle_prefix": {"options": {"max_idle_samples": 4}}}})
    report = api.check(spark, str(root), settings)
    assert [f["observed"] for r in report["results"] if r["rule_id"] == "example.idle_prefix" for f in r["findings"]] == [4] and report["plugins"] == ["example.idle_prefix"]
    assert api.check(spark, str(root), config.from_mapping({**OFF, "plugins": [f"{at}:Idle"]}), config_plugins=False)["ignored_config_plugins"] == [f"{at}:Idle"]
    for spec in (f"{at}:Clash", f"{at}:Nothing", "no.module:X", "plain", f"{at}:build"):
        with pytest.raises(ConfigError):
            plugins.load([spec])


def test_results_on_video_are_kept(spark, tmp_path):
    root = make.directory(tmp_path / "r")
    settings = lambda: config.from_mapping({"cache": {"directory": str(tmp_path / "cache")}, "rules": {"temporal.signal_alignment": {"options": {"min_episodes": 2}}}})
    first, second = (api.check(spark, str(root), settings())["cache"] for _ in range(2))
    assert (first["hits"], first["misses"]) == (0, 1) and (second["hits"], second["misses"]) == (1, 0)


def test_command_line(spark, reports, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["demo", str(tmp_path / "d"), "--corrupt"]) == 0
    assert cli.main(["check", str(tmp_path / "d"), "--json", str(tmp_path / "r.json")]) == 1
    assert cli.main(["baseline", str(tmp_path / "r.json"), str(tmp_path / "b.yaml"), "--author", "me", "--reason", "known"]) == 0
    assert cli.main(["check", str(tmp_path / "d"), "--baseline", str(tmp_path / "b.yaml")]) == 0
    assert cli.main(["compare", str(tmp_path / "r.json"), str(tmp_path / "r.json")]) == 0
    assert cli.main(["inspect", str(tmp_path / "d")]) == 0
    assert cli.main(["rules"]) == cli.main(["doctor"]) == cli.main(["explain", "temporal.max_gap"]) == cli.main(["init", str(tmp_path)]) == 0
    assert cli.main(["init", str(tmp_path)]) == cli.main(["explain", "no.rule"]) == 2
    assert cli.main(["check", str(tmp_path / "nowhere")]) == 3
    assert "49" not in capsys.readouterr().err


def test_hub_sources_come_from_the_cache(tmp_path):
    commit = "0123456789abcdef0123456789abcdef01234567"
    folder = tmp_path / "datasets--me--x" / "snapshots" / commit
    folder.mkdir(parents=True)
    (tmp_path / "datasets--me--x/refs").mkdir()
    (tmp_path / "datasets--me--x/refs/main").write_text(commit)
    assert hub_folder("hf://datasets/me/x@main", str(tmp_path)) == hub_folder(f"hf://datasets/me/x@{commit}", str(tmp_path)) == str(folder)
    for bad in ("hf://datasets/me/x", "hf://datasets/me/x@other", "hf://models/me/x@main"):
        with pytest.raises(SourceError):
            hub_folder(bad, str(tmp_path))


def test_positions_over_many_parts(spark):
    rows = [(i * 37 % 1000, None if i % 5 else i) for i in range(1000)]
    df = numbered(spark.createDataFrame(rows, "k long, v long"), "k")
    out = last_before(df, "v", "pos", "before").orderBy("pos").collect()
    last = None
    for i, r in enumerate(out):
        assert (r.pos, r.k, r.before) == (i, i, last)
        last = r.v if r.v is not None else last
