"""The command line on hand-made run directories, and records inside trajectories."""

import json

import pytest
from pyspark.errors import PySparkException
from test_runs import GOOD, changed

from tallyspark import cli
from tallyspark.sources import runs, trajectories

OK = {"failure": None, "outcome": "ok", "reward": 1.0, "decision": {"action": "score", "attempt": 1, "reason": "x"}}


def directory(path, docs, markers=()):
    (path / "records").mkdir()
    for d in docs:
        (path / "records" / f"{d['unit_id']}--{d['attempt']}.json").write_text(json.dumps(d))
    if markers:
        (path / "started").mkdir()
        for name in markers:
            (path / "started" / name).write_text("86400000")
    return str(path)


def test_show(spark, tmp_path, capsys):
    at = directory(tmp_path, [GOOD, GOOD | OK | {"unit_id": "u2"}], ["u1--1", "u9--2"])
    assert cli.main(["show", at], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert [x.split() for x in lines[:3]] == [list(cli.SHOW), "u1 1 trajectory failed infra sandbox tool - mask 0.0 gpu-min".split(), "u2 1 trajectory ok - - - - score 0.0 gpu-min".split()]
    assert lines[3:] == ["failures: 1 of 2 units; infra 1, agent 0, grader 0, timeout 0; gpu-hours lost 0.00", "evidence u1/1: a", "started, no record: u9 attempt 2 at 1970-01-02T00:00:00Z; the process died before the unit finished"]
    assert cli.main(["show", at, "--failures-only"], spark) == 0
    assert "u2" not in capsys.readouterr().out


def test_integrity(spark, tmp_path, capsys):
    healthy = [GOOD | OK | {"unit_id": f"u{k}", "started_at_ms": k, "tags": [["step", str(k // 4)]]} for k in range(8)]
    (tmp_path / "a").mkdir()
    assert cli.main(["integrity", directory(tmp_path / "a", healthy)], spark) == 0
    assert capsys.readouterr().out.splitlines()[1:] == ["-       0       u0          8      1.000       1.000                0.000             0.000             0.000              0", "no alarms at P >= 0.999"]
    (tmp_path / "b").mkdir()
    mism = {"kl": 0.1, "kl_standard_error": 0.01, "ratio_mean": 0.9, "ratio_standard_error": 0.001, "sequences": 8, "tokens": 80}
    broken = [d | {"failure": GOOD["failure"], "outcome": "failed", "reward": 0.0, "decision": {"action": "zero", "attempt": 1, "reason": "x"}} for d in healthy] + [GOOD | OK | {"unit_id": "s1", "kind": "train_step", "reward": None, "started_at_ms": 100, "mismatch": mism, "tags": []}]
    assert cli.main(["integrity", directory(tmp_path / "b", broken), "--batching", "units"], spark) == 1
    assert [x.split()[:3] for x in capsys.readouterr().out.splitlines()[3:]] == [["poisoned", "-", "u0"], ["failure_rate", "-", "u7"], ["mismatch", "-", "s1"]]


def test_export_and_errors(spark, tmp_path, capsys):
    at = directory(tmp_path, [GOOD])
    for form in ("parquet", "otlp"):
        out = str(tmp_path / form)
        assert cli.main(["export", form, at, "--output", out], spark) == 0
        assert cli.main(["export", form, at, "--output", out], spark) == 2
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 1
    assert cli.main(["show", str(tmp_path / "none")], spark) == 2
    (tmp_path / "records" / "bad--1.json").write_text("{}")
    assert cli.main(["integrity", at], spark) == 2
    assert "bad--1.json" in capsys.readouterr().err


def test_records_in_trajectories(spark, tmp_path):
    docs = [GOOD, GOOD | OK | {"unit_id": "u2", "tags": [["b", "1"], ["a", "2"]]}]
    records = runs.scan_run(spark, directory(tmp_path, docs))
    plain, more = {"schema_version": "ATIF-v1.4", "steps": [{"n": 1}]}, {"extra": {"other": [1, None]}}
    given = spark.createDataFrame([("u1", 1, json.dumps(plain)), ("u2", 1, json.dumps(plain | more)), ("u3", 1, json.dumps(plain))], "unit_id string, attempt int, document string")
    got = {r.unit_id: json.loads(r.document) for r in trajectories.annotate(given, records, ["unit_id", "attempt"], "outcome").collect()}
    want = {d["unit_id"]: d | {"tags": sorted(d["tags"])} for d in docs}
    assert got == {"u1": plain | {"extra": {"outcome": want["u1"]}}, "u2": plain | {"extra": more["extra"] | {"outcome": want["u2"]}}}
    again = spark.createDataFrame([(k, json.dumps(v)) for k, v in got.items()], "file_name string, document string")
    assert {tuple(r) for r in trajectories.annotated_records(again, "outcome").select("unit_id", "reward").collect()} == {("u1", None), ("u2", 1.0)}
    for bad in (plain | {"extra": {"outcome": 1}}, plain | {"steps": []}, plain | {"schema_version": 1}, plain | {"extra": 3}):
        df = spark.createDataFrame([("u1", 1, json.dumps(bad))], given.schema)
        with pytest.raises(PySparkException, match="not annotated"):
            trajectories.annotate(df, records, ["unit_id", "attempt"], "outcome").collect()


def test_filters_stay_above_the_parse(spark):
    records = spark.createDataFrame([("a.json", json.dumps({"extra": {"outcome": GOOD}, "schema_version": "ATIF-v1.4", "steps": [1]}), 3), ("b.json", "{}", 4)], "file_name string, document string, n int")
    found = trajectories.annotated_records(records, "outcome", keep_bad=True, keep=("n",)).where("unit_id = 'u1' and attempt = 1")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(StructField(attempt") == 1
    assert [(r.file_name, r.unit_id, r.n) for r in found.collect()] == [("a.json", "u1", 3)]
    with pytest.raises(PySparkException, match="b.json: schema_version"):
        trajectories.annotated_records(records, "outcome").where("unit_id = 'u1'").collect()


def test_append(spark, tmp_path):
    records = runs.scan_run(spark, directory(tmp_path, [GOOD]))
    out = str(tmp_path / "more")
    trajectories.append_records(records, out, records.limit(0))
    assert json.loads(spark.read.text(out).first().value) == GOOD
    with pytest.raises(FileExistsError, match="u1 attempt 1"):
        trajectories.append_records(records, out, records)
    with pytest.raises(FileExistsError, match="twice"):
        trajectories.append_records(records.union(records), out, records.limit(0))


def test_version_prefix(spark):
    d = spark.createDataFrame([(json.dumps({"schema_version": v, "steps": [1]}),) for v in ("ATIF-v1.4", "ATIF-v10", "ATIF-v1")], "document string")
    assert [r[0] for r in d.select(trajectories.trajectory_problem(d.document)).collect()] == [None, "schema_version", "schema_version"]


def test_step_tag_that_is_no_integer(spark, tmp_path, capsys):
    at = directory(tmp_path, [changed("tags", [["step", "x"]])])
    for _ in range(3):
        assert cli.main(["integrity", at], spark) == 2
        assert capsys.readouterr().err.strip() == "step is no integer in u1"
