"""Error signatures, fault schedules and registries against hand fixtures."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import signatures as S
from tallyspark.functions import traces
from tallyspark.operators import faults, lookup

CHAIN = "chain array<struct<hierarchy: array<struct<module: string, name: string>>, type_name: string, message: string>>"


def error(message, *classes):
    return ([c if isinstance(c, tuple) else ("m", c) for c in classes], classes[0][1] if isinstance(classes[0], tuple) else classes[0], message)


@pytest.mark.parametrize(
    "chain, kind, named",
    [
        ([error("x", ("ray.exceptions", "OutOfMemoryError"), "RayError")], "oom_host", "OutOfMemoryError"),
        ([error("x", ("torch", "OutOfMemoryError"), "RuntimeError")], "oom_gpu", "OutOfMemoryError"),
        ([error("CUDA out of memory", "RuntimeError")], "oom_gpu", "RuntimeError"),
        ([error("CUDA out of memory", "ValueError")], "agent_exception", "ValueError"),
        ([error("no KV cache left", "ValueError")], "oom_kv_cache", "ValueError"),
        ([error("x", "Sub", "ConnectTimeout", "TimeoutError")], "network", "Sub"),
        ([error("x", "Wrapper", "Exception"), error("x", "ReadTimeout", "ConnectionError")], "wall_clock", "ReadTimeout"),
        ([error("x", "ToolError"), error("x", "MemoryError")], "malformed_action", "ToolError"),
        ([error("x", "E")] * 8 + [error("x", "MemoryError")], "agent_exception", "E"),
        ([error(None, "E")], "agent_exception", "E"),
        ([(None, None, None)], "agent_exception", ""),
        ([], None, None),
        (None, None, None),
    ],
)
def test_chain(spark, chain, kind, named):
    f = spark.createDataFrame([(chain,)], CHAIN).select(S.classify_chain(F.col("chain"), F.lit("rollout")).alias("f")).first().f
    assert (f and f.kind, f and f.exception_type) == (kind, named)


def test_failure_of_a_name(spark):
    data = [("E", "one\u2028two", 503), ("E", "y" * 300, None), ("TaskError", None, 500), ("E", "", 404)]
    got = spark.createDataFrame(data, "t string, m string, s int").select(S.at_grade_stage(S.classify_name(F.col("t"), F.col("m"), F.lit("rollout"), F.col("s"))).alias("f")).collect()
    a, b, c, d = (r.f for r in got)
    assert (a.kind, a.stage, a.retryable, a.message, a.evidence) == ("engine_crash", "rollout", True, "engine_crash: E: one", ["exception_type=E", "message=one", "status_code=503"])
    assert b.evidence == ["exception_type=E", "message=" + "y" * 200]
    assert (c.kind, c.stage, c.message) == ("grader_exception", "grade", "grader_exception: TaskError: ")
    assert (d.kind, d.retryable) == ("agent_exception", False)


@pytest.mark.parametrize("kind, reward, want", [("trajectory", None, "missing_reward"), ("eval", 0.0, None), ("train_step", None, None)])
def test_missing_reward(spark, kind, reward, want):
    f = spark.createDataFrame([(None, kind, reward)], CHAIN + ", kind string, reward double").select(S.failure_of_unit(F.col("chain"), F.lit("rollout"), F.col("kind"), F.col("reward")).alias("f")).first().f
    assert (f and f.kind) == want


def test_schedules():
    assert faults.Schedule.from_settings({}) == faults.Schedule()
    assert faults.Schedule.from_settings({"FAULT": "lr_spike", "FAULT_START": "3", "FAULT_RATE": "8"}).rate == 8
    for bad in ({"FAULT": "x"}, {"FAULT": "top_p"}, {"FAULT": "sandbox_zeroed", "FAULT_START": "0", "FAULT_RATE": "2"}, {"FAULT": "sandbox_partly_typed", "FAULT_START": "0", "FAULT_RATE": "1", "FAULT_TYPED": "-1"}):
        with pytest.raises(ValueError):
            faults.Schedule.from_settings(bad)


@pytest.mark.parametrize(
    "fault, want",
    [
        ("grader_missing", ("grader_missing", "mask", "missing_reward", 0.0, None)),
        ("sandbox_masked", ("sandbox_typed", "mask", "sandbox", 0.0, None)),
        ("sandbox_zeroed", ("sandbox_typed", "zero", "sandbox", 0.0, 0.0)),
        ("sandbox_untyped", ("sandbox_untyped", "score", None, 0.0, 0.0)),
        ("temperature", ("healthy", "score", None, 1.0, 1.0)),
    ],
)
def test_fault_on_every_sample(spark, fault, want):
    rows = spark.createDataFrame([(s, "g", i, 1.0) for s in (0, 5) for i in range(2)], "step long, uid string, idx long, reward double")
    got = faults.inject(rows, faults.Schedule(fault, 5, 1.0), 1).select("step", "truth", "action", "failure_kind", "trainer_reward", "record_reward").collect()
    assert {tuple(r)[1:] for r in got if r.step == 5} == {want}
    assert {tuple(r)[1:] for r in got if r.step == 0} == {("healthy", "score", None, 1.0, 1.0)}


def test_registry(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,fault\na,x\nb,y\na,z\n")
    r = lookup.read_registry(spark, str(tmp_path / "r.csv"), "id", "id string, fault string")
    assert sorted(map(tuple, r.collect())) == [("a", "z"), ("b", "y")]
    rows = spark.createDataFrame([("a",), ("c",), (None,)], "id string")
    assert sorted(map(tuple, lookup.with_default(rows, r, "id", {"fault": F.lit("none")}).collect()), key=str) == [("a", "z"), ("c", "none"), (None, "none")]


@pytest.mark.parametrize("rewards, want", [([(0.5, 2.0), (1.0, 1.0)], 2.0), ([], None), (None, None), ([(None, 1.0)], None), ([(1.0, None), (1.0, 1.0)], None)])
def test_weighted_reward(spark, rewards, want):
    assert spark.createDataFrame([(rewards,)], "r array<struct<score:double,weight:double>>").select(traces.weighted_reward(F.col("r"))).first()[0] == want


def test_masked_output(spark):
    got = spark.createDataFrame([([1, 2], True), ([3], False)], "p array<long>, f boolean").select(traces.masked_output(F.col("p"), F.col("f"), F.lit("x")).alias("m")).collect()
    assert (got[0].m.prompt_ids, got[0].m.response_ids, got[0].m.metrics, got[0].m.extra_fields, got[1].m) == ([1, 2], [], {}, "x", None)
