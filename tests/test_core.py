"""Each query with SQL against DuckDB on the driver's smallest tables, and hand fixtures."""

import math
import os
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark import catalog, catalog_plans  # noqa: F401
from tallyspark.functions import likelihood as L
from tallyspark.functions import outcome as O
from tallyspark.plans import crossval, scoring
from tallyspark.operators import detect, faults, mismatch, runscore, steps, telemetry, windows

DATA = "/root/testdata/sf0.001"
RECORD = "run_id string, unit_id string, kind string, attempt int, source string, started_at_ms long, step long, grp string, failure_kind string, action string, reward double"


def rows(got):
    return sorted((tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in got), key=str)


def record(k, kind=None, action="score", reward=None, **more):
    return {"run_id": "r", "unit_id": f"u{k}", "kind": "trajectory", "attempt": 1, "source": "s", "started_at_ms": 1000 * k, "step": 0, "grp": None, "failure_kind": kind, "action": action, "reward": reward} | more


def frame(spark, data):
    return spark.createDataFrame(data, RECORD).withColumn("failure_class", O.failure_class(F.col("failure_kind")))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in "customer events embeddings lineitem".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(catalog.ORACLE[name])
    assert set(want.columns) == set(cols)
    assert rows(df.select(*cols).collect()) == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


def equals_sql(spark, name, path, events):
    """Whether a query and its SQL give the same rows over events (event_id, ts, user_id, event_type, value, props), a DuckDB query."""
    con = duckdb.connect()
    con.sql(f"copy ({events}) to '{path}/events.parquet'")
    con.sql(f"create view events as select * from '{path}/events.parquet'")
    df, want = catalog.QUERIES[name](spark, str(path)), con.sql(catalog.ORACLE[name])
    cols = sorted(df.columns)
    got = rows(df.select(*cols).collect())
    return got == rows(want.select(*[f'"{c}"' for c in cols]).fetchall()) and len(got) > 0


EVENTS = """select i event_id, timestamp '2024-01-15' + to_seconds(i % 100000) ts, i % 40 user_id, case when i % 3 = 0 then 'error' else 'view' end event_type, (i % 50)::double as value, '{"k": ' || i % 100 || '}' props from (select unnest(range(%d, %d)) i)"""


def test_benchmark_records_of_steps_beyond_five_digits(spark, tmp_path):
    assert equals_sql(spark, "M4_benchmark_records", tmp_path, EVENTS.replace("%d, %d", "4999900, 5000100"))
    sample = spark.createDataFrame([("r", 100000, "g", 7, "score", None, 1.0, 0, 1)], "run_id string, step long, uid string, idx long, action string, failure_kind string, record_reward double, started_at_ms long, ended_at_ms long")
    assert faults.benchmark_records(sample, source="s").first().unit_id == "s100000-0007"


def test_summed_profiles_are_those_of_all_members(spark):
    cells = spark.createDataFrame([(k, f, t, None if k == t == 1 else float(k * k + 3 * t)) for k in range(6) for f in "ab" for t in range(k % 3 + 1)], "run long, feature string, step long, value double")
    normals = spark.createDataFrame([(0, -1, k % 3, [p for p in (-1, 0, 1, 2) if p != k % 3], k, f"t{k % 2}", "b") for k in range(6)], "outer long, inner long, own long, others array<long>, run long, task string, batch string")
    members = normals.withColumn("part", F.explode("others")).drop("own", "others")
    means, spreads = runscore.grain_profiles(members.join(cells, "run"), *crossval.PART)
    key = [*crossval.PART, *runscore.GRAIN, "feature"]
    want = {tuple(r[k] for k in key): r for r in means.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("step", "mean"))).alias("means")).join(spreads, key).collect()}
    got = {tuple(r[k] for k in key): r for r in crossval.profiles(normals, cells).collect()}
    assert got.keys() == want.keys() and len(got) > 0
    for k, r in got.items():
        assert r.spread == pytest.approx(want[k].spread) and r.means == pytest.approx(want[k].means)


def test_window_of_six(spark):
    data = [record(0, reward=1.0), record(1, "agent_exception", "zero", 0.0), record(2, "sandbox", "mask"), record(3, "network", "zero", 0.0), record(4, "missing_reward", "mask"), record(5, "wall_clock", "zero", 0.0)]
    w = windows.source_windows(frame(spark, data)).first()
    assert (w.units, w.first_unit_id, w.avg_reward, w.poisoned_units) == (6, "u0", 0.25, 1)
    assert (w.avg_reward_no_infra, w.zero_reward_rate, w.infra_error_rate, w.grader_error_rate) == pytest.approx((1 / 3, 3 / 4, 2 / 6, 1 / 6))


@pytest.mark.parametrize("n, sizes", [(0, []), (1, [1]), (2, [2]), (3, [3]), (4, [3, 1])])
def test_window_sizes(spark, n, sizes):
    w = windows.source_windows(frame(spark, [record(k, reward=1.0) for k in range(n)]), window_units=3)
    assert [r.units for r in w.orderBy("index").collect()] == sizes


def test_cluster_variance(spark):
    rewards = [[1, 1, 0, 1], [0, 0, 1, 0], [1, 1, 1, 1]]
    o = steps.step_observations(frame(spark, [record(4 * g + k, reward=float(v), grp=f"g{g}") for g, vs in enumerate(rewards) for k, v in enumerate(vs)])).first()
    means = [sum(v) / 4 for v in rewards]
    m = sum(means) / 3
    assert (o.clean_mean, o.clean_variance) == pytest.approx((2 / 3, sum((x - m) ** 2 for x in means) / 2 / 3))
    assert (o.units, o.clusters) == (12, 3)


@pytest.mark.parametrize("failures, effect", [([1] * 8, 1.0), ([4] + [0] * 7, 4.0), ([0] * 8, 1.0)])
def test_design_effect(spark, failures, effect):
    data = [record(4 * g + k, "sandbox" if k < n else None, "mask" if k < n else "score", None if k < n else 1.0, grp=f"g{g}") for g, n in enumerate(failures) for k in range(4)]
    assert steps.step_observations(frame(spark, data)).select(steps.design_effect()).first()[0] == pytest.approx(effect)


def test_recursion_equals_enumerated_posterior(spark):
    llrs, hazard = [math.log(3) if k % 3 else -math.log(2) for k in range(30)], 0.02
    df = spark.createDataFrame([("r", k, x) for k, x in enumerate(llrs)], "run_id string, pos long, llr double")
    got = detect.folded(df, ["run_id"], hazard).orderBy("pos").collect()
    for n in (1, 7, 30):
        changed = sum(hazard * (1 - hazard) ** k * math.exp(sum(llrs[k:n])) for k in range(n))
        assert got[n - 1].x == pytest.approx(math.log(changed / (1 - hazard) ** n), rel=1e-9)


def test_recursion_of_a_long_stream(spark):
    """Drifts of tens of thousands up and down, in linear time, against the plain recursion."""
    import random
    import time

    rng = random.Random(4)
    llrs = [rng.gauss(-0.4 if k % 20_000 < 14_000 else 0.9, 1.5) for k in range(60_000)] + [900.0, -2000.0, 5.0]
    began = time.perf_counter()
    got = detect.folded(spark.createDataFrame([(None, k, x) for k, x in enumerate(llrs)], "source string, pos long, llr double"), ["source"]).orderBy("pos").collect()
    assert time.perf_counter() - began < 30
    x, h = -math.inf, math.log(L.HAZARD)
    for row, llr in zip(got, llrs, strict=True):
        x = max(x, h) + math.log1p(math.exp(-abs(x - h))) - math.log1p(-L.HAZARD) + llr
        assert row.x == pytest.approx(x, rel=1e-8, abs=1e-6)


def test_numbers_and_as_of_over_many_buckets(spark):
    data = [record(k, reward=1.0, source=("a", "", None)[k % 3], started_at_ms=(k * 7919) % 1000) for k in range(200)]
    got = {r.unit_id: r.number for r in windows.numbered(frame(spark, data), bucket=100).collect()}
    for s in ("a", "", None):
        own = sorted((d["started_at_ms"], d["unit_id"]) for d in data if d["source"] == s)
        assert [got[u] for _, u in own] == list(range(len(own)))
    history = [("r", (k * 37) % 500, k, float(k)) for k in range(40)] + [("q", 5, 0, None)]
    probes = [(run, t) for run in ("r", "q", "none", None) for t in range(-10, 600, 7)]
    found = detect.as_of(spark.createDataFrame(probes, "run_id string, at_ms long"), spark.createDataFrame(history, "run_id string, at_ms long, pos long, p double"), by="run_id", time="at_ms", value="p", tie="pos", bucket=60)
    for r in found.collect():
        own = sorted((t, k, p) for run, t, k, p in history if run == r.run_id)
        before = [p for t, _, p in own if t <= r.at_ms and p is not None]
        assert r.p == (None if not own else before[-1] if before else 0.0)
    assert found.count() == len(probes)


def test_mismatch_of_tokens_and_identical_log_probabilities(spark):
    d = spark.createDataFrame([([-1.0, -2.0], [-1.0, -2.0]), ([-1.0, -0.5], [-1.5, -0.25])], "t array<double>, r array<double>")
    same, other = [r[0] for r in d.select(mismatch.sequence_sums(F.col("t"), F.col("r"))).collect()]
    assert (same.tokens, same.k3, same.ratio) == (2, 0.0, 2.0)
    assert other.k3 == pytest.approx(math.exp(0.5) - 1 - 0.5 + math.exp(-0.25) - 1 + 0.25) and other.ratio == pytest.approx(math.exp(0.5) + math.exp(-0.25))
    for t, r in (([], []), ([-1.0], [-1.0, -2.0]), ([0.5], [-1.0]), ([float("nan")], [-1.0])):
        with pytest.raises(Exception, match="log probabilities"):
            spark.createDataFrame([(t, r)], d.schema).select(mismatch.sequence_sums(F.col("t"), F.col("r"))).collect()
    one = spark.createDataFrame([("b", 1.0, 0.5, 1.0)], "pos string, tokens double, k3 double, ratio double")
    assert mismatch.batch_summaries(one, "pos").count() == 0


def test_profile_scores_and_threshold(spark):
    normals = spark.createDataFrame([(f"n{k}", "f", s, float(s + 0.1 * k)) for k in range(3) for s in range(4)], "run string, feature string, step int, value double")
    means, spreads = runscore.profile(normals)
    assert {r.step: r["mean"] for r in means.collect()} == pytest.approx({s: s + 0.1 for s in range(4)})
    assert spreads.first().spread == pytest.approx(0.1)
    runs_ = spark.createDataFrame([("same", "f", s, s + 0.1) for s in range(4)] + [("off", "f", s, s + 1.1) for s in range(4)] + [("none", "g", 0, 1.0)], normals.schema)
    got = {r.run: r.score for r in runscore.scores(runscore.shift_factors(runs_, means, spreads)).collect()}
    factor = lambda total, n=4, t2=0.09: -0.5 * math.log1p(n * t2) + total**2 * t2 / (2 * (1 + n * t2))
    assert got == pytest.approx({"same": factor(0.0), "off": factor(40.0)})
    scored = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "score double")
    assert runscore.threshold(scored, 2.0).first()[0] == pytest.approx(4.0)


def test_clean_rewards_and_source_order(spark):
    data = [record(0, reward=1.0, source="b"), record(1, "sandbox", "zero", 0.0, source="b"), record(2, "agent_exception", "zero", 0.0, source="a"), record(3, "agent_exception", "retry", 0.5, source=None), record(4, "wall_clock", "zero", 0.0, source="a")]
    o = {r.source: r for r in steps.step_observations(frame(spark, data)).collect()}
    assert (o["b"].clean_count, o["b"].clean_mean, o["b"].failures) == (1, 1.0, 1)
    assert (o["a"].clean_count, o["a"].clean_mean, o["a"].failures) == (2, 0.0, 0)
    assert o[None].clean_count == 0 and o[None].clean_mean is None
    w = windows.source_windows(frame(spark, data)).orderBy(F.col("source").asc_nulls_last(), "index")
    assert [r.source for r in w.collect()] == ["a", "b", None]


def test_undetermined_verdict(spark):
    """A failure rate that is neither healthy nor broken five steps after the alarm leaves the cause open."""
    def obs(x):
        o = spark.createDataFrame([("r", "s", k, 100 * k) for k in range(8)], "run_id string, source string, step long, at_ms long")
        stream = o.select("run_id", "source", F.col("step").alias("pos"), F.lit(x).alias("x"))
        alarm = spark.createDataFrame([("r", "s", 1)], "run_id string, source string, pos long")
        none = spark.createDataFrame([], "run_id string, at_ms long, pos long, probability double")
        return detect.attributed(alarm, o, stream, none).first()

    assert [obs(x).verdict for x in (-3.0, 0.0, 2.0, 8.0)] == ["algorithm", "undetermined", "undetermined", "configuration"]
    assert obs(0.0).mismatch_probability is None and obs(0.0).at_ms == 600


def test_rendered_scores(spark):
    runs_ = spark.createDataFrame([("a", "healthy", None), ("b", "lr_spike", 2)], "run_id string, arm string, onset int")
    recs = spark.createDataFrame([(r, f"{r}{k}", 1, k, None, 1.0) for r in "ab" for k in range(4)], "run_id string, unit_id string, attempt int, step long, failure_kind string, reward double")
    alarms = spark.createDataFrame([("b", "reward", "s", "b3", 9, "algorithm"), ("b", "mismatch", None, "b1", 5, None)], "run_id string, signal string, source string, unit_id string, at_ms long, verdict string")
    got = scoring.scored(runs_, recs, alarms)
    assert list(scoring.rendered(got))[2:] == ["| a | healthy | 4 | - | 1/1 | - |", "| b | lr_spike | 4 | mismatch@1 reward@3 | 2/3 | D1 no alarm before onset |"]
    assert got.where("run_id = 'b'").first().reward_delay == 1


def test_texts_of_decisions_and_refusals(spark):
    d = spark.createDataFrame([("sandbox", 1), ("sandbox", 2), (None, 1), ("missing_reward", 1)], "kind string, attempt int")
    p = O.Policy(max_attempts=2)
    got = [tuple(r) for r in d.select(O.decide(F.col("kind"), F.col("attempt"), p), O.decision_reason(F.col("kind"), F.lit("tool"), F.col("attempt"), p)).collect()]
    assert got == [("retry", "sandbox is retryable; attempt 1 of 2"), ("mask", "infra failure sandbox at tool: on_infra=mask"), ("score", "unit succeeded"), ("mask", "grader failure missing_reward at tool: on_grader=mask")]
    with pytest.raises(Exception, match="between 1 and 1, got 2"):
        d.select(O.decide(F.col("kind"), F.col("attempt"))).collect()
    with pytest.raises(Exception, match="final attempts"):
        frame(spark, [record(1, "sandbox", "retry")]).select(*O.sample_fields()).collect()
    with pytest.raises(Exception, match="between 0 and"):
        spark.range(1).select(O.headroom_warning(F.lit(5), F.lit(4), F.lit(1))).collect()
    with pytest.raises(Exception, match="3 gpu entries but 2"):
        telemetry.peaks(spark.createDataFrame([(1, 5, [1, 2, 3])], "k int, host_rss_bytes long, gpu_used_bytes array<long>"), "k", devices=2).collect()


def test_prices_and_policy(spark):
    d = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in d.select(O.usd({"a": F.col("a"), "b": F.col("b")}, {"a": 0.5, "b": None})).collect()] == [0.5, None]
    with pytest.raises(ValueError):
        O.Policy(max_attempts=0)
