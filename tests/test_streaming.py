"""The kept-up stream equals the batch fold over all closed steps, over restarts and late rows."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import detect, steps
from tallyspark.sources.events import records
from tallyspark.plans import campaign
from tallyspark.streaming.monitor import failure_rate_monitor, idempotent_sink, mismatch_monitor, reward_monitor

DATA = "/root/testdata/sf0.001"


def test_monitor_equals_batch(spark, tmp_path):
    whole = records(spark, DATA)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(rows):
        """A batch arrives, and a new query goes on from the checkpoint."""
        rows.coalesce(1).write.mode("append").parquet(inbox)
        stream = failure_rate_monitor(spark.readStream.schema(whole.schema).parquet(inbox))
        stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).format("parquet").start(out).awaitTermination()

    arrive(whole.where("step < 7 or step = 7 and k < 50"))
    arrive(whole.where("step = 7 and k >= 50 or step between 8 and 12"))
    arrive(whole.where("step = 3 or step > 12"))
    got = {(r.source, r.pos): r for r in spark.read.parquet(out).collect()}
    want = {(r.source, r.pos): r.x for r in detect.failure_rate_stream(steps.step_observations(whole)).collect()}
    last = {s: max(p for t, p in want if t == s) for s in {s for s, _ in want}}
    assert set(got) == {(s, p) for s, p in want if p < last[s]}
    assert all(r.x == pytest.approx(want[at], rel=1e-9) for at, r in got.items())
    assert sum(max(r.late for (s, _), r in got.items() if s == t) for t in last) == whole.where(F.col("step") == 3).count()
    first = {r.source: r.pos for r in detect.first_crossing(detect.failure_rate_stream(steps.step_observations(whole)), ["run_id", "source"]).collect()}
    assert {s: p for (s, p), r in got.items() if r.alarm} == {s: p for s, p in first.items() if p < last[s]}


def test_reward_and_mismatch_monitors_equal_batch(spark, tmp_path):
    runs = campaign.runs(spark, [campaign.Scenario("drop", steps=60, change_at=40, pass_after=0.1, kl_after=3e-2)], 1)
    whole = campaign.units(runs).cache()
    batches = campaign.train_steps(runs).drop("source").cache()

    def arrive(rows, monitor, name):
        inbox, out = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
        rows.coalesce(1).write.mode("append").parquet(inbox)
        stream = monitor(spark.readStream.schema(rows.schema).parquet(inbox))
        stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-at")).trigger(availableNow=True).foreachBatch(idempotent_sink(out)).start().awaitTermination()
        return out

    arrive(whole.where("step < 33"), reward_monitor, "reward")
    out = arrive(whole.where("step >= 33 or step = 2"), reward_monitor, "reward")
    got = {r.pos: r for r in spark.read.parquet(out).collect()}
    want = {r.pos: r.x for r in detect.reward_stream(steps.step_observations(whole)).collect() if r.pos < 59}
    assert set(got) == set(want) and all(r.x == pytest.approx(want[p], rel=1e-6, abs=1e-9) for p, r in got.items())
    assert sum(r.alarm for r in got.values()) == 1 and max(r.late for r in got.values()) == 32
    arrive(batches.where("pos < 30"), mismatch_monitor, "mismatch")
    out = arrive(batches.where("pos >= 30 or pos = 4"), mismatch_monitor, "mismatch")
    rows = spark.read.parquet(out).collect()
    want = {r.pos: r.x for r in detect.mismatch_stream(batches).collect()}
    assert len(rows) == 60 and all(r.x == pytest.approx(want[r.pos], rel=1e-9) for r in rows)
    assert sum(r.alarm for r in rows) == 1 and max(r.late for r in rows) == 1
    idempotent_sink(out)(spark.read.parquet(f"{out}/batch=0"), 7)
    idempotent_sink(out)(spark.read.parquet(f"{out}/batch=0"), 7)
    assert spark.read.parquet(f"{out}/batch=7").count() == spark.read.parquet(f"{out}/batch=0").count()
