"""Synthetic runs with a planted change, and how late the monitor finds it.

All runs of all scenarios and seeds are one table, keyed by run_id, and go through the streams in one plan. Draws are
hashes of seed, step and rollout, so SQL gives the same runs; scenarios of one seed share their draws."""

from __future__ import annotations

import math
from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import outcome as O
from ..operators import detect, evaluate, steps
from ..operators.faults import draw

GROUPS, ROLLOUTS = 8, 4
PASS_RATE, GAIN, SPREAD = 0.5, 0.1, 0.25
HEALTHY_KL, KL_SPREAD, RATIO_ERROR = 4e-4, 0.2, 2e-3


@dataclass(frozen=True)
class Scenario:
    """A run of so many steps that changes at one of them: the pass rate, the share of rollouts that fail and of typed
    ones among these, what a typed failure is and gets, the mismatch; or a prompt group that fails in every n-th healthy step."""

    scenario: str
    steps: int = 300
    change_at: int = 150
    pass_after: float | None = None
    infra_after: float = 0.0
    typed: float = 1.0
    burst_every: int = 0
    failure: str = "sandbox"
    action: str = "mask"
    kl_after: float = HEALTHY_KL
    ratio_after: float = 1.0


def runs(spark: SparkSession, scenarios: list[Scenario], seeds: int) -> DataFrame:
    """(run_id, seed, the scenario's fields): scenarios x seeds rows."""
    kinds = {"int": "long", "float": "double", "str": "string", "float | None": "double"}
    rows = spark.createDataFrame([astuple(s) for s in scenarios], ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(Scenario)))
    return rows.withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(seeds - 1).cast("long")))).withColumn("run_id", F.concat_ws("|", "scenario", F.col("seed").cast("string")))


def gauss(seed: Column, *parts: Column) -> Column:
    """A standard normal number from two draws."""
    u, v = draw(seed, F.lit("u"), *parts), draw(seed, F.lit("v"), *parts)
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)


def units(runs_: DataFrame) -> DataFrame:
    """Flat records of 8 prompts x 4 rollouts a step; rollouts of one prompt share its difficulty."""
    c, seed, step, number = F.col, F.col("seed"), F.col("step"), F.col("number")
    rows = runs_.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), c("steps") - 1))).repartition("run_id", "step")
    after = step >= c("change_at")
    base = F.when(after, F.coalesce("pass_after", F.lit(PASS_RATE))).otherwise(PASS_RATE) + GAIN * step / c("steps")
    burst = F.when((c("burst_every") > 0) & ~after & (step % F.nullif(c("burst_every"), F.lit(0)) == 0), F.floor(draw(seed, F.lit("b"), step) * GROUPS))
    rows = rows.withColumns({"after": after, "base": base, "burst": burst}).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GROUPS - 1).cast("long"))))
    rows = rows.withColumn("difficulty", F.least(F.greatest(c("base") + SPREAD * gauss(seed, step, c("g")), F.lit(0.0)), F.lit(1.0)))
    rows = rows.withColumn("own", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ROLLOUTS - 1).cast("long")))).withColumn("number", step * GROUPS * ROLLOUTS + c("g") * ROLLOUTS + c("own"))
    hit = c("after") & (draw(seed, F.lit("f"), number) < c("infra_after"))
    rows = rows.withColumn("burst", F.coalesce(c("burst") == c("g"), F.lit(False))).withColumn("hit", hit | c("burst"))
    rows = rows.withColumn("is_typed", c("burst") | (c("hit") & (draw(seed, F.lit("t"), number) < c("typed"))))
    kind = F.when(c("is_typed"), F.when(c("burst"), "sandbox").otherwise(c("failure")))
    action = F.when(c("is_typed"), F.when(c("burst"), "mask").otherwise(c("action"))).otherwise("score")
    passed = F.when(draw(seed, F.lit("p"), number) < c("difficulty"), 1.0).otherwise(0.0)
    reward = F.when(c("is_typed"), F.when(action == "zero", 0.0)).when(c("hit"), 0.0).otherwise(passed)
    return rows.select(
        "run_id", F.format_string("u-%06d", number).alias("unit_id"), F.lit(1).alias("attempt"), F.lit("trajectory").alias("kind"), c("run_id").alias("source"), (number * 1000).alias("started_at_ms"),
        "step", F.concat(F.lit("g"), c("g").cast("string")).alias("grp"), kind.alias("failure_kind"), O.failure_class(kind).alias("failure_class"), action.alias("action"), reward.alias("reward"),
    )


def train_steps(runs_: DataFrame) -> DataFrame:
    """One mismatch summary a step, as detect.mismatch_stream and detect.alarms take them."""
    c, seed, step = F.col, F.col("seed"), F.col("pos")
    rows = runs_.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), c("steps") - 1)))
    after = step >= c("change_at")
    kl = F.when(after, c("kl_after")).otherwise(HEALTHY_KL) * F.pow(F.lit(10.0), KL_SPREAD * gauss(seed, F.lit("k"), step))
    ratio = F.when(after, c("ratio_after")).otherwise(1.0) + RATIO_ERROR * gauss(seed, F.lit("r"), step)
    at = step * GROUPS * ROLLOUTS * 1000 + 500
    return rows.select("run_id", F.lit(None).cast("string").alias("source"), "pos", F.format_string("t-%06d", step).alias("unit_id"), at.alias("at_ms"), kl.alias("kl"), ratio.alias("ratio_mean"), F.lit(RATIO_ERROR).alias("ratio_se"))


def delays(runs_: DataFrame, crossed: DataFrame) -> DataFrame:
    """(scenario, delay): steps from each run's change to its first crossing (run_id, pos); null where there is none."""
    return runs_.join(crossed.select("run_id", "pos"), "run_id", "left").select("scenario", (F.col("pos") - F.col("change_at")).alias("delay"))


def delay_table(spark: SparkSession, failing: list[Scenario], rewards: list[Scenario], mismatched: list[Scenario], seeds: int) -> DataFrame:
    """(signal, scenario, total, missed, median, p90) of the signal that each list of scenarios is meant for."""
    def found(signal, scenarios, stream, keys):
        runs_ = runs(spark, scenarios, seeds)
        return delays(runs_, detect.first_crossing(stream(runs_), keys)).withColumn("signal", F.lit(signal))

    key = ["run_id", "source"]
    all_ = found("failure_rate", failing, lambda r: detect.failure_rate_stream(steps.step_observations(units(r))), key)
    all_ = all_.unionByName(found("reward", rewards, lambda r: detect.reward_stream(steps.step_observations(units(r))), key))
    all_ = all_.unionByName(found("mismatch", mismatched, lambda r: detect.mismatch_stream(train_steps(r)), ["run_id"]))
    return evaluate.delay_summary(all_, "signal", "scenario")


def verdict_table(spark: SparkSession, rewards: list[Scenario], seeds: int) -> DataFrame:
    """(scenario, verdict, n): what reward alarms are attributed to, without a mismatch history."""
    runs_ = runs(spark, rewards, seeds)
    seen = steps.step_observations(units(runs_))
    crossed = detect.first_crossing(detect.reward_stream(seen), ["run_id", "source"]).drop("x")
    none = spark.createDataFrame([], "run_id string, at_ms long, pos long, probability double")
    found = detect.attributed(crossed, seen, detect.failure_rate_stream(seen), none)
    return evaluate.verdict_counts(found.join(runs_.select("run_id", "scenario"), "run_id"), "scenario")


def false_alarm_table(spark: SparkSession, healthy: list[Scenario], seeds: int, *, mismatch: bool) -> DataFrame:
    """(scenario, failure_rate, mismatch, poisoned, reward): alarms on runs without a change, over units or, with mismatch, train steps."""
    runs_ = runs(spark, healthy, seeds)
    some = units(runs_), train_steps(runs_)
    records, batches = (some[0].limit(0), some[1]) if mismatch else (some[0], some[1].limit(0))
    found = detect.alarms(records, steps.step_observations(records), batches).select("run_id", "signal")
    return evaluate.counts_by(runs_.select("run_id", "scenario").join(found, "run_id", "left"), "scenario", "signal", list(detect.SIGNALS))


#: The published campaign: 50 seeds each.
FAILING = [Scenario(f"failure rate {x:.2f}", infra_after=x) for x in (0.05, 0.1, 0.2, 0.3, 0.5, 1.0)]
REWARDS = [
    Scenario("50% failures, 70% untyped", infra_after=0.5, typed=0.3),
    Scenario("30% failures, 70% untyped", infra_after=0.3, typed=0.3),
    Scenario("50% failures, all untyped", infra_after=0.5, typed=0.0),
    Scenario("pass rate 0.5 to 0.2", pass_after=0.2),
    Scenario("pass rate 0.5 to 0.35", pass_after=0.35),
]
MISMATCHED = [Scenario(f"kl 4e-4 to {x:g}", steps=100, change_at=50, kl_after=x) for x in (5e-3, 1e-2, 3e-2, 1e-1)] + [Scenario(f"ratio 1 to {x:g}", steps=100, change_at=50, ratio_after=x) for x in (0.995, 0.99, 0.97)]
HEALTHY = [Scenario("healthy", steps=1000, change_at=10**9), Scenario("a group fails every 4th step", steps=1000, change_at=10**9, burst_every=4)]
