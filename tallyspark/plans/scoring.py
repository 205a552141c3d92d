"""Benchmark runs scored against what the monitor should do on each arm."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import detect, lookup
from ..operators.telemetry import finite

# The arms, and the names of the checks.
ARMS = ("grader_missing", "healthy", "loophole", "lr_spike", "null", "sandbox_masked", "sandbox_partly_typed", "sandbox_untyped", "sandbox_zeroed", "temperature", "top_p")
D1_HEALTHY, D1_ONSET = "D1 no alarm on healthy steps", "D1 no alarm before onset"
D2_ZEROED, D2_NEVER = "D2 poisoned at the first zeroed failure", "D2 never poisoned"
D3, D4 = "D3 failure rate raised", "D4 a reward alarm, if any, is attributed to configuration"
D5 = "D5 a reward alarm is attributed to the algorithm"
D6_ALARM, D6_VERDICT = "D6 no infra, poisoning or mismatch alarm", "D6 never a configuration verdict"
D7_RAISED, D7_NONE = "D7 mismatch raised after onset", "D7 no mismatch alarm"
LIMIT = "recorded limit: verdict is not configuration"


def scored(runs: DataFrame, records: DataFrame, alarms: DataFrame) -> DataFrame:
    """One row for each run (run_id, arm, onset): steps, alarms, delays by signal, checks (array of name, passed).

    records: run_id, unit_id, attempt, step, failure_kind, reward of all kinds, a fork's with its parent's up to the fork;
    alarms: detect.alarms' rows with the verdict of reward alarms. Only an alarm at or after the onset detects."""
    steps = lookup.last_by(records.select("run_id", "unit_id", "attempt", "step"), ["run_id", "unit_id"], "attempt").select("run_id", "unit_id", "step")
    late = F.col("step") >= F.coalesce("onset", F.lit(10**9))
    order = F.struct("at_ms", F.coalesce("source", F.lit("")))
    first = lambda s: F.min_by(F.struct("step", "unit_id", "verdict"), F.when(late & (F.col("signal") == s), order))
    signal = lambda *s: F.count_if(F.col("signal").isin(*s))
    found = alarms.join(steps, ["run_id", "unit_id"]).join(runs.select("run_id", "onset"), "run_id").groupBy("run_id").agg(
        F.count("*").alias("alarms"), F.count_if(~late).alias("early"), signal("failure_rate", "poisoned", "mismatch").alias("of_configuration"),
        *[first(s).alias(s) for s in detect.SIGNALS], F.array_sort(F.collect_list(F.struct("at_ms", "signal", "step"))).alias("listed"),
    )
    zeroed = records.where("failure_kind is not null and reward = 0").groupBy("run_id").agg(F.min_by("unit_id", F.struct("step", "unit_id")).alias("zeroed"))
    all_ = records.groupBy("run_id").agg(F.countDistinct("step").alias("steps"))
    r = runs.join(all_, "run_id", "left").join(found, "run_id", "left").join(zeroed, "run_id", "left")
    verdict, arm, none = F.col("reward.verdict"), F.col("arm"), lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    not_configuration = F.coalesce(verdict != "configuration", F.lit(True))

    def check(arms: tuple[str, ...], name: str, passed: Column) -> Column:
        return F.when(arm.isin(*arms), F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed")))

    healthy, sampled, typed = ("healthy", "null"), ("top_p", "temperature"), ("sandbox_masked", "grader_missing")
    attributed = verdict.isNull() | (verdict == "configuration")
    checks = [
        check(healthy, D1_HEALTHY, none("alarms")),
        check(tuple(a for a in ARMS if a not in healthy), D1_ONSET, none("early")),
        check(("sandbox_zeroed",), D2_ZEROED, F.col("poisoned.unit_id") == F.col("zeroed")),
        check(typed, D2_NEVER, F.col("poisoned").isNull()),
        check(("sandbox_zeroed", "sandbox_partly_typed", *typed), D3, F.col("failure_rate").isNotNull()),
        check(sampled, D7_RAISED, F.col("mismatch").isNotNull()),
        check(("sandbox_partly_typed", *sampled), D4, attributed),
        check(("sandbox_untyped",), LIMIT, not_configuration),
        check(("lr_spike",), D5, verdict == "algorithm"),
        check(("lr_spike",), D7_NONE, F.col("mismatch").isNull()),
        check(("loophole",), D6_ALARM, none("of_configuration")),
        check(("loophole",), D6_VERDICT, not_configuration),
    ]
    delays = [(F.col(f"{s}.step") - F.col("onset")).alias(f"{s}_delay") for s in detect.SIGNALS]
    return r.select("run_id", "arm", "steps", *delays, F.transform("listed", lambda x: F.concat_ws("@", x["signal"], x["step"].cast("string"))).alias("alarms"), F.filter(F.array(*checks), lambda x: x.isNotNull()).alias("checks"))


def rendered(results: DataFrame) -> Iterator[str]:
    """The table of scored() runs in Markdown, row by row."""
    # The report's columns.
    yield "| run | arm | steps | alarms (signal@step) | checks passed | failed checks |"
    yield "|---|---|---|---|---|---|"
    for r in results.orderBy("run_id").toLocalIterator():
        failed = "; ".join(c["name"] for c in r.checks if not c["passed"])
        yield f"| {r.run_id} | {r.arm} | {r.steps} | {' '.join(r.alarms or []) or '-'} | {sum(c['passed'] for c in r.checks)}/{len(r.checks)} | {failed or '-'} |"


def post_run_problems(records: DataFrame, phases: DataFrame) -> DataFrame:
    """(run_id, step, problem) of finished runs.

    phases: run_id, first_step, last_step, onset (null: no failures to look for). Each step must be there with one
    finite mismatch, none before first_step; failures must start at the onset, and zeroed ones must follow."""
    cells = records.groupBy("run_id", "step").agg(F.count_if(F.col("failure_kind").isNotNull()).alias("failed"), F.count_if(F.col("failure_kind").isNotNull() & (F.col("reward") == 0)).alias("zeroed"), F.count("kl").alias("summaries"), F.count(finite(F.col("kl"))).alias("good"))
    wanted = phases.withColumn("step", F.explode(F.sequence(F.col("first_step").cast("long"), F.col("last_step").cast("long"))))
    t = wanted.select("run_id", "step", "onset").join(cells, ["run_id", "step"], "left")
    of_step = F.array_compact(F.array(F.when(F.col("failed").isNull(), "missing"), F.when((F.col("summaries") != 1) | (F.col("good") != 1), "not one finite mismatch"), F.when((F.col("step") < F.col("onset")) & (F.col("failed") > 0), "failures before the onset")))
    out = t.select("run_id", "step", F.explode(of_step).alias("problem"))
    early = cells.join(phases.select("run_id", "first_step"), "run_id").where("step < first_step").select("run_id", "step", F.lit("before the first step").alias("problem"))
    never = t.where("onset is not null").groupBy("run_id").agg(F.sum(F.when(F.col("step") >= F.col("onset"), F.col("zeroed"))).alias("z"), F.max("onset").alias("step")).where("coalesce(z, 0) = 0")
    return out.unionByName(early).unionByName(never.select("run_id", F.col("step").cast("long").alias("step"), F.lit("no zeroed failure from the onset").alias("problem")))


def judged_alarms(records: DataFrame, observations: DataFrame, batches: DataFrame, **kl: float) -> DataFrame:
    """detect.alarms' rows with the verdict of reward alarms."""
    crossed = detect.first_crossing(detect.reward_stream(observations), ["run_id", "source"]).drop("x")
    causes = detect.attributed(crossed, observations, detect.failure_rate_stream(observations), detect.with_probabilities(batches, **kl))
    causes = causes.select(F.col("run_id").alias("_run"), F.col("source").alias("_source"), "verdict")
    found = detect.alarms(records, observations, batches, **kl)
    return found.join(causes, (found.run_id == causes["_run"]) & found.source.eqNullSafe(causes["_source"]) & (found.signal == "reward"), "left").drop("_run", "_source")
