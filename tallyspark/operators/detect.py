"""Change detection streams over step observations, first crossings, and alarms.

Each stream is a window of lagged statistics (where it has any), a log-likelihood ratio for each step, and the change
recursion in closed form: window sums over a key's steps, linear in their number, no array and no row that grows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import likelihood as L
from ..functions import outcome as O
from .steps import design_effect

REFERENCE, LAG, SCALE = 20, 10, 200
SHIFT, FLOOR = 0.25, 0.05
HEALTHY_RATE, BROKEN_RATE = 0.02, 0.16


#: A key's steps are cut into runs in which the largest exponent grows by no more than this.
SPAN = 300.0


def folded(rows: DataFrame, keys: list[str], hazard: float = L.HAZARD) -> DataFrame:
    """rows (keys, pos, llr) with x, the log odds of a change after each position.

    The recursion x' = logaddexp(x, ln hazard) - ln(1 - hazard) + llr, from odds 0, is affine in the odds. With c the
    running sum of llr - ln(1 - hazard), the odds after n are hazard * exp(c_n) * sum over j <= n of exp(-c_(j-1)). That
    sum is taken relative to SPAN * k, where k follows the running maximum of its exponents, so nothing overflows; what
    an earlier k adds enters by the last sum before the cut, and what comes before that is under exp(-SPAN)."""
    order, past = W.partitionBy(*keys).orderBy("pos"), (W.unboundedPreceding, W.currentRow)
    one = F.col("llr") - math.log1p(-hazard)
    t = rows.select(*keys, F.col("pos").cast("long").alias("pos"), one.alias("_one")).withColumn("_c", F.sum("_one").over(order.rowsBetween(*past)))
    t = t.withColumn("_a", F.col("_one") - F.col("_c")).withColumn("_k", F.floor(F.max("_a").over(order.rowsBetween(*past)) / SPAN))
    within = W.partitionBy(*keys, "_k").orderBy("pos").rowsBetween(*past)
    t = t.withColumn("_s", F.sum(F.exp(F.col("_a") - SPAN * F.col("_k"))).over(within))
    before = F.lag("_k").over(order)
    t = t.withColumn("_carry", F.when(before < F.col("_k"), F.lag("_s").over(order) * F.exp(SPAN * (before - F.col("_k")))))
    total = F.col("_s") + F.coalesce(F.max("_carry").over(within), F.lit(0.0))
    return t.select(*keys, "pos", (math.log(hazard) + F.col("_c") + SPAN * F.col("_k") + F.ln(total)).alias("x"))


def first_crossing(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first position of each key whose log odds reach the alarm's."""
    return stream.where(F.col("x") >= L.ALARM_LOG_ODDS).groupBy(*keys).agg(F.min("pos").alias("pos"), F.min_by("x", "pos").alias("x"))


def failure_rate_stream(observations: DataFrame) -> DataFrame:
    llr = L.binomial(F.col("failures"), F.col("units"), HEALTHY_RATE, BROKEN_RATE) / design_effect()
    return folded(observations.select("run_id", "source", F.col("step").alias("pos"), llr.alias("llr")), ["run_id", "source"])


def reward_llrs(observations: DataFrame) -> DataFrame:
    """(run, source, pos, unit_id, at_ms, clean_mean, location, llr) of the informative steps with REFERENCE lagged ones or more."""
    by = W.partitionBy("run_id", "source").orderBy("step")
    near, far, diff = by.rowsBetween(-LAG - REFERENCE, -LAG - 1), by.rowsBetween(-LAG - SCALE, -LAG - 1), by.rowsBetween(-LAG - SCALE + 1, -LAG - 1)
    rows = observations.where("clean_mean is not null and clean_variance is not null").withColumn("d2", F.pow(F.col("clean_mean") - F.lag("clean_mean").over(by), 2))
    rows = rows.select("*", F.avg("clean_mean").over(near).alias("location"), F.avg("d2").over(diff).alias("successive"), F.count("*").over(far).alias("m"), F.avg("clean_variance").over(far).alias("usual"), F.avg("clean_sd").over(far).alias("sd")).where(F.col("m") >= REFERENCE)
    degrees = F.greatest(F.lit(1.0), 2 * F.pow(F.col("m") - 1, 2) / (3 * F.col("m") - 4))
    scale = F.sqrt(F.col("successive") / 2 * (1 + 1 / REFERENCE) + F.greatest(F.lit(0.0), F.col("clean_variance") - F.col("usual")))
    scale = F.greatest(scale, FLOOR / F.sqrt("clean_count"))
    shift = SHIFT * F.greatest(F.coalesce("sd", F.lit(0.0)), F.lit(FLOOR))
    return rows.select("run_id", "source", F.col("step").alias("pos"), "unit_id", "at_ms", "clean_mean", "location", L.student_t(F.col("clean_mean"), F.col("location"), F.col("location") - shift, scale, degrees).alias("llr"))


def reward_stream(observations: DataFrame) -> DataFrame:
    return folded(reward_llrs(observations), ["run_id", "source"])


HEALTHY_KL, BROKEN_KL = 1e-3, 1e-2


def mismatch_llr(healthy_kl: float = HEALTHY_KL, broken_kl: float = BROKEN_KL) -> Column:
    """Of kl, ratio_mean, ratio_se: KL alone where the ratio has no spread."""
    kl = L.gaussian(F.log10(F.greatest(F.col("kl"), F.lit(1e-12))), math.log10(healthy_kl), math.log10(broken_kl), F.lit(0.5))
    ratio = L.gaussian(F.col("ratio_mean"), 1.0, 0.99, F.greatest(F.col("ratio_se"), F.lit(1e-9)))
    return F.when(F.col("ratio_se") == 0, kl).otherwise(L.mean_of_two(kl, ratio))


def mismatch_stream(batches: DataFrame, **kl: float) -> DataFrame:
    """batches: run_id, pos (train steps in start order), kl, ratio_mean, ratio_se; one stream for each run."""
    return folded(batches.select("run_id", "pos", mismatch_llr(**kl).alias("llr")), ["run_id"])


def first_poisoned(records: DataFrame) -> DataFrame:
    return records.where(O.poisoned(F.col("failure_kind"), F.col("reward"))).groupBy("run_id", "source").agg(F.min_by("unit_id", F.struct("started_at_ms", "unit_id", "attempt")).alias("unit_id"), F.min("started_at_ms").alias("at_ms"))


#: Time that an as-of window spans at most; values before it are carried in from a table of one row for each bucket.
AS_OF_BUCKET_MS = 3_600_000


def as_of(probes: DataFrame, history: DataFrame, *, by: str, time: str, value: str, tie: str | None = None, bucket: int = AS_OF_BUCKET_MS) -> DataFrame:
    """probes with the last value of history at or before their time (of equal times the last by tie): no range join.

    Probes and history meet in windows of one key and one bucket of time, so a long run is split over many tasks; the
    last value of earlier buckets comes from an aggregate. Null without any history of the key, 0.0 if none precedes."""
    history = history.select(by, time, value, F.col(tie).cast("long").alias("_tie") if tie else F.lit(0).cast("long").alias("_tie"))
    both = probes.withColumn("_side", F.lit(1)).unionByName(history.withColumn("_side", F.lit(0)), allowMissingColumns=True).withColumn("_bucket", F.floor(F.col(time) / bucket))
    buckets = both.groupBy(by, "_bucket").agg(F.max_by(F.when(F.col("_side") == 0, F.col(value)), F.when(F.col("_side") == 0, F.struct(time, "_tie"))).alias("_last"), F.max(F.col("_side") == 0).alias("_seen"))
    earlier = W.partitionBy(by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = buckets.select(F.col(by).alias("_by"), F.col("_bucket").alias("_at"), F.last("_last", ignorenulls=True).over(earlier).alias("_carried"), F.max("_seen").over(W.partitionBy(by)).alias("_seen"))
    w = W.partitionBy(by, "_bucket").orderBy(time, "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_own", F.last(F.when(F.col("_side") == 0, F.col(value)), ignorenulls=True).over(w)).where("_side = 1")
    both = both.join(carried, both[by].eqNullSafe(carried["_by"]) & (both["_bucket"] == carried["_at"]))
    return both.withColumn(value, F.when(F.col("_seen"), F.coalesce("_own", "_carried", F.lit(0.0)))).drop("_side", "_tie", "_bucket", "_by", "_at", "_carried", "_seen", "_own")


ATTRIBUTION_STEPS, EVEN_ODDS = 5, 0.5


def attributed(alarms: DataFrame, observations: DataFrame, failure_stream: DataFrame, history: DataFrame) -> DataFrame:
    """Reward alarms (run_id, source, pos, ...) with the probability that the configuration changed, and a verdict.

    The failure rate's log odds and the time are those of ATTRIBUTION_STEPS observations later, or of the last one;
    history (run_id, at_ms, pos, probability) is the mismatch stream, looked up as of that time."""
    by = W.partitionBy("run_id", "source").orderBy("step")
    stream = failure_stream.select("run_id", F.col("source").alias("_source"), F.col("pos").alias("step"), F.col("x").alias("_x"))
    o = observations.select("run_id", "source", "step", "at_ms")
    o = o.join(stream, (o.run_id == stream.run_id) & o.source.eqNullSafe(F.col("_source")) & (o.step == stream.step)).select(o.run_id, "source", o.step, F.struct("at_ms", F.col("_x").alias("x")).alias("now"))
    last = F.last("now").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    o = o.select(F.col("run_id").alias("_run"), F.col("source").alias("_source"), "step", F.coalesce(F.lead("now", ATTRIBUTION_STEPS).over(by), last).alias("then"))
    hit = alarms.join(o, (alarms.run_id == F.col("_run")) & alarms.source.eqNullSafe(F.col("_source")) & (alarms.pos == F.col("step")))
    hit = hit.select(*[alarms[c] for c in alarms.columns], L.sigmoid(F.col("then.x")).alias("failure_rate_probability"), F.col("then.at_ms").alias("at_ms"))
    hit = as_of(hit, history.withColumnRenamed("probability", "mismatch_probability"), by="run_id", time="at_ms", value="mismatch_probability", tie="pos")
    p = 1 - (1 - F.col("failure_rate_probability")) * (1 - F.coalesce("mismatch_probability", F.lit(0.0)))
    verdict = F.when(p >= L.ALARM, "configuration").when(p < EVEN_ODDS, "algorithm").otherwise("undetermined")
    return hit.withColumn("configuration_probability", p).withColumn("verdict", verdict)


SIGNALS = ("failure_rate", "mismatch", "poisoned", "reward")


def with_probabilities(batches: DataFrame, **kl: float) -> DataFrame:
    """The mismatch history (run_id, at_ms, pos, probability) of batches."""
    stream = mismatch_stream(batches, **kl)
    return stream.join(batches.select("run_id", "pos", "at_ms"), ["run_id", "pos"]).select("run_id", "at_ms", "pos", L.sigmoid(F.col("x")).alias("probability"))


def details(healthy_kl: float = HEALTHY_KL, broken_kl: float = BROKEN_KL) -> dict[str, Column]:
    """What a report says of an alarm, from its step's columns."""
    c = F.col
    # The report's texts.
    return {
        "failure_rate": F.format_string(f"infra or grader failures %d of %d units in step %d; healthy rate {HEALTHY_RATE}, broken {BROKEN_RATE}", c("failures"), c("units"), c("pos")),
        "reward": F.format_string(f"clean mean reward %.3f in step %d against a reference of %.3f over {REFERENCE} earlier steps", c("clean_mean"), c("pos"), c("location")),
        "mismatch": F.format_string(f"kl %.2e against healthy {healthy_kl:.0e} and broken {broken_kl:.0e}; mean importance ratio %.4f +- %.4f, expected 1", c("kl"), c("ratio_mean"), c("ratio_se")),
        "poisoned": F.lit("an infra or grader failure was scored as zero and entered the reward; set Policy(on_infra=mask, on_grader=mask) or fix the trainer that zeroes it"),
    }


def alarms(records: DataFrame, observations: DataFrame, batches: DataFrame, **kl: float) -> DataFrame:
    """(run_id, signal, source, unit_id, at_ms, probability, detail): the first alarm of each stream, in report order.

    batches: as of mismatch_stream, with source, unit_id and at_ms of the train step; empty if none were recorded."""
    texts = details(**kl)

    def named(crossed: DataFrame, steps: DataFrame, signal: str) -> DataFrame:
        c = crossed.select(F.col("run_id").alias("_run"), *([F.col("source").alias("_source")] if "source" in crossed.columns else []), F.col("pos").alias("_pos"), "x")
        on = (steps.run_id == c["_run"]) & (steps.pos == c["_pos"]) & (steps.source.eqNullSafe(c["_source"]) if "_source" in c.columns else F.lit(True))
        return steps.join(c, on).select("run_id", F.lit(signal).alias("signal"), "source", "unit_id", "at_ms", L.sigmoid(F.col("x")).alias("probability"), texts[signal].alias("detail"))

    keys = ["run_id", "source"]
    steps = observations.select("run_id", "source", F.col("step").alias("pos"), "unit_id", "at_ms", "failures", "units")
    found = named(first_crossing(failure_rate_stream(observations), keys), steps, "failure_rate")
    found = found.unionByName(named(first_crossing(reward_stream(observations), keys), reward_llrs(observations), "reward"))
    found = found.unionByName(named(first_crossing(mismatch_stream(batches, **kl), ["run_id"]), batches, "mismatch"))
    found = found.unionByName(first_poisoned(records).select("run_id", F.lit("poisoned").alias("signal"), "source", "unit_id", "at_ms", F.lit(1.0).alias("probability"), texts["poisoned"].alias("detail")))
    return found.orderBy("run_id", "at_ms", "signal", F.coalesce("source", F.lit("")))
