"""Outcomes of trainers' traces: weighted rewards, and the fields of an output that is kept out of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import outcome as O
from .signatures import at_grade_stage, classify_name


def weighted_reward(rewards: Column) -> Column:
    """The sum of score * weight of array<struct<score, weight>>; null without any, or if a score or weight is null."""
    known = (F.size(rewards) > 0) & ~F.exists(rewards, lambda r: r["score"].isNull() | r["weight"].isNull())
    return F.when(known, F.aggregate(rewards, F.lit(0.0), lambda total, r: total + (r["score"] * r["weight"]).cast("double")))


def trace_failure(errors: Column, rewards: Column, kind: Column, stage: Column) -> Column:
    """The failure of a trace: that of the last of its errors, array<struct<type_name, message, status>>; else a missing reward's."""
    last = F.try_element_at(errors, F.lit(-1))
    of_error = F.when(last.isNotNull(), at_grade_stage(classify_name(last["type_name"], last["message"], stage, last["status"])))
    total = F.coalesce(F.size(rewards), F.lit(0))
    lacking = F.coalesce(F.size(F.filter(rewards, lambda r: r["score"].isNull() | r["weight"].isNull())), F.lit(0))
    # Texts of the record format.
    missing = F.struct(
        F.lit("missing_reward").alias("kind"),
        F.lit("grade").alias("stage"),
        F.lit(False).alias("retryable"),
        F.format_string("missing_reward: trace is ok but %d of %d rewards did not run", lacking, total).alias("message"),
        F.array(F.format_string("rewards_missing=%d", lacking), F.format_string("rewards_total=%d", total)).alias("evidence"),
        F.lit(None).cast("string").alias("exception_type"),
    )
    return F.coalesce(of_error, F.when(kind.isin(*O.REWARDED) & weighted_reward(rewards).isNull(), missing))


def trace_records(traces: DataFrame, policy: O.Policy = O.Policy()) -> DataFrame:
    """Flat records of finished traces (unit_id, attempt, kind, source, ok, errors, rewards): failure, decision and its
    reason, and the reward the trainer sees. A trace that isn't ok but has no errors fails the job."""
    wrong = F.raise_error(F.concat(F.lit("trace "), F.col("unit_id"), F.lit(" is not ok but has no errors")))
    errors = F.when(F.col("ok"), F.slice("errors", 1, 0)).when(F.size("errors") > 0, F.col("errors")).otherwise(wrong)
    f = traces.withColumn("failure", trace_failure(errors, F.col("rewards"), F.col("kind"), F.lit("rollout")))
    return _decided(f.withColumn("reward", weighted_reward(F.col("rewards"))).drop("errors", "rewards", "ok"), policy)


# The kinds of requests that fail before an episode starts.
DISPATCH_KINDS = {"eval": "eval", "train": "trajectory"}


def dispatch_records(failures: DataFrame, policy: O.Policy = O.Policy()) -> DataFrame:
    """Flat records of requests (unit_id, attempt, request, env_name, policy_version, step, task_key, error: struct of
    type_name, message, status) that failed before an episode. An unknown kind of request fails the job."""
    kind = O.lookup(F.col("request"), DISPATCH_KINDS)
    unknown = F.raise_error(F.concat(F.lit(f"request must be one of {sorted(DISPATCH_KINDS)}, got "), F.coalesce("request", F.lit("null"))))
    e = F.col("error")
    failure = at_grade_stage(classify_name(e["type_name"], e["message"], F.lit("setup"), e["status"]))
    tags = F.create_map(*[x for c in ("policy_version", "step", "task_key") for x in (F.lit(c), F.col(c).cast("string"))])
    f = failures.select("unit_id", "attempt", F.coalesce(kind, unknown).alias("kind"), F.col("env_name").alias("source"), tags.alias("tags"), failure.alias("failure"), F.lit(None).cast("double").alias("reward"))
    return _decided(f, policy)


def _decided(records: DataFrame, policy: O.Policy) -> DataFrame:
    kind, attempt = F.col("failure.kind"), F.col("attempt")
    out = records.withColumn("action", O.decide(kind, attempt, policy)).withColumn("reason", O.decision_reason(kind, F.col("failure.stage"), attempt, policy))
    return out.withColumn("outcome", F.when(kind.isNull(), "ok").otherwise("failed")).withColumn("reward", O.reward_for(F.col("action"), F.col("reward")))


def masked_output(prompt_ids: Column, failed: Column, extra: Column) -> Column:
    """What a trainer gets for a failed attempt: its prompt, nothing to train on, reward 0, extra fields; null if it didn't fail."""
    none = lambda t: F.expr(f"cast(array() as array<{t}>)")
    fields = {"prompt_ids": prompt_ids, "response_ids": none("long"), "response_mask": none("int"), "response_logprobs": none("double"), "reward_score": F.lit(0.0), "num_turns": F.lit(0), "metrics": F.expr("cast(map() as map<string,double>)"), "extra_fields": extra}
    return F.when(failed, F.struct(*[v.alias(k) for k, v in fields.items()]))
