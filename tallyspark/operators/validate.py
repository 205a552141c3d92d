"""Row rules of outcome records as named predicates, and uniqueness of keys.

A rule is checked if the frame has its columns; unknown (null) counts as kept, except where a rule asks for a value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import outcome as O

IDENTIFIER = r"\A[A-Za-z0-9][A-Za-z0-9_.-]{0,127}\z"


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def _negative(c: Column) -> Column:
    return ~_finite(c) | (c < 0)


def rules() -> dict[str, tuple[tuple[str, ...], Column]]:
    """Rule: (columns, predicate that is true for a violation)."""
    c, reward, action = F.col, F.col("reward"), F.col("action")
    mismatch = ("kl", "kl_standard_error", "ratio_mean", "ratio_standard_error")
    costs = ("cpu_seconds", "gpu_seconds", "tokens_in", "tokens_out")
    return {
        "V1": (("schema_version",), c("schema_version") != 2),
        "V2": (("run_id", "unit_id"), ~c("run_id").rlike(IDENTIFIER) | ~c("unit_id").rlike(IDENTIFIER)),
        "V3": (("attempt",), c("attempt") < 1),
        "V3_decision": (("attempt", "decision_attempt"), (c("decision_attempt") < 1) | (c("decision_attempt") != c("attempt"))),
        "V4": (("started_at_ms", "ended_at_ms"), c("ended_at_ms") < c("started_at_ms")),
        "V5": (("outcome", "failure_kind"), (c("outcome") == "failed") != c("failure_kind").isNotNull()),
        "V6": (("outcome", "action"), (c("outcome") == "ok") != (action == "score")),
        "V7": (("action", "reward"), (action == "zero") & ~F.coalesce(reward == 0.0, F.lit(False))),
        "V8": (("action", "reward"), action.isin("mask", "retry", "abort") & reward.isNotNull()),
        "V9": (("kind", "action", "reward"), (action == "score") & c("kind").isin(*O.REWARDED) & reward.isNull()),
        "V10": (("reward",), ~_finite(reward)),
        "V11": (("tag_keys",), c("tag_keys") != F.array_sort(F.array_distinct("tag_keys"))),
        "V12": (("message",), c("message") == ""),
        "V12_evidence": (("evidence",), c("evidence") != F.array_sort(F.array_distinct("evidence"))),
        "V13": (("sample_count", "peak_host_rss_bytes", "peak_gpu_used_bytes", "gpu_total_bytes"), (c("sample_count") < 0) | (c("peak_host_rss_bytes") < 0) | (F.size("peak_gpu_used_bytes") != F.size("gpu_total_bytes"))),
        "V14": (costs, reduce(Column.__or__, [_negative(c(x).cast("double")) for x in costs])),
        "V14_usd": (("usd",), _negative(c("usd"))),
        "V15": (("sequences", "tokens", *mismatch), (c("sequences") < 2) | (c("tokens") < c("sequences")) | reduce(Column.__or__, [_negative(c(x)) for x in mismatch])),
        "V16": (("exit_code", "signal", "elapsed"), (c("exit_code").isNull() == c("signal").isNull()) | (c("elapsed") < 0)),
    }


def violations(records: DataFrame, *keys: str) -> DataFrame:
    """One row (keys, rule) for each rule that a row breaks: one pass, no exchange."""
    have = set(records.columns)
    broken = [F.when(bad, F.lit(name)) for name, (needs, bad) in rules().items() if have.issuperset(needs)]
    return records.select(*keys, F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())).alias("rule"))


def duplicates(records: DataFrame, *keys: str) -> DataFrame:
    """V17: keys that more than one row has, and their rows' number."""
    return records.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
