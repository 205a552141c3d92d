"""Column expressions over outcome records: classification, decisions, rewards, costs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The closed vocabularies of the record schema.
FAILURE_CLASSES = {
    "agent_exception": "agent",
    "malformed_action": "agent",
    "grader_exception": "grader",
    "missing_reward": "grader",
    "engine_crash": "infra",
    "hardware": "infra",
    "network": "infra",
    "oom_gpu": "infra",
    "oom_host": "infra",
    "oom_kv_cache": "infra",
    "process_killed": "infra",
    "sandbox": "infra",
    "wall_clock": "timeout",
}
RETRYABLE = ("engine_crash", "network", "process_killed", "sandbox")
REWARDED = ("eval", "trajectory")
EXIT_STATUS = {
    "agent_exception": "AgentError",
    "malformed_action": "AgentError",
    "wall_clock": "TimeLimitExceeded",
    "grader_exception": "VerifierError",
    "missing_reward": "VerifierError",
    "sandbox": "SandboxUnavailable",
    "oom_host": "SandboxUnavailable",
    "process_killed": "SandboxUnavailable",
    "hardware": "SandboxUnavailable",
    "network": "ServerUnreachable",
    "engine_crash": "ServerUnreachable",
    "oom_gpu": "ServerUnreachable",
    "oom_kv_cache": "ServerUnreachable",
}


def lookup(key: Column, values: dict[str, str]) -> Column:
    """values[key], null for keys that aren't there; an inline map, no join."""
    out = F.lit(None).cast("string")
    for group in sorted(set(values.values())):
        out = F.when(key.isin([k for k, v in values.items() if v == group]), F.lit(group)).otherwise(out)
    return out


def failure_class(kind: Column) -> Column:
    return lookup(kind, FAILURE_CLASSES)


def exit_status(kind: Column) -> Column:
    return F.when(kind.isNull(), "Submitted").otherwise(lookup(kind, EXIT_STATUS))


def non_agent(kind: Column) -> Column:
    """Grader or infrastructure failed; a timeout counts as the agent's."""
    return F.coalesce(failure_class(kind).isin("grader", "infra"), F.lit(False))


def poisoned(kind: Column, reward: Column) -> Column:
    return non_agent(kind) & reward.isNotNull()


def clean_reward(kind: Column, action: Column, reward: Column) -> Column:
    return F.when((action != "retry") & ~non_agent(kind), reward)


@dataclass(frozen=True)
class Policy:
    """What a trainer does with a failure of each class, and how many attempts a retryable one gets."""

    actions: dict[str, str] = field(default_factory=lambda: {"agent": "zero", "grader": "mask", "infra": "mask", "timeout": "zero"})
    max_attempts: int = 1

    def __post_init__(self):
        if set(self.actions) != {"agent", "grader", "infra", "timeout"} or not set(self.actions.values()) <= {"abort", "mask", "zero"}:
            raise ValueError("actions must give abort, mask or zero for each failure class")
        if self.max_attempts < 1:
            raise ValueError("max_attempts must be at least 1")


def decide(kind: Column, attempt: Column, policy: Policy = Policy()) -> Column:
    """The action; an attempt that the policy doesn't have fails the job."""
    retry = kind.isin(*RETRYABLE) & (attempt < policy.max_attempts)
    action = F.when(kind.isNull(), "score").when(retry, "retry").otherwise(lookup(failure_class(kind), policy.actions))
    beyond = F.raise_error(F.format_string(f"attempt must be between 1 and {policy.max_attempts}, got %d", attempt.cast("long")))
    return F.when(attempt.between(1, policy.max_attempts), action).otherwise(beyond)


def decision_reason(kind: Column, stage: Column, attempt: Column, policy: Policy = Policy()) -> Column:
    """Why decide() says what it says."""
    # Texts of the record format.
    retry = F.format_string(f"%s is retryable; attempt %d of {policy.max_attempts}", kind, attempt.cast("long"))
    of_class = F.format_string("%s failure %s at %s: on_%s=%s", failure_class(kind), kind, stage, failure_class(kind), lookup(failure_class(kind), policy.actions))
    return F.when(kind.isNull(), "unit succeeded").when(kind.isin(*RETRYABLE) & (attempt < policy.max_attempts), retry).otherwise(of_class)


def reward_for(action: Column, reward: Column) -> Column:
    return F.when(action == "score", reward).when(action == "zero", F.lit(0.0))


def usd(quantities: dict[str, Column], prices: dict[str, float | None]) -> Column:
    """The cost of what was used; null if anything used has no price."""
    total, unpriced = F.lit(0.0), F.lit(False)
    for name, q in quantities.items():
        if prices.get(name) is None:
            unpriced = unpriced | (q != 0)
        else:
            total = total + q * F.lit(float(prices[name]))
    return F.when(~unpriced, total)


def log_line(kind: Column, stage: Column) -> Column:
    return F.coalesce(F.concat(failure_class(kind), F.lit("/"), kind, F.lit("@"), stage), F.lit("-"))


def headroom_percent(used: Column, total: Column) -> Column:
    return F.floor((total - used) * 100 / total)


def headroom_warning(used: Column, total: Column, longest_tokens: Column, *, warn_percent: int = 10) -> Column:
    """A text where the free share is below warn_percent, else null; used beyond total, or no total, fails the job."""
    if not 1 <= warn_percent <= 99:
        raise ValueError("warn_percent must be between 1 and 99")
    free = headroom_percent(used, total).cast("long")
    # Fixed value: the warning's text.
    text = F.format_string(
        f"gpu memory headroom is %d%% of %.1f GiB, below the {warn_percent}%% warning threshold while the longest sample is %d tokens; lower max_tokens_per_gpu or gpu_memory_utilization before the next step",
        free, (total / 2**30).cast("double"), longest_tokens.cast("long"),
    )
    bad = (total < 1) | (used < 0) | (used > total)
    wrong = F.raise_error(F.format_string("gpu_used_bytes must be between 0 and gpu_total_bytes, got %s of %s", used.cast("string"), total.cast("string")))
    return F.when(bad, wrong).when(free < warn_percent, text)


def retryable(kind: Column) -> Column:
    return kind.isin(*RETRYABLE)


def identifier(length: int, domain: str, *parts: Column, separator: str = "\0") -> Column:
    """The first hex digits of SHA-256 over domain and parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws(separator, F.lit(domain), *parts), 256), 1, length)


def classify_exec(timed_out: Column, exit_code: Column, signal: Column, text: Column, peak: Column, limit: Column) -> Column:
    """The failure kind of a finished process, null if it's fine: time, exit 0, GPU memory text, signal, host memory."""
    gpu = text.contains("CUDA out of memory") | text.contains("OutOfMemoryError")
    killer = text.contains("Killed") | text.contains("Out of memory") | text.contains("oom-kill")
    near = F.coalesce(peak >= limit * 0.9, F.lit(False))
    return (
        F.when(timed_out, "wall_clock")
        .when(F.coalesce(exit_code == 0, F.lit(False)), F.lit(None))
        .when(gpu, "oom_gpu")
        .when(signal.isNull(), F.lit(None))
        .when((signal == 9) & (near | killer), "oom_host")
        .otherwise("process_killed")
    )


def exec_failure(kind: Column, stage: Column, elapsed_ms: Column, signal: Column, peak_gpu: Column, peak_host: Column, limit: Column) -> Column:
    """The failure struct of a finished process whose kind classify_exec() gives, with message and evidence; null without a kind."""
    number = lambda c: c.cast("string")
    listed = F.concat(F.lit("["), F.array_join(F.transform(peak_gpu, number), ", "), F.lit("]"))
    # Texts of the record format.
    message = (
        F.when(kind == "wall_clock", F.concat(F.lit("process exceeded its timeout after "), number(elapsed_ms), F.lit(" ms")))
        .when(kind == "oom_gpu", "process reported CUDA out of memory")
        .when(kind == "oom_host", "process was killed near the host memory limit")
        .when(kind == "process_killed", F.concat(F.lit("process was killed by signal "), number(signal)))
    )
    evidence = (
        F.when(kind == "wall_clock", F.array(F.concat(F.lit("elapsed_ms="), number(elapsed_ms))))
        .when(kind == "oom_gpu", F.array(F.concat(F.lit("peak_gpu_used_bytes="), listed)))
        .when(kind == "oom_host", F.array(F.concat(F.lit("host_limit_bytes="), F.coalesce(number(limit), F.lit("None"))), F.concat(F.lit("peak_host_rss_bytes="), number(peak_host))))
        .when(kind == "process_killed", F.array(F.concat(F.lit("signal="), number(signal))))
    )
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), stage.alias("stage"), retryable(kind).alias("retryable"), F.concat(kind, F.lit(": "), message).alias("message"), evidence.alias("evidence"), F.lit(None).cast("string").alias("exception_type")))


def elapsed_seconds(started_at_ms: Column, ended_at_ms: Column) -> Column:
    return (ended_at_ms - started_at_ms) / 1000


def assembled(units: DataFrame, prices: dict[str, float | None], *, cpus_held: int, gpus_held: int, policy: Policy = Policy()) -> DataFrame:
    """Records of units (attempt, failure_kind, stage, reward, started_at_ms, ended_at_ms, tokens_in, tokens_out): with
    schema_version, outcome, decision and its reason, the reward the trainer sees, and cost.

    Held cpus and gpus cost for the whole time; prices, by cpu_seconds, gpu_seconds, tokens_in and tokens_out, are of one unit each."""
    kind, attempt, c = F.col("failure_kind"), F.col("attempt"), F.col
    seconds = elapsed_seconds(c("started_at_ms"), c("ended_at_ms"))
    used = {"cpu_seconds": seconds * cpus_held, "gpu_seconds": seconds * gpus_held, "tokens_in": c("tokens_in"), "tokens_out": c("tokens_out")}
    decided = units.withColumn("action", decide(kind, attempt, policy)).withColumn("reason", decision_reason(kind, c("stage"), attempt, policy))
    return (
        decided.withColumns({**used, "usd": usd(used, prices)})
        .withColumn("schema_version", F.lit(2))
        .withColumn("outcome", F.when(kind.isNull(), "ok").otherwise("failed"))
        .withColumn("failure_class", failure_class(kind))
        .withColumn("reward", reward_for(c("action"), c("reward")))
    )


def outcome_fields() -> list[Column]:
    """Of flat records: the fields that trainers' samples carry."""
    c = F.col
    return [c("attempt").alias("tp_attempt"), c("action").alias("tp_decision"), c("failure_class").alias("tp_failure_class"), c("failure_kind").alias("tp_failure_kind"), c("unit_id").alias("tp_unit_id")]


def sample_fields() -> list[Column]:
    """Of flat records of final attempts: reward, remove_sample, exit_status, status (failed where it is masked). A
    record that was decided retry or abort fails the job."""
    c, action = F.col, F.col("action")
    wrong = F.raise_error(F.concat(F.lit("samples come from final attempts; "), c("unit_id"), F.lit(" was decided "), action))
    return [
        F.when(action.isin("retry", "abort"), wrong).otherwise(F.coalesce(c("reward"), F.lit(0.0))).alias("reward"),
        (action == "mask").alias("remove_sample"),
        exit_status(c("failure_kind")).alias("exit_status"),
        F.when(action == "mask", "failed").alias("status"),
    ]


def trainable(action: Column) -> Column:
    return action.isin("score", "zero")


def savings(gpus: Column, rate: Column, late: Column, early: Column, recovery: Column) -> Column:
    return gpus * rate * F.greatest(F.lit(0.0), late - early - recovery)
