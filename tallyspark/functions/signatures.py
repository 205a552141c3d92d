"""Classification of errors by ordered signatures, as column expressions: no join, no rows multiplied.

An error is a struct of type_name, message and hierarchy, its class and base classes as array<struct<module, name>>.
Null messages count as empty; a null or empty hierarchy matches rules on the message alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import outcome as O

# Fixed values: (failure kind, class names, message fragment, module prefix), first match wins.
SIGNATURES = [
    ("agent_exception", ("ContainerError", "OverlongPromptError", "RolloutDataFailure"), None, None),
    ("malformed_action", ("ToolError", "ModelError"), None, None),
    ("missing_reward", ("RewardFileNotFoundError", "RewardFileEmptyError", "VerifierOutputParseError"), None, None),
    ("grader_exception", ("VerifierTimeoutError", "TaskError"), None, None),
    ("sandbox", ("AgentSetupTimeoutError", "EnvironmentStartTimeoutError"), None, None),
    ("oom_host", ("OutOfMemoryError", "ObjectStoreFullError"), None, "ray"),
    ("oom_gpu", ("OutOfMemoryError",), None, None),
    ("oom_gpu", ("RuntimeError",), "CUDA out of memory", None),
    ("oom_host", ("MemoryError",), None, None),
    ("oom_kv_cache", None, "KV cache", None),
    ("wall_clock", ("RolloutTimeout",), None, None),
    ("engine_crash", ("EngineDeadError", "AsyncEngineDeadError", "EngineGenerateError", "GenerationUnavailable", "NoHealthyShards", "RolloutInfraFailure", "ProviderError", "RaySystemError"), None, None),
    ("process_killed", ("RayActorError", "WorkerCrashedError", "NodeDiedError", "LocalRayletDiedError", "OwnerDiedError", "ObjectLostError"), None, None),
    ("network", ("ConnectTimeout", "ConnectTimeoutError", "ConnectionTimeoutError"), None, None),
    ("wall_clock", ("TimeoutError", "TimeoutException", "Timeout", "ReadTimeout", "SandboxTimeoutError", "ExecTimeoutError", "DaytonaTimeoutError"), None, None),
    ("network", ("RuntimeError",), "NCCL", None),
    ("network", ("ConnectionError", "DaytonaConnectionError", "DistBackendError", "DistNetworkError", "DistStoreError", "TransportError", "ClientConnectionError", "ClientPayloadError", "NewConnectionError", "MaxRetryError", "NameResolutionError", "RpcError", "GymTransportError", "InterceptionError"), None, None),
    ("hardware", ("RuntimeError",), "Xid", None),
    ("hardware", ("RuntimeError",), "uncorrectable ECC", None),
    ("sandbox", ("SandboxError", "SandboxTerminatedError", "TunnelError", "InfraError", "EnvError", "SandboxException", "ServiceBusyException", "InternalFailure", "DaytonaError", "DockerException", "InfraAbort"), None, None),
]
INFRA_HTTP = (408, 429)
CAUSES, LINE_CHARS = 8, 200
ENDS = "[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def matched_kind(hierarchy: Column, message: Column) -> Column:
    """The kind of the first signature that matches, null if none does."""
    message = F.coalesce(message, F.lit(""))

    def matches(names, fragment, prefix):
        named = lambda h: h["name"].isin(*names) & (h["module"].startswith(prefix) if prefix else F.lit(True))
        parts = ([F.coalesce(F.exists(hierarchy, named), F.lit(False))] if names else []) + ([message.contains(fragment)] if fragment else [])
        return reduce(Column.__and__, parts)

    return F.coalesce(*[F.when(matches(*rule), F.lit(kind)) for kind, *rule in SIGNATURES])


def first_line(text: Column) -> Column:
    return F.substring(F.split(F.coalesce(text, F.lit("")), ENDS, 2)[0], 1, LINE_CHARS)


def failure(kind: Column, stage: Column, type_name: Column, message: Column, *evidence: Column) -> Column:
    """A failure struct: null evidence is left out, the rest is sorted and distinct; a grader's failure keeps its stage."""
    type_name, line = F.coalesce(type_name, F.lit("")), first_line(message)
    lines = F.array(F.concat(F.lit("exception_type="), type_name), F.concat(F.lit("message="), line), *evidence)
    return F.struct(
        kind.alias("kind"),
        stage.alias("stage"),
        O.retryable(kind).alias("retryable"),
        F.concat(kind, F.lit(": "), type_name, F.lit(": "), line).alias("message"),
        F.array_sort(F.array_distinct(F.array_compact(lines))).alias("evidence"),
        type_name.alias("exception_type"),
    )


def classify_chain(chain: Column, stage: Column) -> Column:
    """The failure of an error with its explicit causes, outermost first (an array of errors).

    The first of CAUSES errors that a signature matches decides; without any it's the agent's, named by the outermost.
    Null for an empty or null chain."""
    kinds = F.transform(F.slice(chain, 1, CAUSES), lambda e: F.struct(matched_kind(e["hierarchy"], e["message"]).alias("kind"), e["type_name"].alias("type_name"), e["message"].alias("message")))
    hit = F.coalesce(F.get(F.filter(kinds, lambda e: e["kind"].isNotNull()), F.lit(0)), F.get(kinds, F.lit(0)))
    return F.when(F.size(chain) > 0, failure(F.coalesce(hit["kind"], F.lit("agent_exception")), stage, hit["type_name"], hit["message"]))


def classify_name(type_name: Column, message: Column, stage: Column, status: Column) -> Column:
    """The failure of an error known by class name, message and HTTP status (may be null): 5xx and INFRA_HTTP of an
    unknown name are the engine's, other unknown names the agent's. Status is evidence whenever it's there."""
    known = matched_kind(F.array(F.struct(F.lit("").alias("module"), type_name.alias("name"))), message)
    infra = F.coalesce((status >= 500) | status.isin(*INFRA_HTTP), F.lit(False))
    kind = F.coalesce(known, F.when(infra, "engine_crash").otherwise("agent_exception"))
    return failure(kind, stage, type_name, message, F.concat(F.lit("status_code="), status.cast("string")))


def at_grade_stage(failed: Column) -> Column:
    """The same failure, put to the grade stage if it's the grader's."""
    return F.when(failed.isNotNull(), failed.withField("stage", F.when(O.failure_class(failed["kind"]) == "grader", F.lit("grade")).otherwise(failed["stage"])))


def failure_of_unit(chain: Column, stage: Column, kind: Column, reward: Column) -> Column:
    """The failure of a finished attempt: its error's; else a rewarded kind without a reward misses it; else null."""
    missing = F.struct(
        F.lit("missing_reward").alias("kind"),
        F.lit("grade").alias("stage"),
        F.lit(False).alias("retryable"),
        F.lit("missing_reward: no reward was given").alias("message"),
        F.array(F.lit("reward=None")).alias("evidence"),
        F.lit(None).cast("string").alias("exception_type"),
    )
    return F.coalesce(classify_chain(chain, stage), F.when(kind.isin(*O.REWARDED) & reward.isNull(), missing))
