"""Faults put into rewards by a seeded draw, with the truth kept, to test detectors on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# All faults; the share of typed hits of those that hit rewards (None: the schedule's).
FAULTS = ("grader_missing", "lr_spike", "none", "sandbox_masked", "sandbox_partly_typed", "sandbox_untyped", "sandbox_zeroed", "temperature", "top_p")
TYPED_SHARE = {"grader_missing": 1.0, "sandbox_masked": 1.0, "sandbox_partly_typed": None, "sandbox_untyped": 0.0, "sandbox_zeroed": 1.0}


@dataclass(frozen=True)
class Schedule:
    """One fault from step start on. rate is the share of samples hit, or the value set by a fault that hits no rewards."""

    fault: str = "none"
    start: int = 0
    rate: float = 0.0
    typed: float = 0.0

    def __post_init__(self):
        if self.fault not in FAULTS:
            raise ValueError(f"fault must be one of {', '.join(FAULTS)}")
        if self.fault in TYPED_SHARE and not 0 <= self.rate <= 1 or not 0 <= self.typed <= 1:
            raise ValueError("rate and typed must be within 0 and 1")

    @classmethod
    def from_settings(cls, settings: dict[str, str]) -> Schedule:
        """Of FAULT (absent: none), FAULT_START, FAULT_RATE and FAULT_TYPED, as an environment holds them."""
        fault = settings.get("FAULT", "none")
        if fault == "none":
            return cls()
        if lacking := [k for k in ("FAULT_START", "FAULT_RATE") if k not in settings]:
            raise ValueError(f"{fault} lacks {' and '.join(lacking)}")
        return cls(fault, int(settings["FAULT_START"]), float(settings["FAULT_RATE"]), float(settings.get("FAULT_TYPED", "0")))

    def value(self, fault: str, step: Column) -> Column:
        """What this schedule sets for a sampling parameter (temperature, top_p) or learning rate scale at a step; else null."""
        return F.when((step >= self.start) & F.lit(self.fault == fault), F.lit(float(self.rate)))


def draw(seed: int | Column, *parts: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of an MD5: the same in each run, engine and order of rows."""
    text = F.concat_ws(":", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2.0**32


def inject(rows: DataFrame, schedule: Schedule, seed: int) -> DataFrame:
    """rows (step, uid, idx, reward) with truth, action, failure_kind, trainer_reward, record_reward.

    A hit is masked (the trainer sees the mean of its group's clean rewards, 0 without any), zeroed or, untyped,
    scored 0; a null reward that isn't hit stays null."""
    share = TYPED_SHARE.get(schedule.fault)
    hit = F.lit(schedule.fault in TYPED_SHARE) & (F.col("step") >= schedule.start) & (draw(seed, F.lit("hit"), F.col("step"), F.col("idx")) < schedule.rate)
    typed = F.col("hit") & (draw(seed, F.lit("typed"), F.col("step"), F.col("idx")) < (schedule.typed if share is None else share))
    missing, zeroed = schedule.fault == "grader_missing", schedule.fault == "sandbox_zeroed"
    action = F.when(~F.col("typed"), "score").otherwise("zero" if zeroed else "mask")
    mean = F.avg(F.when(~F.col("hit"), F.col("reward"))).over(W.partitionBy("step", "uid"))
    masked = F.col("action") == "mask"
    return (
        rows.withColumn("hit", hit)
        .withColumn("typed", typed)
        .withColumn("truth", F.when(~F.col("hit"), "healthy").when(F.lit(missing), "grader_missing").when(F.col("typed"), "sandbox_typed").otherwise("sandbox_untyped"))
        .withColumn("action", action)
        .withColumn("failure_kind", F.when(F.col("typed"), "missing_reward" if missing else "sandbox"))
        .withColumn("trainer_reward", F.when(~F.col("hit"), F.col("reward")).when(masked, F.coalesce(mean, F.lit(0.0))).otherwise(0.0))
        .withColumn("record_reward", F.when(~F.col("hit"), F.col("reward")).when(masked, F.lit(None)).otherwise(0.0))
        .drop("hit", "typed")
    )


# What benchmark records say of themselves.
REASON, INJECTED = "benchmark", "injected by the benchmark"


def benchmark_records(samples: DataFrame, *, source: str) -> DataFrame:
    """inject()'s rows (run_id, step, uid, idx, action, failure_kind, record_reward, started_at_ms, ended_at_ms) as flat records."""
    kind = F.col("failure_kind")
    return samples.select(
        F.lit(2).alias("schema_version"), "run_id", F.format_string("s%05d-%04d", F.col("step").cast("long"), F.col("idx").cast("long")).alias("unit_id"), F.lit("trajectory").alias("kind"), F.lit(1).alias("attempt"), F.lit(source).alias("source"), "started_at_ms", "ended_at_ms",
        F.when(kind.isNull(), "ok").otherwise("failed").alias("outcome"), kind, F.when(kind.isNotNull(), "grade").alias("failure_stage"), F.concat(kind, F.lit(f": {INJECTED}")).alias("failure_message"),
        F.col("record_reward").alias("reward"), "action", F.lit(REASON).alias("reason"), "step", F.col("uid").alias("grp"),
    )


def train_records(batches: DataFrame) -> DataFrame:
    """The mismatch summaries of steps (run_id, step, started_at_ms, ended_at_ms, sequences, ...) as flat train-step records."""
    none = F.lit(None).cast("string")
    more = [c for c in batches.columns if c not in ("run_id", "step", "started_at_ms", "ended_at_ms")]
    return batches.select(F.lit(2).alias("schema_version"), "run_id", F.format_string("step-%05d", F.col("step").cast("long")).alias("unit_id"), F.lit("train_step").alias("kind"), F.lit(1).alias("attempt"), none.alias("source"), "started_at_ms", "ended_at_ms", F.lit("ok").alias("outcome"), F.lit(None).cast("double").alias("reward"), F.lit("score").alias("action"), F.lit(REASON).alias("reason"), "step", *more)


def best_multiplier(results: DataFrame, *keys: str, most_false_alarms: float = 0.1) -> DataFrame:
    """Of results (keys, k, false_alarms, f1): the k that stays within the false alarms, then has the best F1; the larger on ties."""
    order = F.struct((F.col("false_alarms") <= most_false_alarms).alias("ok"), "f1", "k")
    return results.groupBy(*keys).agg(F.max_by("k", order).alias("k"))
