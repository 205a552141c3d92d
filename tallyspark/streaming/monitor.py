"""The failure-rate, reward and mismatch streams, kept up as records arrive.

State of a (run, source) is one open step's counts by group, the log odds, and the rows that came too late: bounded by
one step, not by the run. A step is closed, observed and folded when a row of a later step of its key arrives, as its
variance needs all its groups; the batch functions give the last, still open one. Rows of a closed step are dropped
and counted in `late`. Restarts go on from the query's checkpoint, which also makes each row count once. The reward
stream's state has the last informative steps too, as many as its windows reach back."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import likelihood as L
from ..functions import outcome as O
from ..operators import detect
from ..operators.detect import BROKEN_RATE, HEALTHY_RATE, LAG, REFERENCE, SCALE

OUT = "run_id string, source string, pos long, units long, failures long, x double, alarm boolean, late long"
STATE = "pos long, groups string, x double, alarmed boolean, late long"


def _llr(groups: dict[str, list[int]]) -> tuple[int, int, float]:
    """Units, failures and the log-likelihood ratio over the design effect of one step's {group: [units, failures]}."""
    n, k, g = sum(v[0] for v in groups.values()), sum(v[1] for v in groups.values()), len(groups)
    effect, p = 1.0, k / n
    if 0 < k < n and g > 1:
        cluster = g / (g - 1) * sum((f - p * m) ** 2 for m, f in groups.values()) / (n * n)
        effect = min(max(cluster / (p * (1 - p) / n), 1.0), n / g)
    return n, k, (k * math.log(BROKEN_RATE / HEALTHY_RATE) + (n - k) * (math.log1p(-BROKEN_RATE) - math.log1p(-HEALTHY_RATE))) / effect


def _grown(x: float) -> float:
    top, low = max(x, math.log(L.HAZARD)), min(x, math.log(L.HAZARD))
    return top + math.log1p(math.exp(low - top)) - math.log1p(-L.HAZARD)


def _observe(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, text, x, alarmed, late = state.get if state.exists else (None, "{}", -math.inf, False, 0)
    # Of each step: units and failures by group, added up over the batches, so that rows may come in any order.
    steps: dict[int, dict[str, list[int]]] = {} if at is None else {at: json.loads(text)}
    for rows in batches:
        if at is not None:
            late += int((rows["step"] < at).sum())
            rows = rows[rows["step"] >= at]
        for (step, grp), part in rows.groupby(["step", "grp"])["failed"]:
            counts = steps.setdefault(int(step), {}).setdefault(grp, [0, 0])
            counts[0] += len(part)
            counts[1] += int(part.sum())
    closed = sorted(steps)[:-1]
    out = []
    for step in closed:
        n, k, llr = _llr(steps[step])
        x = _grown(x) + llr
        alarm = not alarmed and x >= L.ALARM_LOG_ODDS
        alarmed = alarmed or alarm
        out.append((*key, step, n, k, x, alarm, late))
    if steps:
        at = max(steps)
        state.update((at, json.dumps(steps[at]), x, alarmed, late))
    yield pd.DataFrame(out, columns=["run_id", "source", "pos", "units", "failures", "x", "alarm", "late"])


def failure_rate_monitor(records: DataFrame) -> DataFrame:
    """Each closed step of a stream of records, with the log odds after it; alarm marks the first crossing of its key.

    Records without a step, of kinds that aren't rewarded, are left out. For an output in append mode."""
    units = records.where(F.col("kind").isin(*O.REWARDED) & F.col("step").isNotNull())
    grp = F.coalesce("grp", F.concat(F.lit("unit:"), F.col("unit_id"))).alias("grp")
    units = units.select("run_id", "source", F.col("step").cast("long").alias("step"), grp, O.non_agent(F.col("failure_kind")).alias("failed"))
    return units.groupBy("run_id", "source").applyInPandasWithState(_observe, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


REWARD_OUT = "run_id string, source string, pos long, clean_count long, clean_mean double, x double, alarm boolean, late long"
REWARD_STATE = "pos long, groups string, history string, x double, alarmed boolean, late long"


def _informative(groups: dict[str, list[float]]) -> tuple[int, float, float, float | None] | None:
    """Count, mean, cluster-robust variance of the mean and deviation of one step's {group: [n, sum, sum of squares]}; None if it has no variance."""
    some = [v for v in groups.values() if v[0]]
    n, g = sum(v[0] for v in some), len(some)
    if g < 2:
        return None
    mean = sum(v[1] for v in some) / n
    variance = g / (g - 1) * sum((t - mean * k) ** 2 for k, t, _ in some) / (n * n)
    spread = max(0.0, sum(v[2] for v in some) - mean * mean * n)
    return int(n), mean, variance, math.sqrt(spread / (n - 1)) if n > 1 else None


def _reward_llr(now: tuple, lagged: list[list]) -> float:
    """detect.reward_llrs() of one step after the lagged ones (count, mean, variance, deviation), oldest first."""
    count, mean, variance, _ = now
    means, m = [x[1] for x in lagged], len(lagged)
    location = sum(means[-REFERENCE:]) / REFERENCE
    successive = sum((b - a) ** 2 for a, b in zip(means, means[1:])) / (m - 1)
    sds = [x[3] for x in lagged if x[3] is not None]
    degrees = max(1.0, 2 * (m - 1) ** 2 / (3 * m - 4))
    scale = math.sqrt(successive / 2 * (1 + 1 / REFERENCE) + max(0.0, variance - sum(x[2] for x in lagged) / m))
    scale = max(scale, detect.FLOOR / math.sqrt(count))
    shift = detect.SHIFT * max(sum(sds) / len(sds) if sds else 0.0, detect.FLOOR)
    a, b = (mean - location + shift) / scale, (mean - location) / scale
    return -(degrees + 1) / 2 * (math.log1p(a * a / degrees) - math.log1p(b * b / degrees))


def _observe_reward(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, text, past, x, alarmed, late = state.get if state.exists else (None, "{}", "[]", -math.inf, False, 0)
    history: list[list] = json.loads(past)
    steps: dict[int, dict[str, list[float]]] = {} if at is None else {at: json.loads(text)}
    for rows in batches:
        if at is not None:
            late += int((rows["step"] < at).sum())
            rows = rows[rows["step"] >= at]
        for (step, grp), part in rows.groupby(["step", "grp"])["clean"]:
            counts, clean = steps.setdefault(int(step), {}).setdefault(grp, [0, 0.0, 0.0]), part.dropna()
            counts[0] += len(clean)
            counts[1] += float(clean.sum())
            counts[2] += float((clean * clean).sum())
    out = []
    for step in sorted(steps)[:-1]:
        now = _informative(steps[step])
        if now is None:
            continue
        lagged = history[:-LAG] if len(history) > LAG else []
        history = [*history, list(now)][-(SCALE + LAG) :]
        if len(lagged) >= REFERENCE:
            x = _grown(x) + _reward_llr(now, lagged)
            alarm = not alarmed and x >= L.ALARM_LOG_ODDS
            alarmed = alarmed or alarm
            out.append((*key, step, now[0], now[1], x, alarm, late))
    if steps:
        at = max(steps)
        state.update((at, json.dumps(steps[at]), json.dumps(history), x, alarmed, late))
    yield pd.DataFrame(out, columns=["run_id", "source", "pos", "clean_count", "clean_mean", "x", "alarm", "late"])


def reward_monitor(records: DataFrame) -> DataFrame:
    """Each closed informative step with enough lagged ones, with the log odds of a drop of the clean reward after it."""
    units = records.where(F.col("kind").isin(*O.REWARDED) & F.col("step").isNotNull())
    grp = F.coalesce("grp", F.concat(F.lit("unit:"), F.col("unit_id"))).alias("grp")
    units = units.select("run_id", "source", F.col("step").cast("long").alias("step"), grp, O.clean_reward(F.col("failure_kind"), F.col("action"), F.col("reward")).alias("clean"))
    return units.groupBy("run_id", "source").applyInPandasWithState(_observe_reward, REWARD_OUT, REWARD_STATE, "append", GroupStateTimeout.NoTimeout)


MISMATCH_OUT = "run_id string, pos long, at_ms long, x double, alarm boolean, late long"


def _observe_mismatch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, x, alarmed, late = state.get if state.exists else (None, -math.inf, False, 0)
    rows = pd.concat(list(batches)).sort_values("pos", kind="stable")
    out = []
    for pos, at_ms, llr in zip(rows["pos"].tolist(), rows["at_ms"].tolist(), rows["llr"].tolist()):
        if last is not None and pos <= last:
            late += 1
            continue
        last, x = pos, _grown(x) + llr
        alarm = not alarmed and x >= L.ALARM_LOG_ODDS
        alarmed = alarmed or alarm
        out.append((*key, pos, at_ms, x, alarm, late))
    state.update((last, x, alarmed, late))
    yield pd.DataFrame(out, columns=["run_id", "pos", "at_ms", "x", "alarm", "late"])


def mismatch_monitor(batches: DataFrame, **kl: float) -> DataFrame:
    """Each train step (run_id, pos, at_ms, kl, ratio_mean, ratio_se) with the log odds of a mismatch after it; one that
    comes after a later one of its run is dropped and counted in `late`."""
    rows = batches.select("run_id", F.col("pos").cast("long").alias("pos"), "at_ms", detect.mismatch_llr(**kl).alias("llr"))
    return rows.groupBy("run_id").applyInPandasWithState(_observe_mismatch, MISMATCH_OUT, "pos long, x double, alarmed boolean, late long", "append", GroupStateTimeout.NoTimeout)


def idempotent_sink(path: str):
    """For foreachBatch: each micro-batch owns the folder of its number, which a repeated one writes anew, so each row is there once."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return put
