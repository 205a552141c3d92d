"""All queries by name, and SQL for those that SQL can express. Names are the operators' identifiers in the inventory."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import likelihood as L
from .functions import outcome as O
from .functions import signatures as S
from .functions import traces
from .operators import detect, evaluate, faults, lookup, mismatch, runscore, steps, telemetry, validate, windows
from .sources import runs
from .sources.events import CHANGED, HEALTHY, read_table, records

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def r(c, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zeros."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


WINDOWS_SQL = f"""
with {CHANGED}, w as (
  select *, (row_number() over (partition by source order by started_at_ms, unit_id, attempt) - 1) // 50 as "index" from records where kind in ('eval', 'trajectory')
)
select run_id, source, "index"::bigint as "index", count(*) units, arg_min(unit_id, (started_at_ms, unit_id, attempt)) first_unit_id,
  round(avg(reward), 6) + 0.0 avg_reward, round(avg(reward) filter (failure_class is null or failure_class not in ('grader', 'infra')), 6) + 0.0 avg_reward_no_infra,
  round(count(*) filter (reward = 0) / nullif(count(reward), 0), 6) + 0.0 zero_reward_rate,
  round(count(*) filter (failure_class = 'infra') / count(*), 6) + 0.0 infra_error_rate, round(count(*) filter (failure_class = 'grader') / count(*), 6) + 0.0 grader_error_rate,
  count(*) filter (failure_class in ('grader', 'infra') and reward is not null) poisoned_units
from w group by all
"""


@query("F1_E2_source_windows", WINDOWS_SQL)
def source_windows(spark, sf_dir) -> DataFrame:
    w = windows.source_windows(records(spark, sf_dir))
    rates = {"avg_reward", "avg_reward_no_infra", "zero_reward_rate", "infra_error_rate", "grader_error_rate"}
    return w.select(*[r(c).alias(c) if c in rates else F.col(c) for c in w.columns])


@query("E1_summary", f"with {CHANGED} select count(failure_class) failures, count(*) units, count(*) filter (failure_class = 'infra') infra, count(*) filter (failure_class = 'agent') agent, count(*) filter (failure_class = 'grader') grader, count(*) filter (failure_class = 'timeout') timeout, round(coalesce(sum(value) filter (failure_class is not null), 0) / 3600, 6) gpu_hours_lost from records")
def show_summary(spark, sf_dir):
    s = windows.summary(records(spark, sf_dir))
    return s.withColumn("gpu_hours_lost", r("gpu_hours_lost"))


NESTED = """
nested as (
  select *, case when failure_kind is null then 'ok' else 'failed' end outcome, case when failure_kind is not null then 'rollout' end failure_stage, (ended_at_ms - started_at_ms) / 1000 * 4 cpu_seconds, (ended_at_ms - started_at_ms) / 1000 * 2 gpu_seconds, k::bigint tokens_in, tokens_out::bigint tokens,
    k * 1000::bigint peak, case when k % 9 = 0 then k * 0.001 end mismatch_kl, case when k % 9 = 0 then 1 - k * 0.0001 end mismatch_ratio_mean from records
)"""


def nested_records(spark, sf_dir) -> DataFrame:
    """The test records as a run directory's nested ones, assembled with two gpus and four cpus."""
    d, kind, none = records(spark, sf_dir), F.col("failure_kind"), F.lit(None).cast("string")
    d = O.assembled(d.drop("action").withColumns({"own": F.col("reward"), "reward": F.coalesce("reward", F.lit(0.0)), "stage": F.lit("rollout"), "tokens_in": F.col("k").cast("long"), "tokens_out": F.col("tokens_out").cast("long")}), {"cpu_seconds": 0.01, "gpu_seconds": 0.5, "tokens_in": 0.001, "tokens_out": 0.002}, cpus_held=4, gpus_held=2)
    struct = lambda **c: F.struct(*[v.alias(n) for n, v in c.items()])
    failure = struct(evidence=F.array(F.lit("e")), exception_type=none, kind=kind, message=F.concat(kind, F.lit(": m")), retryable=O.retryable(kind), stage=F.col("stage"))
    long = F.col("k").cast("long")
    resources = struct(gpu_total_bytes=F.array(F.lit(100).cast("long")), peak_gpu_used_bytes=F.array(long), peak_host_rss_bytes=long * 1000, sample_count=long)
    cost = struct(**{c: F.col(c) for c in ("cpu_seconds", "gpu_seconds", "tokens_in", "tokens_out", "usd")})
    mism = struct(kl=F.col("k") * F.lit(0.001), kl_standard_error=F.lit(0.1), ratio_mean=1 - F.col("k") * F.lit(0.0001), ratio_standard_error=F.lit(0.1), sequences=long, tokens=long)
    tags = F.create_map(F.lit("step"), F.col("step").cast("string"), F.lit("group"), F.col("grp"))
    decision = struct(action=F.col("action"), attempt=F.col("attempt"), reason=F.col("reason"))
    return d.select("attempt", cost.alias("cost"), decision.alias("decision"), "ended_at_ms", F.when(kind.isNotNull(), failure).alias("failure"), "kind", F.when(F.col("k") % 9 == 0, mism).alias("mismatch"), "outcome", resources.alias("resources"), "reward", "run_id", "schema_version", "source", "started_at_ms", tags.alias("tags"), "unit_id")


@query("B2_flat_projection", f"with {CHANGED}, {NESTED} select run_id, unit_id, attempt, kind, source, outcome, failure_class, failure_kind, failure_stage, case when failure_kind is null then 'score' when failure_class in ('infra', 'grader') then 'mask' else 'zero' end decision, case when failure_kind is null then reward when failure_class in ('agent', 'timeout') then 0.0 end reward, started_at_ms, ended_at_ms, round(cpu_seconds, 6) cpu_seconds, round(gpu_seconds, 6) gpu_seconds, tokens_in, tokens tokens_out, round(cpu_seconds * 0.01 + gpu_seconds * 0.5 + tokens_in * 0.001 + tokens * 0.002, 6) usd, peak peak_host_rss_bytes, round(mismatch_kl, 6) mismatch_kl, round(mismatch_ratio_mean, 6) mismatch_ratio_mean from nested")
def flat_projection(spark, sf_dir):
    f = runs.flat(nested_records(spark, sf_dir))
    real = ("cpu_seconds", "gpu_seconds", "usd", "mismatch_kl", "mismatch_ratio_mean")
    return f.select(*[F.round(c, 6).alias(c) if c in real else F.col(c) for c in f.columns])


@query("B3_I16_assembly", f"with {CHANGED} select unit_id, 2 schema_version, case when failure_kind is null then 'ok' else 'failed' end outcome, round((ended_at_ms - started_at_ms) / 1000 * 8, 6) cpu_seconds, round((ended_at_ms - started_at_ms) / 1000 * 2, 6) gpu_seconds, case when tokens_out <> 0 then null else round((ended_at_ms - started_at_ms) / 1000 * 8 * 0.01 + (ended_at_ms - started_at_ms) / 1000 * 2 * 0.5, 6) end usd, case when failure_kind is null then 'unit succeeded' when failure_kind = 'sandbox' then 'sandbox is retryable; attempt 1 of 2' else failure_class || ' failure ' || failure_kind || ' at tool: on_' || failure_class || '=' || case when failure_class = 'grader' then 'mask' else 'zero' end end reason from records")
def assembly(spark, sf_dir):
    units = records(spark, sf_dir).drop("action").withColumns({"stage": F.lit("tool"), "tokens_in": F.lit(0).cast("long"), "tokens_out": F.col("tokens_out").cast("long")})
    done = O.assembled(units, {"cpu_seconds": 0.01, "gpu_seconds": 0.5, "tokens_in": 0.001, "tokens_out": None}, cpus_held=8, gpus_held=2, policy=O.Policy(max_attempts=2))
    return done.select("unit_id", "schema_version", "outcome", *[F.round(c, 6).alias(c) for c in ("cpu_seconds", "gpu_seconds", "usd")], "reason")


@query("A11_A12_envelope", f"with {CHANGED} select run_id, count(*) spans, min(unit_id) first_unit, max(unit_id) last_unit, 'probe' service from records group by run_id")
def span_envelope(spark, sf_dir):
    request = runs.envelope(runs.spans(runs.in_order(nested_records(spark, sf_dir)), "trace"), "probe").withColumn("v", F.parse_json("request"))
    at = lambda path, t: F.variant_get("v", path, t)
    spans = at("$.resourceSpans[0].scopeSpans[0].spans", "array<variant>")
    unit = lambda x: F.get(F.transform(F.filter(F.variant_get(x, "$.attributes", "array<variant>"), lambda a: F.variant_get(a, "$.key", "string") == "rl.unit_id"), lambda a: F.variant_get(a, "$.value.stringValue", "string")), F.lit(0))
    each = request.select("run_id", spans.alias("s"), at("$.resourceSpans[0].resource.attributes[0].value.stringValue", "string").alias("service"))
    ends = each.select("run_id", F.size("s").cast("long").alias("spans"), unit(F.get("s", F.lit(0))).alias("first_unit"), unit(F.element_at("s", -1)).alias("last_unit"), "service")
    return ends.groupBy("run_id").agg(F.sum("spans").alias("spans"), F.min("first_unit").alias("first_unit"), F.max("last_unit").alias("last_unit"), F.min("service").alias("service"))


@query("B5_B4_decisions", f"with {CHANGED}, d as (select unit_id, reward, case when failure_kind is null then 'score' when failure_kind = 'sandbox' then 'retry' when failure_class in ('grader', 'infra') then 'mask' else 'zero' end first_action, case when failure_kind is null then 'score' when failure_class in ('grader', 'infra') then 'mask' else 'zero' end last_action from records) select unit_id, first_action, last_action, case last_action when 'score' then reward when 'zero' then 0.0 end trainer_reward from d")
def decisions(spark, sf_dir):
    d, kind, p = records(spark, sf_dir), F.col("failure_kind"), O.Policy(max_attempts=2)
    d = d.withColumn("first_action", O.decide(kind, F.lit(1), p)).withColumn("last_action", O.decide(kind, F.lit(2), p))
    return d.select("unit_id", "first_action", "last_action", O.reward_for(F.col("last_action"), F.col("reward")).alias("trainer_reward"))


@query("B6_cost", f"with {CHANGED} select unit_id, round(k * 0.0001 + value * 0.002, 6) usd_full, case when tokens_out <> 0 then null else round(k * 0.0001 + value * 0.002, 6) end usd_unpriced_tokens from records")
def cost(spark, sf_dir):
    q = {"cpu": F.col("k").cast("double"), "gpu": F.col("value"), "out": F.col("tokens_out").cast("double")}
    full = {k: v for k, v in q.items() if k != "out"}
    prices = {"cpu": 0.0001, "gpu": 0.002, "out": None}
    return records(spark, sf_dir).select("unit_id", r(O.usd(full, prices)).alias("usd_full"), r(O.usd(q, prices)).alias("usd_unpriced_tokens"))


@query("B7_B8_B11_B12_B14_fields", f"with {CHANGED} select unit_id, attempt tp_attempt, action tp_decision, failure_class tp_failure_class, failure_kind tp_failure_kind, unit_id tp_unit_id, coalesce(failure_class || '/' || failure_kind || '@rollout', '-') log_line, case when failure_kind is null then 'Submitted' when failure_kind = 'agent_exception' then 'AgentError' when failure_kind = 'wall_clock' then 'TimeLimitExceeded' when failure_kind = 'missing_reward' then 'VerifierError' else 'SandboxUnavailable' end exit_status, action in ('score', 'zero') trainable, coalesce(reward, 0.0) reward, action = 'mask' remove_sample, case when action = 'mask' then 'failed' end status from records")
def fields(spark, sf_dir):
    kind, action = F.col("failure_kind"), F.col("action")
    return records(spark, sf_dir).select("unit_id", *O.outcome_fields(), O.log_line(kind, F.lit("rollout")).alias("log_line"), O.trainable(action).alias("trainable"), *O.sample_fields())


@query("B10_headroom", f"with {CHANGED} select unit_id, cast(floor((100 - k) * 100 / 100) as bigint) percent, case when floor((100 - k) * 100 / 100) < 10 then 'gpu memory headroom is ' || (100 - k) || '% of 100.0 GiB, below the 10% warning threshold while the longest sample is ' || tokens_out || ' tokens; lower max_tokens_per_gpu or gpu_memory_utilization before the next step' end warning from records")
def headroom(spark, sf_dir):
    gib = lambda x: x.cast("long") * 2**30
    used, total = gib(F.col("k")), gib(F.lit(100))
    return records(spark, sf_dir).select("unit_id", O.headroom_percent(used, total).cast("long").alias("percent"), O.headroom_warning(used, total, F.col("tokens_out")).alias("warning"))


@query("C1_C5_filters", f"with {CHANGED} select unit_id, failure_class in ('grader', 'infra') and failure_class is not null non_agent, failure_class is not null and failure_class in ('grader', 'infra') and reward is not null poisoned, case when failure_class is null or failure_class not in ('grader', 'infra') then reward end clean_reward from records where failure_kind is not null")
def filters(spark, sf_dir):
    d, kind = records(spark, sf_dir).where("failure_kind is not null"), F.col("failure_kind")
    return d.select("unit_id", O.non_agent(kind).alias("non_agent"), O.poisoned(kind, F.col("reward")).alias("poisoned"), O.clean_reward(kind, F.col("action"), F.col("reward")).alias("clean_reward"))


@query("D1_unfinished", f"with {CHANGED} select m.unit_id, m.started_at_ms at_ms from records m where k < 50 and k % 3 = 0")
def unfinished(spark, sf_dir):
    d = records(spark, sf_dir)
    markers = d.where("k < 50").select("unit_id", "attempt", F.col("started_at_ms").alias("at_ms"))
    return windows.without_record(markers, d.where("k % 3 <> 0")).select("unit_id", "at_ms")


@query("G3_source_order", f"with {CHANGED} select source, row_number() over (order by source nulls last) position, count(*) n from records group by source")
def source_order(spark, sf_dir):
    from pyspark.sql import Window as W

    d = records(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return d.withColumn("position", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))).cast("long"))


@query("G1_unit_order", f"with {CHANGED} select row_number() over (order by unit_id, attempt) place, unit_id, attempt from records where k % 10 = 3")
def unit_order(spark, sf_dir):
    """Rows come ordered by unit and attempt; the place counts them as they come."""
    rows = records(spark, sf_dir).where("k % 10 = 3").select("unit_id", "attempt").orderBy("unit_id", "attempt")
    return rows.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)


@query("I3_C6_log_likelihoods", f"with {CHANGED} select unit_id, round(case when failure_kind is not null then ln(0.16::double / 0.02::double) else ln(1 - 0.16::double) - ln(1 - 0.02::double) end, 9) bernoulli, round(4 * ((value - 1.5) / 0.5) / 0.5 * 0.25::double, 6) gaussian from records where value is not null")
def log_likelihoods(spark, sf_dir):
    v = F.col("value")
    d = records(spark, sf_dir).where("value is not null")
    return d.select("unit_id", F.round(L.bernoulli(F.col("failure_kind").isNotNull(), 0.02, 0.16), 9).alias("bernoulli"), F.round(L.gaussian(v, 1.0, 2.0, F.lit(0.5)), 6).alias("gaussian"))


@query("A13_identifiers", f"with {CHANGED} select unit_id, substr(sha256('trace' || chr(31) || run_id || chr(31) || unit_id), 1, 32) trace_id, substr(sha256('span' || chr(31) || run_id || chr(31) || unit_id || chr(31) || attempt), 1, 16) span_id from records")
def identifiers(spark, sf_dir):
    # the separator is a parameter of the comparison: DuckDB's chr(0) ends a string
    run, unit = F.col("run_id"), F.col("unit_id")
    span = O.identifier(16, "span", run, unit, F.col("attempt").cast("string"), separator=chr(31))
    return records(spark, sf_dir).select("unit_id", O.identifier(32, "trace", run, unit, separator=chr(31)).alias("trace_id"), span.alias("span_id"))


EXEC_KIND = "case when k % 10 = 0 then 'wall_clock' when k % 10 < 4 then null when k % 10 = 4 then 'oom_gpu' when k % 10 < 6 then null when k % 10 = 6 or k > 90 then 'oom_host' else 'process_killed' end"


@query("J5_exec_failures", f"with {CHANGED}, e as (select unit_id, k, {EXEC_KIND} kind from records) select unit_id, kind, case kind when 'wall_clock' then 'wall_clock: process exceeded its timeout after ' || k || ' ms' when 'oom_gpu' then 'oom_gpu: process reported CUDA out of memory' when 'oom_host' then 'oom_host: process was killed near the host memory limit' when 'process_killed' then 'process_killed: process was killed by signal 9' end message, case kind when 'wall_clock' then 'elapsed_ms=' || k when 'oom_gpu' then 'peak_gpu_used_bytes=[' || k || ', 7]' when 'oom_host' then 'host_limit_bytes=101;peak_host_rss_bytes=' || k when 'process_killed' then 'signal=9' end evidence, kind = 'process_killed' retryable from e")
def exec_failures(spark, sf_dir):
    d, k = F.col("k") % 10, F.col("k").cast("long")
    text = F.when(d == 4, "x CUDA out of memory x").when(d == 6, "Killed").otherwise("")
    signal, limit = F.when(d >= 6, 9), F.lit(101).cast("long")
    kind = O.classify_exec(d == 0, F.when(d < 4, 0).when(d < 6, 1), signal, text, k, limit)
    f = O.exec_failure(kind, F.lit("tool"), k, signal, F.array(k, F.lit(7).cast("long")), k, limit)
    return records(spark, sf_dir).select("unit_id", f.alias("f")).select("unit_id", "f.kind", "f.message", F.array_join("f.evidence", ";").alias("evidence"), "f.retryable")


STEPS = """
u as (
  select *, case when failure_class is null or failure_class not in ('grader', 'infra') then reward end clean, coalesce(failure_class in ('grader', 'infra'), false)::int::double failed from records
), g as (
  select source, step, grp, count(*)::double n, sum(failed) f, count(clean)::double cn, coalesce(sum(clean), 0)::double cs from u group by all
), s as (
  select source, step, sum(n) n, sum(f) f, count(*) clusters, sum(cn) cn, sum(cs) cs, count(*) filter (cn > 0) cc from g group by all
), v as (
  select g.source, g.step, sum(pow(g.f - s.f / s.n * g.n, 2)) fv, sum(pow(g.cs - case when s.cn > 0 then s.cs / s.cn end * g.cn, 2)) cv from g join s on g.source is not distinct from s.source and g.step = s.step group by g.source, g.step
), sds as (
  select source, step, stddev_samp(clean) clean_sd, arg_max(unit_id, (started_at_ms, unit_id)) unit_id, max(started_at_ms) at_ms from u group by all
), obs as (
  select s.source, s.step, n::bigint units, f::bigint failures, clusters, case when clusters > 1 then clusters / (clusters - 1) * fv / (n * n) end failure_variance,
    cn::bigint clean_count, case when cn > 0 then cs / cn end clean_mean, case when cc > 1 then cc / (cc - 1) * cv / (cn * cn) end clean_variance, clean_sd, unit_id, at_ms
  from s join v on s.source is not distinct from v.source and s.step = v.step join sds on s.source is not distinct from sds.source and s.step = sds.step
), eff as (
  select *, case when failures = 0 or failures = units or failure_variance is null then 1.0 else least(greatest(failure_variance / ((failures / units) * (1 - failures / units) / units), 1.0), units / clusters) end design from obs
)"""
STEPS_SQL = STEPS


@query("E3_E6_step_observations", f"with {CHANGED}, {STEPS_SQL} select source, step, units, failures, clusters, round(failure_variance, 6) + 0.0 failure_variance, clean_count, round(clean_mean, 6) + 0.0 clean_mean, round(clean_variance, 6) + 0.0 clean_variance, round(clean_sd, 6) + 0.0 clean_sd, unit_id, at_ms, round(design, 6) + 0.0 design from eff")
def step_observations(spark, sf_dir):
    o = steps.step_observations(records(spark, sf_dir)).withColumn("design", steps.design_effect()).drop("run_id")
    real = {"failure_variance", "clean_mean", "clean_variance", "clean_sd", "design"}
    return o.select(*[r(c).alias(c) if c in real else F.col(c) for c in o.columns])


def fold_sql(llr: str, key: str = "source") -> str:
    """Recursion in step order over a CTE llr (key, pos, llr)."""
    h, one = math.log(L.HAZARD), math.log1p(-L.HAZARD)
    return f"""
{llr}, o as (select *, row_number() over (partition by {key} order by pos) i from llr), f as (
  select {key}, pos, i, {h} - ({one}) + llr x from o where i = 1
  union all
  select o.{key}, o.pos, o.i, greatest(f.x, {h}) + ln(1 + exp(-abs(f.x - ({h})))) - ({one}) + o.llr from f join o on f.{key} is not distinct from o.{key} and o.i = f.i + 1
)"""


FAILURE_LLR = f"llr as (select source, step pos, (failures * ln({detect.BROKEN_RATE / detect.HEALTHY_RATE}) + (units - failures) * ({math.log1p(-detect.BROKEN_RATE) - math.log1p(-detect.HEALTHY_RATE)})) / design llr from eff)"
REWARD_LLR = f"""
inf as (
  select *, pow(clean_mean - lag(clean_mean) over (partition by source order by step), 2) d2 from obs where clean_mean is not null and clean_variance is not null
), lagged as (
  select *, avg(clean_mean) over (partition by source order by step rows between 30 preceding and 11 preceding) loc, avg(d2) over (partition by source order by step rows between 209 preceding and 11 preceding) succ,
    count(*) over w m, avg(clean_variance) over w usual, avg(clean_sd) over w sd from inf window w as (partition by source order by step rows between 210 preceding and 11 preceding)
), par as (
  select source, step pos, clean_mean y, loc, greatest(1.0, 2 * pow(m - 1, 2) / (3 * m - 4)) nu, greatest(sqrt(succ / 2 * 1.05 + greatest(0, clean_variance - usual)), 0.05 / sqrt(clean_count)) sc, 0.25 * greatest(coalesce(sd, 0), 0.05) sh from lagged where m >= 20
), llr as (
  select source, pos, -(nu + 1) / 2 * (ln(1 + pow((y - loc + sh) / sc, 2) / nu) - ln(1 + pow((y - loc) / sc, 2) / nu)) llr from par
)"""


@query("F8_failure_rate_stream", f"with recursive {CHANGED}, {STEPS_SQL}, {fold_sql(FAILURE_LLR)} select source, pos, round(x, 5) + 0.0 x from f")
def failure_rate_stream(spark, sf_dir):
    return detect.failure_rate_stream(steps.step_observations(records(spark, sf_dir))).select("source", "pos", r("x", 5).alias("x"))


@query("F9_reward_stream", f"with recursive {CHANGED}, {STEPS_SQL}, {fold_sql(REWARD_LLR)} select source, pos, round(x, 5) + 0.0 x from f")
def reward_stream(spark, sf_dir):
    return detect.reward_stream(steps.step_observations(records(spark, sf_dir))).select("source", "pos", r("x", 5).alias("x"))


@query("F11_failure_rate_alarms", f"with recursive {CHANGED}, {STEPS_SQL}, {fold_sql(FAILURE_LLR)} select source, min(pos) pos from f where x >= {L.ALARM_LOG_ODDS} group by source")
def failure_rate_alarms(spark, sf_dir):
    s = detect.failure_rate_stream(steps.step_observations(records(spark, sf_dir)))
    return detect.first_crossing(s, ["run_id", "source"]).select("source", "pos")


@query("F11_reward_alarms_healthy", f"with recursive {HEALTHY}, {STEPS_SQL}, {fold_sql(REWARD_LLR)} select source, min(pos) pos from f where x >= {L.ALARM_LOG_ODDS} group by source")
def reward_alarms(spark, sf_dir):
    s = detect.reward_stream(steps.step_observations(records(spark, sf_dir, healthy=True)))
    return detect.first_crossing(s, ["run_id", "source"]).select("source", "pos")


@query("F14_first_poisoned", f"with {CHANGED} select source, arg_min(unit_id, (started_at_ms, unit_id)) unit_id, min(started_at_ms) at_ms from records where failure_class in ('grader', 'infra') and reward is not null group by source")
def first_poisoned(spark, sf_dir):
    return detect.first_poisoned(records(spark, sf_dir)).select("source", "unit_id", "at_ms")


BATCHES = """
ev as (select *, cast(json_extract_string(props, '$.k') as integer) k, event_id // 50 pos from events), sq as (
  select pos, epoch_us(ts) // 1000 ms, k + 1.0 t, value * (case when ts >= '2024-01-11' then 30 else 1 end) * 1e-5 * (k + 1) k3, (k + 1) * (1 + (k - 50) * 1e-4) ra from ev
), tot as (select pos, count(*) n, sum(t) t, sum(k3) / sum(t) kl, sum(ra) / sum(t) ra, max(ms) ms from sq group by pos having count(*) > 1), bt as (
  select 'run-1' run_id, tot.pos, any_value(n) sequences, any_value(tot.t) tokens, any_value(kl) kl, sqrt(any_value(n) / (any_value(n) - 1) * sum(pow(sq.k3 - kl * sq.t, 2))) / any_value(tot.t) kl_se,
    any_value(tot.ra) ratio_mean, sqrt(any_value(n) / (any_value(n) - 1) * sum(pow(sq.ra - tot.ra * sq.t, 2))) / any_value(tot.t) ratio_se, any_value(tot.ms) at_ms from sq join tot on sq.pos = tot.pos group by tot.pos
)"""


def mismatch_batches(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    c = F.when(F.col("ts") >= F.lit("2024-01-11").cast("timestamp"), 30).otherwise(1)
    e = read_table(spark, sf_dir, "events").select(F.lit("run-1").alias("run_id"), F.expr("event_id div 50").alias("pos"), (k + 1).cast("double").alias("tokens"), (F.col("value") * c * 1e-5 * (k + 1)).alias("k3"), ((k + 1) * (1 + (k - 50) * 1e-4)).alias("ratio"))
    return mismatch.batch_summaries(e, "run_id", "pos")


@query("E8_mismatch_batches", f"with {BATCHES} select pos, sequences, tokens, round(kl, 9) kl, round(kl_se, 9) kl_se, round(ratio_mean, 9) ratio_mean, round(ratio_se, 9) ratio_se from bt")
def batches(spark, sf_dir):
    b = mismatch_batches(spark, sf_dir)
    return b.select("pos", "sequences", "tokens", *[F.round(c, 9).alias(c) for c in ("kl", "kl_se", "ratio_mean", "ratio_se")])


MISMATCH_LLR = f"""
terms as (
  select run_id, pos, ratio_se, ({math.log10(1e-2)} - ({math.log10(1e-3)})) / 0.5 * ((log10(greatest(kl, 1e-12)) - ({(math.log10(1e-3) + math.log10(1e-2)) / 2})) / 0.5) a, -0.01 / greatest(ratio_se, 1e-9) * ((ratio_mean - 0.995) / greatest(ratio_se, 1e-9)) b from bt
), llr as (select run_id, pos, case when ratio_se = 0 then a else greatest(a, b) + ln(1 + exp(-abs(a - b))) - ln(2) end llr from terms)"""


@query("F10_mismatch_stream", f"with recursive {BATCHES}, {fold_sql(MISMATCH_LLR, 'run_id')} select pos, round(x, 4) + 0.0 x from f")
def mismatch_stream(spark, sf_dir):
    return detect.mismatch_stream(mismatch_batches(spark, sf_dir)).select("pos", r("x", 4).alias("x"))


@query("E7_sequence_sums", "with d as (select vec_id, unnest(list_transform(list_zip(embedding, list_reverse(embedding)), lambda x: least(greatest(-abs(x[1]::double) + 0.9 * abs(x[2]::double), -20), 20))) d from embeddings) select vec_id, count(*) tokens, round(sum(greatest(0, exp(d) - 1 - d)), 6) k3, round(sum(exp(d)), 6) ratio from d group by vec_id")
def sequence_sums(spark, sf_dir):
    train = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    rollout = F.transform(F.reverse("embedding"), lambda x: F.lit(-0.9) * F.abs(x.cast("double")))
    s = read_table(spark, sf_dir, "embeddings").select("vec_id", mismatch.sequence_sums(train, rollout).alias("s"))
    return s.select("vec_id", "s.tokens", F.round("s.k3", 6).alias("k3"), F.round("s.ratio", 6).alias("ratio"))


@query("E9_peaks", "select l_orderkey, count(*) sample_count, max(floor(l_extendedprice)::bigint) peak_host_rss_bytes, [max(floor(l_quantity)::bigint), max(floor(1000 * l_discount + 0.5)::bigint)]::varchar devices from lineitem group by l_orderkey")
def peaks(spark, sf_dir):
    long = lambda c: F.floor(c).cast("long")
    samples = read_table(spark, sf_dir, "lineitem").select("l_orderkey", long(F.col("l_extendedprice")).alias("host_rss_bytes"), F.array(long(F.col("l_quantity")), long(1000 * F.col("l_discount") + 0.5)).alias("gpu_used_bytes"))
    p = telemetry.peaks(samples, "l_orderkey", devices=2)
    return p.select("l_orderkey", "sample_count", "peak_host_rss_bytes", F.concat(F.lit("["), F.array_join("peak_gpu_used_bytes", ", "), F.lit("]")).alias("devices"))


SERIES = """
cells as (select user_id run, event_type feature, day(ts) step, avg(value) v from events group by all), normal as (select * from cells where run % 6 = 0),
pm as (select feature, step, avg(v) m, var_samp(v) va from normal group by all), ps as (select feature, greatest(coalesce(sqrt(avg(va)), 0), 0.01 * avg(abs(m)), 1e-9) sp from pm group by feature),
z as (select run, cells.feature, count(*) n, sum((v - m) / sp) s from cells join pm on cells.feature = pm.feature and cells.step = pm.step join ps on cells.feature = ps.feature group by all),
fa as (select run, feature, -0.5 * ln(1 + n * 0.09) + s * s * 0.09 / (2 * (1 + n * 0.09)) factor from z),
sc as (select fa.run, any_value(top) + ln(avg(exp(factor - top))) score from fa join (select run, max(factor) top from fa group by run) t on fa.run = t.run group by fa.run)"""


def run_series(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("feature"), F.dayofmonth("ts").alias("step")).agg(F.avg("value").alias("value"))


def run_scores(spark, sf_dir) -> DataFrame:
    cells = run_series(spark, sf_dir)
    means, spreads = runscore.profile(cells.where("run % 6 = 0"))
    return runscore.scores(runscore.shift_factors(cells, means, spreads))


@query("E10_E13_run_scores", f"with {SERIES} select run, round(score, 6) + 0.0 score from sc")
def scored_runs(spark, sf_dir):
    return run_scores(spark, sf_dir).select("run", r("score").alias("score"))


@query("E16_threshold", f"with {SERIES} select round(avg(score) + 1.5 * stddev_samp(score), 6) as threshold from sc where run % 6 = 0")
def run_threshold(spark, sf_dir):
    return runscore.threshold(run_scores(spark, sf_dir).where("run % 6 = 0"), 1.5).select(r("threshold").alias("threshold"))


TELEMETRY_SQL = """
with t as (select user_id run, day(ts) step, event_type, case when cast(json_extract_string(props, '$.k') as integer) % 11 > 0 then value end v from events)
select run, step, count(*) "count", round(avg(v), 6) value_mean, round(stddev_pop(v), 6) + 0.0 value_sd, round(count(*) filter (event_type = 'error') / count(*), 6) error_rate from t group by run, step
"""


@query("E19_C8_telemetry", TELEMETRY_SQL)
def step_telemetry(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int") % 11
    value = F.when(k > 0, F.col("value")).otherwise(F.lit(float("nan")))
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.dayofmonth("ts").alias("step"), F.create_map(F.lit("value"), value).alias("metrics"), F.create_map(F.lit("error"), F.col("event_type") == "error").alias("flags"))
    t = telemetry.step_statistics(rows, "run", "step", metrics=["value"], flags=["error"])
    return t.select("run", "step", "count", r("value_mean").alias("value_mean"), r("value_sd").alias("value_sd"), F.round("error_rate", 6).alias("error_rate"))


@query("C11_injected", "select user_id run, bool_or(event_type = 'error' and cast(json_extract_string(props, '$.k') as integer) % 7 > 0) injected from events group by user_id")
def injected_runs(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.when(F.col("event_type") == "error", "reward").otherwise("").alias("fault_type"), (k % 7).cast("double").alias("fault_strength"))
    return telemetry.injected(rows, "run")


@query("D3_as_of", f"with {BATCHES}, p as (select event_id, epoch_us(ts) // 1000 at_ms from events), h as (select ms at_ms, kl from tot) select p.event_id, round(coalesce(h.kl, 0), 9) kl from p asof left join h on p.at_ms >= h.at_ms")
def as_of(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(F.lit("run-1").alias("run_id"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    times = e.groupBy(F.expr("event_id div 50").alias("pos")).agg(F.max("at_ms").alias("at_ms"), F.first("run_id").alias("run_id"))
    history = mismatch_batches(spark, sf_dir).select("pos", "kl").join(times, "pos").select("run_id", "at_ms", "pos", "kl")
    return detect.as_of(e, history, by="run_id", time="at_ms", value="kl", tie="pos").select("event_id", F.round("kl", 9).alias("kl"))


@query("X1_savings", "select c_custkey, c_nationkey * 2.5 * greatest(0.0, c_acctbal - 100 - 24) savings from customer")
def savings(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", O.savings(F.col("c_nationkey"), F.lit(2.5), F.col("c_acctbal"), F.lit(100), F.lit(24)).alias("savings"))


VIOLATIONS_SQL = rf"""
with {CHANGED}, b as (
  select event_id, case when k % 20 = 1 then '-' else '' end || unit_id unit_id, case when k % 20 = 2 then 0 else 1 end attempt, kind, action, started_at_ms, case when k % 20 = 3 then started_at_ms - 1 else ended_at_ms end ended_at_ms,
    case when failure_kind is null or k % 20 = 4 then 'ok' else 'failed' end outcome, failure_kind, case when k % 20 = 5 then 'nan'::double when k % 20 = 6 then 1.0 when k % 20 <> 7 then reward end reward
  from records join (select event_id, 'u-' || lpad(event_id::varchar, 8, '0') uid from events) e on uid = unit_id
), rules as (
  select event_id, unnest([case when not regexp_full_match(unit_id, '[A-Za-z0-9][A-Za-z0-9_.-]{{0,127}}') then 'V2' end, case when attempt < 1 then 'V3' end, case when ended_at_ms < started_at_ms then 'V4' end,
    case when (outcome = 'failed') <> (failure_kind is not null) then 'V5' end, case when (outcome = 'ok') <> (action = 'score') then 'V6' end, case when action = 'zero' and reward is distinct from 0.0 then 'V7' end,
    case when action in ('mask', 'retry', 'abort') and reward is not null then 'V8' end, case when action = 'score' and kind in ('eval', 'trajectory') and reward is null then 'V9' end, case when not isfinite(reward) then 'V10' end]) as rule from b
) select event_id, rule from rules where rule is not null
"""


@query("V2_V10_violations", VIOLATIONS_SQL)
def row_violations(spark, sf_dir):
    d, t = records(spark, sf_dir), F.col("k") % 20
    d = d.withColumn("event_id", F.substring("unit_id", 3, 8).cast("long")).withColumn("outcome", F.when(F.col("failure_kind").isNull() | (t == 4), "ok").otherwise("failed"))
    d = d.withColumn("unit_id", F.concat(F.when(t == 1, "-").otherwise(""), "unit_id")).withColumn("attempt", F.when(t == 2, 0).otherwise(1))
    d = d.withColumn("ended_at_ms", F.when(t == 3, F.col("started_at_ms") - 1).otherwise(F.col("ended_at_ms")))
    d = d.withColumn("reward", F.when(t == 5, float("nan")).when(t == 6, 1.0).when(t != 7, F.col("reward")))
    return validate.violations(d, "event_id")


@query("V17_duplicates", "select user_id, event_type, count(*) n from events group by all having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return validate.duplicates(read_table(spark, sf_dir, "events"), "user_id", "event_type")


ATTRIBUTION_SQL = f"""
with recursive {HEALTHY}, {STEPS_SQL}, {BATCHES}, fr as (with recursive {fold_sql(FAILURE_LLR)} select * from f), rw as (with recursive {fold_sql(REWARD_LLR)} select * from f), mm as (with recursive {fold_sql(MISMATCH_LLR, 'run_id')} select * from f),
alarms as (select source, min(pos) pos from rw where x >= {L.ALARM_LOG_ODDS} group by source), nums as (
  select source, step, at_ms, row_number() over w i, count(*) over (partition by source) n from obs window w as (partition by source order by step)
), hits as (
  select a.source, a.pos, t.at_ms, 1 / (1 + exp(-fr.x)) pf from alarms a join nums o on o.source is not distinct from a.source and o.step = a.pos
    join nums t on t.source is not distinct from a.source and t.i = least(o.i + 5, o.n) join fr on fr.source is not distinct from a.source and fr.pos = t.step
), history as (select bt.at_ms, 1 / (1 + exp(-mm.x)) pm from mm join bt on bt.pos = mm.pos), p as (
  select hits.*, coalesce(h.pm, 0.0) pm, 1 - (1 - pf) * (1 - coalesce(h.pm, 0.0)) pc from hits asof left join history h on hits.at_ms >= h.at_ms
) select source, pos, at_ms, round(pf, 6) + 0.0 failure_rate_probability, round(pm, 6) + 0.0 mismatch_probability, round(pc, 6) + 0.0 configuration_probability, case when pc >= 0.999 then 'configuration' when pc < 0.5 then 'algorithm' else 'undetermined' end verdict from p
"""


def reward_attributions(spark, sf_dir) -> DataFrame:
    o = steps.step_observations(records(spark, sf_dir, healthy=True))
    alarms = detect.first_crossing(detect.reward_stream(o), ["run_id", "source"]).drop("x")
    times = read_table(spark, sf_dir, "events").groupBy(F.expr("event_id div 50").alias("pos")).agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("at_ms"))
    history = detect.with_probabilities(mismatch_batches(spark, sf_dir).join(times, "pos"))
    return detect.attributed(alarms, o, detect.failure_rate_stream(o), history)


@query("F12_D6_attribution", ATTRIBUTION_SQL)
def attribution(spark, sf_dir):
    return reward_attributions(spark, sf_dir).select("source", "pos", "at_ms", *[r(c).alias(c) for c in ("failure_rate_probability", "mismatch_probability", "configuration_probability")], "verdict")


@query("E22_verdicts", f"select verdict, count(*) n from ({ATTRIBUTION_SQL}) group by verdict")
def verdicts(spark, sf_dir):
    return evaluate.verdict_counts(reward_attributions(spark, sf_dir))


def factor_sql(by: str) -> str:
    """Scores sc of cells by the profile of rows train, both with the columns by."""
    on = lambda a, b: " and ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in by.split(","))
    cols = ", ".join(f"c.{c.strip()}" for c in by.split(","))
    return f"""
pm as (select {by}, feature, step, avg(v) m, var_samp(v) va from train group by all), ps as (select {by}, feature, greatest(coalesce(sqrt(avg(va)), 0), 0.01 * avg(abs(m)), 1e-9) sp from pm group by all),
z as (select {cols}, c.run, c.feature, count(*) n, sum((v - m) / sp) s from cells c join pm on {on('c', 'pm')} and c.feature = pm.feature and c.step = pm.step join ps on {on('c', 'ps')} and c.feature = ps.feature group by all),
fa as (select z.*, -0.5 * ln(1 + n * 0.09) + s * s * 0.09 / (2 * (1 + n * 0.09)) factor from z),
sc as (select {by}, run, max(factor) + ln(sum(exp(factor - top)) / count(*)) score from (select *, max(factor) over (partition by {by}, run) top from fa) group by all)"""


FOLDS_SQL = f"""
with cells as (select user_id run, (user_id // 6) % 5 fold, event_type feature, day(ts) step, avg(value) v from events where user_id % 6 = 0 group by all),
train as (select run, feature, step, v, f.fold from cells join (select unnest(range(5)) fold) f on f.fold <> cells.fold), {factor_sql('fold')}
select run, fold::bigint fold, round(score, 6) + 0.0 score from sc
"""


@query("E15_D8_out_of_sample", FOLDS_SQL)
def out_of_sample(spark, sf_dir):
    normals = run_series(spark, sf_dir).where("run % 6 = 0").withColumn("fold", F.expr("(run div 6) % 5"))
    return runscore.out_of_sample_scores(normals).select("run", F.col("fold").cast("long").alias("fold"), r("score").alias("score"))


GRAINS_SQL = f"""
with base as (select user_id run, 't' || (user_id % 3) task, 'b' || ((user_id // 12) % 4) batch, event_type feature, day(ts) step, avg(value) v from events group by all),
normal as (select * from base where run % 4 = 0), nr as (select distinct run, task, batch from normal),
grain as (select b.run, (select count(*) from nr where nr.task = b.task and nr.batch = b.batch) fine, (select count(*) from nr where nr.task = b.task) coarse, b.task, b.batch from (select distinct run, task, batch from base) b),
chosen as (select run, case when fine >= 5 then 2 when coarse >= 2 then 1 else 0 end depth, case when fine >= 5 or coarse >= 2 then task else '' end task, case when fine >= 5 then batch else '' end batch from grain),
cells as (select base.run, depth, chosen.task, chosen.batch, feature, step, v from base join chosen on base.run = chosen.run),
copies as (select run, 2 depth, task, batch, feature, step, v from normal union all select run, 1, task, '', feature, step, v from normal union all select run, 0, '', '', feature, step, v from normal),
train as (select c.* from copies c join (select depth, task, batch from copies group by all having count(distinct run) >= 2) e on c.depth = e.depth and c.task = e.task and c.batch = e.batch), {factor_sql('depth, task, batch')}
select run, depth, task, batch, round(score, 6) + 0.0 score from sc
"""


@query("E17_D9_grain_scores", GRAINS_SQL)
def grain_scores(spark, sf_dir):
    cells = run_series(spark, sf_dir).withColumn("task", F.concat(F.lit("t"), (F.col("run") % 3).cast("string"))).withColumn("batch", F.concat(F.lit("b"), F.expr("cast((run div 12) % 4 as string)")))
    normals = cells.where("run % 4 = 0")
    chosen = runscore.chosen_grain(cells.select("run", "task", "batch").distinct(), normals)
    means, spreads = runscore.grain_profiles(normals)
    values = cells.drop("task", "batch").join(chosen, "run")
    return runscore.scores(runscore.shift_factors(values, means, spreads, *runscore.GRAIN), *runscore.GRAIN).select("run", "depth", "task", "batch", r("score").alias("score"))


CONFUSION_SQL = """
with runs as (select case when c_nationkey % 5 > 0 then 'f' || (c_nationkey % 5) end family, case when c_custkey % 2 = 0 then 'easy' else 'hard' end setting, c_nationkey % 5 > 0 and c_custkey % 7 > 0 faulty, c_acctbal > 4000 flagged from customer),
t as (select g.family, g.setting, count(*) filter (flagged and faulty) tp, count(*) filter (flagged and not faulty) fp, count(*) filter (not flagged and faulty) fn from (select distinct family, setting from runs where family is not null) g join runs on runs.family is null or runs.family = g.family and runs.setting = g.setting group by all),
p as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end "precision", case when tp + fn > 0 then tp / (tp + fn) else 0.0 end recall from t)
select family, setting, tp, fp, fn, round("precision", 6) "precision", round(recall, 6) recall, round(case when "precision" + recall > 0 then 2 * "precision" * recall / ("precision" + recall) else 0.0 end, 6) f1 from p
"""


@query("E18_D7_confusion", CONFUSION_SQL)
def confusion(spark, sf_dir):
    nation, cust = F.col("c_nationkey") % 5, F.col("c_custkey")
    runs = read_table(spark, sf_dir, "customer").select(F.when(nation > 0, F.concat(F.lit("f"), nation.cast("string"))).alias("family"), F.when(cust % 2 == 0, "easy").otherwise("hard").alias("setting"), ((nation > 0) & (cust % 7 > 0)).alias("faulty"), (F.col("c_acctbal") > 4000).alias("flagged"))
    t = evaluate.confusion(runs)
    return t.select("family", "setting", "tp", "fp", "fn", *[r(c).alias(c) for c in ("precision", "recall", "f1")])


@query("E20_delay_summary", f"with {CHANGED}, d as (select grp scenario, case when k % 10 > 0 then k % 37 end delay from records) select scenario, count(*) total, count(*) filter (delay is null) missed, median(delay)::double median, list_sort(list(delay) filter (delay is not null))[1 + least(count(delay) - 1, floor(0.9::double * count(delay))::bigint)]::bigint p90 from d group by scenario")
def delay_summary(spark, sf_dir):
    d = records(spark, sf_dir).select(F.col("grp").alias("scenario"), F.when(F.col("k") % 10 > 0, F.col("k") % 37).alias("delay"))
    return evaluate.delay_summary(d, "scenario").select("scenario", "total", "missed", F.col("median").cast("double").alias("median"), F.col("p90").cast("long").alias("p90"))


@query("E21_class_counts", f"with {CHANGED} select grp, count(*) filter (failure_class = 'agent') agent, count(*) filter (failure_class = 'grader') grader, count(*) filter (failure_class = 'infra') infra, count(*) filter (failure_class = 'none') \"none\" from records group by grp")
def class_counts(spark, sf_dir):
    return evaluate.counts_by(records(spark, sf_dir), "grp", "failure_class", ["agent", "grader", "infra", "none"])


@query("E23_distinct_steps", f"with {CHANGED} select source, count(distinct step) steps, count(distinct grp) clusters from records group by source")
def distinct_steps(spark, sf_dir):
    return windows.distinct_steps(records(spark, sf_dir), "source")


@query("D10_group_fill", f"with {CHANGED} select unit_id, round(coalesce(reward, avg(reward) over (partition by step, grp), 0.0), 6) filled from records")
def group_fill(spark, sf_dir):
    return records(spark, sf_dir).select("unit_id", r(evaluate.group_fill(F.col("reward"), "step", "grp")).alias("filled"))


#: Class names that records are given in turn: all of the signatures', and some that none knows.
NAMES = [*dict.fromkeys(n for _, names, _, _ in S.SIGNATURES for n in names or ()), "RuntimeError", "ValueError", "HTTPError"]
MESSAGES = ["plain", "first\nsecond", "CUDA out of memory: 2 GiB", "NCCL timeout", "Xid 79", "uncorrectable ECC error", "no room in KV cache", ""]
STATUSES = [None, 200, 408, 429, 500, 503]


def quoted(x) -> str:
    return "null" if x is None else "'" + str(x).replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join("null" if v is None else str(v) if isinstance(v, int) else quoted(v) for v in values) + "]"


RULES_SQL = "rules(priority, kind, name, fragment, prefix) as (values " + ", ".join(f"({i}, {quoted(kind)}, {quoted(n)}, {quoted(fragment)}, {quoted(prefix)})" for i, (kind, names, fragment, prefix) in enumerate(S.SIGNATURES) for n in names or (None,)) + ")"
ERRORS_SQL = f"errors as (select unit_id, k, {listed(NAMES)}[1 + (started_at_ms + k) % {len(NAMES)}] type_name, {listed(MESSAGES)}[1 + (started_at_ms // 7 + k) % {len(MESSAGES)}] message, {listed(STATUSES)}[1 + tokens_out % {len(STATUSES)}] status from records)"
RETRY_SQL = ", ".join(quoted(k) for k in O.RETRYABLE)


def errors(spark, sf_dir) -> DataFrame:
    def pick(values, by):
        return F.get(F.array(*[F.lit(v) for v in values]), by.cast("int"))

    ms = F.col("started_at_ms")
    return records(spark, sf_dir).select("unit_id", "k", pick(NAMES, (ms + F.col("k")) % len(NAMES)).alias("type_name"), pick(MESSAGES, (F.floor(ms / 7) + F.col("k")) % len(MESSAGES)).alias("message"), pick(STATUSES, F.col("tokens_out") % len(STATUSES)).alias("status"))


NAMED_SQL = f"""
with {CHANGED}, {ERRORS_SQL}, {RULES_SQL}, matched as (
  select e.*, (select arg_min(r.kind, r.priority) from rules r where (r.name is null or r.name = e.type_name and r.prefix is null) and (r.fragment is null or contains(e.message, r.fragment))) known from errors e
), judged as (select *, coalesce(known, case when status >= 500 or status in (408, 429) then 'engine_crash' else 'agent_exception' end) kind, split_part(message, chr(10), 1) line from matched)
select unit_id, kind, case when kind in ('grader_exception', 'missing_reward') then 'grade' else 'rollout' end stage, kind in ({RETRY_SQL}) retryable, kind || ': ' || type_name || ': ' || line message,
  array_to_string(list_sort(list_filter(['exception_type=' || type_name, 'message=' || line, 'status_code=' || status], lambda x: x is not null)), ';') evidence from judged
"""


@query("J1_J4_J6_J7_D11_named_errors", NAMED_SQL)
def named_errors(spark, sf_dir):
    f = S.at_grade_stage(S.classify_name(F.col("type_name"), F.col("message"), F.lit("rollout"), F.col("status")))
    return errors(spark, sf_dir).select("unit_id", f.alias("f")).select("unit_id", "f.kind", "f.stage", "f.retryable", "f.message", F.array_join("f.evidence", ";").alias("evidence"))


CHAIN_SQL = f"""
with {CHANGED}, {ERRORS_SQL}, {RULES_SQL}, links as (
  select unit_id, k, 0 depth, type_name, 'app' as module, message, 'Exception' base from errors where k % 3 > 0
  union all select unit_id, k, 1, {listed(NAMES)}[1 + (k * 5) % {len(NAMES)}], case when k % 2 = 0 then 'ray.exceptions' else 'torch' end, 'inner', case when k % 7 = 0 then 'TimeoutError' else 'RuntimeError' end from errors where k % 3 = 2
), hits as (
  select l.unit_id, l.depth, l.type_name, r.kind, r.priority from links l join rules r on (r.name is null or r.name = l.base and r.prefix is null or r.name = l.type_name and (r.prefix is null or starts_with(l.module, r.prefix))) and (r.fragment is null or contains(l.message, r.fragment))
), best as (select unit_id, arg_min(kind, (depth, priority)) kind, arg_min(type_name, (depth, priority)) type_name from hits group by unit_id)
select e.unit_id, case when e.k % 3 > 0 then coalesce(b.kind, 'agent_exception') when r.reward is null then 'missing_reward' end kind, case when e.k % 3 > 0 then coalesce(b.type_name, e.type_name) end exception_type
from errors e join records r on r.unit_id = e.unit_id left join best b on b.unit_id = e.unit_id
"""


@query("J2_J3_J8_error_chains", CHAIN_SQL)
def error_chains(spark, sf_dir):
    k = F.col("k")

    def link(name, module, message, base):
        named = lambda m, n: F.struct(m.alias("module"), n.alias("name"))
        return F.struct(F.array(named(module, name), named(F.lit("base"), base)).alias("hierarchy"), name.alias("type_name"), message.alias("message"))

    outer = link(F.col("type_name"), F.lit("app"), F.col("message"), F.lit("Exception"))
    inner = link(F.get(F.array(*[F.lit(n) for n in NAMES]), (k * 5) % len(NAMES)), F.when(k % 2 == 0, "ray.exceptions").otherwise("torch"), F.lit("inner"), F.when(k % 7 == 0, "TimeoutError").otherwise("RuntimeError"))
    chain = F.when(k % 3 == 1, F.array(outer)).when(k % 3 == 2, F.array(outer, inner))
    e = errors(spark, sf_dir).join(records(spark, sf_dir).select("unit_id", "kind", "reward"), "unit_id")
    return e.select("unit_id", S.failure_of_unit(chain, F.lit("rollout"), F.col("kind"), F.col("reward")).alias("f")).select("unit_id", "f.kind", "f.exception_type")


ALARMS_SQL = f"""
with recursive {{records}}, {STEPS_SQL}, {BATCHES}, fr as (with recursive {fold_sql(FAILURE_LLR)} select * from f), rw as (with recursive {fold_sql(REWARD_LLR)} select * from f), mm as (with recursive {fold_sql(MISMATCH_LLR, 'run_id')} select * from f),
firsts as (
  select 'failure_rate' signal, source, min(pos) pos, arg_min(x, pos) x from fr where x >= {L.ALARM_LOG_ODDS} group by source union all select 'reward', source, min(pos), arg_min(x, pos) from rw where x >= {L.ALARM_LOG_ODDS} group by source
), found as (
  select signal, a.source, o.unit_id, o.at_ms, 1 / (1 + exp(-x)) p from firsts a join obs o on o.source is not distinct from a.source and o.step = a.pos
  union all select 'mismatch', null, 's-' || lpad(bt.pos::varchar, 8, '0'), bt.at_ms, 1 / (1 + exp(-a.x)) from (select min(pos) pos, arg_min(x, pos) x from mm where x >= {L.ALARM_LOG_ODDS}) a join bt on bt.pos = a.pos
  union all select 'poisoned', source, arg_min(unit_id, (started_at_ms, unit_id)), min(started_at_ms), 1.0 from records where failure_class in ('grader', 'infra') and reward is not null group by source
)"""


def alarm_set(spark, sf_dir, healthy: bool) -> DataFrame:
    found = records(spark, sf_dir, healthy=healthy)
    times = read_table(spark, sf_dir, "events").groupBy(F.expr("event_id div 50").alias("pos")).agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("at_ms"))
    batches = mismatch_batches(spark, sf_dir).join(times, "pos").withColumns({"source": F.lit(None).cast("string"), "unit_id": F.concat(F.lit("s-"), F.lpad(F.col("pos").cast("string"), 8, "0"))})
    return detect.alarms(found, steps.step_observations(found), batches)


@query("F13_G4_alarms", ALARMS_SQL.format(records=CHANGED) + " select row_number() over (order by at_ms, signal, coalesce(source, '')) place, signal, source, unit_id, at_ms, round(p, 6) probability from found")
def changed_alarms(spark, sf_dir):
    """With the place of each alarm in the report's order: rows come in that order."""
    rows = alarm_set(spark, sf_dir, False).select("signal", "source", "unit_id", "at_ms", r("probability").alias("probability"))
    return rows.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)  # at most four alarms a source


@query("F13_alarms_healthy", ALARMS_SQL.format(records=HEALTHY) + " select signal, source, unit_id, at_ms, round(p, 6) probability from found")
def healthy_alarms(spark, sf_dir):
    return alarm_set(spark, sf_dir, True).select("signal", "source", "unit_id", "at_ms", r("probability").alias("probability"))


@query("D5_alarm_steps", ALARMS_SQL.format(records=CHANGED) + " select signal, found.source, found.unit_id, r.step from found join records r on r.unit_id = found.unit_id")
def alarm_steps(spark, sf_dir):
    return lookup.alarm_steps(alarm_set(spark, sf_dir, False), records(spark, sf_dir)).select("signal", "source", "unit_id", "step")


@query("D2_refused_starts", f"with {CHANGED}, starts as (select unit_id, k % 3 attempt from records) select starts.* from starts semi join records on records.unit_id = starts.unit_id and records.attempt = starts.attempt")
def refused_starts(spark, sf_dir):
    done = records(spark, sf_dir)
    return lookup.refused_starts(done.select("unit_id", (F.col("k") % 3).alias("attempt")), done)


@query("D12_A5_registry", "with last as (select c_nationkey, arg_max(c_mktsegment, c_custkey) segment from customer where c_nationkey % 4 > 0 group by c_nationkey) select c_custkey, coalesce(segment, 'unregistered') segment from customer left join last using (c_nationkey)")
def registry(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    last = lookup.last_by(c.where("c_nationkey % 4 > 0").select("c_nationkey", "c_custkey", F.col("c_mktsegment").alias("segment")), ["c_nationkey"], "c_custkey")
    return lookup.with_default(c.select("c_custkey", "c_nationkey"), last.select("c_nationkey", "segment"), "c_nationkey", {"segment": F.lit("unregistered")}).select("c_custkey", "segment")


FAULT = faults.Schedule("sandbox_partly_typed", start=20, rate=0.4, typed=0.7)
INJECT_SQL = f"""
with {CHANGED}, d as (select *, step >= 20 and ('0x' || substr(md5('0:hit:' || step || ':' || unit_id), 1, 8))::bigint / 4294967296 < 0.4 hit, ('0x' || substr(md5('0:typed:' || step || ':' || unit_id), 1, 8))::bigint / 4294967296 < 0.7 drawn from records),
m as (select *, avg(reward) filter (not hit) over (partition by step, grp) mean from d)
select unit_id, case when not hit then 'healthy' when drawn then 'sandbox_typed' else 'sandbox_untyped' end truth, case when hit and drawn then 'mask' else 'score' end as action, case when hit and drawn then 'sandbox' end failure_kind,
  round(case when not hit then reward when drawn then coalesce(mean, 0) else 0 end, 6)::double trainer_reward, (case when not hit then reward when not drawn then 0 end)::double record_reward from m
"""


@query("M1_M3_injected_faults", INJECT_SQL)
def injected_faults(spark, sf_dir):
    rows = records(spark, sf_dir).select("unit_id", "step", F.col("grp").alias("uid"), F.col("unit_id").alias("idx"), "reward")
    return faults.inject(rows, FAULT, 0).select("unit_id", "truth", "action", "failure_kind", r("trainer_reward").alias("trainer_reward"), "record_reward")


@query("M2_overrides", f"with {CHANGED} select distinct step, case when step >= 20 then 1.5 end::double temperature, case when step >= 30 then 4.0 else 1.0 end::double learning_rate_scale from records")
def overrides(spark, sf_dir):
    hot, spike = faults.Schedule("temperature", 20, 1.5), faults.Schedule("lr_spike", 30, 4.0)
    step = F.col("step")
    return records(spark, sf_dir).select("step", hot.value("temperature", step).alias("temperature"), F.coalesce(spike.value("lr_spike", step), F.lit(1.0)).alias("learning_rate_scale")).distinct()


@query("G7_best_multiplier", "with t as (select l_partkey % 50 run, floor(l_discount * 100) / 4 k, avg(l_tax) * 2 false_alarms, round(avg(l_quantity) / 50, 1) f1 from lineitem group by all) select run::bigint run, arg_max(k, (false_alarms <= 0.1::double, f1, k)) k from t where abs(false_alarms - 0.1) > 1e-9 group by run")
def multiplier(spark, sf_dir):
    t = read_table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).alias("run"), (F.floor(F.col("l_discount") * 100) / 4).alias("k")).agg((F.avg("l_tax") * 2).alias("false_alarms"), F.round(F.avg("l_quantity") / 50, 1).alias("f1"))
    return faults.best_multiplier(t.where(F.abs(F.col("false_alarms") - 0.1) > 1e-9), "run")


COUNTED = CHANGED + ", numbered as (select records.* exclude (step), ((row_number() over (partition by source order by started_at_ms, unit_id, attempt) - 1) // 32) * 32 step from records)"


@query("F2_counted_steps", f"with {COUNTED}, {STEPS_SQL.replace('from records', 'from numbered')} select source, step::bigint step, units, failures, clusters, clean_count, round(clean_mean, 6) + 0.0 clean_mean, unit_id from obs")
def counted_steps(spark, sf_dir):
    o = steps.step_observations(windows.counted_steps(records(spark, sf_dir)))
    return o.select("source", "step", "units", "failures", "clusters", "clean_count", r("clean_mean").alias("clean_mean"), "unit_id")


TRACES_SQL = """
with t as (select l_orderkey, count(*) filter (l_tax = 0) lacking, sum(l_discount * l_quantity) reward from lineitem group by all)
select l_orderkey, case when lacking = 0 then round(reward, 6) end reward, case when l_orderkey % 5 = 0 then 'engine_crash' when l_orderkey % 5 = 1 then 'grader_exception' when lacking > 0 then 'missing_reward' end failure_kind,
  case when l_orderkey % 5 = 0 then 'rollout' when l_orderkey % 5 = 1 or lacking > 0 then 'grade' end failure_stage from t
"""


@query("B15_J7_trace_outcomes", TRACES_SQL)
def trace_outcomes(spark, sf_dir):
    key = F.col("l_orderkey") % 5
    named = lambda name, status: F.struct(F.lit(name).alias("type_name"), F.lit("m").alias("message"), F.lit(status).cast("int").alias("status"))
    seen = F.when(key == 0, F.array(named("TaskError", None), named("Unknown", 503))).when(key == 1, F.array(named("ReadTimeout", None), named("TaskError", 503)))
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("score"), F.col("l_quantity").alias("weight"))).alias("rewards"))
    f = traces.trace_failure(seen, F.col("rewards"), F.lit("trajectory"), F.lit("rollout"))
    out = lines.select("l_orderkey", r(traces.weighted_reward(F.col("rewards"))).alias("reward"), f.alias("f"))
    return out.select("l_orderkey", "reward", F.col("f.kind").alias("failure_kind"), F.col("f.stage").alias("failure_stage"))


@query("H1_C9_fork", f"with {CHANGED}, b as (select 'b' || unit_id unit_id, step from records where k % 2 = 0 and step > 8) select unit_id, step from records where step <= 8 union all select unit_id, step from b")
def fork(spark, sf_dir):
    parent = records(spark, sf_dir).select("unit_id", "step", "k")
    branch = parent.where("k % 2 = 0 and step > 8").select(F.concat(F.lit("b"), "unit_id").alias("unit_id"), "step")
    return lookup.forked(parent.select("unit_id", "step"), branch, 8)
