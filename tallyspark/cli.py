"""Command line: show, integrity and export of a run directory. Exit 0, 1 if an alarm fired, 2 if it can't run.

show streams rows to the printer partition by partition; its column widths come from an aggregation."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import likelihood as L
from .functions import outcome as O
from .operators import detect, steps, windows
from .sources import runs

# The columns of the tables, and the reports' lines.
SHOW = ("unit", "attempt", "kind", "outcome", "class", "cause", "stage", "peak_gpu", "decision", "cost")
WINDOWS = ("source", "window", "first_unit", "units", "avg_reward", "avg_reward_no_infra", "zero_reward_rate", "infra_error_rate", "grader_error_rate", "poisoned")


NO_RECORD = "started, no record: {unit} attempt {attempt} at {at}; the process died before the unit finished"
NO_ALARMS, ALARMS = "no alarms at P >= {alarm}", "alarms at P >= {alarm} (at most {alpha} of changes are preceded by a false alarm when the model holds):"
_INTEGER = r"\A\s*[+-]?[0-9]+\s*\z"


def check_steps(records: DataFrame) -> None:
    """One small job before any other: bad files and step tags that are no integers fail here, by name."""
    tag = F.try_element_at("tags", F.lit("step"))
    bad = records.agg(F.count("*"), F.min(F.when(tag.isNotNull() & ~tag.rlike(_INTEGER), F.col("unit_id")))).first()[1]
    if bad is not None:
        raise ValueError(f"step is no integer in {bad}")


def outcomes(records: DataFrame) -> DataFrame:
    """Nested records as the flat columns that operators take; a step tag that is no integer fails the job."""
    c = F.col
    tag = F.try_element_at("tags", F.lit("step"))
    step = F.when(tag.isNull(), F.lit(None)).when(tag.rlike(_INTEGER), tag.cast("long")).otherwise(F.raise_error(F.concat(F.lit("step is no integer in "), "unit_id")))
    return records.select("run_id", "unit_id", "attempt", "kind", "source", "started_at_ms", step.alias("step"), F.try_element_at("tags", F.lit("group")).alias("grp"), c("failure.kind").alias("failure_kind"), O.failure_class(c("failure.kind")).alias("failure_class"), c("decision.action").alias("action"), "reward", c("cost.gpu_seconds").alias("value"))


def batches(records: DataFrame) -> DataFrame:
    """The mismatch summaries of a run in start order."""
    rows = records.where("mismatch is not null").select("run_id", "source", "unit_id", "attempt", "started_at_ms", F.col("mismatch.kl").alias("kl"), F.col("mismatch.ratio_mean").alias("ratio_mean"), F.col("mismatch.ratio_standard_error").alias("ratio_se"))
    order = windows.numbered(rows.withColumn("_own", F.col("source")).withColumn("source", F.lit(None).cast("string")), name="pos")
    return order.withColumn("source", F.col("_own")).withColumn("at_ms", F.col("started_at_ms")).drop("_own", "attempt", "started_at_ms")


def table(names: tuple[str, ...], cells: DataFrame) -> Iterator[str]:
    """Lines of a table of strings; a null is a dash."""
    cells = cells.select(*[F.coalesce(F.col(a).cast("string"), F.lit("-")).alias(b) for a, b in zip(cells.columns, names, strict=True)])
    most = cells.agg(*[F.max(F.length(c)).alias(c) for c in names]).first()
    wide = {c: max(len(c), most[c] or 0) for c in names}
    yield "  ".join(c.ljust(wide[c]) for c in names).rstrip()
    for row in cells.toLocalIterator():
        yield "  ".join(row[c].ljust(wide[c]) for c in names).rstrip()


def show_rows(records: DataFrame) -> DataFrame:
    """The cells of the show table, columns as in SHOW; null where it prints a dash."""
    c, gib = F.col, 2**30
    gpu = F.when(F.size("resources.gpu_total_bytes") > 0, F.format_string("%.1f/%.1f GiB", F.get("resources.peak_gpu_used_bytes", F.lit(0)) / gib, F.get("resources.gpu_total_bytes", F.lit(0)) / gib))
    cost = F.when(c("cost.gpu_seconds") > 0, F.format_string("%.1f gpu-min", c("cost.gpu_seconds") / 60)).otherwise(F.format_string("%.1f cpu-min", c("cost.cpu_seconds") / 60))
    cells = [c("unit_id"), c("attempt"), c("kind"), c("outcome"), O.failure_class(c("failure.kind")), c("failure.kind"), c("failure.stage"), gpu, c("decision.action"), cost]
    return records.select(*[x.alias(n) for x, n in zip(cells, SHOW, strict=True)])


def show(spark: SparkSession, directory: str, failures_only: bool) -> Iterator[str]:
    records = runs.scan_run(spark, directory)
    shown = records.where("outcome = 'failed'") if failures_only else records
    yield from table(SHOW, show_rows(shown))
    s = windows.summary(outcomes(records)).first()
    yield f"failures: {s.failures} of {s.units} units; " + ", ".join(f"{k} {s[k]}" for k in ("infra", "agent", "grader", "timeout")) + f"; gpu-hours lost {s.gpu_hours_lost:.2f}"
    for r in shown.where("failure is not null").select("unit_id", "attempt", "failure.evidence").toLocalIterator():
        yield f"evidence {r.unit_id}/{r.attempt}: " + "; ".join(r.evidence)
    try:
        markers = runs.scan_markers(spark, directory)
    except PySparkException as e:  # a run that never started anything has no folder of markers
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return
    for m in windows.without_record(markers, records).orderBy("file_name").toLocalIterator():
        yield NO_RECORD.format(unit=m.unit_id, attempt=m.attempt, at=f"{datetime.fromtimestamp(m.at_ms / 1000, tz=UTC):%Y-%m-%dT%H:%M:%SZ}")


def integrity(spark: SparkSession, directory: str, *, window_units: int, batching: str, **kl: float) -> tuple[list[str], bool]:
    """The report's lines, and whether an alarm fired. There are at most four alarms for each source."""
    records = runs.scan_run(spark, directory)
    check_steps(records)
    # documents are parsed once, not by each of the report's jobs; what an executor loses is parsed again
    flat, mism = outcomes(records).persist(), batches(records).persist()
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.3f", c))
    w = windows.source_windows(flat, window_units=window_units).orderBy(F.col("source").asc_nulls_last(), "index")
    lines = list(table(WINDOWS, w.select("source", "index", "first_unit_id", "units", *[number(c).alias(c) for c in WINDOWS[4:9]], "poisoned_units")))
    seen = steps.step_observations(flat.where("step is not null") if batching == "step" else windows.counted_steps(flat))
    alarms = detect.alarms(flat.where(F.col("kind").isin(*O.REWARDED)), seen, mism, **kl).collect()
    crossed = detect.first_crossing(detect.reward_stream(seen), ["run_id", "source"]).drop("x")
    history = detect.with_probabilities(mism, **kl)
    causes = {(r.run_id, r.source): r for r in detect.attributed(crossed, seen, detect.failure_rate_stream(seen), history).collect()} if any(a.signal == "reward" for a in alarms) else {}
    lines.append((ALARMS if alarms else NO_ALARMS).format(alarm=L.ALARM, alpha=round(1 - L.ALARM, 12)))
    for a in alarms:
        line = f"{a.signal}  {a.source or '-'}  {a.unit_id}  " + ("observed" if a.signal == "poisoned" else f"P={a.probability:.4f}") + f"  {a.detail}"
        if a.signal == "reward" and (c := causes.get((a.run_id, a.source))):
            other = "mismatch not recorded" if c.mismatch_probability is None else f"mismatch {c.mismatch_probability:.4f}"
            line += f"; cause: {c.verdict}, P(config)={c.configuration_probability:.4f} from failure rate {c.failure_rate_probability:.4f} and {other}"
        lines.append(line)
    flat.unpersist()
    mism.unpersist()
    return lines, bool(alarms)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyspark", description=__doc__, allow_abbrev=False)
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("show", allow_abbrev=False)
    p.add_argument("run_dir")
    p.add_argument("--failures-only", action="store_true")
    p = commands.add_parser("integrity", allow_abbrev=False)
    p.add_argument("run_dir")
    p.add_argument("--window-units", type=int, default=50)
    p.add_argument("--healthy-kl", type=float, default=detect.HEALTHY_KL)
    p.add_argument("--broken-kl", type=float, default=detect.BROKEN_KL)
    p.add_argument("--batching", choices=("step", "units"), default="step")
    p = commands.add_parser("export", allow_abbrev=False)
    p.add_argument("format", choices=("otlp", "parquet"))
    p.add_argument("run_dir")
    p.add_argument("--output", required=True)
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if a.command == "show":
            for line in show(spark, a.run_dir, a.failures_only):
                print(line)
        elif a.command == "integrity":
            lines, fired = integrity(spark, a.run_dir, window_units=a.window_units, batching=a.batching, healthy_kl=a.healthy_kl, broken_kl=a.broken_kl)
            print("\n".join(lines))
            return int(fired)
        elif a.format == "parquet":
            runs.write_flat(runs.scan_run(spark, a.run_dir), a.output)
        else:
            runs.envelope(runs.spans(runs.in_order(runs.scan_run(spark, a.run_dir)), "tallyspark"), "tallyspark").select("request").write.mode("errorifexists").text(a.output)
    except (PySparkException, ValueError) as e:
        print(str(e).splitlines()[0], file=sys.stderr)
        return 2
    except Py4JJavaError as e:  # of jobs that fail side by side, Spark may give the wrapped cause
        cause = e.java_exception
        while cause.getCause() is not None:
            cause = cause.getCause()
        print(str(cause.getMessage()).splitlines()[0], file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
