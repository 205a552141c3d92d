"""Run directories: strict scans of JSON records and start markers, JSON lines by step, and the flat Parquet sink.

A document is parsed once as VARIANT for exact types, and its key sets are compared with the version's; only then are
values read by schema. Documents with duplicate keys, or integers beyond 64 bits, are bad."""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import outcome as O

# Types of the record format; a trailing ? allows null.
TOP = {"attempt": "int", "ended_at_ms": "int", "kind": "enum", "outcome": "enum", "reward": "float?", "run_id": "str", "schema_version": "int", "source": "str?", "started_at_ms": "int", "unit_id": "str"}
STRUCTS = {
    "failure": {"evidence": "strs", "exception_type": "str?", "kind": "enum", "message": "str", "retryable": "bool", "stage": "enum"},
    "resources": {"gpu_total_bytes": "ints", "peak_gpu_used_bytes": "ints", "peak_host_rss_bytes": "int", "sample_count": "int"},
    "cost": {"cpu_seconds": "float", "gpu_seconds": "float", "tokens_in": "int", "tokens_out": "int", "usd": "float?"},
    "decision": {"action": "enum", "attempt": "int", "reason": "str"},
    "mismatch": {"kl": "float", "kl_standard_error": "float", "ratio_mean": "float", "ratio_standard_error": "float", "sequences": "int", "tokens": "int"},
}
NULLABLE = ("failure", "mismatch")
ENUMS = {
    "kind": ("eval", "train_step", "trajectory"),
    "outcome": ("failed", "ok"),
    "failure.kind": tuple(O.FAILURE_CLASSES),
    "failure.stage": ("grade", "rollout", "setup", "tool", "train"),
    "decision.action": ("abort", "mask", "retry", "score", "zero"),
}
SCHEMA = """attempt int, cost struct<cpu_seconds:double,gpu_seconds:double,tokens_in:long,tokens_out:long,usd:double>, decision struct<action:string,attempt:int,reason:string>, ended_at_ms long,
failure struct<evidence:array<string>,exception_type:string,kind:string,message:string,retryable:boolean,stage:string>, kind string,
mismatch struct<kl:double,kl_standard_error:double,ratio_mean:double,ratio_standard_error:double,sequences:long,tokens:long>, outcome string,
resources struct<gpu_total_bytes:array<long>,peak_gpu_used_bytes:array<long>,peak_host_rss_bytes:long,sample_count:long>, reward double, run_id string, schema_version int, source string, started_at_ms long, tags array<array<string>>, unit_id string"""


def _type(path: str) -> Column:
    """The type of the value at this path of the VARIANT column _doc: VOID for null, MISSING without one."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.col("_doc"), path, "variant")), F.lit("MISSING"))


def _fits(path: str, want: str) -> Column:
    t, name = _type(f"$.{path}"), want.rstrip("?")
    fits = {
        "int": t == "BIGINT",
        "float": (t == "BIGINT") | (t == "DOUBLE") | t.startswith("DECIMAL"),
        "str": t == "STRING",
        "bool": t == "BOOLEAN",
        "ints": t.isin("ARRAY<BIGINT>", "ARRAY<VOID>"),
        "strs": t.isin("ARRAY<STRING>", "ARRAY<VOID>"),
        "enum": (t == "STRING") & F.coalesce(F.try_variant_get(F.col("_doc"), f"$.{path}", "string").isin(*ENUMS.get(path, ())), F.lit(False)),
    }[name]
    if name in ("ints", "strs"):  # [null] has the type of an empty list
        fits = fits & ~F.exists(F.try_variant_get(F.col("_doc"), f"$.{path}", "array<string>"), lambda x: x.isNull())
    return fits | (t == "VOID") if want.endswith("?") else fits


def _keys(json: Column, want) -> Column:
    return F.coalesce(F.array_sort(F.json_object_keys(json)) == F.array(*[F.lit(k) for k in sorted(want)]), F.lit(False))


def problem(text: Column) -> Column:
    """The path of the first thing wrong with a document, null if it's a record; beside a column _doc, the parsed text."""
    version = F.try_variant_get(F.col("_doc"), "$.schema_version", "int")
    top = {*TOP, "tags", *STRUCTS}
    tags = F.from_json(F.get_json_object(text, "$.tags"), "array<array<string>>")
    checks = [
        ("record", F.coalesce(F.schema_of_variant("_doc").startswith("OBJECT"), F.lit(False))),
        ("record.schema_version", _fits("schema_version", "int") & F.coalesce(version.isin(1, 2), F.lit(False))),
        ("record", F.when(version == 2, _keys(text, top)).otherwise(_keys(text, top - {"mismatch"}))),
    ]
    checks += [(f"record.{k}", _fits(k, t)) for k, t in TOP.items()]
    for name, fields in STRUCTS.items():
        absent = _type(f"$.{name}").isin("VOID", *(["MISSING"] if name == "mismatch" else [])) if name in NULLABLE else F.lit(False)
        checks.append((f"record.{name}", absent | _keys(F.get_json_object(text, f"$.{name}"), fields)))
        checks += [(f"record.{name}.{k}", absent | _fits(f"{name}.{k}", t)) for k, t in fields.items()]
    pairs = _type("$.tags").isin("ARRAY<ARRAY<STRING>>", "ARRAY<VOID>") & F.coalesce(F.forall(tags, lambda p: (F.size(p) == 2) & F.forall(p, lambda x: x.isNotNull())), F.lit(False))
    checks.append(("record.tags", pairs))
    return F.coalesce(*[F.when(~ok, F.lit(path)) for path, ok in checks])


def parse_records(texts: DataFrame, column: str = "value", name: str = "file_name", *, keep_bad: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of documents, upgraded to version 2, beside the columns to keep. A bad one fails the scan by name, or with keep_bad has its path in `problem`.

    The row number, never negative, keeps filters on a record's values above the parse: pushed below, they would hold copies of all of it."""
    docs = texts.withColumn("_doc", F.try_parse_json(column)).withColumn("problem", problem(F.col(column)))
    read = F.from_json(column, SCHEMA)
    if not keep_bad:
        read = F.when(F.col("problem").isNull(), read).otherwise(F.raise_error(F.concat(F.coalesce(name, F.lit("?")), F.lit(": "), "problem")))
    read = F.when((F.col("problem").isNull() if keep_bad else F.lit(True)) & (F.monotonically_increasing_id() >= 0), read)
    docs = docs.select(name, read.alias("r"), "problem", *keep).select(name, "problem", "r.*", *keep)
    return docs.withColumn("schema_version", F.when(F.col("schema_version").isNotNull(), 2)).withColumn("tags", F.map_from_entries(F.transform("tags", lambda p: F.struct(p[0], p[1]))))


def scan_run(spark: SparkSession, directory: str, *, keep_bad: bool = False) -> DataFrame:
    """All records/*.json of a run directory, by (unit_id, attempt)."""
    texts = spark.read.text(f"{directory}/records", wholetext=True, pathGlobFilter="*.json").select("value", "_metadata.file_name")
    return parse_records(texts, keep_bad=keep_bad).orderBy("unit_id", "attempt")


def scan_markers(spark: SparkSession, directory: str) -> DataFrame:
    """Start markers <unit_id>--<attempt>, each with its milliseconds; a malformed one fails the scan by name."""
    m = spark.read.text(f"{directory}/started", wholetext=True).select(F.trim("value").alias("at"), "_metadata.file_name")
    good = F.col("file_name").rlike(r"\A.+--[0-9]+\z") & F.col("at").rlike(r"\A\s*[0-9]+\s*\z")
    part = lambda k: F.regexp_extract("file_name", r"\A(.+)--([0-9]+)\z", k)
    bad = F.raise_error(F.concat(F.lit("bad start marker "), "file_name"))
    return m.select(F.when(good, part(1)).otherwise(bad).alias("unit_id"), part(2).cast("int").alias("attempt"), F.regexp_replace("at", r"\s", "").cast("long").alias("at_ms"), "file_name")


def scan_steps(spark: SparkSession, directory: str, prefix: str = "records", *, last_step: int | None = None) -> DataFrame:
    """Lines of <prefix>-<step>.jsonl with their step, up to last_step if given."""
    lines = spark.read.text(directory, pathGlobFilter=f"{prefix}-*.jsonl").select("value", "_metadata.file_name")
    lines = lines.where(F.trim("value") != "").withColumn("step", F.regexp_extract("file_name", r"-(\d+)\.jsonl\z", 1).cast("long"))
    return lines if last_step is None else lines.where(F.col("step") <= last_step)


def flat(records: DataFrame) -> DataFrame:
    """The flat projection of nested records, 21 columns."""
    c = F.col
    failure = [O.failure_class(c("failure.kind")).alias("failure_class"), c("failure.kind").alias("failure_kind"), c("failure.stage").alias("failure_stage")]
    cost = [c(f"cost.{k}") for k in ("cpu_seconds", "gpu_seconds", "tokens_in", "tokens_out", "usd")]
    mismatch = [c("mismatch.kl").alias("mismatch_kl"), c("mismatch.ratio_mean").alias("mismatch_ratio_mean")]
    return records.select("run_id", "unit_id", "attempt", "kind", "source", "outcome", *failure, c("decision.action").alias("decision"), "reward", "started_at_ms", "ended_at_ms", *cost, "resources.peak_host_rss_bytes", *mismatch)


# The columns that are dictionary-encoded.
DICTIONARY = ("decision", "failure_class", "failure_kind", "failure_stage", "kind", "outcome", "run_id", "source")


def write_flat(records: DataFrame, path: str, *, row_group_rows: int = 65_536) -> None:
    """flat(records) as Parquet; never overwrites. Rows keep their order: files are named in the order of the frame's partitions."""
    out = flat(records).write.mode("errorifexists").option("parquet.block.row.count.limit", row_group_rows).option("parquet.enable.dictionary", "false")
    for c in DICTIONARY:
        out = out.option(f"parquet.enable.dictionary#{c}", "true")
    out.parquet(path)


def _attribute(key: str, kind: str, value: Column) -> Column:
    """struct(key, value) with one typed value, null if the value is; integers are decimal strings."""
    typed = [(value.cast("double" if k == "doubleValue" else "string") if k == kind else F.lit(None).cast("double" if k == "doubleValue" else "string")).alias(k) for k in ("doubleValue", "intValue", "stringValue")]
    return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), F.struct(*typed).alias("value")))


def spans(records: DataFrame, domain: str) -> DataFrame:
    """(run_id, unit_id, attempt, span): each record as an OTLP/JSON span, attributes by key; to_json leaves out nulls.

    domain is the text that the identifiers' digests start with."""
    c, step = F.col, F.col("kind") == "train_step"
    some = lambda x: F.when(x > 0, x)
    attributes = {
        "error.type": ("stringValue", F.when(c("failure").isNotNull(), F.coalesce(F.nullif("failure.exception_type", F.lit("")), "failure.kind"))),
        "gen_ai.conversation.id": ("stringValue", F.when(~step, c("unit_id"))),
        "gen_ai.operation.name": ("stringValue", F.when(~step, "invoke_agent")),
        "gen_ai.usage.input_tokens": ("intValue", some(c("cost.tokens_in"))),
        "gen_ai.usage.output_tokens": ("intValue", some(c("cost.tokens_out"))),
        "rl.attempt": ("intValue", c("attempt")),
        "rl.decision": ("stringValue", c("decision.action")),
        "rl.failure_class": ("stringValue", O.failure_class(c("failure.kind"))),
        "rl.failure_kind": ("stringValue", c("failure.kind")),
        "rl.failure_stage": ("stringValue", c("failure.stage")),
        "rl.mismatch_kl": ("doubleValue", c("mismatch.kl")),
        "rl.mismatch_ratio_mean": ("doubleValue", c("mismatch.ratio_mean")),
        "rl.outcome": ("stringValue", c("outcome")),
        "rl.reward": ("doubleValue", c("reward")),
        "rl.run_id": ("stringValue", c("run_id")),
        "rl.source": ("stringValue", c("source")),
        "rl.unit_id": ("stringValue", c("unit_id")),
        "rl.unit_kind": ("stringValue", c("kind")),
    }
    nanos = lambda x: (c(x).cast("decimal(38,0)") * 1_000_000).cast("string")
    span = F.struct(
        O.identifier(32, domain, c("run_id"), c("unit_id")).alias("traceId"),
        O.identifier(16, domain, c("run_id"), c("unit_id"), c("attempt").cast("string")).alias("spanId"),
        F.when(step, "train_step").otherwise("invoke_agent").alias("name"),
        F.lit(1).alias("kind"),
        nanos("started_at_ms").alias("startTimeUnixNano"),
        nanos("ended_at_ms").alias("endTimeUnixNano"),
        F.filter(F.array(*[_attribute(k, t, v) for k, (t, v) in attributes.items()]), lambda a: a.isNotNull()).alias("attributes"),
        F.when(c("failure").isNotNull(), F.struct(F.lit(2).alias("code"), c("failure.message").alias("message"))).alias("status"),
    )
    return records.select("run_id", "unit_id", "attempt", F.to_json(span).alias("span"))


def in_order(records: DataFrame) -> DataFrame:
    """Rows by (run_id, unit_id, attempt), a range of them in each partition: before spans(), so that records are shuffled, not their text."""
    keys = ("run_id", "unit_id", "attempt")
    return records.repartitionByRange(*keys).sortWithinPartitions(*keys)


def envelope(found: DataFrame, service_name: str, *, scope: str = "tallyspark", version: str = "0", most_bytes: int = 4_000_000) -> DataFrame:
    """(run_id, request): the spans of each run as OTLP/JSON export requests, in the order of the rows, as in_order() gives them.

    A request holds consecutive spans of one run and partition, up to most_bytes of them; a span beyond that goes alone.
    So no row holds a whole run, and a run has as many requests as it needs."""
    head = json.dumps({"attributes": [{"key": "service.name", "value": {"stringValue": service_name}}]})
    name = json.dumps({"name": scope, "version": version})
    start, end = f'{{"resourceSpans":[{{"resource":{head},"scopeSpans":[{{"scope":{name},"spans":[', "]}]}]}"

    def pack(batches):
        import pyarrow as pa

        done, ready, run, spans, size = [], 0, None, [], 0
        table = lambda: pa.RecordBatch.from_pydict({"run_id": [r for r, _ in done], "request": [t for _, t in done]}, pa.schema([("run_id", pa.string()), ("request", pa.string())]))
        for batch in batches:
            for run_id, span in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(span.encode()) + 1
                if spans and (run_id != run or size + n > most_bytes):
                    done.append((run, start + ",".join(spans) + end))
                    ready, spans, size = ready + size, [], 0
                    if ready > most_bytes:
                        yield table()
                        done, ready = [], 0
                run, size = run_id, size + n
                spans.append(span)
        if spans:
            done.append((run, start + ",".join(spans) + end))
        if done:
            yield table()

    return found.select("run_id", "span").mapInArrow(pack, "run_id string, request string")


def write_steps(lines: DataFrame, path: str, prefix: str = "records") -> None:
    """Rows (step, and what else they have) as JSON lines in <path>/<prefix>-<step>.jsonl, as scan_steps() reads them; never overwrites.

    Spark writes a folder for each step and a step's rows as one task; the driver then only renames: it handles names, not rows."""
    spark = lines.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    steps = [r.step for r in lines.select("step").distinct().collect()]
    names = {step: hadoop.Path(root, f"{prefix}-{step:05d}.jsonl") for step in steps}
    if there := [str(p) for p in names.values() if fs.exists(p)]:
        raise FileExistsError(f"{there[0]} exists")
    work = f"{path}/.writing-{uuid.uuid4().hex}"
    lines.withColumn("_step", F.col("step")).repartition("_step").write.partitionBy("_step").json(work)
    try:
        for step, name in names.items():
            (part,) = [x.getPath() for x in fs.listStatus(hadoop.Path(f"{work}/_step={step}")) if x.getPath().getName().startswith("part-")]
            if fs.exists(name) or not fs.rename(part, name):
                raise FileExistsError(f"{name} exists")
    finally:
        fs.delete(hadoop.Path(work), True)


def supersede(spark: SparkSession, path: str, first_step: int) -> list[str]:
    """Moves the files of steps from first_step on, of any prefix, into a folder superseded-<seconds>; gives their names.

    For a run that starts again from first_step: the driver renames files, it reads none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {x.getPath().getName(): x.getPath() for x in fs.listStatus(root) if x.isFile()}
    stale = sorted(n for n in found if (m := re.fullmatch(r".*-([0-9]+)\.jsonl", n)) and int(m[1]) >= first_step)
    if stale:
        aside = hadoop.Path(root, f"superseded-{int(time.time())}")
        if fs.exists(aside) or not fs.mkdirs(aside):
            raise FileExistsError(f"{aside} exists")
        for n in stale:
            if not fs.rename(found[n], hadoop.Path(aside, n)):
                raise OSError(f"{n} could not be moved")
    return stale


TELEMETRY = """metadata struct<rollout_step:long,fault_injection:struct<fault_injection_type:string,fault_injection_strength:double>>,
metrics map<string,double>, flags map<string,boolean>"""


def scan_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Trajectory telemetry as nested JSON lines; blank lines are dropped, a line that is no JSON fails the scan."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", TELEMETRY, {"mode": "FAILFAST"}).alias("r")).select("r.*")
