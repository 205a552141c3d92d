"""Records inside trajectory documents, and records that are added to or set aside from a directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.validate import duplicates
from .runs import STRUCTS, TOP, parse_records

#: Fixed value: what a trajectory's schema_version starts with.
VERSION_PREFIX = "ATIF-v1."
RECORD_FIELDS = tuple(sorted({*TOP, *STRUCTS, "tags"}))


def rendered(records: DataFrame) -> Column:
    """A nested record as compact JSON: keys sorted, nulls written, tags as sorted pairs; scan_run reads it back."""
    tags = F.array_sort(F.transform(F.map_entries("tags"), lambda t: F.array(t["key"], t["value"])))
    fields = [(tags if c == "tags" else F.col(c)).alias(c) for c in RECORD_FIELDS]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def trajectory_problem(document: Column) -> Column:
    """What keeps a JSON document from being a trajectory, null if nothing does."""
    doc = F.try_parse_json(document)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(doc, path, "variant")), F.lit("MISSING"))
    version = F.coalesce((kind("$.schema_version") == "STRING") & F.try_variant_get(doc, "$.schema_version", "string").startswith(VERSION_PREFIX), F.lit(False))
    some_steps = kind("$.steps").startswith("ARRAY<") & F.coalesce(F.json_array_length(F.get_json_object(document, "$.steps")) > 0, F.lit(False))
    extra = kind("$.extra")
    return F.when(~version, "schema_version").when(~some_steps, "steps").when(~((extra == "MISSING") | extra.startswith("OBJECT<")), "extra")


def annotate(trajectories: DataFrame, records: DataFrame, on: list[str], key: str) -> DataFrame:
    """trajectories (on, document) with the record of the same keys under extra.<key> of document, other keys as they are.

    A document that is no trajectory, or has extra.<key> already, fails the job by the name of what is wrong; a
    trajectory without a record is left out."""
    members = lambda json: F.from_json(json, "map<string,variant>")
    put = lambda m, k, v: F.map_concat(F.map_filter(m, lambda name, _: name != k), F.create_map(F.lit(k), v))
    text = F.col("document")
    extra = F.coalesce(F.get_json_object(text, "$.extra"), F.lit("{}"))
    there = F.array_contains(F.json_object_keys(extra), key)
    fault = F.coalesce(trajectory_problem(text), F.when(there, f"extra.{key} is there already"))
    grown = F.to_json(put(members(extra), key, F.parse_json("_record")))
    whole = F.to_json(put(members(text), "extra", F.parse_json(grown)))
    joined = trajectories.join(records.select(*on, rendered(records).alias("_record")), on).withColumn("_fault", fault)
    return joined.withColumn("document", F.when(F.col("_fault").isNotNull(), F.raise_error(F.concat(F.lit("not annotated: "), "_fault"))).otherwise(whole)).drop("_record", "_fault")


def annotated_records(trajectories: DataFrame, key: str, *, keep_bad: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The records under extra.<key> of trajectories (file_name, document, and the columns to keep), checked like those of a run directory."""
    text, inner = F.col("document"), F.col("_inner")
    found = trajectories.select("file_name", F.get_json_object(text, f"$.extra.{key}").alias("_inner"), trajectory_problem(text).alias("_fault"), *keep)
    if not keep_bad:
        found = found.withColumn("_fault", F.coalesce("_fault", F.when(inner.isNull(), f"no extra.{key}")))
        inner = F.when(F.col("_fault").isNull(), inner).otherwise(F.raise_error(F.concat("file_name", F.lit(": "), "_fault")))
    return parse_records(found.select("file_name", F.coalesce(inner, F.lit("null")).alias("value"), *keep), keep_bad=keep_bad, keep=keep)


def append_records(records: DataFrame, path: str, directory_records: DataFrame) -> None:
    """Adds records as lines of JSON; one that is there twice, or among directory_records already, fails before anything is written.

    Check and write are two steps: of two writers at the same time both can pass the check, and duplicates() finds what they wrote."""
    if again := duplicates(records, "unit_id", "attempt").take(1):
        raise FileExistsError(f"{again[0].unit_id} attempt {again[0].attempt} is there twice")
    taken = records.join(directory_records.select("unit_id", "attempt"), ["unit_id", "attempt"], "left_semi").select("unit_id", "attempt").take(1)
    if taken:
        raise FileExistsError(f"{taken[0].unit_id} attempt {taken[0].attempt} has a record already")
    records.select(rendered(records).alias("value")).write.mode("append").text(path)


def before_step(rows: DataFrame, first_step: int) -> DataFrame:
    """Rows of steps that a restart from first_step doesn't write again; those from first_step on are superseded."""
    return rows.where(F.col("step") < first_step)
