"""Sharding by size-tiered compaction.

append() writes an arrival as small immutable shards, one for each task; compact() merges runs of similar size into
files near the target; each change is committed by renaming a complete manifest to the next version's name, which
fails if that version exists; the writer that comes second commits again on the new version. Each write has a folder
of its own name, so no writer can touch another's files. Readers take the newest manifest, so they see all of a change
or nothing. The file system has to refuse a rename onto an existing file (HDFS, local disks; most object stores don't).
The driver handles file names and sizes only: a manifest has a line for each shard, data size / target size at rest.

Edge cases: an append without rows commits a version without new shards; nulls pass, as rows are stored as they are;
an input column named shard_id stays, and the shard's is then shard_id_ (names as free_name() gives them); repeated
rows stay; a row longer than the target, such as a very long text, makes a shard of its own and is never cut; a lost
executor's task is run again, and files of a failed job or a lost race are in no manifest.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, free_name, shared_dir, table

TARGET, FAN_IN = 128 << 20, 4


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = TARGET, fan_in: int = FAN_IN, parallel: int = 8):
        if target_bytes < 1 or fan_in < 2:
            raise ValueError("target_bytes must be positive and fan_in at least 2")
        self.spark, self.root, self.target, self.fan_in, self.parallel = spark, root.rstrip("/"), target_bytes, fan_in, parallel
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def versions(self) -> list[int]:
        folder = self.path(f"{self.root}/manifests")
        names = [x.getPath().getName() for x in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "parent", "shards": [{"id", "path", "bytes"}]}; version 0 is the empty store."""
        version = max([0, *self.versions()]) if version is None else version
        if version == 0:
            return {"version": 0, "parent": None, "shards": []}
        stream = self.fs.open(self.path(f"{self.root}/manifests/{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, shards: list[dict]) -> dict:
        """The next version; a Conflict if somebody has committed it meanwhile, and then nothing has changed."""
        new = {"version": base["version"] + 1, "parent": base["version"], "shards": shards}
        last = self.path(f"{self.root}/manifests/{new['version']:08d}.json")
        temp = self.path(f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp")
        self.fs.mkdirs(last.getParent())
        stream = self.fs.create(temp, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.FileContext.getFileContext(last.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            rename.rename(temp, last, self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            self.fs.delete(temp, False)
            if self.fs.exists(last):
                raise Conflict(f"version {new['version']} exists") from e
            raise
        return new

    # data

    def _write(self, df: DataFrame) -> list[dict]:
        """The shards of one write: its files, without those that hold no row."""
        name = uuid.uuid4().hex
        folder = f"{self.root}/data/{name}"
        df.write.option("parquet.block.size", 32 << 20).parquet(folder)
        files = {x.getPath().getName(): x.getLen() for x in self.fs.listStatus(self.path(folder)) if x.getPath().getName().startswith("part-")}
        full = [r[0] for r in self.spark.read.schema(df.schema).parquet(folder).groupBy(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1)).count().collect()]
        return [{"id": f"{name}-{re.match('part-([0-9]+)', f)[1]}", "path": f"{folder}/{f}", "bytes": files[f]} for f in sorted(full)]

    def append(self, df: DataFrame) -> dict:
        made = self._write(df)
        while True:
            base = self.manifest()
            try:
                return self.commit(base, base["shards"] + made)
            except Conflict:  # the files are nobody else's: they join the newer version
                continue

    def tier(self, size: int) -> int:
        """Runs whose sizes differ by less than fan_in share a tier; those of half the target or more are at rest (-1)."""
        return -1 if 2 * size >= self.target else int(math.log(max(1, size), self.fan_in))

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """The merges due: in each tier with fan_in runs or more, oldest first, bins up to the target."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        out = []
        for t, runs in sorted(tiers.items()):
            if t < 0 or len(runs) < self.fan_in:
                continue
            bins, size = [[]], 0
            for s in runs:
                if bins[-1] and size + s["bytes"] > self.target:
                    bins.append([])
                    size = 0
                bins[-1].append(s)
                size += s["bytes"]
            out += [b for b in bins if len(b) > 1]
        return out

    def compact(self) -> dict:
        """Merge until no merge is due. A merge is one task over at most the target; merges run side by side."""

        def merge(shards: list[dict]) -> list[dict]:
            return self._write(self.spark.read.parquet(*[s["path"] for s in shards]).coalesce(1))

        while merges := self.plan((base := self.manifest())["shards"]):
            with ThreadPoolExecutor(self.parallel) as pool:
                made = list(pool.map(merge, merges))
            while True:
                there = {s["id"] for s in base["shards"]}
                done = [k for k, m in enumerate(merges) if there.issuperset(s["id"] for s in m)]  # others were merged by another writer
                gone = {s["id"] for k in done for s in merges[k]}
                try:
                    self.commit(base, [s for s in base["shards"] if s["id"] not in gone] + [s for k in done for s in made[k]])
                    break
                except Conflict:
                    base = self.manifest()
        return self.manifest()

    def vacuum(self) -> None:
        """Delete the files that only older versions hold, and these versions. Readers of old versions fail from here on."""
        now = self.manifest()
        live = {s["path"] for s in now["shards"]}
        for v in self.versions()[:-1]:
            for s in self.manifest(v)["shards"]:
                if s["path"] not in live:
                    delete(self.spark, s["path"])
            delete(self.spark, f"{self.root}/manifests/{v:08d}.json")

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version, with shard_id."""
        shards = self.manifest(version)["shards"]
        if not shards:
            none = self.spark.createDataFrame([], schema)
            return none.withColumn(free_name(none, "shard_id"), F.lit(""))
        df = self.spark.read.schema(schema).parquet(*[s["path"] for s in shards])
        shard = F.regexp_extract(F.input_file_name(), "/data/([^/]+)/part-(\\d+)", 1)
        number = F.regexp_extract(F.input_file_name(), "/part-(\\d+)[^/]*$", 1)
        return df.select("*", F.concat_ws("-", shard, number).alias(free_name(df, "shard_id")))


def shard_documents(df: DataFrame, *, target_bytes: int = TARGET, fan_in: int = FAN_IN) -> tuple[ShardStore, DataFrame]:
    """df, appended to a new store in the shared folder and compacted; the store and its rows with shard_id."""
    store = ShardStore(df.sparkSession, shared_dir(df.sparkSession), target_bytes=target_bytes, fan_in=fan_in)
    store.append(df)
    store.compact()
    store.vacuum()
    return store, store.read(df.schema)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the shard that holds it and an MD5 of the text as stored there."""
    _, rows = shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), "shard_id")


#: Shard names depend on file sizes, so SQL can't give them; tests check the store against its manifest and the input.
ORACLE = None
