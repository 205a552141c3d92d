"""The corpus pipeline's stages and its run against brute force over hand-made tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import mixing, simhash, toxicity
from tallyspark.llm.common import text_buffers


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(9)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    said = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    item = " ".join(f"item{k}" for k in range(14))
    rows = [(k, said(60) + (" wretched scoundrel idiocy" if k % 4 == 0 else ""), ("a", "b", None)[k % 3]) for k in range(160)]
    base = rows[1][1].split()
    rows += [(200, rows[1][1], "a"), (201, " ".join(["changed", *base[1:]]), "b"), (1, rows[1][1], "a"), (None, rows[5][1], "a"), (None, None, "b"), (202, "", None), (203, " \n", "a")]
    rows += [(204, said(20) + " " + item.upper() + "! " + said(20), "a"), (205, said(30) + " " + " ".join(item.split()[2:12]), "b"), (206, said(30) + " " + " ".join(item.split()[:9]), "b")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    labels = [(k, 1, int(k % 4 == 0)) for k in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, [(i, t, s) for i, t, s in rows]


def brute_force(rows, model):
    scores = toxicity.Scorer(model)(pa.array([t for _, t, _ in rows], pa.string()))
    rows = [r for r, s in zip(rows, scores) if s < 0.3]
    yield list(rows)
    b, *points = simhash.stage_fingerprints_of(*text_buffers(pa.array([t for _, t, _ in rows], pa.string())))
    group = list(range(len(rows)))
    for _ in range(4):
        for i in range(len(rows)):
            for j in range(i):
                if b[i] == b[j] or (int(b[i] ^ b[j]).bit_count() <= 13 and any(int(p[i] ^ p[j]).bit_count() <= 3 for p in points)):
                    group[i] = group[j] = min(group[i], group[j])
    parts = {g: [r for r, x in zip(rows, group) if x == g] for g in set(group)}
    rows = [min(part, key=lambda r: (-1 if r[0] is None else r[0], r[2] or "")) for part in parts.values()]
    yield list(rows)
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    item = [f"item{k}" for k in range(14)]
    windows = {tuple(item[k : k + 10]) for k in range(5)}
    rows = [r for r in rows if not any(tuple(words(r[1])[k : k + 10]) in windows for k in range(len(words(r[1]))))]
    yield list(rows)


def test_stages_and_run(spark, tables):
    at, rows = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{at}/labels.parquet"))
    key = lambda found: sorted((str(r[0]), str(r[1]), str(r[2])) for r in found)
    kept = {}
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute_force(rows, model)):
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        kept[name] = [tuple(r) for r in out.select("doc_id", "text", "source").collect()]
        if name == "near_duplicates":  # which of the texts under one null doc_id stays goes by a hash
            assert sorted(str(r[0]) for r in kept[name]) == sorted(str(r[0]) for r in want)
            assert key(r for r in kept[name] if r[0] is not None) == key(r for r in want if r[0] is not None)
        elif name == "toxicity":
            assert key(kept[name]) == key(want)
        docs = spark.createDataFrame(out.collect(), out.schema)
    ids = {name: {r[0] for r in found} for name, found in kept.items()}
    assert {0, 4, 8}.isdisjoint(ids["toxicity"]) and {200, 201} <= ids["toxicity"]
    assert {200, 201, 203}.isdisjoint(ids["near_duplicates"]) and 1 in ids["near_duplicates"]
    assert {204, 205}.isdisjoint(ids["decontamination"]) and 206 in ids["decontamination"]
    decontaminated = kept["decontamination"]
    mixed = corpus_pipeline.mixing(spark, docs, at)
    assert mixed.columns == docs.columns
    want = [r for r in mixing.mix_sources(docs).select("doc_id", "text", "source").collect()]
    assert key(mixed.select("doc_id", "text", "source").collect()) == key(want) and {tuple(r) for r in want} <= set(decontaminated)
    out = corpus_pipeline.run(spark, at)
    assert out.columns == [*docs.columns, "shard_id"]
    assert key(out.select("doc_id", "text", "source").collect()) == key(want)
    assert out.where(F.col("shard_id").isNull()).count() == 0


def test_run_over_empty_tables(spark, tables, tmp_path):
    at, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert np.array(corpus_pipeline.STAGES).shape == (5, 2)
