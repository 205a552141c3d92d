"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import chat, compaction, decontam, lines, media, mixing, quality, queries, simhash, substrings, toxicity
from tallyspark.llm.common import keyed

DATA = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, id string, spans string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    said = lambda n: " ".join(word() for _ in range(n))
    shared, line = said(45), said(14)
    out = [said(60) + "\n" + shared + "  " + said(10) for _ in range(6)] + [f"{said(30)}\n {re.sub("[a-z]", lambda m: m[0].upper(), line) if k % 2 else line}\t\n{said(5)}" for k in range(7)]
    base = said(300).split()
    for k in range(6):
        near = list(base)
        near[k * 40] = "changed"
        out.append(" ".join(near))
    out += [base[0], "", None, "  \n\t", "x y", shared, shared, "ha " * 80, "ha " * 90, said(4000)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ("de", "en", None)[k % 3], ("a", "b", None)[k % 3], "clash", "clash") for k, t in enumerate(texts())]
    rows.append((None, rows[0][1], "en", "a", "clash", "clash"))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE[name])
    assert set(found.columns) == set(want.columns)
    assert got(found.select(*want.columns)) == sorted(want.fetchall(), key=str)


def test_line_dedup(docs, pairs):
    key = lambda line: lower(line.strip(SPACE))
    where = {}
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                where.setdefault(key(line), set()).add(-1 if i is None else i)
    want = []
    for i, t in pairs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(where.get(key(x), ())) < 5 or max(where[key(x)]) == (-1 if i is None else i)]
        want.append((i, "\n".join(kept), len(all_), len(all_) - len(kept)))
    assert got(lines.dedup_lines(docs)) == sorted(want, key=str)
    assert any(w[3] for w in want)


def test_line_dedup_of_texts_that_share_an_id(spark):
    line = "a line of over forty characters that many documents hold"
    same = [(7, f"{line}\nown one"), (7, "clean first line that no other document has at all\nown two"), (8, line), (9, line), (10, line), (11, line)]
    null = [(None, f"{line}\nnull one"), (None, "another clean line that no other document has at all\nnull two")]
    found = lines.dedup_lines(spark.createDataFrame(same + null, "doc_id long, text string"))
    want = [(7, "own one", 2, 1), (7, same[1][1], 2, 0), (8, "", 1, 1), (9, "", 1, 1), (10, "", 1, 1), (11, line, 1, 0), (None, "null one", 2, 1), (None, null[1][1], 2, 0)]
    assert got(found) == sorted(want, key=str)
    # each text under null is a document: five of them are enough, and one keeps the line
    found = lines.dedup_lines(spark.createDataFrame([(None, f"{line}\n{k}") for k in range(5)], "doc_id long, text string")).collect()
    assert sorted(r.n_dropped for r in found) == [0, 1, 1, 1, 1]


@pytest.mark.parametrize("hot", [1000, 2])
def test_substring_dedup(docs, pairs, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    seen, want = set(), []
    for i, t in sorted(pairs, key=lambda p: -1 if p[0] is None else p[0]):
        w, gone = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")], set()
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone.update(range(k, k + 20))
            seen.add(tuple(w[k : k + 20]))
        want.append((i, bytearray(b" ".join(x for k, x in enumerate(w) if k not in gone)), len(w), len(gone)))
    assert got(substrings.dedup_substrings(docs)) == sorted(want, key=str)


def test_simhash(docs, pairs):
    fp = {}
    for i, t in pairs:
        w = re.findall(r"[^ \t\n\x0b\x0c\r]+", lower(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    group = {i: i for i in fp}
    order = sorted(fp, key=lambda i: -1 if i is None else i)
    for _ in order:
        for a in order:
            for b in order:
                if (fp[a] ^ fp[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b], key=order.index)
    found = simhash.near_duplicates(docs).select(simhash.restored(), F.lower(F.lpad(F.hex("fp"), 16, "0")), simhash.restored("component"))
    assert got(found) == sorted(((i, f"{fp[i]:016x}", group[i]) for i in fp), key=str)


def test_simhash_forest_of_a_dense_cluster(monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 40)
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 3)).astype(np.uint64), axis=1) for c in rng.integers(0, 2**64, 3, dtype=np.uint64)]))

    def parts(links):
        root = {x: x for x in fps.tolist()}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            assert (a ^ b).bit_count() <= 3
            root[find(a)] = find(b)
        return sorted(tuple(sorted(x for x in root if find(x) == r)) for r in {find(x) for x in root})

    brute = [(a, b) for a in fps.tolist() for b in fps.tolist() if a < b and (a ^ b).bit_count() <= 3]
    assert parts(simhash.forest(fps).tolist()) == parts(brute)


def test_simhash_last_row_of_a_large_cell(monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 5)
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), *[pa.array([f for _, f in rows], pa.int64())] * 2], ["cell", "a", "b"])
    found = list(simhash._links(0)(iter([batch([(1, k) for k in range(10)]), batch([(1, 10), (2, 99)])])))
    deferred = {b for r in found for k, b in zip(r.column(0).to_pylist(), r.column(3).to_pylist()) if k == 1}
    assert deferred == set(range(11))


def test_simhash_of_cells_that_are_dealt_out_again(spark, monkeypatch):
    rng = np.random.default_rng(4)
    near = [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, 2)).astype(np.uint64), axis=1) for c in rng.integers(0, 2**64, 4, dtype=np.uint64)]
    fps = np.unique(np.concatenate([*near, rng.integers(0, 2**64, 50, dtype=np.uint64)]))
    group = np.arange(len(fps))
    for _ in range(20):
        for i in range(len(fps)):
            group[np.bitwise_count(fps ^ fps[i]) <= 3] = group[np.bitwise_count(fps ^ fps[i]) <= 3].min()
    monkeypatch.setattr(simhash, "CELL", 3)
    df = spark.createDataFrame([(int(x), int(x)) for x in fps.view(np.int64)], "b long, p long")
    edges = simhash.links(df)
    for r in edges.collect():
        assert ((r.a ^ r.b) % 2**64).bit_count() <= 3
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    found = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
    same = lambda g: {frozenset(np.flatnonzero(np.array(g) == k).tolist()) for k in set(g)}
    assert same(found) == same(group.tolist())


def test_stage_fingerprints_and_components(spark, docs, pairs):
    texts_ = [t or "" for _, t in pairs]
    data, offs = simhash_buffers(texts_)
    b, *points = simhash.stage_fingerprints_of(data, offs)
    one = lambda x: int(simhash.span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0])
    told = lambda x: int(simhash.mix(np.array([x >> 20 << 20], np.uint64))[0])
    for k, t in enumerate(texts_):
        w = [one(x.encode()) for x in re.findall(r"[^ \t\n\x0b\x0c\r]+", lower(t))]
        h = {told(int(simhash.span_hashes(np.array(w[j : j + 5], np.uint64), np.array([0]), np.array([len(w[j : j + 5])]))[0])) for j in range(max(1, len(w) - 4))} if w else set()
        assert int(b[k]) == sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))
        for n, p in enumerate(points):
            weight = {int(simhash.mix(np.array([told(x) + n + 1], np.uint64))[0]): round(16 * w.count(x) ** 0.5) for x in set(w)}
            assert int(p[k]) == sum(1 << j for j in range(64) if 2 * sum(v for x, v in weight.items() if x >> j & 1) > sum(weight.values()))
    group = list(range(len(b)))
    linked = lambda i, j: b[i] == b[j] or (int(b[i] ^ b[j]).bit_count() <= 13 and any(int(p[i] ^ p[j]).bit_count() <= 3 for p in points))
    for _ in group:
        for i in range(len(b)):
            for j in range(i):
                if linked(i, j):
                    group[i] = group[j] = min(group[i], group[j])
    kept = simhash.drop_near_duplicates(docs.withColumn("_kept_id", F.lit(1))).collect()
    order = lambda k: (-1 if pairs[k][0] is None else pairs[k][0])
    want = [min((k for k in range(len(b)) if group[k] == g), key=order) for g in set(group)]
    assert len(set(group)) < len(b) - 8
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(pairs[k][0]), str(pairs[k][1])) for k in want)


def simhash_buffers(texts_):
    from tallyspark.llm.common import text_buffers

    return text_buffers(pa.array(texts_))


def test_drop_near_duplicates_keeps_one_row_of_each_component(spark):
    rng = random.Random(8)
    base, other, third = ([f"w{rng.randint(0, 10**6)}" for _ in range(300)] for _ in range(3))
    near = " ".join(["changed", *base[1:]])
    a, b, c = " ".join(base), " ".join(other), " ".join(third)
    rows = [(2, a, "x"), (2, a, "x"), (2, near, "x"), (5, near, "y"), (5, b, "y"), (6, b, "z"), (None, c, "p"), (None, c, "q"), (None, c + " more", "r"), (9, c, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    parts = {(r.id, r.component) for r in simhash.near_duplicates(docs).collect()}
    assert parts == {(2, 2), (5, 2), (5, 5), (6, 5), (-(2**63), -(2**63)), (9, -(2**63))}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "5", "None"]
    assert [r.text for r in kept.where("doc_id = 5").collect()] == [b]


@pytest.mark.parametrize("block", [200_000, 5])
def test_decontamination(spark, docs, pairs, block):
    t = dict(pairs)
    items = [(1, " ".join((t[0] or "").split()[5:30])), (2, "Ha, ha HA"), (3, None), (4, "..."), (None, " ".join(t[16].split()[:10])), (1, "nowhere to be found")]
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    patterns = {}
    for i, x in items:
        w = words(x)
        for k in range(max(1, len(w) - 9)) if w else []:
            patterns.setdefault(tuple(w[k : k + 10]), set()).add("null" if i is None else str(i))
    want = []
    for i, x in pairs:
        w, hit, ids = words(x), set(), set()
        for p, own in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    ids |= own
        want.append((i, len(w), len(hit), sorted(ids)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_patterns(keyed(docs, "doc_id", "text"), bench, block=block)
    rows = [(None if r.id == -(2**63) else r.id, r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in found.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    clean = decontam.drop_contaminated(docs, bench, block=block)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _, n, _ in want if not n)


def test_decontamination_of_repeated_rows_in_many_passes(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    clean = " ".join(f"clean{k}" for k in range(16))
    rows = [(1, item), (1, item), (1, clean), (None, item), (None, clean), (None, clean), (None, None), (None, "")]
    docs = keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    bench = spark.createDataFrame([(k, item if k == 3 else f"item {k} " * 8) for k in range(6)], "item_id long, text string")
    counts = lambda block: got(decontam.find_patterns(docs, bench, block=block).selectExpr("id", "n_words", "size(spans)", "items"))
    assert counts(2) == counts(200_000) and len(counts(2)) == len(rows) and sum(r[2] for r in counts(2)) == 3


def test_mixing(docs):
    assert got(mixing.mix_sources(docs, weights={"a": 1.0}).select("source").distinct()) == [("a",)]
    m = mixing.mix_sources(docs, epochs=3.0)
    assert got(m.select("doc_id", "mix_copy")) == got(mixing.mix_sources(docs, epochs=3.0).select("doc_id", "mix_copy"))
    n = m.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("mix_copies").alias("c"))
    assert n.where("n <> c").count() == 0 and 60 < m.count() < 130
    u = mixing.uniform(1, F.col("id"))
    mean = docs.sparkSession.range(20000).select(mixing.poisson(u, F.lit(2.5)).alias("k")).agg(F.avg("k"), F.var_samp("k")).first()
    assert mean[0] == pytest.approx(2.5, abs=0.05) and mean[1] == pytest.approx(2.5, abs=0.12)


def test_mixing_of_a_small_source_has_no_bound_on_its_rate(spark, monkeypatch):
    from decimal import Decimal, localcontext

    asked = [(u, r) for r in (0.5, 650.25, 699.75, 700.25, 1234.5, 39000.75) for u in (0.0, 2.0**-52, 1e-9, 0.1, 0.5, 0.9, 1 - 1e-9)]
    want = []
    with localcontext() as c:
        c.prec = 60
        for u, r in asked:
            k, rate = 0, Decimal(r)
            term = cdf = (-rate).exp()
            while cdf <= Decimal(u):
                k += 1
                term = term * rate / k
                cdf += term
            want.append((u, r, k))
    df = spark.createDataFrame(asked, "u double, r double")
    assert got(df.select("u", "r", mixing.poisson(F.col("u"), F.col("r")))) == sorted(want, key=str)
    monkeypatch.setattr(mixing, "BLOCK", 1000)
    rows = spark.createDataFrame([(1, "x" * 40_000, "large"), (2, "y", "small"), (None, "z", "small")], "doc_id long, text string, source string")
    m = mixing.mix_sources(rows, weights={"large": 1, "small": 1}).groupBy("doc_id").agg(F.count("*"), F.count_distinct("mix_copy"), F.max("mix_copy") + 1, F.max("mix_copies"))
    counts = {r[0]: r[1:] for r in m.collect()}
    assert all(len(set(v)) == 1 for v in counts.values())
    assert all(abs(counts[k][0] - 10_000) < 600 for k in (2, None))


def test_mixing_with_clashing_names(docs):
    more = docs.selectExpr("*", "1 mix_copy", "2 mix_rate", "3 mix_order", "4 mix_source", "5 mix_block", "6 mix_copies")
    m = mixing.mix_sources(more)
    assert m.columns == [*more.columns, "mix_copies_", "mix_copy_", "mix_order_"]
    assert got(m.select("doc_id", "mix_copy_")) == got(mixing.mix_sources(docs).select("doc_id", "mix_copy"))


def test_sharding_of_two_writers(spark, docs, tmp_path, monkeypatch):
    one, two = (compaction.ShardStore(spark, str(tmp_path / "s"), target_bytes=60_000, fan_in=2) for _ in range(2))
    base = one.manifest()
    real, calls = two.manifest, []
    one.append(docs)
    # the second writer still holds the first version: it loses, commits again on the new one, and both arrivals stay
    monkeypatch.setattr(two, "manifest", lambda version=None: base if not calls and not calls.append(1) else real(version))
    two.append(docs)
    assert one.manifest()["version"] == 2 and got(one.read(docs.schema).drop("shard_id")) == got(docs.union(docs))
    assert got(one.read(docs.schema, 1).drop("shard_id")) == got(docs)
    with pytest.raises(compaction.Conflict):
        one.commit(base, [])
    ids = {s["id"] for s in one.manifest()["shards"]}
    assert {r[0] for r in one.read(docs.schema).select("shard_id").distinct().collect()} == ids


def test_sharding_query_and_clashing_names(spark, docs):
    more = docs.withColumn("shard_id", F.lit("mine"))
    store, rows = compaction.shard_documents(more, target_bytes=3000, fan_in=2)
    assert rows.columns == [*more.columns, "shard_id_"] and got(rows.drop("shard_id_")) == got(more)
    assert {r[0] for r in rows.select("shard_id_").distinct().collect()} <= {s["id"] for s in store.manifest()["shards"]}
    path = "/root/testdata/sf0.001"
    found = compaction.op7_sharding(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert got(found.drop("shard_id")) == got(docs.select("doc_id", "lang", "source", "n_chars", F.md5("text")))


def test_sharding(spark, docs, tmp_path):
    store = compaction.ShardStore(spark, str(tmp_path / "s"), target_bytes=60_000, fan_in=3)
    for _ in range(4):
        store.append(docs.repartition(2))
    store.append(docs.limit(0))
    before = store.manifest()
    store.compact()
    assert len(store.manifest()["shards"]) < len(before["shards"]) and not store.plan(store.manifest()["shards"])
    assert got(store.read(docs.schema).drop("shard_id")) == got(docs.union(docs).union(docs).union(docs))
    with pytest.raises(Exception):
        store.commit(before, [])
    assert got(store.read(docs.schema, before["version"]).drop("shard_id")) == got(store.read(docs.schema).drop("shard_id"))
    store.vacuum()
    assert store.versions() == [store.manifest()["version"]] and store.read(docs.schema).count() == 4 * docs.count()


def test_media_round_trip(docs, pairs):
    found = media.sniff_media(media.store_texts(docs))
    for r in found.collect():
        payload = r.media[44:]
        assert r.detected == "wav" and len(payload) % 576 == 0 and len(payload) > 0 and payload[r.n_bytes :].strip(b"\xff") == b""
    inner = b"RIFF\x28\0\0\0WAVEfmt \x10\0\0\0\1\0\1\0\x40\x1f\0\0\x40\x1f\0\0\1\0\x08\0data\4\0\0\0abcd"
    assert media.sniff(b"PK\x03\x04junk BM" + inner + b"RIFF1234WAVE", media.automaton()) == [("wav", 11, 48)]
    import gzip

    z = gzip.compress(b"x" * 5000)
    assert media.sniff(b"--" + z + b"--", media.automaton()) == [("gzip", 2, len(z))]


def test_media_query_digests(spark, docs, pairs):
    want = []
    for i, t in pairs:
        b = (t or "").encode()
        b_ = b + b"\xff" * (-len(b) % 576 or (576 if not b else 0))
        want.append((i, len(b), len(b_), hashlib.sha256(b_).hexdigest(), zlib.crc32(b_[-32:])))
    rows = media._digests(media._sniffed(media._stored(iter(docs.select("doc_id", "text").toArrow().to_batches()))))
    found = [tuple(r.values()) for batch in rows for r in batch.to_pylist()]
    assert sorted((r[:5] for r in found), key=str) == sorted(want, key=str)
    stored_ = {r.doc_id: bytes(r.media) for r in media.store_texts(docs).collect()}
    for i, _, size, _, _, n, digest, feature in found:
        assert n == len(stored_[i]) == size + 44 and digest == hashlib.sha256(stored_[i]).hexdigest()
        assert feature.startswith(f"wav;samples={size};sum={sum(stored_[i][44:])};")


def formats():
    import struct

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    box = lambda k, d: struct.pack(">I", 8 + len(d)) + k + d
    return {
        "png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x" * 13) + chunk(b"IDAT", b"yy") + chunk(b"IEND", b""),
        "gif": b"GIF89a\1\0\1\0\x80\0\0" + b"c" * 6 + b"!\xf9\4abcd\0" + b",\0\0\0\0\1\0\1\0\0" + b"\2\2ab\0;",
        "jpeg": b"\xff\xd8\xff\xe0\0\4ab" + b"\xff\xda\0\4cd" + b"scan" + b"\xff\xd9",
        "bmp": b"BM" + struct.pack("<IIII", 60, 0, 54, 40) + b"p" * 42,
        "ogg": b"OggS\0\2" + b"h" * 20 + b"\1\3abc" + b"OggS\0\4" + b"h" * 20 + b"\0",
        "mp4": box(b"ftyp", b"isom") + box(b"moov", b"m" * 5) + box(b"mdat", b"d" * 9),
        "flac": b"fLaC\0\0\0\x22" + b"i" * 34 + b"\x84\0\0\2ab" + b"frames",
    }


def test_media_formats_are_confirmed_corrected_and_carved(spark):
    magic = media.automaton()
    for kind, b in formats().items():
        assert media.sniff(b, magic) == [(kind, 0, len(b))], kind
        tail = b"" if kind == "flac" else b"--\x01"
        assert (kind, 3, len(b)) in media.sniff(b"abc" + b + tail, magic), kind
        assert not [x for x in media.sniff(b[: 12 if kind == "mp4" else len(b) * 2 // 3], magic) if x[0] == kind and kind != "flac"], kind
    png, gif = formats()["png"], formats()["gif"]
    rows = [(1, 5, png + b"--" + gif, "gif"), (2, 0, None, "wav"), (3, 0, b"", None), (1, 5, png + b"--" + gif, "gif")]
    df = media.sniff_media(spark.createDataFrame([(a, b, bytearray(c) if c is not None else None, d) for a, b, c, d in rows], media.STORED))
    assert got(df.select("doc_id", "detected", "type")) == sorted([(1, "png", "png"), (1, "png", "png"), (2, None, "wav"), (3, None, None)], key=str)
    assert [bytes(r.bytes) for r in media.carve(df).collect()] == [gif, gif]


def test_media_of_many_magics_takes_linear_time():
    import time

    magic = media.automaton()
    for unit in (b"%PDF-1.4 ", b"startxref 0 %%EOF %PDF-", b"1 0 obj /XRef startxref 9 %%EOF %PDF-", b"PK\x03\x04PK\x05\x06" + b"\0" * 18, b"GIF89a\0\0\0\0\0\0\0", b"\xff\xd8\xff\xe0\0\4", b"\0\0\0\x08ftyp"):
        took = []
        for n in (1 << 18, 1 << 20):
            began = time.perf_counter()
            media.sniff(unit * (n // len(unit)), magic)
            took.append(time.perf_counter() - began)
        assert took[1] < 10 * took[0] + 0.5 and took[1] < 8, (unit, took)


def test_media_ends_of_revised_pdfs_and_nested_zips():
    import io
    import zipfile

    def pdf(head=b"%PDF-1.4\n1 0 obj <<>> endobj\n", prev=None):
        link = b"" if prev is None else b"/Prev %d " % prev
        return head + b"xref\n0 1\ntrailer << %s>>\nstartxref\n%d\n%%%%EOF" % (link, len(head)), len(head)

    one, at = pdf()
    two, later = pdf(one + b"\n2 0 obj <<>> endobj\n", at)
    three, _ = pdf(two + b"\n3 0 obj <<>> endobj\n", later)
    linear = b"%PDF-1.4\n1 0 obj << /Linearized 1 /L 00000 >> endobj\n"
    page = linear + b"xref\n0 1\ntrailer << >>\nstartxref\n0\n%%EOF\n"
    whole = (page + b"xref\n0 1\ntrailer << >>\nstartxref\n%d\n%%%%EOF" % len(linear)).replace(b"00000", b"%05d" % (len(page) + 39 + len(str(len(linear)))))
    magic = media.automaton()
    length = lambda b: [x[1:] for x in media.sniff(b"--" + b + b"--", magic) if x[0] == "pdf"]
    for x in (one, two, three, whole):
        assert length(x) == [(2, len(x))]
    assert length(two + one) == [(2, len(two)), (2 + len(two), len(one))] and length(one + one) == [(2, len(one)), (2 + len(one), len(one))]
    assert length(one[: -len("startxref\n00\n%%EOF")] + b"startxref\n5\n%%EOF") == []

    def archive(name, data):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(name, data)
        return out.getvalue()

    inner = archive("a.txt", b"text")
    outer = archive("inner.zip", inner)
    assert media.sniff(b"--" + outer + b"--", magic) == [("zip", 2, len(outer)), ("zip", 2 + outer.find(inner), len(inner))]


def test_chat(spark):
    rng, rows = random.Random(5), []
    for c in [*range(8), None]:
        for t in range(rng.randint(1, 12)):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "tool:x", None])
            rows.append((c, t, role, rng.choice([None, "", "\\### User: <</turn>\n\\", "words and words " * rng.randint(1, 30)]), "extra"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    w = chat.chat_windows(df, budget=60, history=20, tokenizer=None)
    assert w.where("n_tokens > 60 and n_turns - repeated > 1").count() == 0 and w.where("window > 0 and repeated > 0").count() > 0
    want = []
    for c in [*range(8), None]:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want.append((c, len(own), hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    assert got(chat.read_back(w).drop("formatted_chars")) == sorted(want, key=str)


def test_toxicity_finds_unseen_misspellings():
    rng = random.Random(2)
    plain = ["and", "house", "green", "walk", "river", "stone", "letter", "window", "table", "bread"]
    texts = [" ".join(rng.choice(plain) for _ in range(40)) for _ in range(300)]
    bad = [t + " you wretched scoundrel" for t in texts[:100]]
    model = toxicity.train(pa.array(bad + texts[100:]), np.array([1] * 100 + [0] * 200), 1 / 3)
    score = toxicity.Scorer(model)(pa.array([texts[0] + " you wretchedd scoundrell", texts[1], "", None]))
    assert score[0] > 0.3 > score[1] and score[2] == score[3]
    assert toxicity.Scorer(toxicity.train(pa.array(["a", None]), np.array([0, 0]), 0.0))(pa.array(["a"]))[0] < 1e-6


def naive_features(texts_):
    """Share of each bucket in each text: n-grams within a word, words within a text, counted equally."""
    out = np.zeros((len(texts_), toxicity.BUCKETS), np.float32)
    for k, t in enumerate(texts_):
        w = [x.encode() for x in re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower(t))]
        for x in w:
            g = [b"<" + x + b">"]
            grams = [g[0][j : j + n] for n in toxicity.GRAMS for j in range(len(g[0]) - n + 1)]
            h = lambda v: simhash.span_hashes(np.frombuffer(v, np.uint8), np.array([0]), np.array([len(v)]))[0]
            hashes = [h(v) for v in grams] + [simhash.mix(np.array([h(g[0])], np.uint64) + np.uint64(1))[0]]
            for v in hashes:
                out[k, int(v) & toxicity.BUCKETS - 1] += 1 / len(hashes) / len(w)
    return out


def test_toxicity_against_a_dense_model(monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKETS", 1 << 11)
    rng = random.Random(6)
    texts_ = [" ".join(rng.choice(["bad", "Good", "wörd", "a1", "longerword", "b"]) for _ in range(rng.randint(0, 12))) for _ in range(30)] + [None]
    y = np.array([float("bad" in (t or "")) for t in texts_], np.float32)
    scores, slope, shift = toxicity.train(pa.array(texts_), y, 0.25, steps=15, least=1)
    x = naive_features(texts_).astype(float)
    used = np.flatnonzero(x.any(0))
    x = x[:, used]
    fit = np.arange(len(y)) % 5 != 4
    weight = fit * np.where(y > 0, 0.5 / y[fit].sum(), 0.5 / (1 - y[fit]).sum())
    frequency = x[fit].mean(0)
    gen = np.random.default_rng(7)
    emb, soft, bias = gen.normal(0, 0.01, (len(used), toxicity.DIM)), gen.normal(0, 1 / toxicity.DIM**0.5, (toxicity.DIM, 2)), np.zeros(2)
    moved = np.zeros_like(emb)
    for _ in range(15):
        mean = x @ emb  # a text's vector
        z = mean @ soft + bias
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        residual = (p - np.stack([1 - y, y], 1)) * weight[:, None]
        moved = 0.9 * moved + (x.T @ residual @ soft.T) / (frequency + frequency.max() * 1e-4)[:, None] + 1e-3 * emb
        push = mean.T @ residual
        emb, soft, bias = emb - 0.3 * moved, soft - 0.3 * 0.01 * push, bias - 0.3 * residual.sum(0)
    want = emb @ (soft[:, 1] - soft[:, 0])
    assert np.allclose(scores[used], want, rtol=1e-3, atol=1e-4)
    given = toxicity.Scorer((scores, slope, shift))(pa.array(texts_))
    assert np.allclose(given, 1 / (1 + np.exp(-(slope * (x @ scores[used]) + shift))), atol=1e-5)


def test_toxicity_query_and_sample(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(24)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    learnable = [k for k in range(24) if zlib.crc32(str(k).encode()) % 4 != 2]
    texts_, y, share = toxicity.sampled(docs.union(docs), labels)
    assert len(texts_) == len(learnable) and y.sum() == sum(k % 2 for k in learnable) and share == pytest.approx(y.mean())
    assert len(toxicity.sampled(docs, labels, sample=3)[0]) == 6
    short = toxicity.sampled(docs, labels, sample_bytes=500)[0]
    assert 0 < sum(len((t or "").encode()) for t in short.to_pylist()) <= 1000
    model = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs.union(docs), model).collect()
    own = dict(docs.select("doc_id", "text").collect())
    plain = dict(zip(own, toxicity.Scorer(model)(pa.array(list(own.values())))))
    assert len(rows) == 2 * docs.count() and all(r.score == pytest.approx(plain[r.doc_id], abs=1e-9) and r.predicted == (r.score >= 0.3) for r in rows)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and got(kept.select("doc_id")) == sorted(((i,) for i, p in plain.items() if p < 0.3), key=str)


def test_held_out_rule(spark):
    d = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "doc_id long")
    for r in d.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def naive_perplexities(rows, trusted):
    """Interpolated modified Kneser-Ney over bytes, by recursion: {(id, text): perplexity}."""
    from collections import Counter

    symbols = lambda t: [0, 0, 0, *(t or "").encode(), 0]
    out = {}
    for lang in {r[2] for r in rows}:
        seqs = [symbols(t) for i, t, x in rows if x == lang and i in trusted]
        counts = {4: Counter(tuple(s[k - 3 : k + 1]) for s in seqs for k in range(3, len(s)))}
        for n in (3, 2, 1):
            counts[n] = Counter(g[1:] for g in counts[n + 1])
        cuts, total, mass = {}, {}, {}
        for n, c in counts.items():
            m = Counter(c.values())
            y = m[1] / (m[1] + 2 * m[2]) if m[1] else None
            d = [max(0.1, min(k, k - (k + 1) * y * m[k + 1] / m[k] if y and m[k] and m[k + 1] else 0.5 * k)) for k in (1, 2, 3)]
            cuts[n] = lambda x, d=d: d[min(x, 3) - 1]
            total[n], mass[n] = Counter(), Counter()
            for g, x in c.items():
                total[n][g[:-1]] += x
                mass[n][g[:-1]] += cuts[n](x)

        def p(g):
            n = len(g)
            below = p(g[1:]) if n > 1 else 1 / 256
            x = counts[n][g]
            return ((x - cuts[n](x) if x else 0) + mass[n][g[:-1]] * below) / total[n][g[:-1]] if total[n][g[:-1]] else below

        for i, t, x in rows:
            if x == lang:
                s = symbols(t)
                logs = [np.log(p(tuple(s[k - 3 : k + 1]))) for k in range(3, len(s))]
                out[i, t] = float(np.exp(-np.mean(logs))) if seqs else None
    return out


def test_quality_against_a_plain_model(spark, docs):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect() if len(r.text or "") < 5000]
    small_ = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 20, 2)] + [(k, 0) for k in range(1, 20, 2)] + [(4, 0), (6, None)], "doc_id long, quality int")
    want = naive_perplexities(rows, {k for k in range(0, 20, 2)} - {4})
    found = quality.score_quality(small_.withColumn("perplexity", F.lit(1)), labels).collect()
    assert len(found) == len(rows)
    for r in found:
        match = [v for (i, _), v in want.items() if i == r.doc_id]
        assert len(match) == 1 and (r.perplexity is None if match[0] is None else r.perplexity == pytest.approx(match[0], rel=1e-4))
    assert any(r.perplexity for r in found)


def test_quality_is_a_distribution_and_shards_agree(spark, docs):
    labels = spark.createDataFrame([(k, 1 if k % 2 else None) for k in range(20)] + [(3, 0)], "doc_id long, quality int")
    a = quality.score_quality(docs, labels)
    b = quality.score_quality(docs, labels, shard_rows=2000)
    for x, y in zip(got(a.select("doc_id", "n_symbols", "perplexity")), got(b.select("doc_id", "n_symbols", "perplexity"))):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], rel=1e-5)
    assert a.count() == docs.count()
    # with every continuation of a context asked for, the probabilities sum to 1
    ctx = 0x61626300
    asked = spark.createDataFrame([("en", ctx + k, 0) for k in range(256)] + [("en", ctx + 0x64, 3), ("en", ctx + 0x65, 1), ("en", 0x62636465, 2)], "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))
    p = quality.probabilities(asked).where(f"g between {ctx} and {ctx + 255}").agg(F.sum(F.exp("logp"))).first()[0]
    assert p == pytest.approx(1, abs=1e-3)


def test_line_dedup_of_a_long_text_takes_linear_time(spark):
    import time

    text = "\n".join(f"a long enough line of over forty characters, number {k}" for k in range(60_000))
    docs = spark.createDataFrame([(k, text) for k in range(5)], "doc_id long, text string")
    began = time.perf_counter()
    assert sorted((r.doc_id, r.n_dropped) for r in lines.dedup_lines(docs).select("doc_id", "n_dropped", F.sha2("text", 256)).collect()) == [(k, 60_000 if k < 4 else 0) for k in range(5)]
    assert time.perf_counter() - began < 60


def test_shared_folder_is_refused_where_executors_could_not_see_it(monkeypatch):
    from types import SimpleNamespace

    from tallyspark.llm import common

    conf = SimpleNamespace(get=lambda *a: None)
    empty = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: empty)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (lines.dedup_lines(none), substrings.dedup_substrings(none), simhash.near_duplicates(none), decontam.find_patterns(keyed(none, "doc_id", "text"), bench), mixing.mix_sources(none), quality.score_quality(none, labels), media.sniff_media(media.store_texts(none)), simhash.drop_near_duplicates(none), chat.read_back(chat.chat_windows(turns, tokenizer=None)), toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels)), compaction.shard_documents(none)[1]):
        assert df.count() == 0
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).where("predicted = 1").count() == 0
    assert decontam.drop_contaminated(docs, bench).count() == docs.count()
