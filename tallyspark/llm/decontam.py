"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 10 consecutive words of a benchmark item (or a whole shorter item). A block is the last two
words of a position; the shift table says how far the search can move on from it (9 words, if the block is in no
pattern), so most positions are never looked at. The table has 64 slots or more for each pattern, so that a full block
of patterns still leaves nine tenths of it at the full shift. Where the shift is 0, the block's hash selects a bucket of patterns,
a hash of the whole window picks the candidate in it, and a direct comparison of the words' bytes confirms the
occurrence. Many pointers move through a batch at once, each over its own lane of positions. Patterns are grouped by
their number of words; each group has its own table, built once in each worker.

Patterns go to the executors in blocks of at most BLOCK patterns: one broadcast of a bounded size for each pass over
the documents; with one block there is one pass and no shuffle.

Edge cases: null, empty or wordless documents have no words and no hits; items without words have no pattern; an
item_id that repeats adds its windows to the same item; a null item_id counts as the item "null" if its text has
words; rows that repeat are each reported, in one pass or many; a very long text is searched whole, alone in its chunk; an
empty benchmark leaves all clean; find_patterns() reads only identifiers and texts, drop_contaminated() passes all columns.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, chunks, keyed, restored, span_hashes, table, tidy, word_spans

WINDOW, LANE = 10, 256
#: Bits of the smallest and of the largest shift table.
TABLE_BITS = 16, 24
#: Patterns in a broadcast; about 150 bytes each.
BLOCK = 200_000


def words_of(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    raw = data.tobytes()
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def patterns_of(text: str | None, window: int = WINDOW) -> set[tuple[int, bytes]]:
    """(number of words, words joined by spaces) of each window of an item."""
    w = words_of(text)
    m = min(window, len(w))
    return {(m, b" ".join(w[k : k + m])) for k in range(len(w) - m + 1)} if w else set()


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)


class Group:
    """Shift table and buckets of the patterns {words: items} of m words each."""

    def __init__(self, m: int, patterns: dict[bytes, list[str]]):
        self.m, self.block = m, min(2, m)
        self.bits = min(max(TABLE_BITS[0], (64 * len(patterns) - 1).bit_length()), TABLE_BITS[1])
        data = np.frombuffer(b" ".join(patterns), np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
        hashes = span_hashes(data, starts, ends).reshape(len(patterns), m)
        far = m - self.block + 1
        self.shift = np.full(1 << self.bits, far, np.uint8)
        for k in range(self.block - 1, m):
            at = self.blocks(hashes[:, k - self.block + 1], hashes[:, k])
            np.minimum.at(self.shift, (at >> np.uint64(64 - self.bits)).astype(np.int64), min(far, m - 1 - k))
        whole = span_hashes(hashes.reshape(-1), m * np.arange(len(patterns)), m * np.arange(1, len(patterns) + 1))
        order = np.lexsort((whole, at))
        #: Buckets, as rows sorted by suffix and window.
        self.suffixes, self.windows = at[order], whole[order]
        known = list(patterns.items())
        self.patterns = [known[k] for k in order.tolist()]

    def blocks(self, a, b):
        return _pairs(a, b) if self.block == 2 else b * np.uint64(0x9E3779B97F4A7C15)

    def candidates(self, h: np.ndarray) -> np.ndarray:
        """Ends (word positions) of windows whose last block is that of a pattern."""
        first = np.arange(0, max(0, len(h) - self.m + 1), LANE) + self.m - 1
        pos, stop, found = first, np.minimum(first + LANE, len(h)), []
        while len(pos):
            block = self.blocks(h[pos - self.block + 1], h[pos])
            step = self.shift[(block >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
            hit = np.flatnonzero(step == 0)
            if len(hit):
                at = np.searchsorted(self.suffixes, block[hit])
                at[at == len(self.suffixes)] = 0
                found.append(pos[hit[self.suffixes[at] == block[hit]]])
            pos = pos + np.maximum(step, 1)
            on = pos < stop
            pos, stop = pos[on], stop[on]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def bucket(self, suffix: int, window: int) -> Iterator[tuple[bytes, list[str]]]:
        """The patterns of a suffix with this hash of the whole window."""
        lo, hi = np.searchsorted(self.suffixes, np.uint64(suffix)), np.searchsorted(self.suffixes, np.uint64(suffix), "right")
        lo, hi = lo + np.searchsorted(self.windows[lo:hi], np.uint64(window)), lo + np.searchsorted(self.windows[lo:hi], np.uint64(window), "right")
        return iter(self.patterns[lo:hi])


def search(groups: list[Group], data: np.ndarray, offs: np.ndarray):
    """(words of each text, [(text, first word, end word, item ids of the pattern)])."""
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offs, ALNUM)
    h, hits = span_hashes(data, starts, ends), []
    for g in groups:
        pos = np.sort(g.candidates(h))
        if not len(pos):
            continue
        owner = np.searchsorted(bounds, pos, "right") - 1
        ok = pos - g.m + 1 >= bounds[owner]
        pos, owner = pos[ok], owner[ok]
        suffix, window = g.blocks(h[pos - g.block + 1], h[pos]), span_hashes(h, pos - g.m + 1, pos + 1)
        likely = np.isin(window, g.windows)
        for p, t, x, y in zip(pos[likely].tolist(), owner[likely].tolist(), suffix[likely].tolist(), window[likely].tolist()):
            lo = p - g.m + 1
            words = None
            for pattern, items in g.bucket(x, y):
                words = words or b" ".join(data[a:b].tobytes() for a, b in zip(starts[lo : p + 1].tolist(), ends[lo : p + 1].tolist()))
                if pattern == words:
                    hits.append((t, lo - int(bounds[t]), p + 1 - int(bounds[t]), items))
    return np.diff(bounds), hits


#: The tables of the last broadcast that this worker has met.
_built: dict[str, list[Group]] = {}


def _groups(value: tuple[str, dict]) -> list[Group]:
    name, by_size = value
    if name not in _built:
        _built.clear()
        _built[name] = [Group(m, by_size[m]) for m in sorted(by_size)]
    return _built[name]


def _blocks(benchmark: DataFrame, window: int, block: int, items: bool) -> Iterator[tuple[str, dict]]:
    """The benchmark's patterns in blocks, as {words: {pattern: items}}; read one partition at a time."""
    by_size, held = defaultdict(dict), 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("string")).toLocalIterator():
        for m, p in patterns_of(row[1], window):
            own = by_size[m].get(p)
            if own is None:
                own = by_size[m][p] = []
                held += 1
            if items and row[0] not in own:
                own.append(row[0])
        if held >= block:
            yield uuid.uuid4().hex, dict(by_size)
            by_size, held = defaultdict(dict), 0
    if held:
        yield uuid.uuid4().hex, dict(by_size)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_found = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def find_patterns(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(id, n_words, spans of hit words, items) of each row of keyed(): merged spans and sorted item ids."""
    spark = docs.sparkSession
    shape = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])

    def finder(shared):
        def run(batches):
            groups = _groups(shared.value)
            for batch in batches:
                for lo, hi, data, offs in chunks(batch.column(1)):
                    n, hits = search(groups, data, offs)
                    spans, items = defaultdict(list), defaultdict(set)
                    for t, a, b, ids in hits:
                        spans[t].append((a, b))
                        items[t].update(ids)
                    keys = [(c, batch.column(c).slice(lo, hi - lo)) for c in batch.schema.names if c != "text"]
                    yield pa.RecordBatch.from_arrays([*[x for _, x in keys], pa.array(n, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in _merged(spans.get(t, []))] for t in range(hi - lo)], shape.field("spans").type), pa.array([sorted(items.get(t, ())) for t in range(hi - lo)], shape.field("items").type)], [*[c for c, _ in keys], *shape.names])

        return run

    shared = [spark.sparkContext.broadcast(b) for b in _blocks(benchmark, window, block, True)] or [spark.sparkContext.broadcast(("", {}))]
    if len(shared) == 1:
        return docs.select("id", "text").mapInArrow(tidy(finder(shared[0])), f"id long, {_found}")
    # more patterns than one broadcast holds: the passes' spans meet by id and text, and equal rows, which have equal
    # spans, are counted and given again as often as they came
    hashed = docs.select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    passes = [hashed.mapInArrow(tidy(finder(s)), f"id long, h1 long, h2 long, {_found}") for s in shared]
    rows = passes[0]
    for p in passes[1:]:
        rows = rows.unionByName(p)
    spans = rows.groupBy("id", "h1", "h2", "n_words").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.expr(f"count(*) div {len(passes)}").alias("times"))
    spans = spans.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("id", "n_words", "spans", "items")
    merge = F.aggregate("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)"), lambda out, x: F.when((F.size(out) > 0) & (x.start <= F.element_at(out, -1).end), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1).start.alias("start"), F.greatest(F.element_at(out, -1).end, x.end).alias("end"))))).otherwise(F.concat(out, F.array(x))))
    return spans.withColumn("spans", merge)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, without any window's occurrence: a pass for each block of patterns, no join."""
    schema, spark = docs.schema, docs.sparkSession

    def cleaner(shared):
        def run(batches):
            groups = _groups(shared.value)
            for batch in batches:
                at = batch.schema.get_field_index("text")
                for lo, hi, data, offs in chunks(batch.column(at)):
                    hit = np.zeros(hi - lo, bool)
                    hit[[x[0] for x in search(groups, data, offs)[1]]] = True
                    yield batch.slice(lo, hi - lo).filter(pa.array(~hit))

        return run

    for b in _blocks(benchmark, window, block, False):
        docs = docs.mapInArrow(tidy(cleaner(spark.sparkContext.broadcast(b))), schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_patterns(keyed(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.end - x.start)
    return found.select(restored().alias("doc_id"), "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
with i as (
  select coalesce(item_id::varchar, 'null') item, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark
), p as (
  select item, least(len(ws), {WINDOW}) m, ws, unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) pos from i where len(ws) > 0
), q as (
  select distinct item, m, md5(array_to_string(ws[pos:pos + m - 1], ' ')) key from p
), d as (
  select doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents
), w as (
  select doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) pos from d, (select distinct m from q) where len(ws) >= m
), h as (
  select w.doc_id, w.pos, w.m, q.item from w join q on q.m = w.m and q.key = md5(array_to_string(w.ws[w.pos:w.pos + w.m - 1], ' '))
), n as (
  select doc_id, count(distinct at_) n_hit from (select doc_id, unnest(range(pos, pos + m)) at_ from h) group by doc_id
), s as (
  select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from h) group by doc_id
)
select doc_id, len(ws) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from d left join n using (doc_id) left join s using (doc_id)
"""
