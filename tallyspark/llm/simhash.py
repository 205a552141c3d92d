"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint of 64 bits is embedded as the bit counts of its 32 segments of two bits. Manhattan distance between
embeddings is never over the Hamming distance, so links (Hamming distance of 3 or less) lie within 3 there. The range
join runs on a grid: the 32 axes are grouped into six slabs; two points within 3 differ in at most three slabs, so
they share a cell of one of the 20 grids that fix three slabs. Cell mates within 3 are verified exactly.

Only distinct fingerprints enter the join, so exact copies cost nothing. A cell links its members by a spanning
forest, not by all pairs. A cell of over CELL members is dealt out again under 20 finer cells for each member (three
of six interleaved parts of all bits, by the same argument for exact bits), where at most 2^16 fingerprints meet;
inside a task, runs of equal keys are split further in the same way. Components then spread over the links by
alternating large-star and small-star steps, all in DataFrames.

near_duplicates() links three-word fingerprints, h being XXH64, as its query's contract says. drop_near_duplicates(),
a pipeline's stage, asks for five-word shingles and a similarity of 0.8: there a point of the grid is one of three
fingerprints of a text's words (each weighted by the root of its count, in sixteenths), and two texts are linked if one of these
differs in 3 bits or less, and those of their different five-word shingles in at most 13, the angle of a cosine of
0.8; or if the latter are equal.

Edge cases: a null, empty or wordless text has fingerprint zero and links as any other; fewer words than a shingle
has are one shingle; a text of any length is read whole, in blocks; rows that share a doc_id are separate rows with
one component where they link; a null doc_id is smaller than all others and reported as null; no rows give no rows;
near_duplicates() reads the identifier and text alone; drop_near_duplicates() passes all columns, of whatever names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NULL_ID, SPACED, chunks, free_name, keyed, mix, release, restored, span_hashes, stored, table, tidy, word_spans

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: Of the pipeline's stage: words in a shingle, bits by which shingles' fingerprints may differ, fingerprints of words.
STAGE_SHINGLE, STAGE_DISTANCE, STAGE_POINTS = 5, 13, 3
CELL, RUN = 20_000, 2048


def fingerprints_of(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text of a buffer."""
    import xxhash

    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offs, SPACED)
    lens = ends - starts
    # the words alone, each followed by a space: a shingle is a slice
    mark = np.zeros(len(data) + 1, np.int32)
    mark[starts] += 1
    mark[ends] -= 1
    inside = np.cumsum(mark[:-1]) > 0
    at = np.concatenate([[0], np.cumsum(lens + 1)])
    flat = np.full(int(at[-1]), 0x20, np.uint8)
    keep = np.ones(len(flat), bool)
    keep[at[1:] - 1] = False
    flat[keep] = data[inside]
    view, first, last = memoryview(flat.tobytes()), at[:-1], at[1:] - 1
    n = np.diff(bounds)
    shingles = np.where(n > 0, np.maximum(n - size, 0) + 1, 0)
    edges = np.concatenate([[0], np.cumsum(shingles)])
    start = np.arange(edges[-1]) + np.repeat(bounds[:-1] - edges[:-1], shingles)
    end = start + np.repeat(np.minimum(size, n), shingles) - 1
    hash_ = xxhash.xxh64_intdigest
    h = np.fromiter((hash_(view[a:b], SEED) for a, b in zip(first[start].tolist(), last[end].tolist())), np.uint64, len(start))
    return _majority(h, edges)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, fp) of each row of keyed(), and its columns besides the text."""
    more = [c for c in docs.columns if c not in ("id", "text")]

    def run(batches):
        for batch in batches:
            got = [fingerprints_of(data, offs) for _, _, data, offs in chunks(batch.column(1))]
            fp = np.concatenate(got) if got else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], ["id", "fp", *more])

    return docs.select("id", "text", *more).mapInArrow(tidy(run), ", ".join(["id long, fp long", *[f"{c} {docs.schema[c].dataType.simpleString()}" for c in more]]))


def _majority(values: np.ndarray, bounds: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """For each text the fingerprint of its values (values[bounds[t]:bounds[t + 1]]): bits set in over half their weight.

    Weights are whole numbers, so sums don't depend on where a block ends."""
    ones, total = np.zeros((len(bounds) - 1, 64)), np.zeros(len(bounds) - 1)
    for lo in range(0, len(values), 1 << 15):
        hi = min(lo + (1 << 15), len(values))
        t = np.arange(np.searchsorted(bounds, lo, "right") - 1, np.searchsorted(bounds, hi, "left"))
        t = t[bounds[t + 1] > bounds[t]]
        at = np.append(np.maximum(bounds[t], lo), hi) - lo
        bits = np.unpackbits(values[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w = np.ones(hi - lo) if weights is None else weights[lo:hi].astype(np.float64)
        if hi - lo < 16 * len(t):  # short texts
            ones[t] += np.add.reduceat(bits * w[:, None], at[:-1], axis=0)
        else:
            bits = bits.astype(np.float64)
            for k, x, y in zip(t.tolist(), at[:-1].tolist(), at[1:].tolist()):
                ones[k] += w[x:y] @ bits[x:y]
        total[t] += np.add.reduceat(w, at[:-1])
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _distinct(owner: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, count, bounds) of each text's different values, told apart by the upper 44 bits: one sort of numbers."""
    if texts >= 1 << 20:
        raise ValueError("at most 2^20 - 1 texts at once")
    key = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count, key = np.diff(np.append(first, len(key))), key[first]
    return mix(key << np.uint64(20)), count, np.searchsorted(key >> np.uint64(44), np.arange(texts + 1, dtype=np.uint64))


def stage_fingerprints_of(data: np.ndarray, offs: np.ndarray, size: int = STAGE_SHINGLE, points: int = STAGE_POINTS) -> list[np.ndarray]:
    """The shingles' fingerprint of each text of a buffer, and its words' fingerprints."""
    data, texts = LOWER[data], len(offs) - 1
    starts, ends, bounds = word_spans(data, offs, SPACED)
    h = span_hashes(data, starts, ends)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(texts), n)
    take = np.minimum(size, n)[owner]
    first = np.arange(len(h))
    whole = first + take <= bounds[1:][owner]
    first, take = first[whole], take[whole]
    shingles, _, at = _distinct(owner[whole], span_hashes(h, first, first + take), texts)
    out = [_majority(shingles, at)]
    words, count, at = _distinct(owner, h, texts)
    weight = np.rint(16 * np.sqrt(count))
    return out + [_majority(mix(words + np.uint64(k + 1)), at, weight) for k in range(points)]


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The embedding, two bits for each count."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))


def manhattan(a, b) -> np.ndarray:
    """Distance between embeddings a and b of popcounts()."""
    low = np.uint64(0x3333333333333333)
    total = np.zeros(np.broadcast(a, b).shape, np.uint8)
    for shift in (0, 2):
        x, y = (a >> np.uint64(shift)) & low, (b >> np.uint64(shift)) & low
        # |x - y| of nibbles 0..2 without borrows: the sum of both saturated differences
        hi = np.uint64(0x8888888888888888)
        d = ((x | hi) - y) ^ hi
        neg = (d >> np.uint64(3)) & np.uint64(0x1111111111111111)
        full = neg * np.uint64(15)
        d = (d ^ full) + neg
        total += np.bitwise_count(d & np.uint64(0x1111111111111111)) + 2 * np.bitwise_count(d & np.uint64(0x2222222222222222))
    return total


#: Bits of the six slabs of the grid; each holds whole segments of two bits.
_SLABS = [sum(3 << (2 * k) for k in part) for part in np.array_split(np.arange(32), 6)]
_GRIDS = [np.uint64(sum(c)) for c in combinations(_SLABS, 3)]


def _parts(bits: np.ndarray) -> list[np.uint64]:
    """The 20 masks that fix three of six parts of these bits."""
    return [np.uint64(sum(1 << int(k) for k in np.concatenate(c))) for c in combinations(np.array_split(bits, 6), 3)]


def _tree(a: np.ndarray, b: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (two arrays of b) of a spanning forest: breadth first, so that a dense run costs little more than its length."""
    if len(a) <= 8:  # few enough to verify each pair at once
        one, two, root, found = a.tolist(), b.tolist(), list(range(len(a))), []
        for i, j in combinations(range(len(a)), 2):
            if root[i] != root[j] and (one[i] ^ one[j]).bit_count() <= DISTANCE and (two[i] ^ two[j]).bit_count() <= within:
                found.append((i, j))
                root = [root[i] if r == root[j] else r for r in root]
        at = np.array(found, np.int64).reshape(-1, 2)
        return b[at[:, 0]], b[at[:, 1]]
    embedded, left, right, todo = popcounts(a), [], [], np.arange(len(a))
    while len(todo) > 1:
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            part, front = front[:256], front[256:]
            for lo in range(0, len(todo), 1 << 16):
                rest = todo[lo : lo + (1 << 16)]
                x, y = np.nonzero(manhattan(embedded[part][:, None], embedded[rest][None]) <= DISTANCE)
                ok = np.bitwise_count(a[part[x]] ^ a[rest[y]]) <= DISTANCE
                if within < 64:
                    ok &= np.bitwise_count(b[part[x]] ^ b[rest[y]]) <= within
                met, at = np.unique(y[ok], return_index=True)
                left.append(b[part[x[ok][at]]])
                right.append(b[rest[met]])
                front = np.concatenate([front, rest[met]])
                todo[lo + met] = -1
            todo = todo[todo >= 0]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(a: np.ndarray, b: np.ndarray | None = None, within: int = 64, mask_left: int = 2**64 - 1) -> np.ndarray:
    """Links (pairs of b, as rows) that connect whatever chains of links connect: a within DISTANCE bits, b within `within`.

    (a, b) are distinct, b is a by default; the a agree outside mask_left. Runs of up to RUN are compared directly;
    others are sorted by each of 20 masks of which one is equal for any linked pair, and their runs are taken alone."""
    b = a if b is None else b
    if len(a) < 2:
        return np.zeros((0, 2), np.uint64)
    bits = np.flatnonzero([(mask_left >> k) & 1 for k in range(64)])
    if len(a) <= RUN or len(bits) < 12:
        return np.stack(_tree(a, b, within), 1)
    links = []
    for mask in _parts(bits):
        key = a & mask
        order = np.argsort(key, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(run) > 1:
                links.append(forest(a[run], b[run], within, mask_left & ~int(mask)))
    return np.concatenate(links) if links else np.zeros((0, 2), np.uint64)


def _cells(batches):
    """(cell, a, b): from rows (b, points...) the 20 cells of each point."""
    for batch in batches:
        b, *points = (c.to_numpy().view(np.uint64) for c in batch.columns)
        for s, a in enumerate(points):
            embedded = popcounts(a)
            cell = np.concatenate([_hash(embedded & grid, 20 * s + k) for k, grid in enumerate(_GRIDS)])
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (cell, np.tile(a, 20), np.tile(b, 20))], ["cell", "a", "b"])


def _hash(key: np.ndarray, grid: int) -> np.ndarray:
    """A cell's name; names that collide only make a larger cell."""
    return mix(mix(key) + np.uint64(grid + 1))


#: The finer cells: bits k, k + 6, k + 12, ... are a part, so each halves whatever bits a cell of the grid leaves free.
_FINER = [np.uint64(sum(1 << k for k in range(64) if k % 6 in c)) for c in combinations(range(6), 3)]


def _links(level: int, within: int = 64):
    """From rows sorted by cell to links (kind 0: a, b), and, of cells over CELL members, to finer cells (kind 1: cell, a, b)."""

    def run(batches):
        out, held, size, name, large = [], [], 0, None, False

        def defer(a, b):
            for k, mask in enumerate(_FINER):
                out.append((np.ones(len(a), np.int32), _hash(a & mask, 1000 + k) ^ np.uint64(name & (2**64 - 1)), a, b))

        def close():
            if size > 1:
                points = np.unique(np.concatenate([np.stack(x, 1) for x in held]), axis=0)
                got = forest(np.ascontiguousarray(points[:, 0]), np.ascontiguousarray(points[:, 1]), within)
                out.append((np.zeros(len(got), np.int32), np.zeros(len(got), np.uint64), got[:, 0], got[:, 1]))

        def ready():
            kinds = [np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int32 if k == 0 else np.uint64) for k in range(4)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds[0]), *[pa.array(x.view(np.int64)) for x in kinds[1:]]], ["kind", "cell", "a", "b"])

        for batch in batches:
            cell, a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy().view(np.uint64)
            if not len(cell):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
            sizes, inner = np.diff(cuts), np.ones(len(cuts) - 1, bool)
            inner[[0, -1]] = False  # the others begin and end in this batch
            pair = cuts[:-1][inner & (sizes == 2)]
            near = (np.bitwise_count(a[pair] ^ a[pair + 1]) <= DISTANCE) & (np.bitwise_count(b[pair] ^ b[pair + 1]) <= within)
            pair = pair[near]
            out.append((np.zeros(len(pair), np.int32), np.zeros(len(pair), np.uint64), b[pair], b[pair + 1]))
            for k in np.flatnonzero(~inner | (sizes > 2)).tolist():
                lo, hi = int(cuts[k]), int(cuts[k + 1])
                if cell[lo] != name:
                    close()
                    held, size, name, large = [], 0, int(cell[lo]), False
                if large:
                    defer(a[lo:hi], b[lo:hi])
                    continue
                held.append((a[lo:hi].copy(), b[lo:hi].copy()))
                size += hi - lo
                if level == 0 and size > CELL:
                    for x in held:
                        defer(*x)
                    held, size, large = [], 0, True
            yield ready()
        close()
        yield ready()

    return run


def links(points: DataFrame, within: int = 64) -> DataFrame:
    """(a, b): links between distinct rows (b, points...), named by b, that connect all that lie in one component, and no others."""
    shape = "kind int, cell long, a long, b long"
    cells = points.mapInArrow(tidy(_cells), "cell long, a long, b long")
    first = stored(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(_links(0, within)), shape))
    again = first.where("kind = 1").select("cell", "a", "b").repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(_links(1, within)), shape)
    out = stored(first.where("kind = 0").select("a", "b").unionByName(again.where("kind = 0").select("a", "b")))
    release(first)
    return out


def components(edges: DataFrame, *, most: int = 60) -> DataFrame:
    """(node, root) of each node of edges (a, b): alternating large-star and small-star steps until nothing moves.

    Groups are only ever reduced to a minimum, never collected, and each step's links are stored in the shared folder."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), edges)
    before = None
    for _ in range(most):
        both = now.unionByName(now.selectExpr("b a", "a b"))
        # stored, so that both sides of the join are plain exchanges and AQE can split the partition of a hub
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m"))
        large = both.join(least, "a").where("b > a and b <> m").selectExpr("b a", "m b").distinct()  # large star: larger neighbours go to the minimum
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").selectExpr("b a", "m b").unionByName(down.selectExpr("a", "m b")).where("a <> b").distinct()
        now = stored(small, now, least)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components didn't settle")
    out = now.selectExpr("a node", "b root")
    out._stored_at = now._stored_at
    return out


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the smallest id reachable by links, as stored for nulls (see keyed())."""
    prints = stored(fingerprints(keyed(df, id_col, text_col)))
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(distinct.selectExpr("fp b", "fp point")))
    found = stored(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), distinct, roots)
    least = found.groupBy("root").agg(F.min("first").alias("component"))
    named = stored(found.join(least, "root").select("fp", "component"), found)
    return prints.join(named, "fp").select("id", "fp", "component")


def stage_fingerprints(docs: DataFrame) -> DataFrame:
    """(id, h1, h2, b, p0, p1, ...) of rows (id, text, h1, h2)."""
    names = ["b", *[f"p{k}" for k in range(STAGE_POINTS)]]

    def run(batches):
        for batch in batches:
            got = [stage_fingerprints_of(data, offs) for _, _, data, offs in chunks(batch.column(1))]
            columns = [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0, np.uint64)] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *[pa.array(x.view(np.int64)) for x in columns]], ["id", "h1", "h2", *names])

    return docs.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in ("id", "h1", "h2", *names)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns: the smallest by doc_id (nulls first) and a hash of the text; of rows equal in both, the smallest.

    Texts cross the network once, in a merge join that is the same at every size: what is kept grows with the input."""
    names = ("id", "h1", "h2")
    prints = stored(stage_fingerprints(keyed(docs, "doc_id", "text").select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))))
    # equal rows are counted, and each fingerprint is reduced to one candidate, before components meet
    firsts = stored(prints.groupBy("b", *names).agg(F.count("*").alias("n")).groupBy("b").agg(F.min(F.struct(*names, "n")).alias("first")))
    points = stored(prints.drop(*names).distinct(), prints)
    edges = links(points, STAGE_DISTANCE)
    release(points)
    roots = components(edges)
    found = firsts.join(roots, firsts["b"] == roots["node"], "left").groupBy(F.coalesce("root", "b").alias("root")).agg(F.min("first").alias("first"))
    kept = stored(found.select("first.*"), firsts, roots)
    text = F.col("`text`").cast("string")
    keys = {"id": F.coalesce(F.col("`doc_id`").cast("long"), F.lit(NULL_ID)), "h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)}
    own = {c: free_name(docs, f"_kept_{c}") for c in names}

    def rows(which):
        which = which.select([F.col(c).alias(own[c]) for c in names]).hint("merge")
        return docs.join(which, [keys[c] == F.col(own[c]) for c in names], "left_semi")

    out = rows(kept.where("n = 1"))
    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return out
    least = rows(repeated).groupBy(*[keys[c].alias(own[c]) for c in names]).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row"))
    return out.unionByName(least.select("_row.*"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(restored().alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), restored("component").alias("component_id"))


def _oracle() -> str:
    """XXH64 in 128-bit arithmetic over hexadecimal texts, bits by majority, and the closure of all near pairs."""
    # The primes of XXH64.
    p1, p2, p3, p4, p5 = (f"{x}::uhugeint" for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    m = "18446744073709551616::uhugeint"
    rotl = lambda x, r: f"((({x}) * {2**r}::uhugeint) % {m} + (({x}) * {2**r}::uhugeint) // {m})"
    xor = lambda a, b: f"xor(({a})::ubigint, ({b})::ubigint)::uhugeint"
    round_ = lambda acc, lane: f"({rotl(f'({acc} + {lane} * {p2} % {m}) % {m}', 31)} * {p1} % {m})"
    zero = "0::uhugeint"
    number = lambda at, size: "('0x' || " + " || ".join(f"substr(b, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(size))) + ")::ubigint::uhugeint"
    lane = lambda k, start: f"list_reduce([({start}) % {m}] || lanes[{k}:4 * (n // 32):4], lambda acc, x: {round_('acc', 'x')})"
    merged = lambda h, v: f"(({xor(h, round_(zero, v))}) * {p1} + {p4}) % {m}"
    bits = ", ".join(f"sum((h >> {k}) & 1) b{k}" for k in range(64))
    print_ = " + ".join(f"(case when 2 * b{k} > c then {2**k}::uhugeint else 0::uhugeint end)" for k in range(64))
    return f"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents
), g as (
  select doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) i from d where len(ws) > 0)
), u as (
  select s, hex(encode(s)) b, octet_length(encode(s))::bigint n from (select distinct s from g)
), l as (
  select *, list_transform(range(n // 8), lambda i: {number('8 * i', 8)}) lanes from u
), v as (
  select *, {lane(1, f"{SEED}::uhugeint + {p1} + {p2}")} v1, {lane(2, f"{SEED}::uhugeint + {p2}")} v2, {lane(3, f"{SEED}::uhugeint")} v3, {lane(4, f"{SEED}::uhugeint + {m} - {p1}")} v4 from l
), w1 as (
  select *, ({rotl('v1', 1)} + {rotl('v2', 7)} + {rotl('v3', 12)} + {rotl('v4', 18)}) % {m} h from v
), w2 as (select * replace ({merged('h', 'v1')} as h) from w1), w3 as (select * replace ({merged('h', 'v2')} as h) from w2), w4 as (select * replace ({merged('h', 'v3')} as h) from w3), w5 as (select * replace ({merged('h', 'v4')} as h) from w4
), x1 as (
  select *, (case when n >= 32 then h else {SEED}::uhugeint + {p5} end + n::uhugeint) % {m} a from w5
), x2 as (
  select * replace (list_reduce([a] || lanes[4 * (n // 32) + 1:], lambda acc, x: ({rotl(xor('acc', round_(zero, 'x')), 27)} * {p1} + {p4}) % {m}) as a) from x1
), x3 as (
  select * replace (case when n % 8 >= 4 then ({rotl(xor('a', f"{number('8 * (n // 8)', 4)} * {p1} % {m}"), 23)} * {p2} + {p3}) % {m} else a end as a) from x2
), x4 as (
  select * replace (list_reduce([a] || list_transform(range(4 * (n // 4), n), lambda i: ('0x' || substr(b, 2 * i + 1, 2))::ubigint::uhugeint), lambda acc, x: {rotl(xor('acc', f'x * {p5} % {m}'), 11)} * {p1} % {m}) as a) from x3
), x5 as (select s, {xor('a', 'a::ubigint >> 33')} * {p2} % {m} a from x4), x6 as (select s, {xor('a', 'a::ubigint >> 29')} * {p3} % {m} a from x5), x7 as (select s, ({xor('a', 'a::ubigint >> 32')})::ubigint h from x6
), o as (
  select doc_id, count(*) c, {bits} from g join x7 using (s) group by doc_id
), f as (
  select doc_id, coalesce(({print_})::ubigint, 0::ubigint) fp from d left join o using (doc_id)
), k as (select fp, min(doc_id) first from f group by fp
), e as (select x.fp x, y.fp y from k x join k y on bit_count(xor(x.fp, y.fp)::hugeint) <= {DISTANCE}
), r as (
  select fp a, fp b from k union select r.a, e.y from r join e on r.b = e.x
), c as (select a, min(first) component_id from r join k on k.fp = r.b group by a)
select doc_id, lower(lpad(hex(fp), 16, '0')) fingerprint, component_id from f join c on c.a = f.fp
"""


#: Compares all pairs of fingerprints, so it is for tables as small as those of the correctness gate.
ORACLE = _oracle()
