"""Substring dedup by suffix automata of reference shards.

A window of 20 consecutive words is removed where its word sequence also starts earlier (smaller id, or same document
and smaller start). The reference is the corpus itself, which has no size bound, so its shards are not broadcast to
every document: windows and reference meet by content instead.

1. Each window has an anchor: the 8 consecutive words in it of least hash, the first of equals. Equal windows have
   equal anchors, so a window whose anchor occurs once in the corpus can't repeat. Anchors are counted.
2. The windows of a repeated anchor form a run of words around it, a reference segment. Segments are dealt out by
   anchor; each shard holds the segments of its anchors in order of (id, start).
3. A shard streams: a suffix automaton over the segments so far gives the matching statistics of the next segment;
   where they reach 20, the window starts earlier in the corpus. Then the segment itself is added, unless it is equal
   to one there. The spans of such windows are merged for each document, are maximal, and are cut out.

A shard's automaton has the different segments of one anchor only. Anchors in over HOT documents (a passage that a
share of all documents hold, with as many different neighbours) are dealt out by single windows, salted by content,
so no task holds their neighbourhoods. Before anything is dealt out, a task sends of each BUFFER bytes of segments only
the first of those that are equal; the others are covered whole and go on as spans without words. So a passage that a
third of all documents hold costs its shard a row for each buffer, not for each document.

Edge cases: null, empty and short texts lose nothing; rows with equal id and text are one document and get equal
results; rows with equal id and different texts are ordered by a hash of the text; a null id comes first; no rows
give no rows; only identifier and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACED, chunks, keyed, mix, restored, run_hashes, span_hashes, table, text_buffers, tidy, word_spans

WINDOW, ANCHOR, HOT = 20, 8, 1000
#: Bytes of segments that a task looks through for equal ones at once.
BUFFER = 32 << 20


def anchors(data: np.ndarray, offs: np.ndarray, window: int = WINDOW, k: int = ANCHOR):
    """(word starts, word ends, bounds, words' hashes, window starts, their anchors' places, their anchors' hashes)."""
    starts, ends, bounds = word_spans(data, offs, SPACED)
    h = span_hashes(data, starts, ends)
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return starts, ends, bounds, h, none, none, np.zeros(0, np.uint64)
    grams = run_hashes(h, k)
    wide = window - k + 1
    n = len(h) - window + 1
    least, place = grams[:n].copy(), np.arange(n)
    for j in range(1, wide):
        other = grams[j : j + n]
        better = other < least
        least[better] = other[better]
        place[better] = np.flatnonzero(better) + j
    at = np.arange(n)
    inside = at + window <= bounds[np.searchsorted(bounds, at, "right")]
    return starts, ends, bounds, h, at[inside], place[inside], least[inside]


class Automaton:
    """A suffix automaton over several segments of words, grown online."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def add(self, words) -> None:
        nxt, link, length, last = self.next, self.link, self.length, 0
        for w in words:
            if w in nxt[last]:
                q = nxt[last][w]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, q, w)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
            last = cur

    def _clone(self, p: int, q: int, w) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        link[q] = c
        return c

    def matches(self, words) -> list[int]:
        """For each word, the length of the longest suffix up to it that is in a segment."""
        nxt, link, length, s, n, out = self.next, self.link, self.length, 0, 0, []
        for w in words:
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            if w in nxt[s]:
                s, n = nxt[s][w], n + 1
            else:
                n = 0
            out.append(n)
        return out


def _anchor_rows(batches):
    """(anchor, id, th, n): the anchors of each document and how many places they have in it."""
    for batch in batches:
        for lo, hi, data, offs in chunks(batch.column(2)):
            _, _, bounds, _, at, place, key = anchors(data, offs)
            first = np.concatenate([[True], np.diff(place) != 0]) if len(place) else np.zeros(0, bool)
            owner = np.searchsorted(bounds, at[first], "right") - 1
            key = key[first]
            order = np.lexsort((key, owner))
            owner, key = owner[order], key[order]
            new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(key) != 0)]) if len(key) else np.zeros(0, bool)
            cuts = np.flatnonzero(new)
            n = np.diff(np.concatenate([cuts, [len(key)]])) if len(key) else cuts
            rows = pa.array(owner[cuts] + lo)
            yield pa.RecordBatch.from_arrays([pa.array(key[cuts].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(n, pa.int32())], ["anchor", "id", "th", "n"])


_SEGMENTS = "shard long, id long, th long, start int, end int, words binary"


def _reduced(parts: list[tuple]) -> pa.RecordBatch:
    """Of parts (shard, digest, id, th, start, end, words): the first of equal segments with its words, the others dealt out by place, without."""
    shard, digest, i, t, start, end = (np.concatenate([p[k] for p in parts]) for k in range(6))
    words = [w for p in parts for w in p[6]]
    order = np.lexsort((start, t, i, digest, shard))
    first = np.ones(len(order), bool)
    first[1:] = (shard[order][1:] != shard[order][:-1]) | (digest[order][1:] != digest[order][:-1])
    lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    again = ~first & (i[order] == i[lead]) & (t[order] == t[lead]) & (start[order] == start[lead])  # rows that repeat are one document
    order, first = order[~again], first[~again]
    shard, i, t, start, end = (x[order] for x in (shard, i, t, start, end))
    shard = np.where(first, shard, mix(t.view(np.uint64) ^ start.astype(np.uint64)))
    kept = pa.array([words[k] if alone else None for k, alone in zip(order.tolist(), first.tolist())], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(shard.view(np.int64)), pa.array(i), pa.array(t), pa.array(start, pa.int32()), pa.array(end, pa.int32()), kept], ["shard", "id", "th", "start", "end", "words"])


def _segments(batches):
    """(shard, id, th, start, end, words) of each run of windows with a repeated anchor; words is null if an earlier segment is equal."""
    parts, size = [], 0
    for batch in batches:
        known, hot = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo, hi, data, offs in chunks(batch.column(2)):
            starts, ends, bounds, h, at, place, key = anchors(data, offs)
            owner = np.searchsorted(bounds, at, "right") - 1
            shard, row, first, count = [], [], [], []
            edges = np.searchsorted(owner, np.arange(hi - lo + 1))
            for t in range(hi - lo):
                if not known[lo + t] or edges[t] == edges[t + 1]:
                    continue
                own = slice(edges[t], edges[t + 1])
                k, p, a = key[own], place[own], at[own]
                mine = np.array(known[lo + t], np.int64).view(np.uint64)
                is_hot = np.array(hot[lo + t], bool)
                order = np.argsort(mine)
                mine, is_hot = mine[order], is_hot[order]
                spot = np.searchsorted(mine, k)
                spot[spot == len(mine)] = 0
                ok = mine[spot] == k
                single = ok & is_hot[spot]
                new = np.concatenate([[True], np.diff(p) != 0])
                group = np.cumsum(new) - 1
                heads = np.flatnonzero(new & ok & ~single)
                sizes = np.bincount(group)[group[heads]]
                shard.append(k[heads])
                first.append(a[heads])
                count.append(sizes + WINDOW - 1)
                row.append(np.full(len(heads), t))
                alone = np.flatnonzero(single)
                if len(alone):
                    shard.append(span_hashes(h, a[alone], a[alone] + WINDOW) ^ k[alone])
                    first.append(a[alone])
                    count.append(np.full(len(alone), WINDOW))
                    row.append(np.full(len(alone), t))
            if not row:
                continue
            shard, row, first, count = map(np.concatenate, (shard, row, first, count))
            for cut in range(0, len(row), 50_000):
                part = slice(cut, cut + 50_000)
                r, f, e = row[part], first[part], first[part] + count[part]
                words = [data[x:y].tobytes() for x, y in zip(starts[f].tolist(), ends[e - 1].tolist())]
                parts.append((shard[part], span_hashes(h, f, e), ids[r + lo], hashes[r + lo], f - bounds[r], e - bounds[r], words))
                size += sum(map(len, words))
                if size > BUFFER:
                    yield _reduced(parts)
                    parts, size = [], 0
    if parts:
        yield _reduced(parts)


def _removed(batches):
    """From segments sorted by (shard, id, th, start) to (id, th, start, end): words that a repeated window covers."""
    shard, seen, todo, grown = None, {}, [], None
    for batch in batches:
        out = []
        for s, i, t, start, end, raw in zip(*(batch.column(c).to_pylist() for c in range(6))):
            if raw is None:
                out.append((i, t, start, end))
                continue
            if s != shard:
                shard, seen, todo, grown = s, {}, [], None
            words = raw.split()
            name = b" ".join(words)
            if name in seen:
                if seen[name] != (i, t, start):
                    out.append((i, t, start, end))
                continue
            if seen:
                grown = grown or Automaton()
                for old in todo:
                    grown.add(old)
                todo = []
                a = None
                for k, n in enumerate(grown.matches(words)):
                    if n >= WINDOW:
                        if a is None or k - WINDOW + 1 > b:
                            if a is not None:
                                out.append((i, t, start + a, start + b))
                            a = k - WINDOW + 1
                        b = k + 1
                if a is not None:
                    out.append((i, t, start + a, start + b))
            seen[name] = (i, t, start)
            todo.append(words)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["id", "th", "start", "end"])


def _cut(batches):
    """(id, text without the removed words if any is removed, n_words, n_removed)."""
    for batch in batches:
        data, offs = text_buffers(batch.column(1))
        spans, texts, total, gone = batch.column(2).to_pylist(), [], [], []
        for t, cut in enumerate(spans):
            words = data[offs[t] : offs[t + 1]].tobytes().split()
            total.append(len(words))
            if cut:
                keep = np.ones(len(words), bool)
                for x in cut:
                    keep[x["start"] : x["end"]] = False
                words = [w for w, k in zip(words, keep.tolist()) if k]
            gone.append(total[-1] - len(words))
            texts.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["id", "kept", "n_words", "n_removed"])


def removed_spans(docs: DataFrame) -> DataFrame:
    """(id, th, spans) of the rows (id, th, text) that lose words."""
    places = docs.mapInArrow(tidy(_anchor_rows), "anchor long, id long, th long, n int")
    by = W.partitionBy("anchor")
    repeated = places.repartition("anchor").select("id", "th", "anchor", F.sum("n").over(by).alias("all"), F.count("*").over(by).alias("docs")).where("all > 1")
    flags = repeated.groupBy("id", "th").agg(F.collect_list("anchor").alias("known"), F.collect_list(F.col("docs") > HOT).alias("hot"))
    segments = docs.join(flags, ["id", "th"]).select("id", "th", "text", "known", "hot").mapInArrow(tidy(_segments), _SEGMENTS)
    spans = segments.repartition("shard").sortWithinPartitions("shard", "id", "th", "start").mapInArrow(tidy(_removed), "id long, th long, start int, end int")
    return spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def dedup_substrings(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept: the kept words' bytes joined by one space, n_words, n_removed) of each row."""
    docs = keyed(df, id_col, text_col).select("id", F.xxhash64("text").alias("th"), "text")
    out = docs.join(removed_spans(docs), ["id", "th"], "left").select("id", "text", "spans").mapInArrow(tidy(_cut), "id long, kept binary, n_words long, n_removed long")
    return out.select(restored().alias(id_col), "kept", "n_words", "n_removed")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents
), w as (
  select doc_id, ws, unnest(range(1, len(ws) + 1)) pos from d
), k as (
  select doc_id, pos, ws[pos] word, case when pos + 19 <= len(ws) then md5(array_to_string(ws[pos:pos + 19], ' ')) end key from w
), r as (
  select *, key is not null and row_number() over (partition by key order by doc_id, pos) > 1 again from k
), c as (
  select *, bool_or(again) over (partition by doc_id order by pos rows between 19 preceding and current row) gone from r
), s as (
  select doc_id, count(*) n_words, count(*) filter (gone) n_removed, string_agg(word, ' ' order by pos) filter (not gone) kept from c group by doc_id
)
select doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join s using (doc_id)
"""
