"""Toxicity by subword bags.

A word's vector is the mean of the embeddings of its character n-grams (bytes of UTF-8, hashed), so an unseen
misspelling shares most of a known word's vectors; a text is the mean of its words' vectors; a linear softmax reads it.
Embeddings and softmax are trained jointly in numpy on a bounded sample of labelled texts; a held-back part of that
sample calibrates the probabilities to the labels' own share. After training, an n-gram's embedding matters only by
its product with the softmax, so a model is one number for each bucket.

Words are maximal runs of letters a-z (A-Z lower-cased), digits and all bytes outside ASCII.

Edge cases: null, empty and wordless texts have the zero vector and so the calibrated prior's score; labels that are
null are no labels; a doc_id that is labelled twice is toxic if one label says so; a doc_id that several rows share is
fitted on once, by the text of least hash; labelled identifiers that tie in the sample's order come by doc_id; a null
doc_id counts as the empty text for the held-out rule; without labels of both kinds each score is the share of toxic
labels (0 without labels); repeated rows get equal scores; a very long text is scored whole, and fitted on only if it
fits into the sample's bytes; scores read the text alone; drop_toxic() passes all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, chunks, mix, release, span_hashes, stored, table, tidy, word_spans

#: At most so many labelled texts of each class are fitted on, and so many bytes of them: those first by a hash of
#: doc_id, passing over what doesn't fit in.
SAMPLE, SAMPLE_BYTES = 2500, 16 << 20
BUCKETS, DIM, GRAMS, THRESHOLD = 1 << 18, 8, (3, 4, 5, 6), 0.3
#: N-grams in fewer of the sample's texts than this aren't learned from: they would memorise single texts.
LEAST_TEXTS = 25
#: Words whose scores a Python worker keeps.
CACHE = 1 << 17


class Words:
    """The words of a buffer of texts."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.ends, self.bounds = word_spans(self.data, offs, ALNUM)
        self.names, self.first, self.at = np.unique(span_hashes(self.data, self.starts, self.ends), return_index=True, return_inverse=True)

    def grams(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number within `which`, bucket) of the n-grams of these different words, each written as <word>, and of the whole words."""
        starts, sizes = self.starts[self.first[which]], (self.ends - self.starts)[self.first[which]]
        first = np.concatenate([[0], np.cumsum(sizes + 2)])
        flat = np.full(first[-1], ord("<"), np.uint8)
        each = np.arange(sizes.sum())
        flat[each + np.repeat(2 * np.arange(len(sizes)) + 1, sizes)] = self.data[each + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]
        flat[first[1:] - 1] = ord(">")
        last, number, at = np.repeat(first[1:], sizes + 2), np.repeat(np.arange(len(sizes)), sizes + 2), np.arange(len(flat))
        bucket = lambda h: (h & np.uint64(BUCKETS - 1)).astype(np.int32)
        for n in GRAMS:
            ok = at[at + n <= last]
            yield number[ok], bucket(span_hashes(flat, ok, ok + n))
        yield np.arange(len(sizes)), bucket(mix(span_hashes(flat, first[:-1], first[1:]) + np.uint64(1)))


class _Sparse:
    """A sparse matrix as row runs, times a vector from the right (times) or the left (under)."""

    def __init__(self, cols, offs, vals, n_cols):
        self.cols, self.offs, self.vals, self.n_cols = cols.astype(np.int32), offs, vals.astype(np.float32), n_cols

    def _parts(self):
        """Runs of rows with about a million entries."""
        lo, n = 0, len(self.offs) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.offs, self.offs[lo] + 1_000_000, "right")) - 1)
            yield lo, hi, slice(self.offs[lo], self.offs[hi])
            lo = hi

    def times(self, v):
        out = np.zeros(len(self.offs) - 1)
        for lo, hi, part in self._parts():
            full = lo + np.flatnonzero(np.diff(self.offs[lo : hi + 1]))
            if len(full):
                out[full] = np.add.reduceat(v[self.cols[part]] * self.vals[part], self.offs[full] - self.offs[lo])
        return out

    def under(self, v):
        out = np.zeros(self.n_cols)
        for lo, hi, part in self._parts():
            out += np.bincount(self.cols[part], np.repeat(v[lo:hi], np.diff(self.offs[lo : hi + 1])) * self.vals[part], self.n_cols)
        return out


def _bags(texts: pa.Array, words: int = 20_000):
    """(documents by words: shares; words by buckets: shares) of texts as sparse matrices, and the texts of each bucket's words."""
    known, number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ids, shares, sizes, pieces, lens = [], [], [], [], []
    for _, _, data, offs in chunks(texts):
        w = Words(data, offs)
        there = np.isin(w.names, known)
        new = np.flatnonzero(~there)
        for lo in range(0, len(new), words):
            part = new[lo : lo + words]
            owner, bucket = (np.concatenate(x) for x in zip(*w.grams(part)))
            order = np.argsort(owner, kind="stable")
            pieces.append(bucket[order])
            lens.append(np.bincount(owner, minlength=len(part)))
        known, number = np.concatenate([known, w.names[new]]), np.concatenate([number, len(known) + np.arange(len(new))])
        order = np.argsort(known)
        known, number = known[order], number[order]
        name = number[np.searchsorted(known, w.names)][w.at]
        n = np.diff(w.bounds)
        both, count = np.unique(np.repeat(np.arange(len(n)), n) << 32 | name, return_counts=True)
        ids.append((both & 0xFFFFFFFF).astype(np.int32))
        shares.append(count / n[both >> 32])
        sizes.append(np.bincount(both >> 32, minlength=len(n)))
    if not len(known):
        return None
    edges = lambda x: np.concatenate([[0], np.cumsum(np.concatenate(x))])
    docs = _Sparse(np.concatenate(ids), edges(sizes), np.concatenate(shares), len(known))
    buckets, lens = np.concatenate(pieces), np.concatenate(lens)
    # a bucket's texts, counted by its words' texts; words that share a text count it once each
    texts_of = np.bincount(docs.cols, minlength=len(known))
    often = np.bincount(buckets, np.repeat(texts_of, lens), BUCKETS)
    return docs, buckets, lens, often


def train(texts: pa.Array, labels: np.ndarray, share: float, *, steps: int = 120, rate: float = 0.3, decay: float = 1e-3, least: int = LEAST_TEXTS, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """(score of each bucket, slope, intercept); share: of toxic among all labels, for calibration."""
    labels = np.asarray(labels, np.float32)
    bags = _bags(texts) if len(labels) and labels.min() != labels.max() else None
    if bags is None:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(BUCKETS, np.float32), 0.0, float(np.log(p / (1 - p)) if share > 0 else -30.0)
    docs, buckets, lens, often = bags
    keep = (often >= least)[buckets]
    share_of = np.repeat((1 / lens).astype(np.float32), lens)[keep]
    offs = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(lens)])]
    buckets = buckets[keep]
    used = np.unique(buckets)
    grams = _Sparse(np.searchsorted(used, buckets), offs, share_of, max(1, len(used)))
    used = used if len(used) else np.zeros(1, np.int32)
    fit = np.arange(len(labels)) % 5 != 4
    weight = fit * np.where(labels > 0, 0.5 / max(1, labels[fit].sum()), 0.5 / max(1, (1 - labels[fit]).sum()))
    # Logits differ by the texts' mean vectors times (soft[1] - soft[0]), so both gradients follow from one residual
    # for each text. Steps of the embeddings are scaled by their n-grams' frequency, as in diagonal discriminants.
    frequency = grams.under(docs.under(fit / fit.sum()))
    slow = 1 / (frequency + frequency.max() * 1e-4)[:, None]
    rng = np.random.default_rng(seed)
    table_, soft, bias = rng.normal(0, 0.01, (len(used), DIM)), rng.normal(0, 1 / DIM**0.5, (DIM, 2)), np.zeros(2)
    moved = np.zeros_like(table_)
    for _ in range(steps):
        way = soft[:, 1] - soft[:, 0]
        z = docs.times(grams.times(table_ @ way)) + bias[1] - bias[0]
        off = (1 / (1 + np.exp(-z)) - labels) * weight
        each = grams.under(docs.under(off))
        moved = 0.9 * moved + slow * (each[:, None] * way[None]) + decay * table_
        push = table_.T @ each
        table_ -= rate * moved
        soft -= rate * np.stack([-push, push], 1) * 0.01
        bias -= rate * np.array([-off.sum(), off.sum()])
    scores = np.zeros(BUCKETS, np.float32)
    scores[used] = table_ @ (soft[:, 1] - soft[:, 0])
    logits = docs.times(grams.times(scores[used])) + bias[1] - bias[0]
    slope, shift = _calibrated(logits[~fit], labels[~fit], share)
    return scores, slope, shift + slope * float(bias[1] - bias[0])


def _calibrated(z, y, share: float) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of y on z, classes weighted as in all labels."""
    if len(y) < 20 or y.min() == y.max():
        return 1.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    w = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, beta = np.stack([z / (abs(z).mean() + 1e-9), np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (w * (p - target)) + 1e-3 * beta)
        beta -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(beta[0] / (abs(z).mean() + 1e-9)), float(beta[1])


class Scorer:
    """Scores of texts; keeps the scores of words it has met, up to a bound."""

    def __init__(self, model):
        self.buckets, self.slope, self.shift = model
        self.known, self.value = np.zeros(0, np.uint64), np.zeros(0)

    def _words(self, w: Words) -> np.ndarray:
        """The mean score of each different word's n-grams."""
        at = np.searchsorted(self.known, w.names)
        at[at == len(self.known)] = 0
        there = self.known[at] == w.names if len(self.known) else np.zeros(len(w.names), bool)
        out = np.zeros(len(w.names))
        out[there] = self.value[at[there]]
        new = np.flatnonzero(~there)
        for lo in range(0, len(new), 10_000):
            part = new[lo : lo + 10_000]
            total, count = np.zeros(len(part)), np.zeros(len(part))
            for owner, bucket in w.grams(part):
                total += np.bincount(owner, self.buckets[bucket], len(part))
                count += np.bincount(owner, minlength=len(part))
            out[part] = total / count
        if len(self.known) + len(new) > CACHE:
            self.known, self.value = np.zeros(0, np.uint64), np.zeros(0)
        if len(new) <= CACHE:
            spot = np.searchsorted(self.known, w.names[new])
            self.known, self.value = np.insert(self.known, spot, w.names[new]), np.insert(self.value, spot, out[new])
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = []
        for _, _, data, offs in chunks(texts):
            w = Words(data, offs)
            n = np.diff(w.bounds)
            mean, some = np.zeros(len(n)), np.flatnonzero(n)
            if len(some):
                mean[some] = np.add.reduceat(self._words(w)[w.at], w.bounds[some]) / n[some]
            out.append(1 / (1 + np.exp(-np.clip(self.slope * mean + self.shift, -500, 500))))
        return np.concatenate(out) if out else np.zeros(0)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES):
    """(texts, labels, share of toxic among all labels): at most `sample` texts and `sample_bytes` of each class whose identifier isn't held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n, share = known.agg(F.count("*"), F.avg(F.col("toxic").cast("double"))).first()
    if not n:
        return pa.array([], pa.string()), np.zeros(0), 0.0
    pick = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = docs.sparkSession.createDataFrame(pick[0].unionByName(pick[1]).collect(), "id long, toxic int")  # 2 x sample rows
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    rows = stored(own.groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select(F.xxhash64("id").alias("place"), "id", "toxic", "one.text"))
    left, fits = {0: sample_bytes, 1: sample_bytes}, []
    for r in rows.select("id", "toxic", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy("place", "id").collect():
        if r.size <= left[r.toxic]:
            left[r.toxic] -= r.size
            fits.append((r.id,))
    taken = rows.join(F.broadcast(docs.sparkSession.createDataFrame(fits, "id long")), "id").orderBy("place", "id").select("text", "toxic").toArrow()
    release(rows)
    return taken.column("text").combine_chunks() if taken.num_rows else pa.array([], pa.string()), taken.column("toxic").to_numpy(), share


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE):
    """The model, from sampled() texts."""
    return train(*sampled(docs, labels, sample=sample))


def score_toxicity(docs: DataFrame, model, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; the model is a broadcast of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scorer(batch.column(2)), pa.float64())], ["doc_id", "held_out", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold; one pass, no join."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array(scorer(batch.column(at)) < threshold, pa.bool_()))

    return docs.mapInArrow(tidy(run), schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


#: A trained model isn't SQL; tests compare its training and scores with plain loops.
ORACLE = None
