"""Quality by an interpolated modified Kneser-Ney model of byte n-grams, per language.

Trusted texts (labelled quality 1) are counted whole; every n-gram of the corpus gets its probability by joins between
count tables that are sharded by n-gram or context: counts, continuation counts, contexts' totals and the lower
order's probability. A document's perplexity is the exponential of its mean surprise per byte (and end mark). It is
kept if that lies between two quantiles of its language's trusted documents, which are wider for short texts: junk of
rare symbols is over the upper one, mindless repetition under the lower one. The defaults were chosen by four folds of
labelled rows, each judged by a model of the other three: the best mean of both classes' hits that keeps 98 % of good ones.

Documents meet the table of probabilities shard by shard: each shard has about SHARD rows (16 bytes each) and is
broadcast, and a pass over the documents adds what it knows of their n-grams to a running sum, so texts and n-grams
are never shuffled and no broadcast grows with the table.

Edge cases: a null text is the empty text, which has the end mark alone; a null language is a language of its own;
a language without trusted text has no model: perplexity and thresholds are null and the document is kept; labels
that are null are none, and a doc_id that is labelled twice is trusted if all labels are 1; repeated rows are each
scored; a very long text is counted and scored whole, alone in its chunk; no rows give no rows; only the named columns
are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, mix, release, small, stored, table, tidy

ORDER = 4
LOW, HIGH = 0.005, 0.95
#: The thresholds of a text of n symbols are wider by exp(SHORT / sqrt(n)): means over few symbols scatter.
SHORT = 3.0
#: Rows of the table of probabilities in a broadcast.
SHARD = 2_000_000
#: Trusted identifiers that are broadcast at most; more are joined. Languages likewise.
TRUSTED, LANGUAGES = 4_000_000, 100_000


def ngrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, bounds): the n-gram that ends at each byte of each text and at its end mark, packed into 32 bits."""
    n = np.diff(offs)
    out = np.zeros(len(data) + ORDER * len(n), np.uint32)
    out[np.arange(len(data)) + np.repeat(ORDER * np.arange(len(n)) + ORDER - 1, n)] = data
    keys = out.copy()
    for k in range(1, ORDER):
        keys[k:] |= out[:-k] << np.uint32(8 * k)
    real = np.ones(len(out), bool)
    starts = offs[:-1] + ORDER * np.arange(len(n))
    for k in range(ORDER - 1):
        real[starts + k] = False
    return keys[real], offs + np.arange(len(n) + 1)


def _by_language(batch, most: int = 1 << 20):
    """(language, rows, bytes, offsets, trusted) of the runs of a batch's rows that share a language."""
    langs = batch.column("lang").to_pylist()
    groups: dict = {}
    for k, x in enumerate(langs):
        groups.setdefault(x, []).append(k)
    for lang, rows in groups.items():
        part = batch.take(pa.array(rows))
        for lo, hi, data, offs in chunks(part.column("text"), most):
            yield lang, np.array(rows[lo:hi]), data, offs, part.column("trusted").slice(lo, hi - lo)


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, g, c) of every n-gram of docs (text, lang, trusted); c counts trusted texts only and may be 0."""

    def run(batches):
        held: dict = {}

        def reduced(parts):
            keys = np.concatenate([k for k, _ in parts])
            sums = np.concatenate([c for _, c in parts])
            got, at = np.unique(keys, return_inverse=True)
            return [(got, np.bincount(at, sums, len(got)).astype(np.int64))]

        for batch in batches:
            for lang, _, data, offs, trusted in _by_language(batch):
                keys, bounds = ngrams(data, offs)
                ok = np.repeat(trusted.to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
                parts = held.setdefault(lang, [])
                for own, counted in ((keys[ok], True), (keys[~ok], False)):
                    got, c = np.unique(own, return_counts=True)
                    parts.append((got, c if counted else np.zeros(len(got), np.int64)))
                if sum(len(k) for k, _ in parts) > 2_000_000:
                    held[lang] = reduced(parts)
        for lang, parts in held.items():
            keys, sums = reduced(parts)[0]
            for lo in range(0, len(keys), 100_000):
                k = keys[lo : lo + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(sums[lo : lo + 100_000])], ["lang", "g", "c"])

    return docs.select("text", "lang", "trusted").mapInArrow(tidy(run), "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _null(lang: str):
    return F.coalesce(F.col(lang), F.lit("\0"))


def probabilities(counts: DataFrame) -> DataFrame:
    """(lang, g, logp) of each n-gram of counts, for languages that have trusted text; lang null as chr(0)."""
    corpus = stored(counts.select(_null("lang").alias("lang"), "g", "c"))
    grams, cuts = {ORDER: corpus.where("c > 0")}, {}
    for n in range(ORDER - 1, 0, -1):
        # each n-gram's continuation count: how many different symbols stand before it
        grams[n] = stored(grams[n + 1].select("lang", F.expr(f"g & {(1 << 8 * n) - 1}").alias("g")).groupBy("lang", "g").agg(F.count("*").alias("c")))
    # joins by language alone are broadcasts of a row for each language: else all n-grams of a language would meet
    known = stored(grams[1].select("lang").distinct())
    wanted = corpus.select("lang", "g").join(small(known, LANGUAGES), "lang", "left_semi")
    lower = None
    for n in range(1, ORDER + 1):
        mask = (1 << 8 * n) - 1
        tally = grams[n].groupBy("lang").agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2")))
        cut = lambda k: F.greatest(F.lit(0.1), F.least(F.lit(float(k)), F.coalesce(k - (k + 1) * y * F.when(F.col(f"n{k + 1}") > 0, F.col(f"n{k + 1}")) / F.when(F.col(f"n{k}") > 0, F.col(f"n{k}")), F.lit(0.5 * k))))  # noqa: E731, B023
        cuts[n] = stored(tally.select("lang", *[cut(k).alias(f"d{k}") for k in (1, 2, 3)]))
        counted = grams[n].join(small(cuts[n], LANGUAGES), "lang").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        contexts = counted.groupBy("lang", F.expr("g div 256").alias("h")).agg(F.sum("c").alias("total"), F.sum("d").alias("mass"))
        asked = wanted.select("lang", F.expr(f"g & {mask}").alias("g")).distinct() if n < ORDER else wanted
        rows = asked.join(counted.select("lang", "g", (F.col("c") - F.col("d")).alias("own")), ["lang", "g"], "left").withColumn("h", F.expr("g div 256")).join(contexts, ["lang", "h"], "left")
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = rows.withColumn("s", F.expr(f"g & {(1 << 8 * (n - 1)) - 1}")).join(lower.select("lang", F.col("g").alias("s"), F.col("p").alias("below")), ["lang", "s"])
        p = F.coalesce(F.coalesce("own", F.lit(0.0)) / F.col("total") + F.col("mass") / F.col("total") * F.col("below"), F.col("below"))
        lower = stored(rows.select("lang", "g", p.alias("p")), *([lower] if lower is not None else []))
    release(corpus, known, *cuts.values(), *[grams[n] for n in range(1, ORDER)])
    return lower.select("lang", "g", F.ln("p").alias("logp"))


class Lookup:
    """Sums of log probabilities from an open hash table of one language."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several for one slot, the last stays
            won = free & (self.keys[at] == keys[left])
            self.values[at[won]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys):
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot, out = self._slot(keys), np.zeros(len(keys))
        got = self.keys[slot] == keys
        out[got] = self.values[slot[got]]
        left = np.flatnonzero(~got)
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            at = slot[left]
            got = self.keys[at] == keys[left]
            out[left[got]] = self.values[at[got]]
            left = left[~got & (self.keys[at] >= 0)]
        return out


def _added(docs: DataFrame, shard: DataFrame) -> DataFrame:
    """docs with what a shard's n-grams add to n_symbols and surprise."""
    rows = shard.orderBy("lang").toArrow()  # about SHARD rows
    runs = pc.run_end_encode(rows.column("lang").combine_chunks()) if rows.num_rows else None
    ends = [0, *(runs.run_ends.to_pylist() if runs is not None else [])]
    keys, values = rows.column("g").to_numpy(), rows.column("logp").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast({lang: (keys[a:b], values[a:b]) for lang, a, b in zip(runs.values.to_pylist() if runs is not None else [], ends, ends[1:])})

    def run(batches):
        tables: dict = {}
        for batch in batches:
            surprise = batch.column("surprise").to_numpy(zero_copy_only=False).copy()
            n = np.zeros(batch.num_rows, np.int64)
            for lang, rows, data, offs, _ in _by_language(batch, 1 << 18):
                keys, bounds = ngrams(data, offs)
                n[rows] = np.diff(bounds)
                name = "\0" if lang is None else lang
                if name in shared.value:
                    if name not in tables:
                        tables[name] = Lookup(*shared.value[name])
                    surprise[rows] = np.nan_to_num(surprise[rows]) - np.add.reduceat(tables[name](keys), bounds[:-1])
            at = {"n_symbols": pa.array(n), "surprise": pa.array(surprise, from_pandas=True)}
            yield pa.RecordBatch.from_arrays([at.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(tidy(run), docs.schema)


def _scored(docs: DataFrame, model: DataFrame, shard_rows: int) -> DataFrame:
    """(doc_id, lang, trusted, n_symbols, surprise) of each row; surprise is null without a model of its language."""
    out = docs.select("doc_id", "text", "lang", "trusted", F.lit(0).cast("long").alias("n_symbols"), F.lit(None).cast("double").alias("surprise"))
    shards = max(1, math.ceil(model.count() / shard_rows))
    for k in range(shards):
        out = _added(out, model.where(F.pmod(F.xxhash64("lang", "g"), F.lit(shards)) == k))
    return out.drop("text")


def score_quality(docs: DataFrame, labels: DataFrame, *, low: float = LOW, high: float = HIGH, short: float = SHORT, shard_rows: int = SHARD) -> DataFrame:
    """(doc_id, lang, trusted, n_symbols, perplexity, low, high, keep) of each row of docs (doc_id, text, lang)."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_good")).agg(F.min("quality").alias("q")).where("q = 1").select("_good")
    good = small(stored(good), TRUSTED)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = docs.join(good, F.col("doc_id") == F.col("_good"), "left").withColumn("trusted", F.col("_good").isNotNull()).drop("_good")
    model = probabilities(count_ngrams(docs))
    scored = stored(_scored(docs, model, shard_rows).withColumn("perplexity", F.exp(F.col("surprise") / F.col("n_symbols"))))
    limits = scored.where("trusted and perplexity is not null").groupBy(F.col("lang").alias("_lang")).agg(F.percentile_approx("perplexity", [low, high], 10_000).alias("q")).select("_lang", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    limits = small(stored(limits), LANGUAGES)
    wider = F.exp(F.lit(short) / F.sqrt("n_symbols"))
    out = scored.join(limits, scored["lang"].eqNullSafe(limits["_lang"]), "left")
    return out.select("doc_id", "lang", "trusted", "n_symbols", "perplexity", "low", "high", F.coalesce(F.col("perplexity").between(F.col("low") / wider, F.col("high") * wider), F.lit(True)).alias("keep"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "trusted", "n_symbols", *[F.round(c, 6).alias(c) for c in ("perplexity", "low", "high")], "keep")


def _oracle() -> str:
    """The model over hexadecimal n-grams, an order after the other; quantiles by rank, as percentile_approx gives them
    for languages of up to 10,000 trusted texts."""
    orders = []
    for n in range(1, ORDER + 1):
        counts = "select lang, g, count(*) c from grams where trusted group by lang, g" if n == ORDER else f"select lang, substr(g, 3) g, count(*) c from c{n + 1} group by all"
        cut = lambda k: f"greatest(0.1, least({k}, coalesce({k} - {k + 1} * (case when n1 > 0 then n1 / (n1 + 2 * n2) end) * nullif(n{k + 1}, 0) / nullif(n{k}, 0), {0.5 * k})))"
        below = "1 / 256" if n == 1 else "l.p"
        lower = "" if n == 1 else f"join p{n - 1} l on l.lang = w.lang and l.g = substr(w.g, 3)"
        orders.append((n, f"c{n} as ({counts})", f"""
t{n} as (select lang, {", ".join(f"count(*) filter (c = {k}) n{k}" for k in (1, 2, 3, 4))} from c{n} group by lang),
d{n} as (select lang, {", ".join(f"{cut(k)} d{k}" for k in (1, 2, 3))} from t{n}),
k{n} as (select c{n}.*, case c when 1 then d1 when 2 then d2 else d3 end d from c{n} join d{n} using (lang)),
x{n} as (select lang, substr(g, 1, {2 * n - 2}) h, sum(c) total, sum(d) mass from k{n} group by all),
p{n} as (
  select w.lang, w.g, case when total is null then {below} else (coalesce(k.c - k.d, 0) + mass * {below}) / total end p
  from (select distinct lang, substr(g, {2 * (ORDER - n) + 1}) g from grams semi join c1 using (lang)) w {lower} left join k{n} k on k.lang = w.lang and k.g = w.g left join x{n} x on x.lang = w.lang and x.h = substr(w.g, 1, {2 * n - 2})
)"""))
    tables = ",\n".join([c for _, c, _ in reversed(orders)]) + "," + ",".join(p for _, _, p in orders)
    return f"""
with good as (select doc_id from labels where quality is not null group by doc_id having min(quality) = 1),
d as (select doc_id, documents.lang own, coalesce(documents.lang, '?null') lang, good.doc_id is not null trusted, '000000' || hex(encode(coalesce(text, ''))) || '00' h from documents left join good using (doc_id)),
grams as (select doc_id, lang, trusted, substr(h, 2 * k + 1, 8) g from (select *, unnest(range(len(h) // 2 - 3)) k from d)),
{tables},
s as (select doc_id, count(*) n_symbols, exp(-avg(ln(p))) perplexity from grams left join p{ORDER} using (lang, g) group by doc_id),
f as (select d.doc_id, own, lang, trusted, n_symbols, perplexity from d join s using (doc_id)),
q as (select lang, list_sort(list(perplexity)) v from f where trusted and perplexity is not null group by lang),
l as (select lang, v[greatest(1, ceil({LOW}::double * len(v))::bigint)] low, v[greatest(1, ceil({HIGH}::double * len(v))::bigint)] high from q)
select doc_id, own lang, trusted, n_symbols, round(perplexity, 6) perplexity, round(low, 6) low, round(high, 6) high, coalesce(perplexity between low / exp({SHORT} / sqrt(n_symbols)) and high * exp({SHORT} / sqrt(n_symbols)), true) keep from f left join l using (lang)
"""


ORACLE = _oracle()
