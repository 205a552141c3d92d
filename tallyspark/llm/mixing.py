"""Mixing sources to target weights by Poisson replication.

Each document is repeated as often as a Poisson variate with its source's mean repetition rate says; the variate is
the inverse of the distribution at a uniform number hashed from seed and doc_id, so reruns and retries agree. Copies
are exploded and shuffled globally by a hash of seed, doc_id and copy. JVM expressions only.

A source's rate is epochs x total size x its share / its size, with sizes in code points over all documents. Shares
are given, or proportional to size ** alpha.

Edge cases: a null or empty text has size 0 and texts of any length count whole; an input column named like one of
this operator's (mix_copy, mix_copies, mix_order) stays, and the operator's gets an underscore (free_name());
a null source is a source; sources without a given weight have share 0 and go; a source of size 0 has
the rate `epochs`; a null doc_id hashes as the word null; repeated rows get equal counts; no rows give no rows.
A rate has no upper bound: up to 700, where exp(-rate) is a normal double, the terms start from 0 copies; above, from
12 standard deviations below the rate, under which lies less than exp(-60) of the distribution and no uniform number
but 0. A document's copies are exploded in blocks of BLOCK, so no array grows with their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, stored, table

SEED, ALPHA = 42, 0.5
#: Rates up to here start from exp(-rate); copies in an exploded array.
DIRECT, BLOCK = 700, 1 << 16


def source_rates(df: DataFrame, *, weights: dict | None = None, alpha: float = ALPHA, epochs: float = 1.0) -> DataFrame:
    """(mix_source, rate): the mean repetition rate of each source; as many rows as sources."""
    sizes = stored(df.groupBy(F.col("source").alias("mix_source")).agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("size")))
    if weights is None:
        share = F.pow(F.col("size").cast("double"), F.lit(alpha))
    else:
        share = F.coalesce(*[F.when(F.col("mix_source").eqNullSafe(k), F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    total, shares = sizes.agg(F.sum("size"), F.sum(share)).first()
    rate = F.when(F.col("size") == 0, F.lit(float(epochs))).otherwise(F.lit(float(epochs)) * float(total or 0) * share / float(shares or 1) / F.col("size"))
    return sizes.select("mix_source", rate.alias("mix_rate"))


def uniform(seed: int, *parts) -> F.Column:
    """A number in [0, 1) of 52 bits, from the MD5 of seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def poisson(u, rate) -> F.Column:
    """The smallest k whose cumulative probability is over u, by the recurrence of the terms; a long."""
    first = F.when(rate <= DIRECT, F.lit(0)).otherwise(F.floor(rate - 12 * F.sqrt(rate))).cast("long")
    # the term of a large k by the saddle point, without differences of large numbers: d is (k - rate) / rate
    d = (first - rate) / rate
    error = 1 / (12 * first) - 1 / (360 * F.pow(first, F.lit(3))) + 1 / (1260 * F.pow(first, F.lit(5)))
    start = F.when(rate <= DIRECT, F.exp(-rate)).otherwise(F.exp(-rate * ((1 + d) * F.log1p(d) - d) - error) / F.sqrt(2 * F.pi() * first))
    most = (F.ceil(rate + 12 * F.sqrt(rate)) + 24).cast("long")
    step = lambda s, k: F.when(s.cdf <= u, F.struct(k.alias("k"), (s.term * rate / k).alias("term"), (s.cdf + s.term * rate / k).alias("cdf"))).otherwise(s)
    k = F.aggregate(F.sequence(first + 1, most), F.struct(first.alias("k"), start.alias("term"), start.alias("cdf")), step, lambda s: s.k)
    return F.when(u <= 0, F.lit(0).cast("long")).otherwise(k)


def mix_sources(df: DataFrame, *, weights: dict | None = None, alpha: float = ALPHA, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """df's rows, each as often as its count says, in a global random order, with mix_copy (from 0), mix_copies and mix_order.

    Expects doc_id, source and text; other columns pass. The rates join by Spark's own choice: they are read from a
    stored table, so they are broadcast only if its files are under the session's threshold."""
    rates = source_rates(df, weights=weights, alpha=alpha, epochs=epochs)
    source, rate, block, copy, copies, order = (free_name(df, f"mix_{x}") for x in ("source", "rate", "block", "copy", "copies", "order"))
    rates = rates.select(F.col("mix_source").alias(source), F.col("mix_rate").alias(rate))
    out = df.join(rates, df["source"].eqNullSafe(rates[source])).withColumn(copies, poisson(uniform(seed, F.col("doc_id")), F.col(rate))).where(F.col(copies) > 0)
    out = out.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(BLOCK).cast("long"))))
    out = out.withColumn(copy, F.explode(F.sequence(F.col(block), F.least(F.col(copies), F.col(block) + BLOCK) - 1)))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(copy).cast("string")))
    return out.drop(source, rate, block).withColumn(order, key).repartition(order).sortWithinPartitions(order)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", F.col("mix_copy").cast("int").alias("copy"), F.col("mix_copies").cast("int").alias("copies"), F.col("mix_order").alias("order_key"), F.md5("text").alias("text_md5"))


ORACLE = f"""
with recursive s as (
  select source, sum(coalesce(length(text), 0))::double size from documents group by source
), r as (
  select source, case when size = 0 then 1.0 else (select sum(size) from s) * pow(size, {ALPHA}) / (select sum(pow(size, {ALPHA})) from s) / size end rate from s
), p as (
  select source, rate, 0 k, exp(-rate) term, exp(-rate) cdf from r
  union all
  select source, rate, k + 1, term * rate / (k + 1), cdf + term * rate / (k + 1) from p where k < ceil(rate + 12 * sqrt(rate)) + 24
), d as (
  select doc_id, source, text, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / pow(2, 52) u from documents
), c as (
  select doc_id, d.source, any_value(text) text, count(p.k) copies from d left join p on d.source is not distinct from p.source and p.cdf <= d.u group by doc_id, d.source
)
select doc_id, source, copy::integer copy, copies::integer copies, md5('{SEED}:order:' || coalesce(doc_id::varchar, 'null') || ':' || copy) order_key, md5(text) text_md5
from (select *, unnest(range(copies)) copy from c)
"""
