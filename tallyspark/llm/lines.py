"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

JVM expressions only. A line's key is the line without white space bytes at both ends, A-Z lower-cased. Keys of at
least min_chars code points found in at least min_docs documents lose all their lines, except in the largest doc_id
that holds them. Keys travel as 128 bits of hash.

Edge cases: a null or empty text is one empty line; rows that share a doc_id are one document in the counts and are
each reported, with only the lines of their own text dropped; each text under a null doc_id is a document of its own,
smaller than all others and ordered by a hash of the text; equal rows are one document; a very long text's lines are
exploded as they come and its kept lines joined again, in time proportional to its length; no rows give no rows; only
the identifier and text columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, keyed, restored, stored, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"


def line_drops(docs: DataFrame, *, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """(id, th, drop): the positions of the lines that go, for each id and text (by its hash th) of keyed() that loses some."""
    exploded = docs.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = exploded.select("id", "th", "pos", F.translate(F.btrim("line", F.lit(_SPACE)), _UPPER, _LOWER).alias("key")).where(F.length("key") >= min_chars)
    # the hashes are read twice, to count and to find the lines again; lines are split and hashed once
    hashed = stored(keys.select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")))
    # one row for each key and document before anything is counted, so a frequent line costs a row a task and document
    own = F.when(F.col("id") == NULL_ID, F.col("th")).otherwise(F.lit(0))
    frequent = stored(hashed.select("h1", "h2", "id", own.alias("own")).groupBy("h1", "h2").agg(F.count_distinct("id", "own").alias("n"), F.max("id").alias("last"), F.max("own").alias("last_own")).where(F.col("n") >= min_docs).select("h1", "h2", "last", "last_own"))
    # frequent lines are a stored table: they are broadcast if their files are under the session's threshold; else both
    # sides are plain exchanges, of which AQE splits a frequent line's partition
    kept = (F.col("id") == F.col("last")) & ((F.col("id") != NULL_ID) | (F.col("th") == F.col("last_own")))
    return hashed.join(frequent, ["h1", "h2"]).where(~kept).groupBy("id", "th").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """(id, text without the dropped lines, n_lines, n_dropped); see the module's text."""
    docs = keyed(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("th", F.xxhash64("text"))
    lines = F.split("text", "\n", -1)
    out = docs.join(line_drops(docs, min_docs=min_docs, min_chars=min_chars), ["id", "th"], "left").withColumn("lines", lines)
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop"), lambda i: F.get("lines", i)), "\n"))
    return out.select(restored().alias(id_col), kept.alias(text_col), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents
), k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l
), f as (
  select key, max(doc_id) last from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5
)
select doc_id, count(*) n_lines, count(*) filter (f.key is not null and doc_id <> last) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (f.key is null or doc_id = last), '')) kept_sha256
from k left join f on k.key = f.key group by doc_id
"""
