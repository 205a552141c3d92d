"""A corpus pipeline over documents: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of documents; the last adds shard_id.

Edge cases, by stage as its operator's module says: a null or empty text scores the toxicity prior, is a near-duplicate
of other such texts, holds no benchmark window and counts 0 for its source's size; rows with a null doc_id are compared
as the smallest id, and draw one Poisson count together; equal rows become one in near_duplicates; very long texts are
read whole by every stage; other columns pass unchanged, whatever their names; no documents give no rows.
"""

from pyspark.sql import functions as F

from tallyspark.llm.common import release, scratch, stored, table
from tallyspark.llm.compaction import shard_documents
from tallyspark.llm.decontam import drop_contaminated
from tallyspark.llm.mixing import mix_sources
from tallyspark.llm.simhash import drop_near_duplicates
from tallyspark.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark, docs, sf_dir):
    """Documents that the classifier predicts as toxic go."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark, docs, sf_dir):
    """Of each component of near-duplicates (five-word shingles, similarity 0.8), one row stays: the smallest by doc_id, then by a hash of the text."""
    return drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    """Each document is repeated by its Poisson count; rows come in a global random order."""
    return mix_sources(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def sharding(spark, docs, sf_dir):
    """Rows are appended to a shard store, compacted, and read back with the shard that holds them."""
    return shard_documents(docs)[1]


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]


def run(spark, sf_dir):
    """The last stage's rows, read from its shard store. What an earlier stage stored for itself goes once its rows are
    stored, and its input with it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            out = stored(stage(spark, docs, sf_dir))
            keep(out)
        release(docs)
        docs = out
    shards = STAGES[-1][1](spark, docs, sf_dir)
    release(docs)
    return shards


#: A trained classifier and a fixed point aren't SQL; tests compare the chain with brute force.
ORACLE_SQL = None
