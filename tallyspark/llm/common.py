"""What the operators of this subpackage share: shared-folder tables, Arrow text buffers, vectorised words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null identifier inside the operators, where keys must be comparable; nulls sort first.
NULL_ID = -(2**63)
#: Bytes of text that the vectorised passes take at once; a longer text is taken alone.
CHUNK = 1 << 19

_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 2**64)
_pow = {_P: np.ones(1, np.uint64), _PINV: np.ones(1, np.uint64)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that shared_dir() named inside each open scratch().
_named: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir or the context's checkpoint folder; where neither is set, below a
    temporary folder of this machine, which only a local master can share with its executors."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyspark-"))
        root = context._jsc.sc().getCheckpointDir().get()
    path = f"{root.rstrip('/')}/tallyspark-{uuid.uuid4().hex}"
    if _named:
        _named[-1].append(path)
    return path


def stored(df: DataFrame, *done: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage, survives lost executors. Frames that were stored
    before and are done with are deleted."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    release(*done)
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of frames that stored() gave; others stay as they are."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            delete(df.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """On leaving, deletes whatever was stored inside, but for the frames given to the function that it yields."""
    _named.append([])
    kept = set()
    try:
        yield lambda df: kept.add(df._stored_at)
    finally:
        for path in _named.pop():
            if path not in kept:
                delete(spark, path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted: df should be stored)."""
    return F.broadcast(df) if df.count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):  # another run may have removed it
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def keyed(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Columns id (nulls as NULL_ID), text, and more ones: whatever else df holds can't clash."""
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`") for c in more])


def restored(name: str = "id"):
    return F.when(F.col(name) != NULL_ID, F.col(name))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as (bytes, offsets), nulls as empty texts, without copying the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about most bytes."""
    data, offs = text_buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def byte_table(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: Words between the bytes 0x20 and 0x09-0x0D.
SPACED = byte_table(lambda b: b not in (0x20, 9, 10, 11, 12, 13))
#: Words of digits, letters a-z and everything outside ASCII, after A-Z is lower-cased.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def word_spans(data: np.ndarray, offs: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): byte spans of the maximal runs of marked bytes, never across texts; text t has words bounds[t]:bounds[t+1]."""
    w, n = marked[data], len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    before[offs[:-1][offs[:-1] < n]] = False
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _powers(base: int, n: int) -> np.ndarray:
    if len(_pow[base]) < n:
        full = np.full(max(n, 1 << 20), base, np.uint64)
        full[0] = 1
        _pow[base] = np.multiply.accumulate(full)
    return _pow[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of values that depends on its content alone."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(_P, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_PINV, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """The hashes of every k consecutive values."""
    at = np.arange(max(0, len(values) - k + 1))
    return span_hashes(values, at, at + k)


def tidy(f):
    """f, a function over Arrow batches, that gives its memory back to the system at the end: workers are used again."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run
