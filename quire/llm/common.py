"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.shared import shared_dir, small_batches

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The fold (crc32 of the id as text, modulo 4) that no classifier learns from.
HELD_OUT_FOLD = 2


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that ``written`` has made and ``discard`` has not deleted, oldest first.
_FOLDERS: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends here
    and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _FOLDERS.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of ``written``. Only for tables that no later job, nor a repeated
    task of one, reads: what was made of them is itself written."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _FOLDERS:
            _FOLDERS.remove(path)


@contextmanager
def passing(spark: SparkSession, keep: list[DataFrame] | None = None) -> Iterator[list[DataFrame]]:
    """What is written inside the block is deleted at its end, but for the tables that
    the block adds to the list it is given."""
    keep, before = [] if keep is None else keep, set(_FOLDERS)
    yield keep
    stay = {df.written_to for df in keep}
    discard(spark, *(p for p in list(_FOLDERS) if p not in before and p not in stay))


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that labels are never learned from; a null id is not in it."""
    return F.coalesce(fold(doc_id) == HELD_OUT_FOLD, F.lit(False))


def texts_of(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, text) and the named columns; a null text becomes empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def gathered(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.Table]:
    """Arrow batches joined up to about ``max_bytes``, and larger ones cut, so that
    per-batch work is spread over many rows while a task's memory stays bounded."""
    held, size = [], 0
    for b in sliced(batches, max_bytes):
        if held and size + b.nbytes > max_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = None
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: Python workers are reused by later tasks,
    whose executors share one limit with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sliced(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that none is much over ``max_bytes`` (one row may be)."""
    for b in batches:
        step = max(1, int(b.num_rows * max_bytes / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def row_key(*names: str) -> Column:
    """A hash of the text and the named columns: with the doc_id, null or shared as it
    may be, it tells a row by what its verdict depends on. A null text counts as empty."""
    others = [x for n in names for x in (F.col(n), F.col(n).isNull())]
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), *others)


#: More rows than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, dropped: DataFrame, *names: str) -> DataFrame:
    """The rows of ``docs`` that are not in ``dropped`` (doc_id, row), where ``row`` is
    ``row_key(*names)``; null ids are equal. What is dropped is written and counted first:
    few are broadcast, so that no text is shuffled."""
    dropped = written(dropped.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct(), "dropped")
    hint = "broadcast" if dropped.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS else "merge"
    keyed = docs.select(F.struct(*docs.columns).alias("_all"), F.col("doc_id").alias("_own"), row_key(*names).alias("_key"))
    return keyed.join(dropped.hint(hint), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_row")), "left_anti").select("_all.*")
