"""Token-id output as shuffled planes (operator 1).

A data set is a Parquet folder of chunk rows. A chunk holds whole documents, one
after another in id order; its ids are cut into blocks of ``block_ids``, each block
is transposed into byte planes (or bit planes) and each plane is compressed with
zstandard by itself. ``plane_sizes`` with ``n_planes`` is the chunk's index of
planes, ``doc_ids`` with ``doc_lens`` its index of documents, and ``first_id`` its
place in the shard. Spark's own writer commits the files, so lost executors and
repeated tasks leave no torn chunk, and any store that Spark reaches will do.

Nulls: a null text is an empty one (its ids are the end id alone); a null doc_id
sorts first. Repeated ids and rows are all kept, ordered by id and then by text.
Empty input gives an empty data set. Other columns are not read, whatever their names. A
document longer than ``chunk_ids`` has a chunk of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import gathered, sliced, small_batches, texts_of
from quire.llm.tokens import encoder

CHUNK_DDL = (
    "shard int, chunk int, first_id long, n_ids long, block_ids int, plane_kind string, n_planes array<int>, "
    "plane_sizes array<int>, payload binary, doc_ids array<long>, doc_lens array<long>"
)


def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    """A block's planes, lowest first; planes above the highest one used are left out."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, k].tobytes() for k in range(-(-top // 8))]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(top)]


def ids_of(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The inverse of ``planes_of`` for a block of ``n`` ids."""
    if kind == "byte":
        octets = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            octets[:, k] = np.frombuffer(plane, np.uint8)
        return octets.view("<u4").reshape(n)
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


def pack_chunk(ids: np.ndarray, block_ids: int, kind: str, level: int) -> tuple[list[int], list[int], bytes]:
    press = zstandard.ZstdCompressor(level=level)
    blocks = [planes_of(ids[i : i + block_ids], kind) for i in range(0, len(ids), block_ids)]
    parts = [press.compress(p) for planes in blocks for p in planes]
    return [len(planes) for planes in blocks], [len(p) for p in parts], b"".join(parts)


def unpack_chunk(n_ids: int, block_ids: int, kind: str, n_planes: list[int], sizes: list[int], payload: bytes) -> np.ndarray:
    press, at, k, out = zstandard.ZstdDecompressor(), 0, 0, []
    for b, count in enumerate(n_planes):
        planes = []
        for size in sizes[k : k + count]:
            planes.append(press.decompress(payload[at : at + size]))
            at += size
        k += count
        out.append(ids_of(planes, min(block_ids, n_ids - b * block_ids), kind))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_token_planes(
    docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 0, block_ids: int = 16384, chunk_ids: int = 1 << 18, kind: str = "byte", level: int = 1, file_bytes: int = 128 << 20
) -> None:
    """Encode ``docs`` and write the ids in ascending doc_id order under ``path``.

    Only a range shuffle of (doc_id, text) is needed; ids are never shuffled. There is a
    file for each task, and a task for each ``file_bytes`` of text, or as many as Spark's
    shuffles have if that is more.
    """
    n_bytes = texts_of(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // file_bytes)
    schema = pa.schema(
        [("shard", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("block_ids", pa.int32()), ("plane_kind", pa.string()), ("n_planes", pa.list_(pa.int32()))]
        + [("plane_sizes", pa.list_(pa.int32())), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64()))]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunk, first = TaskContext.get().partitionId(), 0, 0

        def row(ids: np.ndarray, names: list, lens: np.ndarray) -> pa.RecordBatch:
            n_planes, sizes, payload = pack_chunk(ids, block_ids, kind, level)
            values = [shard, chunk, first, len(ids), block_ids, kind, n_planes, sizes, payload, names, lens.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        for t in gathered(batches, 4 << 20):
            names = t.column("doc_id").to_pylist()
            ids, bounds = encoder(tokenizer).encode(t.column("text"))
            n = len(names)
            lens = np.diff(bounds) + 1
            ends = np.cumsum(lens)
            out = np.empty(int(ends[-1]) if n else 0, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(n), lens - 1)] = ids
            out[ends - 1] = end_id
            i = 0
            while i < n:
                low = int(ends[i] - lens[i])
                j = max(i + 1, int(np.searchsorted(ends, low + chunk_ids, side="right")))
                yield row(out[low : int(ends[j - 1])], names[i:j], lens[i:j])
                first += int(ends[j - 1]) - low
                chunk += 1
                i = j

    (
        texts_of(docs)
        .repartitionByRange(n_files, "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, CHUNK_DDL)
        .write.parquet(path)
    )


def read_token_planes(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document of a data set.

    ``start`` counts the ids before the document in the whole set: a shard's base is
    summed over the list of shards, which has one entry for each file written.
    """
    chunks = spark.read.schema(CHUNK_DDL).parquet(path)
    base, bases = 0, []
    for shard, n in sorted(chunks.groupBy("shard").agg(F.sum("n_ids")).collect()):
        bases.append((shard, base))
        base += n
    small_batches(spark)
    ddl = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for r in b.to_pylist():
                ids = unpack_chunk(r["n_ids"], r["block_ids"], r["plane_kind"], r["n_planes"], r["plane_sizes"], r["payload"])
                raw, lens = memoryview(ids.astype("<u4").tobytes()), np.array(r["doc_lens"], np.int64)
                ends = np.cumsum(lens)
                starts = ends - lens
                crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array([r["shard"]] * len(lens), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["first_id"]), pa.array(lens), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[s:e] for s, e in zip(starts, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    # a row for each file, some 20 bytes
    held = spark.createDataFrame(bases, "shard int, base long")
    rows = chunks.mapInArrow(decode, ddl).join(F.broadcast(held), "shard")
    return rows.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
