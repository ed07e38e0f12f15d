"""Pattern packing by non-negative least squares (operator 5).

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece
lengths (at most ``capacity`` numbers, whatever the corpus) reaches the driver: there,
patterns of few documents that fill a sequence are enumerated, their repeat counts
are fitted to the histogram by non-negative least squares and rounded, and what is
left is packed best fit, longest first, as counts of equal lengths. The plan is a
list of (lengths, repeats); ranks within a length then tell every piece its sequence.

Nulls: a null text is an empty one (the end id alone); null and repeated doc_ids are
ordinary documents; equal ones are placed in any order. A very long text is encoded whole
and cut. Empty input gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import gathered, texts_of, written
from quire.llm.tokens import encoder

Plan = list[tuple[tuple[int, ...], int]]


def token_pieces(docs: DataFrame, *, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, copy) of every piece. A document
    that is too long is cut into pieces of ``capacity``; its first piece takes the rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches, 4 << 20):
            ids, bounds = encoder(tokenizer).encode(t.column("text"))
            raw, end = memoryview(np.ascontiguousarray(ids, dtype="<u4").tobytes()), np.array([end_id], "<u4").tobytes()
            lens = np.diff(bounds) + 1
            rest = lens % capacity
            counts = lens // capacity + (rest > 0)
            doc = np.repeat(np.arange(len(lens)), counts)
            piece = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            head = np.where(rest > 0, rest, capacity)[doc]
            start = np.where(piece > 0, head + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head)
            low = bounds[:-1][doc] + start
            last = start + length == lens[doc]
            crcs = [zlib.crc32(end, zlib.crc32(raw[4 * a : 4 * (b - 1)])) if z else zlib.crc32(raw[4 * a : 4 * b]) for a, b, z in zip(low.tolist(), (low + length).tolist(), last.tolist())]
            yield pa.RecordBatch.from_arrays(
                [t.column("doc_id").combine_chunks().take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return texts_of(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def nonnegative_least_squares(a: np.ndarray, h: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """The x >= 0 least in |a x - h|, by an active set; at most one positive entry a row."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = tolerance * max(1.0, np.abs(a.T @ h).max(initial=0))
    for _ in range(3 * a.shape[0]):
        slope = a.T @ (h - a @ x)
        slope[passive] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= scale:
            break
        passive[j] = True
        while True:
            trial = np.zeros(n)
            trial[passive] = np.linalg.lstsq(a[:, passive], h, rcond=None)[0]
            low = passive & (trial <= 0)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x += step * (trial - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = trial
    return x


def length_patterns(units: int) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` with one, two or three lengths."""
    three = [(units - b - c, b, c) for c in range(1, units // 3 + 1) for b in range(c, (units - c) // 2 + 1)]
    return [(units,), *((units - b, b) for b in range(1, units // 2 + 1)), *three]


def packing_plan(histogram: dict[int, int], capacity: int = 1024, quantum: int = 4) -> Plan:
    """Patterns of lengths with repeat counts that use up ``histogram`` exactly."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan: Plan = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    units = capacity // quantum
    coarse = np.zeros(units + 1, np.int64)
    np.add.at(coarse, -(-np.arange(capacity + 1) // quantum), left)
    patterns = [p for p in length_patterns(units) if all(coarse[u] for u in p)]
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    if patterns:
        a = np.zeros((units + 1, len(patterns)))
        for j, p in enumerate(patterns):
            for u in p:
                a[u, j] += 1
        repeats = np.floor(nonnegative_least_squares(a, coarse.astype(float)) + 0.5).astype(int)
        for j in np.argsort(-repeats, kind="stable"):
            todo = int(repeats[j])
            while todo > 0:  # true lengths, largest first, until a length of the pattern runs out
                lengths: list[int] = []
                for k, u in enumerate(patterns[j]):
                    # the last place takes the longest piece that still fits
                    top = capacity - sum(lengths) if k and k == len(patterns[j]) - 1 else u * quantum
                    span = np.arange(min(top, capacity - 1), (u - 1) * quantum, -1)
                    free = [int(s) for s in span if left[s] > lengths.count(int(s))]
                    lengths += free[:1]
                if len(lengths) < len(patterns[j]):
                    break
                n = min([todo, *(int(left[s]) // lengths.count(s) for s in lengths)])
                for s in lengths:
                    left[s] -= n
                todo -= n
                open_bins[capacity - sum(lengths)].append((tuple(lengths), n))
    for s in range(capacity, 0, -1):
        n = int(left[s])
        while n:
            room = min((r for r in open_bins if r >= s and open_bins[r]), default=None)
            if room is None:
                m = capacity // s
                for copies, bins in ((m, n // m), (n % m, 1)):
                    if copies and bins:
                        open_bins[capacity - copies * s].append(((s,) * copies, bins))
                break
            lengths, bins = open_bins[room].pop()
            used = min(n, bins)
            if bins > used:
                open_bins[room].append((lengths, bins - used))
            open_bins[room - s].append(((*lengths, s), used))
            n -= used
    return plan + [x for r in sorted(open_bins) for x in open_bins[r]]


def ranked(df: DataFrame, key: str, order: list[str], n_rows: int, rows_per_bucket: int = 4000) -> DataFrame:
    """Adds ``rank``, gapless from 0 within ``key``. A key is dealt over as many hash
    buckets as all rows would need, so that one hot key is no single task."""
    buckets = max(16, min(65536, n_rows // rows_per_bucket))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(key, "_bucket").count().select(key, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    local = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1)
    return local.join(offsets.hint("merge"), [key, "_bucket"]).withColumn("rank", F.col("_before") + F.col("_at")).drop("_bucket", "_at", "_before")


def pack(pieces: DataFrame, capacity: int = 1024, quantum: int = 4) -> DataFrame:
    """``pieces`` (see ``token_pieces``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    slots, base = [], 0
    taken: dict[int, int] = defaultdict(int)
    for lengths, n in packing_plan(histogram, capacity, quantum):
        offset = 0
        for s in lengths:
            slots.append((s, taken[s], taken[s] + n, base - taken[s], offset))
            taken[s] += n
            offset += s
        base += n
    table = spark.createDataFrame(slots, "length long, _low long, _high long, _shift long, offset long")
    placed = ranked(pieces, "length", ["doc_id", "piece", "ids_crc32"], sum(histogram.values()))
    here = (F.col("rank") >= F.col("_low")) & (F.col("rank") < F.col("_high"))
    # the slots are at most a few for each pattern of the plan, whatever the corpus
    return placed.join(F.broadcast(table), "length").where(here).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("_shift")).alias("sequence_id"), "offset")
