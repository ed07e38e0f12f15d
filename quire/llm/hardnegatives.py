"""Hard negatives by angular triangle filtering.

Vectors are scaled and floored to whole numbers, so that scores are exact. Each row keeps its
norm and its angles to a few reference directions. By the triangle inequality the angle between
two rows lies between the difference and the sum of their angles to any one direction; the
cosines of these ends, times both norms and widened by more than rounding can shift them, bound
the score. Rows are stored in order of their nearest direction, and a block of rows is met by
the anchors alone whose bounds overlap what they still look for; only there are scores made.

* A row whose label, vector or any component is null or not finite, or whose id is null, takes
  no part. Shorter vectors count as padded with zeros; an empty one is all zeros.
* Rows are judged singly: copies of a row are rows of their own. Rows that share the anchor's
  id are no other rows of it. An id that stands in several rows is an anchor in each of them,
  and gives each its own result rows.
* Ties are broken by the smaller id. Other columns, whatever their names, are not looked at.
* Scores must fit in a long: components so large that they might not raise a ValueError.
* An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import gathered, passing, shared_dir, small_batches, written

#: Reference directions, and how many rows at most they are fitted on (about that many of all
#: are drawn, by a hash of the id).
REFERENCES, SAMPLE_ROWS = 16, 4096
#: Bounds of what one pass over the rows searches for: anchors, and bytes of their vectors.
BLOCK_ANCHORS, BLOCK_BYTES = 8192, 32 << 20
#: Rows that are bounded together.
ROW_BLOCK = 128
#: Angles are kept in 32 bits; bounds are widened by more than that and rounding can matter.
SLACK = 1e-5
_NONE, _NO_ID = -(2**62), 2**63 - 1

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _ints(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    """Vectors as rows of whole numbers, padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _angles(vectors: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of rows to unit directions; a row of zeros is at right angles to all."""
    cos = vectors.astype(np.float64) @ directions.T / np.where(norms > 0, norms, 1.0)[:, None]
    return np.arccos(np.clip(cos, -1.0, 1.0)).astype(np.float32)


def directions_of(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Unit directions that a sample of rows clusters around."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    found = unit[np.linspace(0, len(unit) - 1, min(count, len(unit))).astype(int)]
    for _ in range(rounds):
        sums = np.zeros_like(found)
        np.add.at(sums, (unit @ found.T).argmax(1), unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(size > 0, sums / np.where(size > 0, size, 1.0), found)
    return found


def _index(rows: DataFrame, dims: int, scale: float, directions: np.ndarray) -> DataFrame:
    """The rows with whole-number vectors, norms and angles, in order of the nearest direction."""
    fields = [("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.binary()), ("norm", pa.float64()), ("angles", pa.binary()), ("cell", pa.int32()), ("near", pa.float32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            v = _ints(t.column("embedding"), dims, scale)
            norms = np.sqrt((v.astype(np.float64) ** 2).sum(1))
            angles = _angles(v, norms, directions)
            cell = angles.argmin(1)
            arrays = [t.column("vec_id"), t.column("label"), [x.tobytes() for x in v], norms, [x.tobytes() for x in angles], cell.astype(np.int32), angles[np.arange(len(cell)), cell]]
            yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else pa.array(x, f[1]) for x, f in zip(arrays, fields)], names=[f[0] for f in fields])

    spark = rows.sparkSession
    indexed = rows.mapInArrow(run, "vec_id long, label long, v binary, norm double, angles binary, cell int, near float")
    order = ["cell", "near", "vec_id"]
    return written(indexed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order), "angles")


class _Rows:
    """Some rows of the index as arrays."""

    def __init__(self, t: pa.Table, dims: int, exact):
        raw = lambda c, kind, width: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(t.num_rows, width)
        self.ids, self.labels = (t.column(c).to_numpy() for c in ("vec_id", "label"))
        self.v = raw("v", np.int64, dims).astype(exact)
        self.norms = t.column("norm").to_numpy()
        self.angles = raw("angles", np.float32, -1 if t.num_rows else 0).astype(np.float64)

    def __len__(self) -> int:
        return len(self.ids)


def score_bounds(anchors: _Rows, low: np.ndarray, high: np.ndarray, norm_low: float, norm_high: float) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the least and greatest score of any row whose angles lie in
    [low, high] and whose norm lies in [norm_low, norm_high]."""
    apart = np.maximum(anchors.angles - high, low - anchors.angles).max(1)
    least = np.maximum(apart - SLACK, 0.0)
    most = np.minimum(np.minimum(anchors.angles + high, 2 * np.pi - anchors.angles - low).min(1) + SLACK, np.pi)
    top, end = np.cos(least), np.cos(most)
    slack = SLACK * anchors.norms * norm_high + 1.0
    upper = anchors.norms * np.where(top > 0, norm_high, norm_low) * top + slack
    lower = anchors.norms * np.where(end > 0, norm_low, norm_high) * end - slack
    return np.floor(lower), np.ceil(upper)


class _Best:
    """The ``k`` best (score, id) of each of several lists."""

    def __init__(self, lists: int, k: int):
        self.k, self.scores, self.ids = k, np.full((lists, k), _NONE, np.int64), np.full((lists, k), _NO_ID, np.int64)
        self.held, self.size = [], 0

    def least(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((lists, scores.astype(np.int64), ids))
        self.size += len(lists)
        if self.size > 50_000:
            self.settle()

    def settle(self) -> None:
        if not self.size:
            return
        lists, scores, ids = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        met = np.unique(lists)
        lists = np.concatenate([lists, np.repeat(met, self.k)])
        scores = np.concatenate([scores, self.scores[met].ravel()])
        ids = np.concatenate([ids, self.ids[met].ravel()])
        order = np.lexsort((ids, -scores, lists))
        first = np.searchsorted(lists[order], met)
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.scores[met], self.ids[met] = scores[take].reshape(-1, self.k), ids[take].reshape(-1, self.k)


def _scan(anchors: _Rows, owner: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, k: int, same: bool, batches: Iterator[pa.RecordBatch], dims: int) -> _Best:
    """The best rows of each list, which belongs to the anchor ``owner`` and takes scores in
    [floor, ceiling] of rows with the anchor's label (``same``), or with any other one."""
    best = _Best(len(owner), k)
    for t in gathered(batches):
        rows = _Rows(t, dims, anchors.v.dtype)
        for i in range(0, len(rows), ROW_BLOCK):
            part = slice(i, i + ROW_BLOCK)
            angles, norms, labels = rows.angles[part], rows.norms[part], rows.labels[part]
            lower, upper = score_bounds(anchors, angles.min(0), angles.max(0), norms.min(), norms.max())
            wants = np.maximum(floor, best.least())
            mine = np.flatnonzero((upper[owner] >= wants) & (lower[owner] <= ceiling))
            if same:
                mine = mine[np.isin(anchors.labels[owner[mine]], labels)]
            if not len(mine):
                continue
            some, back = np.unique(owner[mine], return_inverse=True)
            scores = anchors.v[some] @ rows.v[part].T
            fits = ((anchors.labels[some, None] == labels) == same) & (anchors.ids[some, None] != rows.ids[part])
            scores, ids, least = scores[back], rows.ids[part], best.scores[mine, -1, None]
            better = (scores > least) | ((scores == least) & (ids < best.ids[mine, -1, None]))
            hit, row = np.nonzero(fits[back] & better & (scores >= floor[mine, None]) & (scores <= ceiling[mine, None]))
            if len(hit):
                best.add(mine[hit], scores[hit, row], ids[row])
    best.settle()
    return best


def mine_hard_negatives(vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, references: int = REFERENCES, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors
    (vec_id, embedding, label): for each anchor, a row whose id is divisible by
    ``anchor_every``, and each of its ``positives`` best rows of the same label, the
    ``negatives`` best rows of another label that score between ``low`` and ``high`` percent
    of the positive. Anchors are searched for in blocks of bounded size, each against all
    rows; a task keeps the best rows only, and Spark merges them by anchor."""
    spark = vectors.sparkSession
    small_batches(spark)
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    peak = F.max(F.greatest(F.abs(F.array_max("embedding")), F.abs(F.array_min("embedding"))).cast("double"))
    n, dims, peak, n_anchors = rows.agg(F.count("*"), F.max(F.size("embedding")), peak, F.count_if(F.col("vec_id") % anchor_every == 0)).first()
    if not n_anchors:
        return spark.createDataFrame([], RESULT)
    dims, reach = max(dims, 1), (scale * (peak or 0.0) + 1) ** 2 * max(dims, 1)
    if reach >= 2.0**62:
        raise ValueError(f"scores of components as large as {peak} may not fit in a long")
    exact = np.float64 if reach < 2.0**53 else np.int64

    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SAMPLE_ROWS))) == 0).limit(2 * SAMPLE_ROWS).select("embedding").toArrow()
    directions = directions_of(_ints(drawn.column("embedding"), dims, scale).astype(np.float64), references)
    with passing(spark):
        index = _index(rows, dims, scale, directions)
        anchors = written(index.where(F.col("vec_id") % anchor_every == 0).withColumn("no", F.monotonically_increasing_id()), "anchors")
        blocks = -(-n_anchors // max(64, min(block_anchors, BLOCK_BYTES // (8 * dims)))) if block_anchors >= 64 else -(-n_anchors // block_anchors)
        path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
        for k in range(blocks):
            block = anchors.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == k).orderBy("no").toArrow()
            if block.num_rows:
                _search(index, block, dims, exact, positives, negatives, low, high).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def _search(index: DataFrame, block: pa.Table, dims: int, exact, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result rows of one block of anchors."""
    spark = index.sparkSession
    held = spark.sparkContext.broadcast(block)
    every = np.arange(block.num_rows)

    def best_of(same: bool, owner: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, k: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _scan(_Rows(held.value, dims, exact), owner, floor, ceiling, k, same, batches, dims)
            at, place = np.nonzero(best.scores > _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(best.scores[at, place]), pa.array(best.ids[at, place])], names=["list", "score", "id"])

        found = index.select("vec_id", "label", "v", "norm", "angles").mapInArrow(run, "list int, score long, id long")
        rank = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    none = np.full(len(every), _NONE, np.int64)
    near = best_of(True, every, none, np.full(len(every), -_NONE, np.int64), positives).orderBy("list", "rank").toArrow()
    owner, score, positive = (near.column(c).to_numpy() for c in ("list", "score", "id"))
    floor, ceiling = -(-low * score // 100), high * score // 100
    far = best_of(False, owner.astype(np.int64), floor, ceiling, negatives)
    ids = block.column("vec_id").to_numpy()
    lists = pa.table({"list": pa.array(np.arange(len(owner), dtype=np.int32)), "anchor_id": pa.array(ids[owner]), "positive_id": pa.array(positive), "positive_score": pa.array(score)})
    named = far.join(F.broadcast(spark.createDataFrame(lists)), "list")  # at most `positives` rows for each anchor of the block
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
