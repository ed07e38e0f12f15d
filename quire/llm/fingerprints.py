"""Threshold-scaled sketches of documents.

A sketch keeps every shingle hash below a fixed share of the hash space (1 in ``SHARE``), so
that its size follows the document's and two sketches of very unequal documents still compare
hash by hash. A text with few shingles also keeps its ``LEAST`` least hashes, or all it has, and
every sketch says up to which hash it is complete; two sketches are compared up to the lesser of
their bounds. Sketches of parts merge into the sketch of the whole (``merged``).

* Words are what lies between ASCII white space, A-Z taken as a-z; shingles are runs of five
  words, a text with fewer is one shingle, and a text without words has an empty sketch. Null
  texts count as empty. Two empty sketches are alike (1), an empty one and another are not (0).
* Documents follow each other in descending doc_id, a null id last; documents that share an id
  in an order of their own that depends on their texts. After the last comes the first, which
  may be the document itself.
* Hashes have 48 bits; equal texts have equal sketches, whatever else differs. No row is
  dropped; other columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import gathered, texts_of, written
from quire.llm.wordhash import FOLDED, WHITE, grams, hashed_words, raw_bytes

#: One shingle in so many is kept; a text's so many least hashes are kept anyway.
SHARE, LEAST = 16, 32
WORDS = 5
#: Hashes are below this.
SPACE = 1 << 48


class Sketch:
    """Distinct hashes in order, and the bound below which none is missing."""

    __slots__ = ("bound", "hashes")

    def __init__(self, hashes: np.ndarray, bound: int):
        self.hashes, self.bound = hashes, bound

    def raw(self) -> bytes:
        """Six bytes for the bound less one, and six for each hash."""
        numbers = np.concatenate([np.array([self.bound - 1], np.uint64), self.hashes])
        return np.ascontiguousarray(numbers.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()

    def text(self) -> str:
        return base64.b64encode(self.raw()).decode()

    @staticmethod
    def parsed(text: str) -> Sketch:
        raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
        numbers = np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], 1).view(">u8").ravel().astype(np.uint64)
        return Sketch(numbers[1:], int(numbers[0]) + 1)


def kept(hashes: np.ndarray, complete: int = SPACE, share: int = SHARE, least: int = LEAST) -> Sketch:
    """The sketch of distinct ordered hashes that are complete up to ``complete``."""
    bound = min(complete, SPACE // share)
    n = int(np.searchsorted(hashes, np.uint64(bound)))
    if n < least and complete > bound:
        n = min(least, int(np.searchsorted(hashes, np.uint64(complete))))
        bound = complete if n < least else max(bound, int(hashes[n - 1]) + 1)
    return Sketch(hashes[:n], bound)


def merged(a: Sketch, b: Sketch, share: int = SHARE, least: int = LEAST) -> Sketch:
    """The sketch of two parts' shingles together."""
    return kept(np.union1d(a.hashes, b.hashes), min(a.bound, b.bound), share, least)


def compared(a: Sketch, b: Sketch) -> tuple[float, float, float]:
    """Estimates of the likeness of two sets of shingles (common part of the union), and of
    the parts of ``a`` and of ``b`` that the other holds."""
    bound = min(a.bound, b.bound)
    n, m = (int(np.searchsorted(x.hashes, np.uint64(bound))) for x in (a, b))
    common = len(np.intersect1d(a.hashes[:n], b.hashes[:m], assume_unique=True))
    whole = lambda part, of: part / of if of else float(n == m)
    return whole(common, n + m - common), whole(common, n), whole(common, m)


def sketches(texts: pa.Array, share: int = SHARE, least: int = LEAST) -> list[Sketch]:
    """The sketches of texts without nulls."""
    hashes, _, _, bounds = hashed_words(*raw_bytes(texts), WHITE, FOLDED)
    runs, out = grams(np.concatenate([hashes, np.zeros(WORDS, np.uint64)]), WORDS) >> np.uint64(16), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WORDS:
            found = runs[a : b - WORDS + 1]
        else:
            found = grams(hashes[a:b], b - a)[:1] >> np.uint64(16) if b > a else runs[:0]
        out.append(kept(np.unique(found), SPACE, share, least))
    return out


def _judged(texts: list[str], following: list[str], share: int, least: int, max_bytes: int = 1 << 20) -> list[tuple]:
    """(n_chars, edited_sha256, fingerprint, edited_fingerprint, likeness of the edited text,
    of the next one, part of this text that each of them holds) of texts and what follows them."""
    out, i = [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < max_bytes):
            size += len(texts[j]) + len(following[j])
            j += 1
        own = texts[i:j]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(own, following[i:j])]
        a, b = (sketches(pa.array(x, pa.large_string()), share, least) for x in (own, edited))
        chained = all(n is t for n, t in zip(following[i:j], own[1:]))  # what follows is then known but for the last
        c = (a[1:] if chained else []) + sketches(pa.array(following[j - 1 : j] if chained else following[i:j], pa.large_string()), share, least)
        for t, e, x, y, z in zip(own, edited, a, b, c):
            (near_edited, in_edited, _), (near_next, in_next, _) = compared(x, y), compared(x, z)
            out.append((len(t), hashlib.sha256(e.encode()).hexdigest(), x.raw(), y.raw(), near_edited, near_next, in_edited, in_next))
        i = j
    return out


_JUDGED = [("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "binary"), ("edited_fingerprint", "binary"), ("near_edited", "double"), ("near_next", "double"), ("in_edited", "double"), ("in_next", "double")]
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
_DDL = "doc_id long, " + ", ".join(f"{n} {k}" for n, k in _JUDGED)


def _batch(ids: list, judged: list[tuple], **more: list) -> pa.RecordBatch:
    columns = list(zip(*judged)) or [[] for _ in _JUDGED]
    arrays = [pa.array(ids, pa.int64()), *(pa.array(list(c), _KINDS[k]) for c, (_, k) in zip(columns, _JUDGED))]
    kinds = {"part": pa.int32(), "end": pa.string(), "text": pa.string()}
    return pa.RecordBatch.from_arrays(arrays + [pa.array(v, kinds[c]) for c, v in more.items()], names=["doc_id", *(n for n, _ in _JUDGED), *more])


def fingerprint_edits(docs: DataFrame, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """For each document its sketch, and the sketch of its edited text, whose second half is
    replaced by the beginning of the next document: (doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, in_edited, in_next).

    Texts are dealt once into ranges of descending ids and read there in order, with one row
    held back; a hot id is spread over ranges. The ends of neighbouring ranges, two rows for
    each range, meet in a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        nothing = [(None,) * len(_JUDGED)]
        for t in gathered(batches):
            ids, texts = (t.column(c).to_pylist() for c in ("doc_id", "text"))
            if last is None:
                yield _batch([None], nothing, part=[part], end=["first"], text=texts[:1])
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = ids[-1], texts[-1]
            n = len(ids) - 1
            yield _batch(ids[:-1], _judged(texts[:-1], texts[1:], share, least), part=[part] * n, end=[None] * n, text=[None] * n)
        if last is not None:
            yield _batch([last[0]], nothing, part=[part], end=["last"], text=[last[1]])

    order = [F.desc_nulls_last("doc_id"), "_hash", "_at"]
    placed = texts_of(docs).withColumn("_hash", F.xxhash64("text")).withColumn("_at", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    done = written(ranged.mapInArrow(run, f"{_DDL}, part int, end string, text string"), "fingerprints")

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            ids, texts, following = (t.column(c).to_pylist() for c in ("doc_id", "text", "following"))
            yield _batch(ids, _judged(texts, following, share, least))

    parts = done.where("end = 'first'").select("part")  # numbers of ranges that hold rows
    after = parts.withColumn("next", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))))
    firsts = done.where("end = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    lasts = done.where("end = 'last'").select("doc_id", "part", "text").join(after.hint("merge"), "part").join(firsts.hint("merge"), "next")
    found = done.where("end is null").drop("part", "end", "text").unionByName(lasts.select("doc_id", "text", "following").mapInArrow(join_ends, _DDL))
    return found.select("doc_id", *((F.replace(F.base64(n), F.lit("\r\n"), F.lit("")) if k == "binary" else F.col(n)).alias(n) for n, k in _JUDGED))
