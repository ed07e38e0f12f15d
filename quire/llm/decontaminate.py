"""Benchmark decontamination by Wu-Manber search over words (operator 9).

Words are maximal runs of characters other than ASCII non-alphanumerics, after A-Z
are lower-cased. Patterns are the windows of ``window`` consecutive words of the
benchmark items (one window for a shorter item). For the patterns of one length, ``m``
words, the search reads the pair of words that ends at a position: the shift table
tells how far the search may jump (``m - 1`` words for a pair that no pattern has), the
bucket of a pair that ends a pattern lists the patterns to compare word by word.

Nulls: a null document or item text has no words; an item without words has no
window; the windows of an item without an id are hit like others, but it is left out of
the list of items. Repeated items, and items of one id, count once for each item_id;
ids are listed in the order of strings. Documents keep one row each, repeated ones too,
and are read whole, however long; empty tables give no rows or no hits. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, row_key, small_batches, texts_of, written

#: Spreads the first word of a pair over the slots of the shift table.
_STIR = 2_654_435_761
_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


class WordSearch:
    """Wu-Manber tables for patterns (words joined by one space) of one length, ``m`` words
    (``m`` >= 1). Words are numbers and patterns lie in one array. The shift table is hashed:
    pairs that fall together share the least shift, so that no occurrence is jumped over."""

    def __init__(self, patterns: list[bytes], m: int, numbers: dict[bytes, int]):
        self.m, self.numbers = m, numbers
        number = numbers.setdefault
        flat = np.fromiter((number(w, len(numbers)) for p in patterns for w in p.split(b" ")), np.int64, len(patterns) * m).reshape(-1, m)
        self.mask = (1 << min(24, max(10, (2 * flat.size).bit_length()))) - 1
        shift = np.full(self.mask + 1, min(255, max(1, m - 1)), np.uint8)
        for end in range(2, m):  # of a pair's places the nearest to the end comes last
            shift[self._slots(flat[:, end - 2], flat[:, end - 1])] = min(255, m - end)
        last = flat[:, m - 1] + (flat[:, m - 2] << 32 if m > 1 else 0)
        shift[self._slots(flat[:, m - 2] if m > 1 else 0, flat[:, m - 1])] = 0
        self.shift = shift.tobytes()
        self.order = np.argsort(last, kind="stable").astype(np.int32)
        keys, starts = np.unique(last[self.order], return_index=True)
        self.buckets, self.starts = dict(zip(keys.tolist(), range(len(keys)))), np.append(starts, len(last))
        self.patterns = flat.astype(np.int32)

    def _slots(self, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        return (a * _STIR + b) & self.mask

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of every occurrence; words that are jumped over are not read."""
        m, n, shift, mask, two, number = self.m, len(words), self.shift, self.mask, self.m > 1, self.numbers.get
        i = m
        while i <= n:
            a, b = number(words[i - 2], -1) if two else 0, number(words[i - 1], -1)
            step = shift[(a * _STIR + b) & mask]
            if step:
                i += step
                continue
            k = self.buckets.get((a << 32) + b)
            if k is not None:
                own = [number(w, -1) for w in words[i - m : i]]
                for at in self.order[self.starts[k] : self.starts[k + 1]]:
                    if self.patterns[at].tolist() == own:
                        yield i - m, int(at)
            i += 1


class Searches:
    """A search for each length of pattern, over one numbering of words: short patterns would
    spoil the jumps of the full windows."""

    def __init__(self, table: pa.Table):
        self.numbers: dict[bytes, int] = {}
        self.parts: list[tuple[WordSearch, pa.Array]] = []
        for n in pc.unique(table.column("n")).to_pylist():
            t = table.filter(pc.equal(table.column("n"), n)).combine_chunks()
            self.parts.append((WordSearch(t.column("pattern").to_pylist(), n, self.numbers), t.column("items").combine_chunks()))

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int, list[str]]]]:
        """The number of words of a text, and (first word, end, items) of every occurrence."""
        words = words_of(text)
        return len(words), [(low, low + s.m, items[at].as_py()) for s, items in self.parts for low, at in s.find(words)]


#: The tables of the block that this worker has built last.
_BUILT: list[tuple[str, Searches]] = []


def searches_of(name: str, block: bytes) -> Searches:
    """The tables of a block, built once in a worker, whatever the number of its tasks."""
    if not _BUILT or _BUILT[0][0] != name:
        _BUILT.clear()
        _BUILT.append((name, Searches(pa.ipc.open_stream(block).read_all())))
    return _BUILT[0][1]


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(pattern binary, n, items) of the distinct windows of all items: the words joined
    by one space, their number, and the ids of the items that hold them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, found, n = [], [], []
            for item, text in zip(b.column("item").to_pylist(), b.column("text")):
                words = words_of(text.as_py())
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    items.append(item)
                    found.append(b" ".join(words[i : i + window]))
                    n.append(min(window, len(words)))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.binary()), pa.array(n, pa.int32())], names=["item", "pattern", "n"])

    small_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").mapInArrow(cut, "item string, pattern binary, n int")
    return rows.groupBy("pattern", "n").agg(F.collect_set("item").alias("items"))


#: Words in one block of patterns; more patterns take more scans.
MAX_BLOCK_WORDS = 800_000


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, hit_share: int = 20, with_row: bool = False, block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document,
    and its ``row_key`` as ``row`` if asked for.

    The patterns are made and counted by Spark. A block of about ``block_words`` words of them
    is sent to the workers, as packed Arrow, and scanned for in one pass over the text, without a
    shuffle. For several blocks the texts are first written with a number for each row; the scans'
    hits, of rows that have any, are merged by it.
    """
    spark = docs.sparkSession

    def scan(name: str, held, all_rows: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found, at = searches_of(name, held.value), []
                rows: list[list] = [[], [], [], []]
                for k, text in enumerate(b.column("text")):
                    n, hits = found.hits(text.as_py())
                    if hits or all_rows:
                        at.append(k)
                        for c, v in zip(rows, (n, [h[0] for h in hits], [h[1] for h in hits], sorted(set().union(*(h[2] for h in hits))))):
                            c.append(v)
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
                kept = [b.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "row", "number")]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(r, k) for r, k in zip(rows, kinds))], names=["doc_id", "row", "number", "n_words", "lows", "ends", "items"])

        return run

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, digest, n_items = [], [], []
            for low, end, items in zip(b.column("lows").to_pylist(), b.column("ends").to_pylist(), b.column("items").to_pylist()):
                covered = at = 0
                for s, e in sorted(zip(low, end)):
                    covered += max(0, e - max(s, at))
                    at = max(at, e)
                hit.append(covered)
                n_items.append(len(set(items)))
                digest.append(hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "row", "n_words", "n_hit", "n_items", "items_sha256"])

    patterns = written(item_windows(benchmark, window), "patterns")
    blocks = max(1, -(-(patterns.agg(F.sum("n")).first()[0] or 0) // block_words))
    block = F.pmod(F.xxhash64("pattern"), F.lit(blocks))
    texts, ddl = texts_of(docs).withColumn("row", row_key()), "doc_id long, row long, n_words long, n_hit long, n_items long, items_sha256 string"

    def sent(k: int):
        table, sink = patterns.where(block == k).toArrow(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    name = uuid.uuid4().hex
    if blocks == 1:
        search = scan(name, sent(0), True)
        discard(spark, patterns.written_to)
        rows = texts.withColumn("number", F.lit(0).cast("long")).mapInArrow(lambda batches: total(search(batches)), ddl)
    else:
        texts = written(texts.withColumn("number", F.monotonically_increasing_id()), "texts")
        scans, hits = [], "doc_id long, row long, number long, n_words long, lows array<long>, ends array<long>, items array<string>"
        for k in range(blocks):
            held = sent(k)
            scans.append(written(texts.mapInArrow(scan(f"{name}-{k}", held, not k), hits), "scan"))
            held.destroy()
        discard(spark, patterns.written_to, texts.written_to)
        merged = reduce(DataFrame.unionByName, scans).groupBy("number").agg(
            *(F.first(c).alias(c) for c in ("doc_id", "row", "n_words")), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("lows")).alias("lows"), F.flatten(F.collect_list("ends")).alias("ends")
        )
        rows = merged.mapInArrow(total, ddl)
    rows = rows if with_row else rows.drop("row")
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * hit_share >= F.col("n_words")))
