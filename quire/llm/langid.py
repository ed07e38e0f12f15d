"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 7).

All documents outside the held-out fold with a language are counted. The matrix of log
probabilities (buckets x languages) is broadcast, 64 MB of it at a time: more than
``MAX_LANGUAGES`` languages take several scans, merged by document. A document's log
likelihoods are sums over its n-grams, taken for a slice of documents at once.

Nulls: a null text, or one without a letter, is ``und`` with score 0; rows with a null
language, and with a null doc_id, are not learned from. Repeated documents keep one row
each; of equal likelihoods the language first in alphabetical order is taken. Letters are
Unicode's (categories L*): number signs are none. Without anything to learn from every
document is ``und``. Very long texts are read whole. Empty tables give no rows. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import gathered, held_out, passing, row_key, small_batches, texts_of, written
from quire.llm.wordhash import small_tables

BUCKETS = 1 << 16
#: Columns of the matrix that are sent at once: 64 MB.
MAX_LANGUAGES = 256


def hashed_grams(texts: list[str], longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For n = 1 to ``longest`` the bucket of the n-gram that starts at each character
    (n-grams across two texts are left to bucket 0), and the texts' bounds."""
    line = "\0".join(t.replace("\0", " ").lower() for t in texts) + "\0"
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 0)
    bounds = np.concatenate([[0], ends + 1])
    left = np.repeat(ends, np.diff(bounds)) - np.arange(len(codes))
    rolled, out = codes * np.uint32(2654435761), []
    for n in range(1, longest + 1):
        if n > 1:
            rolled = rolled.copy()
            rolled[: len(codes) - n + 1] = (rolled[: len(codes) - n + 1] + codes[n - 1 :]) * np.uint32(2246822519)
        x = rolled ^ (rolled >> np.uint32(15))
        x = (x * np.uint32(3266489917)) >> np.uint32(16)
        out.append(np.where(left >= n, np.maximum(x, 1), 0))
    return out, bounds


def count_grams(docs: DataFrame, longest: int) -> DataFrame:
    """(lang, bucket, n) over rows (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])
            held.clear()

        for t in gathered(batches):
            for part in small_tables(t):
                langs = part.column("lang").to_pylist()
                grams, bounds = hashed_grams(part.column("text").to_pylist(), longest)
                names = sorted(set(langs))
                which = np.repeat([names.index(x) for x in langs], np.diff(bounds))
                for k, lang in enumerate(names):
                    mine = which == k
                    total = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for g in grams:
                        total += np.bincount(g[mine], minlength=BUCKETS)
                    total[0] = 0
            if len(held) > 64:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def log_matrix(counts: DataFrame, langs: list[str], smoothing: float) -> np.ndarray:
    """(languages, buckets) log probabilities of ``langs``, at most ``MAX_LANGUAGES``, from
    counts (lang, bucket, n). Bucket 0 belongs to no n-gram."""
    rows = counts.where(F.col("lang").isin(langs)).toArrow()
    matrix = np.full((len(langs), BUCKETS), smoothing)
    which = {x: k for k, x in enumerate(langs)}
    at = np.array([which[x] for x in rows.column("lang").to_pylist()], np.int64)
    matrix[at, rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
    matrix = np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)
    matrix[:, 0] = 0
    return matrix


def identify_language(docs: DataFrame, *, longest: int = 3, smoothing: float = 0.5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document."""
    small_batches(docs.sparkSession)
    with passing(docs.sparkSession) as keep:
        return _identify_language(docs, longest, smoothing, keep)


def _identify_language(docs: DataFrame, longest: int, smoothing: float, keep: list[DataFrame]) -> DataFrame:
    spark = docs.sparkSession
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang")
    counts = written(count_grams(train, longest), "grams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    blocks = [langs[i : i + MAX_LANGUAGES] for i in range(0, len(langs), MAX_LANGUAGES)] or [[]]

    def rated(held):
        """For each text the likeliest language of a block, its log likelihood, and the log
        of the sum of all likelihoods."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, logs = held.value
            for t in gathered(batches):
                for part in small_tables(t):
                    texts = part.column("text").to_pylist()
                    grams, bounds = hashed_grams(texts, longest)
                    total = np.zeros((max(len(names), 1), len(texts)))
                    for k in range(len(names)):
                        for g in grams:
                            total[k] += np.add.reduceat(logs[k][g], bounds[:-1], dtype=np.float64)
                    known = np.array([bool(names) and any(map(str.isalpha, x)) for x in texts])
                    best, top = total.argmax(axis=0), total.max(axis=0)
                    whole = top + np.log(np.exp(np.maximum(total - top, -700)).sum(axis=0))
                    pred = [names[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist())]
                    columns = [*(part.column(c).combine_chunks() for c in ("doc_id", "row")), pa.array(known), pa.array(pred, pa.string()), pa.array(top), pa.array(whole)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "known", "lang_pred", "top", "whole"])

        return run

    texts, scans = texts_of(docs).withColumn("row", row_key()), []
    for block in blocks:
        held = spark.sparkContext.broadcast((block, log_matrix(counts, block, smoothing)))
        scans.append(texts.mapInArrow(rated(held), "doc_id long, row long, known boolean, lang_pred string, top double, whole double"))
        if len(blocks) > 1:  # one block's matrix is held at a time
            scans[-1] = written(scans[-1].withColumn("block", F.lit(len(scans))), "rated")
            keep.append(scans[-1])
            held.destroy()
    found = scans[0]
    if len(blocks) > 1:
        every = reduce(DataFrame.unionByName, scans)
        most = every.groupBy("doc_id", "row").agg(F.max("top").alias("_top"))
        every = every.join(most.hint("merge"), (every["doc_id"].eqNullSafe(most["doc_id"])) & (every["row"] == most["row"])).select(every["*"], "_top")
        first = F.min(F.when(F.col("top") == F.col("_top"), F.col("lang_pred")))
        merged = every.groupBy("doc_id", "row").agg(
            F.count(F.when(F.col("block") == 1, 1)).alias("_n"), F.bool_or("known").alias("known"), first.alias("lang_pred"), F.first("_top").alias("top"), F.sum(F.exp(F.col("whole") - F.col("_top"))).alias("_sum")
        )
        # repeated rows were summed together
        merged = merged.withColumn("whole", F.col("top") + F.log(F.col("_sum") / F.col("_n")))
        found = merged.select("*", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("col")
    # the posterior of the best language under equal priors
    score = F.when(F.col("known"), F.least(F.lit(1.0), F.exp(F.col("top") - F.col("whole")))).otherwise(F.lit(0.0))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", score.alias("score"))
