"""Quality classifier: regularised quadratic discriminant analysis (operator 2).

Statistics of the whole text (logarithms of smoothed shares, so that short and long
texts compare) are taken once for every document and written. The class means and
covariances come from sums over all labelled documents outside the held-out fold; each
covariance is shrunk towards the pooled diagonal. A score is the logistic of the
difference of the two Gaussian log densities, read through Cholesky factors that are
computed once and sent to the tasks.

Nulls: a null text is an empty one and gets a score; labels that are null are left out;
of repeated labels the greater counts; a null doc_id is scored and never learned from.
Repeated documents keep one row each. Without labels of both classes every score is the
share of the class that is there, or 0.5. Texts of equal statistics have equal scores;
very long texts are read whole. Empty tables give no rows. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import gathered, held_out, texts_of, written
from quire.llm.wordhash import FOLDED, hashed_words, raw_bytes, small_tables


def _class(members: bytes | range) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[list(members)] = 1
    return table


_UPPER, _LOWER, _DIGIT = _class(range(65, 91)), _class(range(97, 123)), _class(range(48, 58))
_MARK, _STOP, _LINE, _HIGH = _class(b"#*$%&|<>!@^~=+\\_{}[]"), _class(b".,;:?'\"()-"), _class(b"\n"), _class(range(128, 256))
#: Prior weight, and prior share, of a smoothed share.
_WEIGHT = 12.0
N_STATS = 10


def _share(part: np.ndarray, whole: np.ndarray, prior: float) -> np.ndarray:
    return np.log((part + _WEIGHT * prior) / (whole + _WEIGHT))


def statistics(texts: pa.ChunkedArray) -> np.ndarray:
    """(texts, N_STATS) transformed statistics."""
    octets, bounds = raw_bytes(texts)
    hashes, starts, ends, words = hashed_words(octets, bounds, table=FOLDED)
    n, size = np.diff(words).astype(float), np.diff(bounds).astype(float)

    def per_text(table: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(table[octets])])[bounds]).astype(float)

    def per_words(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[words]).astype(float)

    doc = np.repeat(np.arange(len(n)), np.diff(words))
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=len(n)).astype(float)
    length = (ends - starts).astype(float)
    upper, lower, mark, stop = per_text(_UPPER), per_text(_LOWER), per_text(_MARK), per_text(_STOP)
    odd_ends = per_words(_MARK[octets[ends - 1]]) if len(ends) else n * 0
    return np.stack(
        [
            _share(upper, upper + lower, 0.03),
            _share(mark, size, 0.001),
            _share(odd_ends, n, 0.002),
            _share(stop, size, 0.03),
            _share(per_text(_DIGIT), size, 0.002),
            _share(per_text(_LINE), n, 0.02),
            np.log((per_words(length) + 5 * _WEIGHT) / (n + _WEIGHT)),
            0.5 * np.log((per_words(length**2) + 36 * _WEIGHT) / (n + _WEIGHT)),
            _share(distinct, n, 0.8) + 0.1 * np.log1p(n),
            _share(per_text(_HIGH), size, 0.01),
        ],
        axis=1,
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of each document, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            for part in small_tables(t):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), pa.array(list(statistics(part.column("text"))), pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return written(texts_of(docs).mapInArrow(run, "doc_id long, stats array<double>"), "stats")


def class_sums(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """n, sum and sum of products of ``stats`` for each ``label``, summed by Spark."""
    pairs = [(i, j) for i in range(N_STATS) for j in range(i + 1)]
    x = [F.get("stats", F.lit(i)) for i in range(N_STATS)]
    rows = labelled.groupBy("label").agg(F.count("*").alias("n"), *(F.sum(v).alias(f"s{i}") for i, v in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs)).collect()
    out = {}
    for r in rows:
        products = np.zeros((N_STATS, N_STATS))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"p{i}_{j}"]
        out[int(r["label"])] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(N_STATS)]), products)
    return out


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = 0.1, ridge: float = 1e-3) -> dict:
    """Means, Cholesky factors and log determinants of the two classes."""
    n_all = sum(s[0] for s in sums.values())
    pooled = sum((p - np.outer(s, s) / n for n, s, p in sums.values()), np.zeros((N_STATS, N_STATS))) / max(n_all, 1)
    base = np.diag(np.diag(pooled) + ridge)
    model = {}
    for c, (n, s, p) in sums.items():
        mean = s / n
        cov = (p - np.outer(s, s) / n) / n
        # few documents lean more on the pooled diagonal
        weight = shrinkage + (1 - shrinkage) * N_STATS / (n + N_STATS)
        lower = np.linalg.cholesky((1 - weight) * cov + weight * base)
        model[c] = (mean, lower, 2 * np.log(np.diag(lower)).sum(), np.log(n / n_all))
    return model


def log_odds(x: np.ndarray, model: dict) -> np.ndarray:
    if len(model) < 2:
        return np.full(len(x), 30.0 if 1 in model else -30.0 if model else 0.0)
    logs = {}
    for c, (mean, lower, det, prior) in model.items():
        z = np.linalg.solve(lower, (x - mean).T)
        logs[c] = prior - 0.5 * (det + (z * z).sum(axis=0))
    return logs[1] - logs[0]


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, shrinkage: float = 0.1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    stats = with_statistics(docs)
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    train = stats.where(~held_out()).join(known.hint("merge"), "doc_id").where("label in (0, 1)")
    held = docs.sparkSession.sparkContext.broadcast(fit(class_sums(train), shrinkage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("stats").flatten()).reshape(b.num_rows, N_STATS)
            score = 1 / (1 + np.exp(-np.clip(log_odds(x, held.value), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
