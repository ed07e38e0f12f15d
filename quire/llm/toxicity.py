"""Toxicity by maximum-scoring segments (operator 6).

A word's score is its log odds between toxic and other labelled documents under an
informative Dirichlet prior (the words' shares in both, with ``prior`` times the weight
of the counts); words whose log odds are not
significant share one slightly negative score. A linear-time scan finds every maximal
scoring segment of a document. Segment scores are compared with what chance gives in a
text of that length (extreme-value law with the two Karlin-Altschul numbers of the
clean word distribution); the evidence of the significant segments is added and a
logistic curve, fitted on labelled documents, turns it into a score.

Labels are learned from at most ``max_labelled`` documents, those with the least hash of
doc_id, so that the list of labels can be sent to the tasks. The bound concerns the model
only, whose words are all significant ones of those documents: every document is scored
whole, however long.

Nulls: a null text is empty and scores as a text without evidence; null labels are left
out; of repeated labels the greater counts; a null doc_id is scored and never learned
from. Repeated documents keep one row each. Without labels of both classes the score is
the share of toxic labels, or 0. Texts of equal evidence have equal scores. Empty tables
give no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import gathered, held_out, passing, texts_of, written
from quire.llm.wordhash import FOLDED, hashed_words, raw_bytes, small_tables

#: Bytes that end a word: ASCII other than letters and digits.
_ENDS = np.ones(256, bool)
_ENDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def maximal_segments(scores: list[float], before: list[float]) -> list[float]:
    """Scores of all maximal scoring segments. ``scores`` are the positive items in
    order, ``before`` the total score in front of each; what lies between two items
    is negative. One pass with a stack of candidates."""
    stack: list[tuple[float, float]] = []  # (total before, total after) of each candidate
    for s, low in zip(scores, before):
        low, high = low, low + s
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= low:
                j -= 1
            if j < 0 or stack[j][1] >= high:
                break
            low = stack[j][0]
            del stack[j:]
        stack.append((low, high))
    return [high - low for low, high in stack]


def count_words(labelled: DataFrame) -> DataFrame:
    """(word, clean, toxic): in how many documents of each label a word occurs, by
    64-bit word hash over (text, label). A word counts once for a document, so one
    document that repeats itself weighs no more than others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            words, toxic = [], []
            for part in small_tables(t):
                h, _, _, bounds = hashed_words(*raw_bytes(part.column("text")), _ENDS, FOLDED)
                doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                words.append(h[new])
                toxic.append(part.column("label").to_numpy()[doc[new]])
            if words:
                names, at = np.unique(np.concatenate(words), return_inverse=True)
                toxic = np.concatenate(toxic)
                bad = np.bincount(at, weights=toxic, minlength=len(names)).astype(np.int64)
                every = np.bincount(at, minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(every - bad), pa.array(bad)], names=["word", "clean", "toxic"])

    rows = labelled.mapInArrow(run, "word long, clean long, toxic long")
    return rows.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def weighted_words(counts: DataFrame, *, prior: float, min_z: float, min_odds: float) -> tuple[list, tuple[int, int]]:
    """(word, log odds, clean count, toxic count) of the significant words, and totals."""
    n0, n1 = counts.agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n0 or not n1:
        return [], (n0, n1)
    alpha, whole = (F.col("clean") + F.col("toxic")) * F.lit(prior), prior * (n0 + n1)
    y1, y0 = F.col("toxic") + alpha, F.col("clean") + alpha
    odds = F.log(y1 / (F.lit(n1 + whole) - y1)) - F.log(y0 / (F.lit(n0 + whole) - y0))
    rated = counts.where("toxic > 1").select("word", odds.alias("odds"), (odds / F.sqrt(1 / y1 + 1 / y0)).alias("z"), "clean", "toxic")
    best = rated.where((F.col("z") >= min_z) & (F.col("odds") >= min_odds))
    # words of the labelled documents only, whose number is bounded
    return sorted(tuple(r) for r in best.select("word", "odds", "clean", "toxic").collect()), (n0, n1)


def least_hashed(known: DataFrame, most: int) -> DataFrame:
    """The rows (doc_id, ..) with the least hashes of doc_id, about ``most`` of them and
    never more: the cutoff comes from counts by the hash's top bits."""
    slot = F.shiftrightunsigned(F.xxhash64("doc_id"), 48)
    counts = sorted(tuple(r) for r in known.groupBy(slot.alias("slot")).count().collect())
    total, cutoff = 0, 0
    for s, n in counts:
        total += n
        if total > most:
            break
        cutoff = s + 1
    return known.where(slot < cutoff)


def chance_law(model: list, totals: tuple[int, int], rest: float) -> tuple[float, float]:
    """lambda and K: a clean text of n words has a segment over x with chance about
    1 - exp(-K n exp(-lambda x))."""
    share = np.array([m[2] + 0.5 for m in model]) / (totals[0] + 0.5 * len(model))
    score = np.array([m[1] for m in model])
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        total = (share * np.exp(np.minimum(mid * score, 600))).sum() + (1 - share.sum()) * np.exp(mid * rest)
        low, high = (mid, high) if total < 1 else (low, mid)
    # a segment begins at a positive word, and almost always has only one
    return low, float((share * np.exp(np.minimum(low * score, 600))).sum())


def evidence(docs: DataFrame, model: list, rest: float, law: tuple[float, float]) -> DataFrame:
    """(doc_id, evidence) of each document: over its segments, the sum of how far
    lambda * score lies above log(K n)."""
    order = sorted(model)
    held = docs.sparkSession.sparkContext.broadcast((np.array([m[0] for m in order], np.int64).view(np.uint64), np.array([m[1] for m in order])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, odds = held.value
        by_hash = np.argsort(names)
        names, odds = names[by_hash], odds[by_hash]
        maybe = np.zeros(1 << 20, bool)
        maybe[names & np.uint64((1 << 20) - 1)] = True
        for t in gathered(batches):
            for part in small_tables(t):
                h, _, _, bounds = hashed_words(*raw_bytes(part.column("text")), _ENDS, FOLDED)
                at = np.flatnonzero(maybe[h & np.uint64((1 << 20) - 1)])
                k = np.searchsorted(names, h[at])
                k[k == len(names)] = 0
                hit = names[k] == h[at] if len(names) else np.zeros(0, bool)
                at, score = at[hit], odds[k[hit]] if len(names) else np.zeros(0)
                cuts = np.searchsorted(at, bounds)
                out = np.zeros(part.num_rows)
                for d in np.flatnonzero(np.diff(cuts)).tolist():
                    a, b = cuts[d], cuts[d + 1]
                    s = score[a:b]
                    gaps = rest * (at[a:b] - bounds[d] - np.arange(b - a))
                    found = np.array(maximal_segments(s.tolist(), (gaps + np.cumsum(s) - s).tolist()))
                    over = law[0] * found - np.log(max(law[1] * (bounds[d + 1] - bounds[d]), 1e-12))
                    out[d] = np.maximum(over, 0).sum()
                yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), pa.array(out)], names=["doc_id", "evidence"])

    return texts_of(docs).mapInArrow(run, "doc_id long, evidence double")


def logistic_curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """a, b of the chance 1 / (1 + exp(-(a + b x))) fitted to (x, clean, toxic) counts."""
    x, n0, n1 = (np.array(v, float) for v in zip(*bins))
    n, y = n0 + n1, n1
    design, coef = np.stack([np.ones_like(x), x], axis=1), np.array([np.log((y.sum() + 1) / (n0.sum() + 1)), 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ coef, -30, 30)))
        w = np.maximum(n * p * (1 - p), 1e-9)
        slope = design.T @ (y - n * p) - 1e-3 * coef
        step = np.linalg.solve(design.T @ (design * w[:, None]) + 1e-3 * np.eye(2), slope)
        coef = coef + np.clip(step, -2, 2)
    return float(coef[0]), float(coef[1])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, max_labelled: int = 400_000, prior: float = 0.1, min_z: float = 3.5, min_odds: float = 1.5, drift: float = 0.05
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    with passing(docs.sparkSession) as keep:
        found, (a, b) = _rated(docs, labels, max_labelled, prior, min_z, min_odds, drift)
        keep.append(found)
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.least("evidence", F.lit(100.0)))))
    return found.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def _rated(docs: DataFrame, labels: DataFrame, max_labelled: int, prior: float, min_z: float, min_odds: float, drift: float) -> tuple[DataFrame, tuple[float, float]]:
    """(doc_id, evidence) of each document, and the curve that makes scores of it."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("label"))
    known = written(least_hashed(written(known.where(~held_out()), "labelled"), max_labelled), "labels")
    counts = written(count_words(texts_of(docs).join(F.broadcast(known), "doc_id").select("text", "label")), "words")
    model, totals = weighted_words(counts, prior=prior, min_z=min_z, min_odds=min_odds)
    mass = [sum(m[2 + c] for m in model) / max(totals[c], 1) for c in (0, 1)]
    rest = float(np.log(max(1 - mass[1], 1e-6) / max(1 - mass[0], 1e-6))) - drift if model else -drift
    found = written(evidence(docs, model, rest, chance_law(model, totals, rest) if model else (1.0, 1.0)), "evidence")
    binned = found.join(F.broadcast(known), "doc_id").groupBy(F.least(F.ceil(F.col("evidence") * 2), F.lit(200)).alias("bin")).agg(F.sum(1 - F.col("label")), F.sum("label")).collect()
    bins = [(r[0] / 2, r[1], r[2]) for r in binned]
    toxic, every = sum(b[2] for b in bins), sum(b[1] + b[2] for b in bins)
    return found, logistic_curve(bins) if 0 < toxic < every else (30.0 if toxic else -30.0, 0.0)
