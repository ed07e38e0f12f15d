"""Hard negatives against a plain search."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import hardnegatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def model(rows, k=5, m=10):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], la) for i, v, la, *_ in rows if i is not None and v is not None and la is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for a, v, la in ok:
        if a % 100 == 0:
            scored = sorted((-dot(v, w), i, lb) for i, w, lb in ok if i != a)
            for s, p, _ in [x for x in scored if x[2] == la][:k]:
                fits = [(i, t) for t, i, lb in scored if lb != la and 30 * -s <= 100 * -t <= 90 * -s]
                for n, (i, t) in enumerate(fits[:m]):
                    out[a, p, n + 1, i, -s, -t] += 1
    return out


def made(seed, n, spread=1.0, dims=6, labels=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels + 2, dims))
    rows = []
    for i in range(n):
        v = (centres[i % len(centres)] + spread * r.normal(size=dims)).astype(np.float32)
        rows.append((i * 20, v.tolist(), int(r.integers(labels)), 1, "s"))
    return rows


ODD = [
    (100_000, None, 1, 0, ""), (100_100, [float("nan")] * 6, 1, 0, ""), (100_200, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 1, 0, ""), (100_300, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 0, ""),
    (100_400, [1.0] * 6, None, 0, ""), (None, [1.0] * 6, 1, 0, ""), (100_500, [], 1, 0, ""), (100_600, [0.0] * 6, 2, 0, ""), (100_700, [3.0, -2.5], 0, 0, ""), (100_801, [0.5] * 6, 9, 0, ""), (-100, [2.0] * 6, 0, 0, ""),
]


@pytest.mark.parametrize("seed,spread,block", [(1, 1.0, 8192), (2, 0.05, 7), (3, 0.3, 3)])
def test_against_a_plain_search(spark, seed, spread, block):
    rows = made(seed, 400, spread) + ODD
    rows += [(7, rows[0][1], 0, 1, "s")] * 150 + [rows[3]] * 2  # a hot vector, and repeated rows
    found = H.mine_hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4), block_anchors=block)
    assert Counter(tuple(r) for r in found.collect()) == model(rows)


def test_an_anchor_in_several_rows(spark):
    rows = made(4, 60) + [(0, [1.0] * 6, 1, 0, ""), (0, [1.0] * 6, 1, 0, ""), (0, [-1.0, 2.0, 0.0, 0.0, 1.0, 0.0], 2, 0, "")]
    found = H.mine_hard_negatives(spark.createDataFrame(rows, SCHEMA))
    assert Counter(tuple(r) for r in found.collect()) == model(rows)


def test_nothing_and_no_anchor(spark):
    assert H.mine_hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert H.mine_hard_negatives(spark.createDataFrame([(7, [1.0], 1, 0, "")], SCHEMA)).collect() == []
    assert H.mine_hard_negatives(spark.createDataFrame([(100, [1.0], 1, 0, "")], SCHEMA)).collect() == []


def test_large_components(spark):
    rows = [(i * 50, [float(2**20 + i), float(-i)], i % 2, 0, "") for i in range(20)]
    found = H.mine_hard_negatives(spark.createDataFrame(rows, SCHEMA))
    assert Counter(tuple(r) for r in found.collect()) == model(rows)
    with pytest.raises(ValueError):
        H.mine_hard_negatives(spark.createDataFrame([(100, [1e30], 1, 0, "")], SCHEMA))


def test_bounds_hold_and_narrow():
    """No score lies outside its bounds, and rows near a direction have narrow ones."""
    r = random.Random(6)
    rows = np.array([[math.floor(256 * r.gauss(0, 1)) for _ in range(8)] for _ in range(300)])
    directions = H.directions_of(rows.astype(float), 16)
    norms = np.sqrt((rows.astype(float) ** 2).sum(1))
    angles = H._angles(rows, norms, directions).astype(float)

    class Some:
        pass

    anchors = Some()
    anchors.angles, anchors.norms = angles, norms
    for i in range(0, 300, 20):
        part = slice(i, i + 20)
        low, high = H.score_bounds(anchors, angles[part].min(0), angles[part].max(0), norms[part].min(), norms[part].max())
        scores = rows @ rows[part].T
        assert (scores.min(1) >= low).all() and (scores.max(1) <= high).all()
    tight = np.tile(directions[:1] * 256, (5, 1))
    a = H._angles(tight, np.full(5, 256.0), directions).astype(float)
    anchors.angles, anchors.norms = a, np.full(5, 256.0)
    low, high = H.score_bounds(anchors, a.min(0), a.max(0), 256.0, 256.0)
    assert (high - low < 100).all()
