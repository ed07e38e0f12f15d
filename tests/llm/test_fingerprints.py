"""Sketches of documents against whole sets of shingles."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import LOW, ROWS, SCHEMA, words

from quire.llm import fingerprints as P


def shingles(text):
    w = words((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def sketch(text, **k):
    return P.sketches(pa.array([text], pa.large_string()), **k)[0]


def likeness(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(text, following):
    n = len(text or "")
    return (text or "")[: n - n // 2] + (following or "")[: n // 2]


def test_every_row_follows_another(spark):
    found = P.fingerprint_edits(spark.createDataFrame(ROWS, SCHEMA).repartition(5)).collect()
    assert len(found) == len(ROWS)
    last = {r[0]: r[1] or "" for r in ROWS}  # ids stand once but for a repeated row, and the row without one comes last
    order = sorted((r for r in ROWS if r[0] is not None), key=lambda r: -r[0]) + [r for r in ROWS if r[0] is None]
    want = Counter()
    for r, after in zip(order, order[1:] + order[:1]):
        text = r[1] or ""
        want[r[0], len(text), hashlib.sha256(edited(text, after[1]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == want
    following = dict(zip([r[0] for r in order], order[1:] + order[:1]))
    for r in found:
        if r["doc_id"] != 9:  # the repeated row
            text, other = last[r["doc_id"]], following[r["doc_id"]][1] or ""
            assert r["fingerprint"] == sketch(text).text() and r["edited_fingerprint"] == sketch(edited(text, other)).text()
            for c, t in (("near_edited", edited(text, other)), ("near_next", other)):
                assert r[c] == P.compared(sketch(text), sketch(t))[0]
                if len(shingles(text)) <= P.LEAST and len(shingles(t)) <= P.LEAST:  # whole sets are kept
                    assert r[c] == likeness(text, t)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    rows = [(i, f"a b c d e f g {i}") for i in range(n)]
    found = P.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == n
    if n == 1:  # it follows itself
        assert found[0]["near_next"] == 1.0


def test_a_hot_id_is_spread(spark):
    rows = [(None, f"t{i % 3} " + "w " * (i % 7)) for i in range(300)] + [(i, "x y z") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = P.fingerprint_edits(df)
    assert found.count() == 400
    by_text = {r["fingerprint"] for r in found.where("doc_id is null").collect()}
    assert by_text == {sketch(t).text() for d, t in rows if d is None}


def prose(r, n):
    return " ".join(r.choice("abcdefghijklmnopqrstuvw") * r.randint(1, 4) + str(r.randint(0, 99)) for _ in range(n))


def test_estimates_of_unequal_documents():
    r = random.Random(3)
    errors = []
    for _ in range(40):
        a, b = prose(r, r.randint(2000, 4000)), prose(r, 200)
        long = a + " " + b  # holds the short one
        x, y = sketch(long), sketch(b)
        like, part_long, part_short = P.compared(x, y)
        assert part_short > 0.6
        errors.append(like - likeness(long, b))
        assert P.compared(x, x) == (1.0, 1.0, 1.0) and P.compared(sketch(prose(r, 900)), y)[0] == 0.0
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_sketches_merge_and_parse():
    r = random.Random(4)
    for n, m in ((3, 0), (20, 900), (1500, 700), (0, 0), (40, 30)):
        parts = [prose(r, k) for k in (n, m)]
        hashes = [P.sketches(pa.array([t]), share=1, least=0)[0].hashes for t in parts]
        whole = P.kept(np.union1d(*hashes))
        got = P.merged(sketch(parts[0]), sketch(parts[1]))
        assert (got.hashes == whole.hashes[: len(got.hashes)]).all() and got.bound <= whole.bound
        assert got.bound >= P.SPACE // P.SHARE and len(got.hashes) >= np.searchsorted(whole.hashes, np.uint64(P.SPACE // P.SHARE))
        back = P.Sketch.parsed(got.text())
        assert (back.hashes == got.hashes).all() and back.bound == got.bound
    assert sketch("").text() == sketch(" \n").text() and sketch("A B").text() == sketch("a  b").text() != sketch("a c").text()
