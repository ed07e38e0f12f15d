"""Tries of rebuilt conversations against a plain model."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from quire.llm.prefixtrie import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, depth int, key string"


def model(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 9, c - c % 5
        turns = own[c] if c == base else own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, ms in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(ms) - 1) * len(k[-1][1].encode()) if k else 0
    sha = lambda k: hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()
    return Counter((ms[0], len(k), members[k[:-1]][0] if k else None, len(ms), children[k], leaves[k], saved[k], sha(k)) for k, ms in members.items())


def made(seed, n, longest):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-20, 3 * n), n):
        for t in range(r.choice([1, 2, 3, 5, 12, longest])):
            rows.append((c, t, r.choice(["user", "user", None]), r.choice(["a", "a", "é", "", None]), 7, "k"))
    return rows


@pytest.mark.parametrize("shard_rows", [3, 40, 25_000])
def test_against_the_model(spark, shard_rows):
    rows = made(shard_rows, 150, 20) + [(None, 0, "user", "a", 1, "k"), (7777, None, "user", "z", 1, "k")]
    found = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), shard_rows=shard_rows)
    assert Counter(tuple(r) for r in found.collect()) == model(rows)


def test_conversations_of_several_segments(spark):
    """Copies of a long conversation, one that leaves it late, and one of just two segments."""
    long = [("user", f"t{i}") for i in range(300)]
    talks = {0: long, 5: long, 10: long[:200] + [("x", "y")], 15: long[:128], 20: long[:64], 25: long[:65], 31: [("user", "t0")], 33: []}
    rows = [(c, i, a, b, 0, "") for c, ts in talks.items() for i, (a, b) in enumerate(ts)]
    for shard_rows in (2, 1000):
        found = prefix_trie(spark.createDataFrame(rows, SCHEMA), shard_rows=shard_rows)
        assert Counter(tuple(r) for r in found.collect()) == model(rows)


def test_repeated_rows_and_a_crowd(spark):
    """A repeated turn is a turn of its own; a third of the conversations are the same."""
    rows = made(5, 60, 6)
    rows += rows[:20]
    rows += [(1000 + c, t, "user", "same", 0, "") for c in range(200) for t in range(3)]
    found = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4), shard_rows=20)
    assert Counter(tuple(r) for r in found.collect()) == model(rows)


def test_nothing(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 0, "user", "a", 0, "")], SCHEMA)).collect() == []
