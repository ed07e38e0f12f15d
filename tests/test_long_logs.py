"""Logs folded in segments against the fold from end to end."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_streams import logged, made

from quire.operators import edits as E
from quire.operators import longlogs as L


def whole(rows, history=100, burst_ms=600):
    d = E.Document(history, burst_ms)
    for _, _, ms, action, key, page, payload in rows:
        d.apply(action, ms, key, page, payload)
    return d


def in_segments(rows, cuts, history, burst_ms=600):
    """The same by ``Segment``, ``verdicts``, ``net_effect`` and ``put_together``, without Spark."""
    parts, summaries = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])], []
    for k, part in enumerate(parts):
        s = L.Segment(burst_ms)
        for pos, (_, _, ms, action, key, _, payload) in enumerate(part):
            s.take(pos, action, ms, key, payload)
        if part:
            summaries.append((k, json.loads(s.summary(history))))
    met, past, future, seed = L.verdicts(summaries, history, burst_ms)
    nets = {}
    for k, v in met:
        if not v["dead"]:
            given = [(pos, action, ms, key, page, payload) for pos, (_, _, ms, action, key, page, payload) in enumerate(parts[k])]
            for _, kind, key, part, net, on_page, anchor in L.net_effect(given, v, history, burst_ms).rows(1, k):
                nets.setdefault((kind, key), []).append((part, net, on_page, anchor))
    gone = {(on_page, part) for (kind, _), ns in nets.items() if kind == "deleted" for part, _, on_page, _ in ns}
    out = {}
    if seed is not None:
        nets.setdefault(("order", ""), []).insert(0, (-1, json.dumps({"seed": seed}), None, False))
    for (kind, key), ns in nets.items():
        if kind != "deleted":
            marked = []
            for i, (part, net, on_page, anchor) in enumerate(ns):
                end = next((p for p, _, _, a in ns[i + 1 :] if a), 10**9)
                marked.append((json.loads(net), anchor and any(q == on_page and part < p < end for q, p in gone)))
            found = L.put_together(kind, marked)
            if found:
                out[kind, key] = found
    return out, past, future


@pytest.mark.parametrize("history", [1, 3, 100])
def test_any_cut_gives_the_same(history):
    for seed in range(250):
        r = random.Random(seed)
        rows = made(seed, r.choice([5, 40, 120]), 1)
        cuts = sorted(r.randint(0, len(rows)) for _ in range(r.choice([1, 4, 15])))
        d = whole(rows, history)
        got, past, future = in_segments(rows, cuts, history)
        want = {(kind, key): (place, json.loads(value)) for _, kind, key, place, value, *_ in d.rows(1) if kind != "empty"}
        assert (past, future) == d.counts(), seed
        assert got == want, seed


def test_deep_undos_over_segments():
    """Runs of undos and redos that dig through several segments and the limit of versions."""
    for seed in range(120):
        r, rows = random.Random(1000 + seed), []
        for i in range(300):
            rows += [(0, len(rows) + k, 10_000 * (len(rows) + k), action, r.choice("ab"), 0, json.dumps({"v": len(rows) + k})) for action in [r.choice(["add", "update", "undo", "undo", "redo", "delete"])] for k in range(r.choice([1, 1, 5, 12]))]
        rows = rows[:400]
        d = whole(rows, 7)
        got, past, future = in_segments(rows, list(range(11, 400, 11)), 7)
        assert (past, future) == d.counts() and got == {(kind, key): (place, json.loads(value)) for _, kind, key, place, value, *_ in d.rows(1) if kind != "empty"}


def test_against_the_fold_of_whole_logs(spark):
    rows = made(2, 900, 2) + [(9, 5000, 5, "undo", None, None, None), (8, 5001, 7, "seed_order", None, None, '{"pages": 2}')]
    log = logged(spark, rows).repartition(5)
    got = L.fold_long_logs(log, segment_rows=20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.fold_edits(log).collect()))
    assert got.dtypes == E.fold_edits(log).dtypes
    assert L.fold_long_logs(logged(spark, [])).count() == 0


def test_one_document_takes_many_tasks(spark):
    """No task sees more than its share of a log that is all of one document."""
    n = 60_000
    log = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("seq"), F.timestamp_millis(F.col("id") * 1000).alias("ts"), F.when(F.col("id") % 5 == 4, "undo").otherwise("add").alias("action"), (F.col("id") % 700).cast("string").alias("edit_id"), F.lit(0).alias("page"), F.to_json(F.struct(F.col("id").alias("v"))).alias("payload"))
    folder = set()
    keep = L.kept
    try:
        L.kept = lambda df, name: folder.add((name, out := keep(df, name))) or out
        got = L.fold_long_logs(log, segment_rows=4000)
    finally:
        L.kept = keep
    marked = next(df for name, df in folder if name == "log")
    sizes = [r["count"] for r in marked.where("summary is null").groupBy("part").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 10_000
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.fold_edits(log).collect()))


def test_short_segments_share_tasks(spark, monkeypatch):
    """Two hundred segments of one document take no more tasks than their actions ask for."""
    kept, rows = {}, made(11, 2000, docs=1)

    def noting(df, name):
        kept[name] = plain(df, name)
        return kept[name]

    plain = L.kept
    monkeypatch.setattr(L, "kept", noting)
    log = logged(spark, rows).localCheckpoint()
    got = L.fold_long_logs(log, segment_rows=10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.fold_edits(log).collect()))
    assert kept["log"].where("summary is not null").count() >= 200
    assert len(kept["log"].inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
