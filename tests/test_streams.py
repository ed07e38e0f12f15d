"""Streams against the batch fold, over restarts, repeated batches and timers."""

import json
import random
import zlib

import pandas as pd
from pyspark.sql import functions as F

from quire.operators import edits as E
from quire.streaming import states as S

LOG = "doc_id long, seq long, ms long, action string, edit_id string, page int, payload string"


def made(seed, n, docs=3):
    """All actions, most of them updates; the count of pages comes early or late."""
    r, ms, rows = random.Random(seed), 0, []
    for i in range(n):
        action = r.choice(["add", "update", "update", "update", "delete", "undo", "undo", "redo", "set_page_op", "rotate", "set_page_order", "delete_page", "seed_order", "add", "open" if r.random() < 0.2 else "update"])
        ms += r.choice([1, 100, 599, 600, 900])
        page, key = r.randint(0, 3), r.choice("abcde")
        given = {"add": {"v": i}, "update": r.choice([{"v": i}, {"w": i, "page": page}, {}]), "set_page_op": r.choice([{"rotation": 90 * page}, {"crop": i}]), "rotate": r.choice([{}, {"delta": -90}]), "set_page_order": [2, 0, 1][: page + 1], "seed_order": {"pages": 4}}.get(action)
        rows.append((r.randrange(docs), i, ms, action, key if action in ("add", "update", "delete") else None, page if action in ("add", "set_page_op", "rotate", "delete_page") else None, json.dumps(given) if given is not None else None))
    return rows


def logged(spark, rows):
    return spark.createDataFrame(rows, LOG).withColumn("ts", F.timestamp_millis("ms")).drop("ms")


def test_edits_over_a_restart(spark, tmp_path):
    rows = made(1, 400)
    changes, stored = [], str(tmp_path / "in")
    for k in range(4):  # the query is stopped and started again between the parts of the log
        logged(spark, rows[k * 100 : k * 100 + 100]).coalesce(1).write.mode("append").parquet(stored)
        stream = spark.readStream.schema(logged(spark, []).schema).parquet(stored)
        q = S.stream_edits(stream).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        changes.append(spark.read.parquet(str(tmp_path / "out")).count())
    got = S.latest(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.fold_edits(logged(spark, rows)).collect()))


def test_a_trigger_writes_what_it_changes():
    """Puts to the state of a document with 1,000 edits: an update makes three, whatever the size."""

    class Counting(E.Memory):
        puts = 0

        def put(self, table, key, value):
            Counting.puts += 1
            super().put(table, key, value)

    d = E.Document(store=Counting())
    for i in range(1000):
        d.apply("add", i, str(i), 0, "{}")
    d.changes(1)
    Counting.puts = 0
    d.apply("update", 5000, "7", None, '{"v": 1}')
    assert Counting.puts == 3 and [c[1:3] for c in d.changes(1)] == [("document", ""), ("edit", "7")]
    Counting.puts = 0
    d.apply("update", 5100, "7", None, '{"v": 2}')
    d.apply("undo", 9000, None, None, None)
    assert Counting.puts == 3 and d.value("edit", "7")[1] == {"page": 0}


def alert_events(spark, tmp_path, batches):
    schema = "owner string, id string, variant string, message string, ts timestamp, sticky boolean, duration_ms long"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = S.stream_alerts(stream).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    for rows in batches:
        df = spark.createDataFrame(rows, "owner string, id string, variant string, message string, s double, sticky boolean, duration_ms long")
        df.select("owner", "id", "variant", "message", F.timestamp_millis((F.col("s") * 1000 + 1_000_000).cast("long")).alias("ts"), "sticky", "duration_ms").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    events = {}
    for owner, i, event, _, message in map(tuple, spark.table("alerts").collect()):
        events.setdefault((owner, i), []).append((event, message))
    return events


def test_alerts_end_when_they_were_told_to(spark, tmp_path):
    show = lambda i, variant, at, sticky=False, ms=None, owner="o": (owner, i, variant, i.upper(), float(at), sticky, ms)
    patch = lambda i, text, at: ("o", i, "patch", text, float(at), False, None)
    batches = [
        [show("a", "error", 0), show("b", "info", 0), show("c", "info", 0, True), show("d", "info", 0, ms=60_000), show("a", "info", 0, owner="p")],
        [patch("a", "A2", 2), patch("c", "C2", 2), patch("none", "x", 2), show("z", "info", 3, owner="p")],
        [patch("a", None, 4.5)], [show("e", "info", 4.9)], [show("f", "info", 5.2, owner="p")],  # a's five seconds are over now, whatever patched it
        [patch("a", "late", 6)], [("o", "c", "dismiss", "", 10.0, False, None)], [show("g", "info", 20, owner="p")], [show("h", "info", 21, owner="p")],
    ]
    events = alert_events(spark, tmp_path, batches)
    assert events["o", "a"] == [("shown", "A"), ("patched", "A2"), ("patched", "A2"), ("expired", "A2")]
    assert events["o", "b"] == [("shown", "B"), ("expired", "B")] and events["p", "a"] == [("shown", "A"), ("expired", "A")]
    assert events["o", "c"] == [("shown", "C"), ("patched", "C2"), ("dismissed", "C2")]  # a patch makes nothing end
    assert events["o", "d"] == [("shown", "D")] and events["o", "e"] == [("shown", "E"), ("expired", "E")]
    assert ("o", "none") not in events and events["p", "f"] == [("shown", "F"), ("expired", "F")]


class Calls:
    """State and timers of one key, with the calls to them counted."""

    def __init__(self):
        self.n, self.timers, self.states = 0, set(), {}

    def state(self, name, *_):
        calls, held = self, self.states.setdefault(name, {})

        class State:
            def __getattr__(self, op):
                def call(key=None, value=None):
                    calls.n += 1
                    return {"exists": lambda: bool(held), "containsKey": lambda: key in held, "getValue": lambda: held.get(key), "get": lambda: held.get(None), "keys": lambda: list(held), "iterator": lambda: list(held.items()),
                        "updateValue": lambda: held.update({key: value}), "update": lambda: held.update({None: key}), "removeKey": lambda: held.pop(key, None)}[op]()

                return call

        return State()

    getMapState = getValueState = state

    def registerTimer(self, at):
        self.n += 1
        self.timers.add(at)


def test_many_edits_of_a_document():
    """2,000 actions in fifty triggers, over some hundred edits: state is asked for cells and not
    for each edit and version, and what changes adds up to the document."""
    calls, whole, held, r = Calls(), E.Document(), {}, random.Random(5)
    p = S.EditState(100, 600)
    p.init(calls)
    rows = [(7, i, ms, action, str(r.randrange(200)) if edit else None, page, payload) for _, i, ms, action, edit, page, payload in made(3, 2000, docs=1)]
    rows = [x for x in rows if x[3] not in ("delete_page", "open") or x[1] % 5 == 0]
    for k in range(0, len(rows), 40):
        given = pd.DataFrame(rows[k : k + 40], columns=["doc_id", "seq", "ms", "action", "edit_id", "page", "payload"])
        given["ts"], given["doc"] = pd.to_datetime(given["ms"], unit="ms"), given["doc_id"].astype(str)
        for frame in p.handleInputRows((7,), iter([given]), None):
            for doc, kind, key, place, value, past, future, _ in frame.itertuples(index=False):
                held[kind, key] = (doc, kind, key, place, value, past, future)
    for _, _, ms, action, edit, page, payload in rows:
        whole.apply(action, ms, edit, page, payload)
    depths = held.pop(("document", ""))[5:]
    assert sorted((*v[:5], *depths) for v in held.values() if v[4] is not None) == sorted(whole.rows(7))
    assert calls.n < len(rows)


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_many_alerts_of_one_owner():
    """3,000 alerts come in thirty triggers: state is asked for cells and not for each alert, and
    every alert ends in the trigger in which it should."""
    calls, r, alive, want, got = Calls(), random.Random(2), {}, [], []
    p = S.AlertState(5000, 2500)
    p.init(calls)
    for step in range(30):
        now = max(0, step * 1000 - 500)
        rows = [("o", str(r.randrange(4000)), r.choice(["error", "info", "info", "dismiss", "patch"]), f"m{step}", step * 1000 + i, i % 9 == 0, r.choice([None, 700, 40_000])) for i in range(100)]
        given = pd.DataFrame(rows, columns=["owner", "id", "variant", "message", "ms", "sticky", "duration_ms"])
        given["ts"], given["code"] = pd.to_datetime(given["ms"], unit="ms"), [zlib.crc32(i.encode()) for i in given["id"]]
        for _, i, variant, message, ms, sticky, duration in rows:
            if variant == "dismiss" and i in alive:
                want.append((step, i, "dismissed", *alive.pop(i)[1:]))
            elif variant != "dismiss" and i in alive:
                alive[i] = (*alive[i][:2], message)
                want.append((step, i, "patched", *alive[i][1:]))
            elif variant not in ("dismiss", "patch"):
                alive[i] = (None if sticky else max(now + 1, ms + (duration or (5000 if variant == "error" else 2500))), variant, message)
                want.append((step, i, "shown", variant, message))
        for i in [i for i, a in alive.items() if a[0] is not None and a[0] <= now]:
            want.append((step, i, "expired", *alive.pop(i)[1:]))
        found = list(p.handleInputRows(("o",), iter([given]), Now(now)))
        for at in sorted(t for t in calls.timers if t <= now):
            timer = Now(at)
            found += list(p.handleExpiredTimer(("o",), Now(now), timer))
            calls.timers.discard(at)
        got += [(step, *row[1:]) for f in found for row in f.itertuples(index=False)]
    assert sorted(got) == sorted(want) and len([w for w in want if w[2] == "expired"]) > 500
    assert calls.n < 6000


def test_pages_of_cancelled_documents(spark, tmp_path):
    pages = "doc_id long, page int, error string, truncated boolean"
    stopped, out, stored = str(tmp_path / "stopped"), str(tmp_path / "out"), str(tmp_path / "in")
    spark.createDataFrame([], "doc_id long").write.parquet(stopped)
    put = S.page_sink(out, lambda session: session.read.schema("doc_id long").parquet(stopped))
    seen = {}

    def keep(batch, number):
        seen[number] = batch.collect()
        put(batch, number)

    for k in range(3):
        spark.createDataFrame([(d, k, "bad" if (d, k) == (1, 0) else None, False) for d in range(4)], pages).coalesce(1).write.mode("append").parquet(stored)
        q = spark.readStream.schema(pages).parquet(stored).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        if k == 0:
            spark.createDataFrame([(2,), (2,)], "doc_id long").write.mode("append").parquet(stopped)
    found = spark.read.parquet(out)
    assert sorted((r["doc_id"], r["page"]) for r in found.collect()) == sorted((d, k) for d in range(4) for k in range(3) if d != 2 or k == 0)
    put(spark.createDataFrame(seen[1], pages), 1)  # the batch is repeated after its commit was lost
    assert spark.read.parquet(out).count() == 10
    report = {r["doc_id"]: (r["done"], r["failed"]) for r in S.page_progress(spark.read.parquet(out)).collect()}
    assert report == {0: (3, 0), 1: (2, 1), 2: (1, 0), 3: (3, 0)}
