"""Streams of edits, alerts and recognised pages. Rows later than the watermark are left
out; the others are applied in order of their time within each trigger. State lies in RocksDB,
and a trigger writes what it changes, not what a key holds."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.edits import STATE, Document, Marks

#: What ``stream_edits`` gives: rows of ``fold_edits`` that changed, without a value those that
#: went, and ``at``, how many actions the document had seen then.
CHANGES = f"{STATE}, at long"
_DEFAULT = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_rocks(spark: SparkSession) -> None:
    """Sets the state store that state by key needs, unless the session has chosen one."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if (spark.conf.get(name, None) or _DEFAULT) == _DEFAULT:
        spark.conf.set(name, _ROCKS)


#: Entries that a cell of a document's tables, or of a bucket of alerts, holds, about.
CELL_ROWS = 64


class _Store:
    """A document's tables in cells, each an entry of a map state; versions that follow one another
    lie together. Cells double in number as rows do, so that one holds about ``CELL_ROWS`` of
    them whatever the document holds: a trigger reads and writes the cells that it touches once
    each. The first cell has the document's marks too."""

    def __init__(self, cells, doc: str | None):
        self.cells, self.doc, self.dirty = cells, doc, set()
        found = cells.getValue((doc, 0))
        self.n, self.held, marks, rows = json.loads(found[0]) if found else (1, 0, None, [])
        self.marks = Marks(**marks) if marks else Marks()
        self.read = {0: {(t, k): v for t, k, v in rows}}

    def _number(self, table: str, key: str) -> int:
        return (int(key) // 16 if table == "version" else zlib.crc32(f"{table} {key}".encode())) % self.n

    def _cell(self, number: int) -> dict:
        if number not in self.read:
            found = self.cells.getValue((self.doc, number))
            self.read[number] = {(t, k): v for t, k, v in json.loads(found[0])} if found else {}
        return self.read[number]

    def get(self, table: str, key: str):
        return self._cell(self._number(table, key)).get((table, key))

    def put(self, table: str, key: str, value) -> None:
        number = self._number(table, key)
        cell, n = self._cell(number), len(self._cell(number))
        if value is None and (table, key) not in cell:
            return
        if value is None:
            del cell[table, key]
        else:
            cell[table, key] = value
        self.held += len(cell) - n
        self.dirty.add(number)

    def items(self, table: str) -> list[tuple]:
        return [(k, v) for number in range(self.n) for (t, k), v in self._cell(number).items() if t == table]

    def save(self, marks: Marks) -> None:
        if self.held > CELL_ROWS * self.n:
            every = [x for number in range(self.n) for x in self._cell(number).items()]
            while self.held > CELL_ROWS * self.n:
                self.n *= 2
            self.read, self.dirty = {k: {} for k in range(self.n)}, set(range(self.n))
            for (table, key), v in every:
                self.read[self._number(table, key)][table, key] = v
        for number in sorted(self.dirty | {0}):
            rows = [[t, k, v] for (t, k), v in self.read[number].items()]
            if number == 0:
                rows = [self.n, self.held, vars(marks), rows]
            if rows:
                self.cells.updateValue((self.doc, number), (json.dumps(rows),))
            else:
                self.cells.removeKey((self.doc, number))


class EditState(StatefulProcessor):
    """The edits, page operations, order and versions of the documents of a bucket, each document
    in cells of its own."""

    def __init__(self, history: int, burst_ms: int):
        self.history, self.burst_ms = history, burst_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cell", "doc string, number int", "value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given, out = pd.concat(list(rows)).sort_values(["doc", "ts", "seq"], kind="stable"), []
        columns = [[None if pd.isna(v) else v for v in given[c].tolist()] for c in ("doc", "action", "ms", "edit_id", "page", "payload")]
        for name, log in groupby(zip(*columns), lambda r: r[0]):
            store = _Store(self.cells, name)
            doc = Document(self.history, self.burst_ms, store, store.marks)
            for _, action, ms, edit_id, page, payload in log:
                doc.apply(action, ms, edit_id, None if page is None else int(page), payload)
            changes = doc.changes(None if name is None else int(name))
            store.save(doc.marks)
            out += changes
            if len(out) > 10_000:
                yield self._frame(out)
                out = []
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGES.split(", ")])
        return found.assign(doc_id=pd.array([r[0] for r in rows], "Int64"))  # a null among them makes no fractions of the others

    def close(self) -> None:
        pass


def stream_edits(log: DataFrame, history: int = 100, burst_ms: int = 600, delay: str = "10 seconds", buckets: int = 1024) -> DataFrame:
    """What each trigger changes in the documents that it touches (``CHANGES``). Added up
    (``latest``), changes give what ``fold_edits`` gives for the whole log. Documents are dealt
    into ``buckets``, whose number a stream keeps."""
    on_rocks(log.sparkSession)
    doc, bucket = F.col("doc_id").cast("long"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(buckets))
    rows = log.select(bucket.alias("bucket"), doc.cast("string").alias("doc"), "seq", "ts", F.unix_millis("ts").alias("ms"), "action", "edit_id", "page", "payload").withWatermark("ts", delay)
    return rows.groupBy("bucket").transformWithStateInPandas(EditState(history, burst_ms), CHANGES, "Update", "None")


def latest(changes: DataFrame) -> DataFrame:
    """The state that a table of changes adds up to, as ``fold_edits`` gives it."""
    last = lambda *c: F.max_by(F.struct(*c), "at")
    rows = changes.where("kind <> 'document'").groupBy("doc_id", "kind", "key").agg(last("place", "value").alias("v")).where("v.value is not null")
    docs = changes.where("kind = 'document'").groupBy("doc_id").agg(last("past", "future").alias("n"))
    kind, key = F.coalesce("kind", F.lit("empty")), F.coalesce("key", F.lit(""))
    found = docs.join(rows, "doc_id", "left")
    return found.select("doc_id", kind.alias("kind"), key.alias("key"), F.coalesce("v.place", F.lit(0)).cast("long").alias("place"), F.coalesce("v.value", F.lit("{}")).alias("value"), "n.past", "n.future")


class AlertState(StatefulProcessor):
    """The alerts of a bucket of owners and ids in cells, each an entry of its own. Cells double in
    number as alerts do, so that one holds about ``CELL_ROWS`` of them whatever the bucket holds:
    a trigger reads and writes the cells that it touches once each. A cell has a timer for the
    alert that ends first."""

    def __init__(self, error_ms: int, other_ms: int, buckets: int = 1024):
        self.error_ms, self.other_ms, self.buckets = error_ms, other_ms, buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "cells int, held long")
        self.cells = handle.getMapState("cell", "number int", "value string")  # when its timer fires, and alerts
        self.due = handle.getMapState("due", "until long", "cells string")

    def _open(self) -> None:
        self.n, self.held = self.head.get() if self.head.exists() else (1, 0)
        self.before, self.read, self.dirty = (self.n, self.held), {}, set()

    def _cell(self, number: int) -> list:
        if number not in self.read:
            found = self.cells.getValue((number,)) if self.held else None
            at, rows = json.loads(found[0]) if found else (-1, [])
            self.read[number] = [at, {(owner, i): alert for owner, i, *alert in rows}]
        return self.read[number]

    def _save(self) -> None:
        if self.held > CELL_ROWS * self.n:
            every = [self._cell(k) for k in {*(k[0] for k in list(self.cells.keys())), *self.read}]
            while self.held > CELL_ROWS * self.n:
                self.n *= 2
            self.dirty, self.read = set(range(self.n)), {k: [-1, {}] for k in range(self.n)}
            for _, alerts in every:
                for k, alert in alerts.items():
                    self.read[alert[0] // self.buckets % self.n][1][k] = alert
        timers: dict[int, set[int]] = {}
        for k in sorted(self.dirty):
            cell = self.read[k]
            if not cell[1]:
                self.cells.removeKey((k,))
                continue
            first = min((alert[3] for alert in cell[1].values() if alert[3] >= 0), default=-1)
            if first >= 0 and (cell[0] < 0 or first < cell[0]):
                cell[0] = first
                timers.setdefault(first, set()).add(k)
            self.cells.updateValue((k,), (json.dumps([cell[0], [[*who, *alert] for who, alert in cell[1].items()]]),))
        for until, numbers in timers.items():
            found = self.due.getValue((until,))
            self.due.updateValue((until,), (json.dumps(sorted({*numbers, *(json.loads(found[0]) if found else [])})),))
            if not found:
                self.handle.registerTimer(until)
        if (self.n, self.held) != self.before:
            self.head.update((self.n, self.held))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, now = [], timerValues.getCurrentWatermarkInMs()
        self._open()
        given = pd.concat(list(rows)).sort_values("ts", kind="stable")
        for owner, i, variant, message, ms, sticky, duration, code in zip(*(given[c].tolist() for c in ("owner", "id", "variant", "message", "ms", "sticky", "duration_ms", "code"))):
            number = code // self.buckets % self.n
            alerts = self._cell(number)[1]
            held = alerts.get((owner, i))
            if variant == "dismiss":
                if held:
                    del alerts[owner, i]
                    self.held -= 1
                    self.dirty.add(number)
                    out.append((owner, i, "dismissed", held[1], held[2]))
            elif held:  # a patch changes the message; when and whether it ends was told when it came
                held[2] = held[2] if pd.isna(message) else message
                self.dirty.add(number)
                out.append((owner, i, "patched", held[1], held[2]))
            elif variant != "patch":
                until = -1
                if not sticky:
                    ttl = int(duration) if not pd.isna(duration) else self.error_ms if variant == "error" else self.other_ms
                    until = max(ms + ttl, now + 1)
                alerts[owner, i] = [code, variant, message, until]
                self.held += 1
                self.dirty.add(number)
                out.append((owner, i, "shown", variant, message))
        self._save()
        yield pd.DataFrame(out, columns=["owner", "id", "event", "variant", "message"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, now, at = [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        self._open()
        numbers = self.due.getValue((at,))
        for number in json.loads(numbers[0]) if numbers else []:
            cell = self._cell(number)
            if cell[0] != at:  # it was dealt anew, or another timer was sooner and has seen to it
                continue
            cell[0] = -1
            ended = [who for who, alert in cell[1].items() if 0 <= alert[3] <= now]
            for who in ended:
                _, variant, message, _ = cell[1].pop(who)
                out.append((*who, "expired", variant, message))
            self.held -= len(ended)
            self.dirty.add(number)
        self.due.removeKey((at,))
        self._save()
        if out:
            yield pd.DataFrame(out, columns=["owner", "id", "event", "variant", "message"])

    def close(self) -> None:
        pass


def stream_alerts(alerts: DataFrame, error_ms: int = 5000, other_ms: int = 2500, delay: str = "0 seconds", buckets: int = 1024) -> DataFrame:
    """(owner, id, event, variant, message) of alerts (owner, id, variant, message, ts, sticky,
    duration_ms): ``shown`` when an alert comes, ``patched`` when its id comes again (with the
    variant ``patch`` only then), ``dismissed`` by one of variant ``dismiss``, ``expired`` when
    event time passes the end that was set when it came. A patch moves no end, and a sticky
    alert has none. Owners and ids are dealt into ``buckets``, whose number a stream keeps."""
    on_rocks(alerts.sparkSession)
    rows = alerts.select("owner", "id", "variant", "message", "ts", F.unix_millis("ts").alias("ms"), F.coalesce("sticky", F.lit(False)).alias("sticky"), "duration_ms", F.xxhash64("owner", "id").alias("code"))
    rows = rows.withColumn("bucket", F.pmod("code", F.lit(buckets))).withWatermark("ts", delay)
    state = AlertState(error_ms, other_ms, buckets)
    return rows.groupBy("bucket").transformWithStateInPandas(state, "owner string, id string, event string, variant string, message string", "Append", "EventTime")


def page_progress(results: DataFrame) -> DataFrame:
    """Running counts of done, failed and truncated pages of each document of a stream."""
    ok = F.col("error").isNull()
    return results.groupBy("doc_id").agg(F.count_if(ok).alias("done"), F.count_if(~ok).alias("failed"), F.count_if("truncated").alias("truncated"))


def page_sink(path: str, cancelled: Callable[[SparkSession], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of a stream of recognised pages: each batch is a folder of the table
    at ``path``, named by its number, so that one that is repeated replaces itself. Pages of
    documents that ``cancelled`` lists (doc_id), asked anew for each batch, are left out; what
    was written before a document was cancelled stays."""

    def put(batch: DataFrame, number: int) -> None:
        stopped = cancelled(batch.sparkSession).select("doc_id").distinct()
        batch.join(stopped, "doc_id", "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put
