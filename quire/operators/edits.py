"""Folding an edit log into the current state of each document."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.runs import STYLE
from quire.schemas import STYLED_RUN

STATE = "doc_id long, kind string, key string, place long, value string, past int, future int"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
_NAMES = ["doc_id", "kind", "key", "place", "value", "past", "future"]


class Memory:
    """A document's tables in dictionaries."""

    def __init__(self):
        self.maps: dict[str, dict] = {"edit": {}, "page_op": {}, "order": {}, "version": {}}

    def get(self, table: str, key: str):
        return self.maps[table].get(key)

    def put(self, table: str, key: str, value) -> None:
        if value is None:
            self.maps[table].pop(key, None)
        else:
            self.maps[table][key] = value

    def items(self, table: str) -> list[tuple]:
        return list(self.maps[table].items())


@dataclass
class Marks:
    """Of the versions numbered from 0, [low, mid) can be undone and [mid, high) redone.
    ``next`` counts what was given a place, ``at`` all actions; ``seed`` is the number of pages."""

    low: int = 0
    mid: int = 0
    high: int = 0
    next: int = 0
    at: int = 0
    burst_id: str | None = None
    burst_ms: int | None = None
    seed: int | None = None


class Document:
    """Edits, page operations and page order of one document, with undo and redo.

    Tables lie in a store, by key; a version holds only what it changed, as [table, key, before,
    after], so that each action writes as much as it changes and at most ``history`` versions are
    kept. The page order is a list, or what was taken from the pages that ``seed_order`` counts:
    the count holds for all versions, and pages that were deleted before it came stay away."""

    def __init__(self, history: int = 100, burst_ms: int = 600, store=None, marks: Marks | None = None):
        self.history, self.burst_ms = max(1, history), burst_ms
        self.store, self.marks = store or Memory(), marks or Marks()
        self.touched: set[tuple[str, str]] = set()

    def _put(self, table: str, key: str, value) -> None:
        self.store.put(table, key, value)
        self.touched.add((table, key))

    def _commit(self, changes: list, joined: bool = False) -> None:
        m = self.marks
        for table, key, _, after in changes:
            self._put(table, key, after)
        if joined:  # an update of the edit that the last version updates
            last = self.store.get("version", str(m.mid - 1))
            old = {(t, k): before for t, k, before, _ in last}
            fresh = [[t, k, old.get((t, k), before), after] for t, k, before, after in changes]
            self.store.put("version", str(m.mid - 1), [x for x in last if (x[0], x[1]) not in {(c[0], c[1]) for c in changes}] + fresh)
            return
        for k in range(m.mid, m.high):
            self.store.put("version", str(k), None)
        self.store.put("version", str(m.mid), changes)
        m.mid += 1
        m.high = m.mid
        if m.mid - m.low > self.history:
            self.store.put("version", str(m.low), None)
            m.low += 1

    def _step(self, k: int, undo: bool) -> None:
        for table, key, before, after in self.store.get("version", str(k)):
            self._put(table, key, before if undo else after)

    def apply(self, action: str, ts_ms: int, edit_id: str | None, page: int | None, payload: str | None) -> None:
        given = json.loads(payload) if payload else {}
        m, get = self.marks, self.store.get
        m.at += 1
        joined = action == "update" and m.burst_ms is not None and m.burst_id == edit_id and ts_ms - m.burst_ms < self.burst_ms and m.mid > m.low
        if action != "seed_order":
            m.burst_id, m.burst_ms = (edit_id, ts_ms) if action == "update" else (None, None)
        if action == "open":
            for table in ("edit", "page_op", "order", "version"):
                for key, _ in self.store.items(table):
                    self.store.put(table, key, None)
                    if table != "version":
                        self.touched.add((table, key))
            self.touched.add(("order", ""))
            self.marks = Marks(at=m.at)
        elif action == "undo":
            if m.mid > m.low:
                m.mid -= 1
                self._step(m.mid, True)
        elif action == "redo":
            if m.mid < m.high:
                self._step(m.mid, False)
                m.mid += 1
        elif action == "add":
            m.next += 1
            self._commit([["edit", edit_id, get("edit", edit_id), [m.next, {"page": page, **given}]]])
        elif action == "update":
            old = get("edit", edit_id)
            self._commit([["edit", edit_id, old, [old[0], {**old[1], **given}]]] if old else [], joined)
        elif action == "delete":
            old = get("edit", edit_id)
            self._commit([["edit", edit_id, old, None]] if old else [])
        elif action in ("set_page_op", "rotate"):
            m.next += 1
            old = get("page_op", str(page))
            before = old[1] if old else {"rotation": 0}
            change = given if action == "set_page_op" else {"rotation": before.get("rotation", 0) + given.get("delta", 90)}
            self._commit([["page_op", str(page), old, [m.next, {**before, **change}]]])
        elif action == "set_page_order":
            self._commit([["order", "", get("order", ""), {"list": list(given)}]])
        elif action == "delete_page":
            gone = [["edit", k, v, None] for k, v in self.store.items("edit") if v[1].get("page") == page] if page is not None else []
            op, order = get("page_op", str(page)), get("order", "")
            gone += [["page_op", str(page), op, None]] if op and page is not None else []
            self._commit([*gone, ["order", "", order, without_page(order, page)]] if page is not None else [])
        elif action == "seed_order" and m.seed is None:
            m.seed = int(given.get("pages", 0))
            self.touched.add(("order", ""))

    def value(self, table: str, key: str) -> tuple[int, object] | None:
        """Place and value of a row, None if there is none."""
        found = self.store.get(table, key)
        if table != "order":
            return tuple(found) if found else None
        order = order_of(found, self.marks.seed)
        return None if order is None else (0, order)

    def counts(self) -> tuple[int, int]:
        return self.marks.mid - self.marks.low, self.marks.high - self.marks.mid

    def rows(self, doc_id) -> list[tuple]:
        keys = [(t, k) for t in ("edit", "page_op") for k, _ in self.store.items(t)] + [("order", "")]
        held = [(t, k, self.value(t, k)) for t, k in keys]
        found = [(doc_id, t, k, v[0], json.dumps(v[1], sort_keys=True), *self.counts()) for t, k, v in held if v]
        return found or [(doc_id, "empty", "", 0, "{}", *self.counts())]

    def changes(self, doc_id) -> list[tuple]:
        """The rows touched since the last call, without a value those that went; the document's
        own row comes first, with the number of actions behind it in each."""
        out = [(doc_id, "document", "", 0, "{}", *self.counts(), self.marks.at)]
        for table, key in sorted(self.touched):
            v = self.value(table, key)
            out.append((doc_id, table, key, v[0] if v else 0, json.dumps(v[1], sort_keys=True) if v else None, *self.counts(), self.marks.at))
        self.touched.clear()
        return out


def without_page(order: dict | None, page: int) -> dict:
    """An order without a page."""
    if order and "list" in order:
        return {"list": [p for p in order["list"] if p != page]}
    return {"minus": sorted({*(order or {}).get("minus", []), page})}


def order_of(order: dict | None, seed: int | None) -> list | None:
    """The pages in order, None while neither an order nor a count is known."""
    if order and "list" in order:
        return order["list"]
    if seed is None:
        return None
    gone = set((order or {}).get("minus", []))
    return [p for p in range(seed) if p not in gone]


def fold_edits(log: DataFrame, history: int = 100, burst_ms: int = 600) -> DataFrame:
    """(doc_id, kind, key, place, value, past, future) after each document's whole log, in
    order of (ts, seq). Logs are streamed in that order, so that memory holds one
    document's state, never its log."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, state, out = None, None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("doc_id", "action", "_ms", "edit_id", "page", "payload")]
            for d, *row in zip(*columns):
                if state is None or d != doc:
                    if state is not None:
                        out += state.rows(doc)
                    doc, state = d, Document(history, burst_ms)
                state.apply(*row)
            if len(out) > 10_000:
                yield batch()
        if state is not None:
            out += state.rows(doc)
        if out:
            yield batch()

    rows = log.select("doc_id", "action", F.unix_millis("ts").alias("_ms"), "edit_id", F.col("page").cast("int").alias("page"), "payload", "ts", "seq")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "ts", "seq").drop("ts", "seq").mapInArrow(run, STATE)


def edit_bursts(log: DataFrame, gap_ms: int = 600) -> DataFrame:
    """Adds ``burst``: an update less than ``gap_ms`` after an update of the same edit, with
    no other action between them, belongs to its burst."""
    w = Window.partitionBy("doc_id").orderBy("ts", "seq")
    near = F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(w)) < gap_ms
    same = (F.col("action") == "update") & (F.lag("action").over(w) == "update") & F.col("edit_id").eqNullSafe(F.lag("edit_id").over(w)) & near
    flagged = log.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int"))
    return flagged.withColumn("burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def with_edit_defaults(edits: DataFrame) -> DataFrame:
    """Missing fields of edits filled with the defaults of a new text box; its place and size
    have none."""
    fixed = {"font_size": 18.0, "font_family": "Helvetica", "color": "#111827", "align": "left", "bold": False, "italic": False, "origin": "added", "cover_color": "#ffffff"}
    filled = {c: F.coalesce(c, F.lit(v)) for c, v in fixed.items()}
    if "runs" in edits.columns:
        plain = F.array(F.struct(F.lit("Your text").alias("text"), *(F.lit(None).alias(k) for k in STYLE))).cast(f"array<{STYLED_RUN}>")
        filled["runs"] = F.coalesce("runs", plain)
    return edits.select(*((filled[c] if c in filled else F.col(c)).alias(c) for c in edits.columns))
