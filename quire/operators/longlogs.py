"""Edit logs of any length: the log of one document is cut into segments, which are folded side
by side and then put together.

A segment is told by what it does to the versions on its left: how many of them it undoes at
most, how many stay below its own, and how many of its own are left at its end. These summaries,
some numbers for each segment, are walked through in order, which tells for each segment what it
met and which of its versions are in force in the end. With that a segment is folded into the net
effect of what is in force on each edit, page operation and the order; net effects of one key
are put together in order, whatever the number of keys.

Pages that are deleted reach all edits that lie on them, also those that a segment does not
name: they are looked up by page between the places where an edit is put on a page."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.edits import STATE, order_of, without_page
from quire.sources.shared import kept

#: Actions that a segment has, and actions that a task reads, about: a task cuts them into segments.
SEGMENT_ROWS, TASK_ROWS = 50_000, 200_000
#: Segments are numbered by their task and, within it, in order.
_TASK = 1 << 32
_PLACED = ("add", "set_page_op", "rotate")

_LOG = [("doc_id", pa.int64(), "long"), ("part", pa.int64(), "long"), ("pos", pa.int64(), "long"), ("action", pa.string(), "string"), ("ms", pa.int64(), "long"), ("edit_id", pa.string(), "string"), ("page", pa.int32(), "int"), ("payload", pa.string(), "string"), ("summary", pa.string(), "string")]
_VERDICT = [("doc_id", pa.int64(), "long"), ("part", pa.int64(), "long"), ("verdict", pa.string(), "string"), ("past", pa.int32(), "int"), ("future", pa.int32(), "int"), ("seed", pa.int64(), "long")]
_NET = [("doc_id", pa.int64(), "long"), ("kind", pa.string(), "string"), ("key", pa.string(), "string"), ("part", pa.int64(), "long"), ("net", pa.string(), "string"), ("on_page", pa.int64(), "long"), ("anchor", pa.bool_(), "boolean")]


def _ddl(fields: list[tuple]) -> str:
    return ", ".join(f"{n} {k}" for n, _, k in fields)


def _batch(fields: list[tuple], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k, _) in zip(columns, fields)], names=[f[0] for f in fields])


# ---- what a segment does to versions


def walk(codes: str, past: int, history: int) -> tuple[int, int, int, int, int]:
    """Commits (c), undos (u) and redos (r), the first of them a commit, with ``past`` versions
    on the left. Relative to ``past``: how many versions on the left stay below the segment's
    own, the own ones, the place of the newest one in force, the oldest that can be undone (not
    relative), and how far below ``past`` the walk went."""
    below = mid = least = past
    low, high = 0, past
    for c in codes:
        if c == "c":
            below = min(below, mid)
            mid += 1
            high = mid
            low = max(low, mid - history)
        elif c == "u":
            if mid > low:
                mid -= 1
                least = min(least, mid)
        elif c == "r" and mid < high:
            mid += 1
    return below - past, high - below, mid - past, low, past - least


def outcome(codes: str, history: int) -> dict:
    """What a segment does, whatever it meets: ``pre`` before its first commit, ``any`` where
    enough versions are on the left, and ``few`` for each smaller number of them."""
    first = codes.find("c")
    pre = [c for c in (codes if first < 0 else codes[:first]) if c in "ur"]
    if first < 0:
        return {"pre": "".join(pre), "any": None, "few": []}
    below, own, mid, low, dug = walk(codes[first:], history, history)
    return {"pre": "".join(pre), "any": [below, own, mid, low - history], "few": [walk(codes[first:], p, history)[:4] for p in range(dug)]}


class Segment:
    """The codes of a segment as its actions come; what lies before an ``open`` is forgotten."""

    def __init__(self, burst_ms: int):
        self.burst_ms, self.opened = burst_ms, -1
        self.clear()
        self.acted = False  # whether an action other than a count of pages has come

    def clear(self) -> None:
        self.codes: list[str] = []
        self.first: tuple | None = None  # an update that may belong to a burst on the left
        self.last: tuple | None = None  # the last action, if it is an update
        self.places, self.seed = 0, None

    def take(self, pos: int, action: str, ms: int, edit_id: str | None, payload: str | None) -> None:
        self.places += action in _PLACED
        if action == "open":
            self.clear()
            self.opened, self.acted = pos, True
        elif action == "seed_order":
            if self.seed is None:
                self.seed = int((json.loads(payload) if payload else {}).get("pages", 0))
        else:
            joined = action == "update" and self.last is not None and self.last[0] == edit_id and ms - self.last[1] < self.burst_ms
            if action == "update" and not self.acted:
                self.first = (edit_id, ms)
                self.codes.append("?")
            else:
                self.codes.append({"undo": "u", "redo": "r"}.get(action, "j" if joined else "c"))
            self.last = (edit_id, ms) if action == "update" else None
            self.acted = True

    def summary(self, history: int) -> str:
        codes = "".join(self.codes)
        ways = [outcome(codes.replace("?", "c"), history)] + ([outcome(codes.replace("?", "j"), history)] if self.first else [])
        return json.dumps({"opened": self.opened, "acted": self.acted, "first": self.first, "last": self.last, "places": self.places, "seed": self.seed, "ways": ways})


def verdicts(summaries: list[tuple[int, dict]], history: int, burst_ms: int) -> tuple[list[tuple[int, dict]], int, int, int | None]:
    """For each segment (part, summary) of a document, in order, what it met and how much of it
    is in force in the end; then the depths of both stacks and the count of pages."""
    low = mid = high = places = 0
    last, seed, met = None, None, []
    own: list[list] = []  # stretches of versions by segment: [index in met, start, end]
    hooks: list[tuple[int, int]] = []  # joined updates: (index in met, the version that they belong to)
    for part, s in summaries:
        if s["opened"] >= 0:
            low = mid = high = places = 0
            last, seed, own, hooks = None, None, [], []
            for v in met:
                v[1]["dead"] = True
        joined = bool(s["first"] and last and last[0] == s["first"][0] and s["first"][1] - last[1] < burst_ms and mid > low)
        met.append((part, {"dead": False, "opened": s["opened"], "joined": joined, "past": mid - low, "future": high - mid, "places": places, "kept": 0, "hook": False}))
        if joined:
            hooks.append((len(met) - 1, mid - 1))
        way = s["ways"][1 if joined else 0]
        for c in way["pre"]:
            mid = max(low, mid - 1) if c == "u" else min(high, mid + 1)
        if way["any"]:
            past = mid - low
            below, n, end, oldest = way["few"][past] if past < len(way["few"]) else way["any"]
            oldest = oldest if past < len(way["few"]) else max(0, past + oldest)
            cut = mid + below
            while own and own[-1][1] >= cut:
                own.pop()
            if own:
                own[-1][2] = min(own[-1][2], cut)
            while hooks and hooks[-1][1] >= cut:
                hooks.pop()
            own.append([len(met) - 1, cut, cut + n])
            low, mid, high = low + oldest, mid + end, cut + n
        places += s["places"]
        seed = s["seed"] if seed is None else seed
        last = s["last"] if s["acted"] else last
    for i, start, end in own:
        met[i][1]["kept"] = max(0, min(end, mid) - start)
    for i, slot in hooks:
        met[i][1]["hook"] = slot < mid
    return met, mid - low, high - mid, seed


# ---- what a segment does to each key


class Net:
    """The net effect of a segment's actions in force, by key."""

    def __init__(self):
        self.edits: dict[str, dict] = {}
        self.ops: dict[str, dict] = {}
        self.order: dict | None = None
        self.deleted: dict[int, int] = {}  # when a page was deleted last
        self.now = 0

    def _gone(self, page, since: int) -> bool:
        return not isinstance(page, (list, dict)) and self.deleted.get(page, -1) > since

    def _edit(self, key: str) -> dict | None:
        """The entry of an edit, after the deletion of the page that it was put on here."""
        e = self.edits.get(key)
        if e and "since" in e and e["value"] is not None and self._gone(e["value"].get("page"), e["since"]):
            e = self.edits[key] = {"set": True, "place": 0, "value": None}
        return e

    def take(self, action: str, edit_id: str | None, page: int | None, payload: str | None, place: int) -> None:
        given = json.loads(payload) if payload else {}
        self.now += 1
        if action == "add":
            self.edits[edit_id] = {"set": True, "place": place, "value": {"page": page, **given}, "since": self.now}
        elif action == "delete":
            self.edits[edit_id] = {"set": True, "place": 0, "value": None}
        elif action == "update":
            e = self._edit(edit_id) or self.edits.setdefault(edit_id, {"set": False, "value": {}})
            if e["value"] is not None:
                if "page" in given:
                    if not e["set"] and "since" not in e:
                        e["not_on"] = sorted(self.deleted)  # where the edit must not have been before
                    e["since"] = self.now
                e["value"].update(given)
        elif action in ("set_page_op", "rotate"):
            o = self.ops.setdefault(str(page), {"set": False, "value": {}, "turn": 0})
            o["place"] = place
            if o["set"]:
                o["value"] = o["value"] or {"rotation": 0}
            if action == "set_page_op":
                o["value"].update(given)
                o["turn"] = 0 if "rotation" in given else o["turn"]
            elif "rotation" in o["value"] or o["set"]:
                o["value"]["rotation"] = o["value"].get("rotation", 0) + given.get("delta", 90)
            else:
                o["turn"] += given.get("delta", 90)
        elif action == "set_page_order":
            self.order = {"list": list(given)}
        elif action == "delete_page" and page is not None:
            self.deleted[page] = self.now
            self.ops[str(page)] = {"set": True, "place": 0, "value": None, "turn": 0}
            self.order = without_page(self.order, page)

    def rows(self, doc_id: int, part: int) -> list[tuple]:
        out = []
        for key in list(self.edits):
            e = self._edit(key)
            page = e["value"].get("page") if e["value"] else None
            whole = int(page) if isinstance(page, (int, float)) and page == int(page) else None
            out.append((doc_id, "edit", key, part, json.dumps({k: v for k, v in e.items() if k != "since"}), whole, e["set"] or "since" in e))
        out += [(doc_id, "page_op", key, part, json.dumps(o), None, False) for key, o in self.ops.items()]
        out += [(doc_id, "order", "", part, json.dumps(self.order), None, False)] if self.order else []
        return out + [(doc_id, "deleted", "", part, None, page, False) for page in self.deleted]


def net_effect(rows: list[tuple], v: dict, history: int, burst_ms: int) -> Net:
    """Rows (pos, action, ms, edit_id, page, payload) of a segment under its verdict."""
    below = high = v["past"] + v["future"]
    mid, low, last, place = v["past"], 0, None, v["places"]
    chain: list[int] = []  # own versions that can come into force
    owner: list[tuple[int | None, int, tuple]] = []  # version, or -1 for one on the left; place; row
    started = v["opened"] >= 0
    for row in rows:
        pos, action, ms, edit_id, _, payload = row
        if pos <= v["opened"]:
            continue
        place += action in _PLACED
        if action == "seed_order":
            continue
        if action == "update" and not started:
            joined = v["joined"]
        else:
            joined = action == "update" and last is not None and last[0] == edit_id and ms - last[1] < burst_ms
        started, last = True, (edit_id, ms) if action == "update" else None
        if action == "undo":
            mid = max(low, mid - 1)
        elif action == "redo":
            mid = min(high, mid + 1)
        elif joined:
            owner.append((chain[mid - 1 - below] if mid > below else -1, place, row))
        else:
            if mid < below:
                below, chain = mid, []
            del chain[mid - below :]
            chain.append(len(owner))
            owner.append((len(owner), place, row))
            mid += 1
            high = mid
            low = max(low, mid - history)
    lives, net = set(chain[: v["kept"]]), Net()
    for version, at, (_, action, _, edit_id, page, payload) in owner:
        if version in lives or (version == -1 and v["hook"]):
            net.take(action, edit_id, page, payload, at)
    return net


def put_together(kind: str, nets: list[tuple[dict, bool]]) -> tuple[int, object] | None:
    """Place and value after net effects in order, each with whether the edit's page was deleted
    between it and the next that sets the page."""
    place, value = 0, None
    for n, gone in nets:
        if kind == "order":
            seed = n["seed"] if "seed" in n else value[1] if value else None
            before = value[0] if value else None
            if "list" in n:
                before = {"list": n["list"]}
            for page in n.get("minus", []):
                before = without_page(before, page)
            value = (before, seed)
        elif n["set"]:
            place, value = n["place"], n["value"]
        elif kind == "page_op":
            base = value or {"rotation": 0}
            value = {**base, **n["value"]} if "rotation" in n["value"] else {**base, **n["value"], "rotation": base.get("rotation", 0) + n["turn"]}
            place = n["place"]
        elif value is not None:
            value = None if value.get("page") in n.get("not_on", []) else {**value, **n["value"]}
        if gone:
            value = None
    if kind == "order":
        order = order_of(*value) if value else None
        return None if order is None else (0, order)
    return None if value is None else (place, value)


# ---- the jobs


def fold_long_logs(log: DataFrame, history: int = 100, burst_ms: int = 600, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """What ``fold_edits`` gives, with a document's log cut into segments of about
    ``segment_rows`` actions, which are folded side by side. The log is dealt into ranges of
    (doc_id, ts, seq) and written once, in order; a range has ``TASK_ROWS`` actions, however
    short segments are, so that there are no more tasks and files than the log's size asks for.
    No task holds more than a segment, or the segments' summaries of a document."""
    spark, history = log.sparkSession, max(1, history)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-log.count() // max(segment_rows, TASK_ROWS)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, doc, segment, pos, size = TaskContext.get().partitionId() * _TASK, None, None, 0, 0
        for b in batches:
            out = []
            for d, action, ms, edit_id, page, payload in zip(*(b.column(c).to_pylist() for c in ("doc_id", "action", "ms", "edit_id", "page", "payload"))):
                if segment is None or d != doc or size >= segment_rows:
                    if segment is not None:
                        out.append((doc, part, pos, None, None, None, None, None, segment.summary(history)))
                        part += 1
                    doc, segment, size = d, Segment(burst_ms), 0
                pos += 1
                size += 1
                segment.take(pos, action, ms, edit_id, payload)
                out.append((d, part, pos, action, ms, edit_id, page, payload, None))
            yield _batch(_LOG, out)
        if segment is not None:
            yield _batch(_LOG, [(doc, part, pos, None, None, None, None, None, segment.summary(history))])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held, out = None, [], []

        def close() -> None:
            met, past, future, seed = verdicts(held, history, burst_ms)
            out.extend((doc, part, json.dumps(v), None, None, None) for part, v in met if not v["dead"])
            out.append((doc, -1, None, past, future, seed))

        for b in batches:
            for d, part, summary in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "summary"))):
                if held and d != doc:
                    close()
                    held = []
                doc = d
                held.append((part, json.loads(summary)))
        if held:
            close()
        yield _batch(_VERDICT, out)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, verdict, held = None, None, []
        for b in batches:
            for d, part, v, *row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "verdict", "pos", "action", "ms", "edit_id", "page", "payload"))):
                if v is not None:  # it comes before the segment's rows; a segment that an ``open`` follows has none
                    if held:
                        yield _batch(_NET, net_effect(held, verdict, history, burst_ms).rows(*at))
                    at, verdict, held = (d, part), json.loads(v), []
                elif (d, part) == at:
                    held.append(tuple(row))
        if held:
            yield _batch(_NET, net_effect(held, verdict, history, burst_ms).rows(*at))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []
        names, kinds = ["doc_id", "kind", "key", "place", "value"], [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        fields = list(zip(names, kinds, names))

        def close() -> None:
            found = put_together(at[1], held)
            if found:
                out.append((*at, found[0], json.dumps(found[1], sort_keys=True)))

        for b in batches:
            for d, kind, key, net, gone in zip(*(b.column(c).to_pylist() for c in ("doc_id", "kind", "key", "net", "gone"))):
                if held and (d, kind, key) != at:
                    close()
                    held = []
                at = (d, kind, key)
                held.append((json.loads(net), bool(gone)))
            if len(out) > 10_000:
                yield _batch(fields, out)
                out = []
        if held:
            close()
        yield _batch(fields, out)

    rows = log.select(F.col("doc_id").cast("long").alias("doc_id"), "ts", "seq", "action", F.unix_millis("ts").alias("ms"), "edit_id", F.col("page").cast("int").alias("page"), "payload")
    marked = kept(rows.repartitionByRange(parts, "doc_id", "ts", "seq").sortWithinPartitions("doc_id", "ts", "seq").mapInArrow(mark, _ddl(_LOG)), "log")
    told = marked.where("summary is not null").select("doc_id", "part", "summary").repartition("doc_id").sortWithinPartitions("doc_id", "part")
    told = kept(told.mapInArrow(judge, _ddl(_VERDICT)), "verdicts")
    docs = told.where("part < 0").select("doc_id", "past", "future", "seed")

    judged = marked.where("summary is null").drop("summary").unionByName(told.where("part >= 0").select("doc_id", "part", "verdict", F.lit(-1).cast("long").alias("pos")), allowMissingColumns=True)
    nets = kept(judged.repartition("doc_id", "part").sortWithinPartitions("doc_id", "part", "pos").mapInArrow(fold, _ddl(_NET)), "nets")

    # whether the page that an edit was put on is deleted before the edit is put on another
    put = nets.where("anchor").withColumn("_end", F.lead("part").over(Window.partitionBy("doc_id", "key").orderBy("part")))
    put = put.where("on_page is not null").select("doc_id", "on_page", "part", "key", "_end", F.lit(0).alias("_gone"))
    gone = nets.where("kind = 'deleted'").select("doc_id", "on_page", "part", F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("_end"), F.lit(1).alias("_gone"))
    back = Window.partitionBy("doc_id", "on_page").orderBy(F.desc("part"), "_gone").rowsBetween(Window.unboundedPreceding, 0)
    seen = put.unionByName(gone).withColumn("_next", F.last(F.when(F.col("_gone") == 1, F.col("part")), ignorenulls=True).over(back))
    hit = seen.where("_gone = 0 and _next is not null and (_end is null or _next < _end)").select("doc_id", F.lit("edit").alias("kind"), "key", "part", F.lit(True).alias("gone"))

    seeds = docs.where("seed is not null").select("doc_id", F.lit("order").alias("kind"), F.lit("").alias("key"), F.lit(-1).cast("long").alias("part"), F.to_json(F.struct("seed")).alias("net"))
    every = nets.where("net is not null").select("doc_id", "kind", "key", "part", "net").unionByName(seeds).join(hit.hint("merge"), ["doc_id", "kind", "key", "part"], "left")
    found = kept(every.repartition("doc_id", "kind", "key").sortWithinPartitions("doc_id", "kind", "key", "part").mapInArrow(combine, "doc_id long, kind string, key string, place long, value string"), "folded")
    depths = docs.select("doc_id", "past", "future").hint("merge")
    empty = docs.join(found.select("doc_id").hint("merge"), "doc_id", "left_anti")
    names = [c.split()[0] for c in STATE.split(", ")]
    bare = empty.select("doc_id", F.lit("empty").alias("kind"), F.lit("").alias("key"), F.lit(0).cast("long").alias("place"), F.lit("{}").alias("value"), "past", "future")
    return found.join(depths, "doc_id").select(*names).unionByName(bare)
