"""Page operations and orders in the cases that are easily got wrong, the whole edit log
against snapshots, and the streams."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import edits as E
from quire.operators import pages as P
from quire.schemas import RUNS
from quire.sources import readers
from quire.streaming.states import page_progress

SHEET = "doc_id long, page int, width double, height double, source_rotation int, source_crop struct<x: double, y: double, width: double, height: double>"
OPS = "doc_id long, page int, rotation int, crop struct<top: double, right: double, bottom: double, left: double>"


def test_a_page_is_turned_before_its_crop_is_scaled(spark):
    sheets = [(1, 0, 612.0, 792.0, 0, None), (2, 0, 612.0, 792.0, 90, None), (3, 0, 612.0, 792.0, 90, None), (4, 0, 612.0, 792.0, 0, (10.0, 20.0, 500.0, 700.0)), (5, 0, 612.0, 792.0, None, None), (6, 0, 612.0, 792.0, 270, None)]
    inset = (0.0, 0.0, 0.0, 100.0)
    ops = [(1, 0, 90, inset), (2, 0, 0, inset), (3, 0, 180, inset), (4, 0, 0, inset), (5, 0, -44, (0.0, 900.0, 0.0, 0.0))]
    out = {r["doc_id"]: (r["rotation_out"], r["crop_box"] and tuple(round(v, 6) for v in r["crop_box"])) for r in P.apply_page_ops(spark.createDataFrame(sheets, SHEET), spark.createDataFrame(ops, OPS)).collect()}
    assert out[1] == (90, (99.0, 0.0, 513.0, 792.0))  # seen 792 wide
    assert out[2] == (90, (99.0, 0.0, 513.0, 792.0))  # a turn by none leaves the page's own
    assert out[3] == (180, (76.5, 0.0, 535.5, 792.0))
    assert out[4] == (0, (86.5, 20.0, 423.5, 700.0))
    assert out[5] == (0, None) and out[6] == (270, None)


def test_pages_listed_twice_or_out_of_range(spark):
    order = spark.createDataFrame([(1, 0, 2), (1, 1, 9), (1, 2, 0), (1, 3, 2), (1, 4, -1), (1, 5, 1)], "doc_id long, pos int, page int")
    edits = spark.createDataFrame([(1, p, 0.0, p) for p in range(4)], "doc_id long, page int, y double, ord int")
    assert [r["page"] for r in P.order_edits(edits, order).orderBy("rank").collect()] == [0, 2, 3, 1]
    counts = spark.createDataFrame([(1, 3)], "doc_id long, page_count int")
    out = {r["page"]: r["out_page"] for r in P.remap_edits(edits, order, counts).collect()}
    assert out == {0: 1, 2: 2, 1: 3}
    assert P.is_reordered(order, counts).collect()[0]["reordered"]


class Snapshots:
    """Whole states on both stacks."""

    def __init__(self):
        self.now, self.past, self.future, self.last, self.order = ({}, {}, None), [], [], None, []

    def apply(self, action, ts, key, page, given):
        edits, ops, order = dict(self.now[0]), dict(self.now[1]), self.now[2]
        if action == "open":
            self.__init__()
            return
        if action == "undo":
            if self.past:
                self.future.insert(0, self.now)
                self.now = self.past.pop()
        elif action == "redo":
            if self.future:
                self.past.append(self.now)
                self.now = self.future.pop(0)
        else:
            joined = action == "update" and self.last and self.last[0] == key and ts - self.last[1] < 600 and self.past
            if not joined:
                self.past, self.future = [*self.past, self.now][-100:], []
            if action == "add":
                edits[key] = {"page": page, **given}
            elif action == "update" and key in edits:
                edits[key] = {**edits[key], **given}
            elif action == "delete":
                edits.pop(key, None)
            elif action == "set_page_op":
                ops[page] = {"rotation": 0, **ops.get(page, {}), **given}
            elif action == "rotate":
                before = ops.get(page, {"rotation": 0})
                ops[page] = {**before, "rotation": before.get("rotation", 0) + given.get("delta", 90)}
            elif action == "set_page_order":
                order = given
            elif action == "delete_page":
                edits, order = {k: v for k, v in edits.items() if v["page"] != page}, order and [p for p in order if p != page]
                ops.pop(page, None)
            self.now = (edits, ops, order)
        self.last = (key, ts) if action == "update" else None


STEP = st.one_of(
    st.tuples(st.sampled_from(["add", "update", "delete"]), st.sampled_from("ab"), st.integers(0, 2), st.dictionaries(st.sampled_from("xy"), st.integers(0, 9), max_size=2)),
    st.tuples(st.just("set_page_op"), st.none(), st.integers(0, 2), st.dictionaries(st.sampled_from(["rotation", "crop"]), st.integers(0, 9), max_size=2)),
    st.tuples(st.just("rotate"), st.none(), st.integers(0, 2), st.sampled_from([{}, {"delta": -90}])),
    st.tuples(st.just("set_page_order"), st.none(), st.none(), st.permutations([0, 1, 2])),
    st.tuples(st.sampled_from(["delete_page", "undo", "redo", "undo"]), st.none(), st.integers(0, 2), st.just({})),
    st.tuples(st.just("open"), st.none(), st.none(), st.just({})),
)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(STEP, st.integers(1, 900)), max_size=50), st.booleans())
def test_every_action_against_snapshots(steps, seeded):
    d, m, ts = E.Document(), Snapshots(), 0
    if seeded:
        d.apply("seed_order", 0, None, None, '{"pages": 3}')
        m.now = ({}, {}, [0, 1, 2])
    for (action, key, page, given_), wait in steps:
        ts += wait
        d.apply(action, ts, key, page, json.dumps(given_))
        m.apply(action, ts, key, page, given_)
        assert {k: v[1] for k, v in d.store.items("edit")} == m.now[0]
        assert {int(k): v[1] for k, v in d.store.items("page_op")} == m.now[1]
        assert (d.value("order", "") or (0, None))[1] == m.now[2]
        assert d.counts() == (len(m.past), len(m.future)) and len(d.store.maps["version"]) == sum(d.counts())


def drained(spark, tmp_path, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_progress_of_recognition(spark, tmp_path):
    rows = [(i % 3, i, None if i % 4 else "bad", i % 5 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, page int, error string, truncated boolean")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted(drained(spark, tmp_path, page_progress(stream), "complete", "progress")) == sorted(tuple(r) for r in page_progress(df).collect())


def test_runs_without_text_are_dropped(spark, tmp_path):
    rows = [(1, 0, i, t, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, "f", False, True) for i, t in enumerate(["a", None, " ", "", "\ufeff", " b "])]
    spark.createDataFrame(rows, RUNS).write.parquet(str(tmp_path / "runs"))
    found = readers.read_runs(spark, str(tmp_path / "runs"))
    assert sorted(r["str"] for r in found.collect()) == [" b ", "a"]


def test_trees_come_as_json(spark, tmp_path):
    box = lambda x: {"x0": x, "y0": 0.0, "x1": x + 9, "y1": 8.0}
    line = {"text": "hi there\n\n", "bbox": box(1.0), "rowAttributes": {"row_height": 0.0}, "words": [{"text": " ", "bbox": box(2.0), "is_bold": False}, {"text": "hi", "bbox": box(3.0), "is_bold": True}]}
    tree = {"doc_id": 1, "page": 2, "blocks": [{"paragraphs": [{"lines": [line, {"text": " \n", "bbox": box(0.0)}, {"text": "no box"}]}]}, {"paragraphs": [{"lines": [{"text": "plain", "bbox": box(7.0), "words": None}]}]}]}
    (tmp_path / "t.json").write_text(json.dumps(tree) + "\n{broken\n")
    rows = readers.ocr_lines(readers.read_ocr(spark, str(tmp_path / "t.json"))).orderBy("ord").collect()
    assert [(r["text"], r["first_x"], r["row_height"], r["all_words_bold"]) for r in rows] == [("hi there", 3.0, 0.0, True), ("plain", 7.0, 8.0, False)]
    plain = readers.ocr_lines(readers.read_ocr(spark, str(tmp_path / "t.json")), words=False).orderBy("ord").first()
    assert (plain["first_x"], plain["all_words_bold"]) == (1.0, False)
