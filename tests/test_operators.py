import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import edits as E
from quire.operators import layout, pages, paragraphs, raster, regions, search, spatial
from quire.schemas import RUNS
from quire.sources import readers


def runs(spark, rows):
    full = [(1, 0, i, s, float(x), base - 10.0, float(w), 12.0, float(base), 10.0, "Helvetica", False, False) for i, (s, x, w, base) in enumerate(rows)]
    return spark.createDataFrame(full, RUNS)


def test_line_blocks(spark):
    merged = layout.line_blocks(runs(spark, [("Hello", 10, 30, 100), ("world", 42, 30, 100)])).collect()
    assert [(b["str"], b["x"], b["width"], len(b["runs"])) for b in merged] == [("Hello world", 10.0, 62.0, 2)]
    assert layout.line_blocks(runs(spark, [("a", 10, 30, 100), ("b", 400, 30, 100)])).count() == 2
    lines = layout.cluster_lines(runs(spark, [("a", 1, 1, 100), ("b", 2, 1, 102), ("c", 3, 1, 104), ("d", 4, 1, 106)])).orderBy("ord")
    assert [r["line"] for r in lines.collect()] == [0, 0, 1, 1]


def paras(spark, rows):
    lines = [(1, 0, i, t, 0.0, float(y), 100.0, y + 20.0, 0.0, 20.0, False) for i, (t, y) in enumerate(rows)]
    df = spark.createDataFrame(lines, "doc_id long, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, first_x double, row_height double, all_words_bold boolean")
    return [(r["text"], r["is_list_item"]) for r in paragraphs.build_paragraphs(df).orderBy("paragraph").collect()]


def test_paragraphs(spark):
    assert paras(spark, [("one", 0), ("two", 22)]) == [("one two", False)]
    assert paras(spark, [("one", 0), ("two", 80)]) == [("one", False), ("two", False)]
    assert paras(spark, [("Head", 0), ("• a", 22), ("• b", 44), ("1. c", 66)]) == [("Head", False), ("• a", True), ("• b", True), ("1. c", True)]
    assert paras(spark, [("« Abc", 0), ("inter-", 22), ("national agreement.", 44)]) == [("• Abc international agreement.", True)]


def test_page_sets(spark):
    specs = spark.createDataFrame([(1, "1-3, 5, 8-10", 10), (2, "2-99, abc, 0, 4", 5), (3, "3-1", 5), (4, "", 3)], "doc_id long, spec string, page_count int")
    got = {}
    for d, p, page in sorted(map(tuple, pages.parse_page_ranges(specs).collect())):
        got.setdefault(d, {}).setdefault(p, []).append(page)
    assert {d: list(v.values()) for d, v in got.items()} == {1: [[0, 1, 2], [4], [7, 8, 9]], 2: [[1, 2, 3, 4], [3]], 3: [[0, 1, 2]]}
    seven = spark.range(7).selectExpr("1L as doc_id", "cast(id as int) as page")
    assert [r["part"] for r in pages.split_every(seven, 3).orderBy("page").collect()] == [0, 0, 0, 1, 1, 1, 2]
    labels = pages.part_labels(pages.split_every(seven, 3)).orderBy("part").collect()
    assert [r["label"] for r in labels] == ["p1-3", "p4-6", "p7"]
    order = seven.withColumn("pos", F.col("page"))
    moved = pages.move_page(order, 5, 1).orderBy("pos").collect()
    assert [r["page"] for r in moved] == [0, 5, 1, 2, 3, 4, 6] and pages.move_page(order, 0, 9).where("pos <> page").count() == 0
    assert pages.delete_pages(seven, seven, order).count() == 7 and pages.delete_pages(seven, seven.where("page = 2"), order).count() == 6
    twice = order.union(spark.createDataFrame([(1, 3, 7)], "doc_id long, page int, pos int"))
    edits = seven.withColumn("ord", F.lit(0)).withColumn("y", F.lit(0.0))
    assert {r["page"]: r["out_page"] for r in pages.remap_edits(edits, twice).collect()}[3] == 7


def test_scans(spark):
    vlm = spark.createDataFrame([(1, 0, [[1.0] * 8, [1.0] * 4, [2.0] * 9], ["<s>a</s>", "b", " ", "d"])], "doc_id long, page int, boxes array<array<double>>, labels array<string>")
    assert [tuple(r)[2:4] for r in regions.regions_from_vlm(vlm).collect()] == [(0, "a")]
    poly = spark.createDataFrame([(1, 0, 0, "t", [[1.0, 2.0], [3.0, 4.0]]), (1, 0, 1, "t", [[1.0, 2.0]])], "doc_id long, page int, ord int, text string, poly array<array<double>>")
    assert [r["quad"] for r in regions.regions_from_polygons(poly).collect()] == [[1.0, 2.0, 3.0, 4.0, 3.0, 4.0, 3.0, 4.0]]
    assets = spark.createDataFrame([("o", json.dumps([{"id": "a", "dataUrl": "x"}, {"id": 1}, {"id": "b"}])), ("p", "no"), ("q", "{}")], "owner string, json string")
    assert [tuple(r) for r in readers.read_assets(assets).select("owner", "id").collect()] == [("o", "a")]
    files = spark.createDataFrame([(1, 0, "a.png"), (1, 1, "b.PDF"), (2, 0, "c.csv"), (3, 0, "x.exe")], "batch int, ord int, path string")
    assert {r["batch"]: (r["path"], r["route"]) for r in readers.route_files(files).collect()} == {1: ("b.PDF", "pdf"), 2: ("c.csv", "convert")}
    rows = readers.fixed_width_rows(spark.createDataFrame([("a", None), (None, None)], "x string, y int"), "s", ["x"]).orderBy("part").collect()
    assert [r["text"] for r in rows] == ["# s", "a".ljust(16) + " " + " " * 16, ""]


def test_spatial_and_search(spark):
    kind = "doc_id long, page int, x double, y double, width double, height double"
    items = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 10.0, 0.0, 5.0, 5.0), (1, 1, 0.0, 0.0, 10.0, 10.0)], kind)
    cover = spark.createDataFrame([(1, 0, 5.0, 5.0, 5.0, 5.0)], kind)
    assert sorted((r["page"], r["x"]) for r in spatial.uncovered_items(items, cover).collect()) == [(0, 10.0), (1, 0.0)]
    assert spatial.unreplaced_images(items, spark.createDataFrame([(1, 0, 3.9, 0.0, 1.0, 1.0)], kind)).count() == 2
    times = [(1, k, i) for i, k in enumerate("aba")]
    recent = search.recent_distinct(spark.createDataFrame(times, "o int, k string, t int"), "o", "k", "t").orderBy("place")
    assert [r["k"] for r in recent.collect()] == ["a", "b"]
    assert search.find_text(items.withColumn("t", F.lit("Abc")), " ", F.col("t")).count() == 0
    px = spark.createDataFrame([(1, x, y, 0, 0, 0, 255 if x in (2, 3) and y in (1, 2) else 3) for x in range(6) for y in range(4)], "img_id long, x int, y int, r int, g int, b int, a int")
    assert tuple(raster.ink_bounds(px).first())[1:] == (2, 1, 2, 2)


def test_recognize_keeps_good_pages(spark):
    df = spark.createDataFrame([(1, 0, bytearray(b"ok")), (1, 1, bytearray(b"bad"))], "doc_id long, page int, content binary")

    def engine(data):
        if data == b"bad":
            raise ValueError("unreadable")
        return [{"text": "t", "quad": [0.0] * 8, "truncated": True}]

    got = regions.recognize(df, engine)
    totals = spark.createDataFrame([(1, 3)], "doc_id long, page_count int")
    assert tuple(regions.ocr_report(got, totals).first()) == (1, 1, 1, 3, "1", True)


def test_undo_redo_and_bursts():
    d = E.Document()
    d.apply("add", 0, "a", 0, '{"v": 0}')
    for t, v in ((1000, 1), (1599, 2), (2199, 3)):  # 599 ms joins, 600 ms does not
        d.apply("update", t, "a", 0, json.dumps({"v": v}))
    assert d.counts() == (3, 0)
    d.apply("undo", 3000, None, None, None)
    assert d.value("edit", "a")[1]["v"] == 2
    d.apply("undo", 3000, None, None, None)
    assert d.value("edit", "a")[1]["v"] == 0
    d.apply("redo", 3000, None, None, None)
    assert d.value("edit", "a")[1]["v"] == 2
    d.apply("delete", 3001, "a", None, None)
    assert d.counts()[1] == 0 and not d.store.items("edit")
    d.apply("undo", 3002, None, None, None)
    assert d.value("edit", "a")[1]["v"] == 2
    for i in range(101):
        d.apply("add", 4000 + i, str(i), 0, None)
    assert d.counts() == (100, 0)
    d.apply("open", 9000, None, None, None)
    assert d.rows(1)[0][1] == "empty"


class Model:
    """Whole snapshots: slow, and plainly right."""

    def __init__(self):
        self.now, self.past, self.future, self.last = {}, [], [], None

    def apply(self, action, ts, key):
        if action == "undo" and self.past:
            self.future.insert(0, self.now)
            self.now = self.past.pop()
        elif action == "redo" and self.future:
            self.past.append(self.now)
            self.now = self.future.pop(0)
        elif action in ("add", "update", "delete"):
            joined = action == "update" and self.last and self.last[0] == key and ts - self.last[1] < 600
            if not joined:
                self.past, self.future = [*self.past, self.now][-100:], []
            new = dict(self.now)
            if action == "add" or (action == "update" and key in new):
                new[key] = ts
            elif action == "delete":
                new.pop(key, None)
            self.now = new
        self.last = (key, ts) if action == "update" else None


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.sampled_from(["add", "update", "delete", "undo", "redo"]), st.integers(1, 900), st.sampled_from("ab")), max_size=40))
def test_fold_equals_snapshots(steps):
    d, m, ts = E.Document(), Model(), 0
    for action, wait, key in steps:
        ts += wait
        d.apply(action, ts, key, 0, json.dumps({"v": ts}))
        m.apply(action, ts, key)
        assert {k: v[1]["v"] for k, v in d.store.items("edit")} == m.now
        assert d.counts() == (len(m.past), len(m.future))


@pytest.mark.parametrize("gap,bursts", [(599, 1), (600, 2), (601, 2)])
def test_burst_gap(spark, gap, bursts):
    log = spark.createDataFrame([(1, 0, 0, "update", "a"), (1, 1, gap, "update", "a")], "doc_id long, seq long, ms long, action string, edit_id string")
    log = log.withColumn("ts", F.timestamp_millis("ms"))
    assert E.edit_bursts(log).agg(F.max("burst")).first()[0] == bursts


def test_blocks_are_made_once_in_one_exchange(spark):
    from quire.plans.source_queries import picked_items

    plan = picked_items(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
