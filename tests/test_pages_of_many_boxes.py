"""Joins on dense pages, sums over pixels, lookups by offset, files and engines against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import edits as E
from quire.operators import pages as P
from quire.operators import raster, regions, spatial
from quire.schemas import STYLED_RUN
from quire.sources import readers, writers

BOX = "doc_id long, page int, x double, y double, width double, height double, n int"


def rects(seed, n):
    r = random.Random(seed)
    size = lambda: r.choice([0.0, 3.0, 40.0, 64.0, 65.0, 300.0, 5000.0, -2.0])
    return [(r.randint(0, 1), 0, r.uniform(-200, 900), r.choice([0.0, 64.0, 128.5, r.uniform(-100, 1200)]), size(), size(), i) for i in range(n)]


def test_items_under_covers(spark):
    items = [*rects(1, 300), (0, 0, None, 1.0, 1.0, 1.0, 900), (None, 0, 1.0, 1.0, 1.0, 1.0, 901)]
    covers = [c for c in rects(2, 40) if c[4] < 1000] + [(1, 0, 500.0, 500.0, 1e12, 3.0, 0), (0, 0, None, 0.0, 9.0, 9.0, 0), (1, 1, 0.0, 0.0, 1e6, 1e6, 0)]
    hit = lambda a, b: None not in (*a[:6], *b[:6]) and a[:2] == b[:2] and a[2] < b[2] + b[4] and a[2] + a[4] > b[2] and a[3] < b[3] + b[5] and a[3] + a[5] > b[3]
    got = spatial.uncovered_items(spark.createDataFrame(items, BOX), spark.createDataFrame(covers, BOX))
    assert got.columns == [c.split()[0] for c in BOX.split(", ")]
    assert sorted(r["n"] for r in got.collect()) == sorted(a[6] for a in items if not any(hit(a, b) for b in covers))


def test_images_near_covers(spark):
    images, covers = rects(3, 300), rects(4, 60)
    near = lambda a, b: a[:2] == b[:2] and abs(a[2] - b[2]) < 4 and abs(a[3] - b[3]) < 4
    covers += [(*a[:2], a[2] + d, a[3] - d, 1.0, 1.0, 0) for a, d in zip(images[:40], [0.0, 3.9, 4.0, -3.999] * 10)]
    got = spatial.unreplaced_images(spark.createDataFrame(images, BOX), spark.createDataFrame(covers, BOX))
    assert sorted(r["n"] for r in got.collect()) == sorted(a[6] for a in images if not any(near(a, b) for b in covers))


def test_a_dense_page_makes_few_pairs(spark):
    """20,000 items and 20,000 covers on one page: an item meets some dozens of copies of covers, not all."""
    at = F.struct((F.col("id") % 200 * 70).cast("double").alias("x"), (F.floor(F.col("id") / 200) * 30).cast("double").alias("y"))
    page = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page"), at.alias("p"), F.col("id"))
    items = page.select("doc_id", "page", "p.x", "p.y", F.lit(60.0).alias("width"), F.lit(20.0).alias("height"), "id")
    covers = page.where("id % 2 = 0").select("doc_id", "page", "p.x", "p.y", F.lit(5.0).alias("width"), F.lit(5.0).alias("height"))
    assert spatial.uncovered_items(items, covers).count() == 10_000
    copies = covers.select(F.size(spatial._tiles_of(*(F.col(c) for c in ("x", "y", "width", "height")))).alias("n")).agg(F.max("n"), F.avg("n")).first()
    assert copies[0] <= 20


@pytest.mark.parametrize("cells", [4_000_000, 37])
def test_ink_by_sums(spark, monkeypatch, cells):
    import numpy as np

    monkeypatch.setattr(spatial, "MAX_CELLS", cells)
    r = random.Random(5)
    pixels = [(r.randint(0, 30), r.randint(0, 40), r.randint(0, 255)) for _ in range(700)]
    boxes = [(x := r.uniform(-5, 35), y := r.uniform(-5, 45), x + r.choice([-1, 0, 0.5, 7, 60]), y + r.choice([-1, 0, 3, 9, 60])) for _ in range(80)]
    got = spatial._shares(np.array(boxes), np.array(pixels), 128)
    for b, share in zip(boxes, got):
        inside = [v < 128 for x, y, v in pixels if np.floor(b[0]) <= x < np.ceil(b[2]) and np.floor(b[1]) <= y < np.ceil(b[3])]
        assert share == (sum(inside) / len(inside) if inside else 0.0)


def test_ink_of_pages_without_pixels(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 2.0, 2.0), (2, 0, 0, 0.0, 0.0, 2.0, 2.0), (1, 0, 1, None, 0.0, 2.0, 2.0)], "doc_id long, page int, box int, x0 double, y0 double, x1 double, y1 double")
    pixels = spark.createDataFrame([(1, 0, 0, 0, 5), (1, 0, 1, 1, 200), (3, 0, 0, 0, 0)], "doc_id long, page int, x int, y int, r int")
    assert sorted((r["doc_id"], r["box"], r["density"]) for r in spatial.ink_density(boxes, pixels).collect()) == [(1, 0, 0.5), (1, 1, 0.0), (2, 0, 0.0)]


def test_ink_of_pages_that_batches_cut(spark):
    """Pages and documents of any size, whatever the bounds of the batches that hold them."""
    r = random.Random(8)
    pages = [(f"d{i % 7}", i) for i in range(40)]
    boxes = [(d, p, k, *(float(v) for v in (r.randint(0, 5), r.randint(0, 5), r.randint(5, 12), r.randint(5, 12)))) for d, p in pages for k in range(r.choice([0, 1, 6]))]
    pixels = [(d, p, r.randint(0, 12), r.randint(0, 12), r.randint(0, 255)) for d, p in pages for _ in range(r.choice([0, 1, 200]))]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size in ("7", "10000"):
            spark.conf.set(name, size)
            found = spatial.ink_density(spark.createDataFrame(boxes, "doc_id string, page int, box int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(pixels, "doc_id string, page int, x int, y int, r int")).collect()
            assert len(found) == len(boxes)
            for b in found:
                inside = [v < 128 for d, p, x, y, v in pixels if (d, p) == (b["doc_id"], b["page"]) and b["x0"] <= x < b["x1"] and b["y0"] <= y < b["y1"]]
                assert b["density"] == (sum(inside) / len(inside) if inside else 0.0)
    finally:
        spark.conf.set(name, before)


def test_background_of_strips(spark):
    r = random.Random(6)
    pixels = [(1, x, y, *(r.randint(0, 255) for _ in range(3)), 255) for x in range(150) for y in range(30) if r.random() < 0.7]
    boxes = [(1, i, r.uniform(-5, 160), r.uniform(-3, 40), r.choice([0.2, 3.0, 70.0, 140.0]), r.choice([0.4, 2.0, 30.0])) for i in range(40)]
    got = raster.background_color(spark.createDataFrame(boxes, "img_id long, box int, x double, y double, width double, height double"), spark.createDataFrame(pixels, "img_id long, x int, y int, r int, g int, b int, a int"))
    half_up = lambda v: math.floor(v + 0.5)
    for row in got.collect():
        left, top = max(0, half_up(row["x"])), max(0, half_up(row["y"] - 4))
        right, end = left + max(1, half_up(row["width"])), top + max(1, half_up(min(row["height"], 6.0)))
        inside = [p for p in pixels if left <= p[1] < right and top <= p[2] < end]
        want = "#ffffff" if not inside else "#" + "".join(f"{sorted(p[k] for p in inside)[len(inside) // 2]:02x}" for k in (3, 4, 5))
        assert row["background"] == want


def test_offsets_between_pages(spark):
    pages = [(1, 0, 100.0), (1, 1, 100.0), (1, 2, 250.0), (2, 5, 10.0)]
    asked = [(1, 0.0, "a"), (1, 99.9, "b"), (1, 100.0, "c"), (1, 100.0, "d"), (1, 250.0, "e"), (1, 1e9, "f"), (2, -1.0, "g"), (2, 10.0, "h"), (3, 5.0, "i")]
    got = spatial.page_at_offset(spark.createDataFrame(asked, "doc_id long, offset double, tag string"), spark.createDataFrame(pages, "doc_id long, page int, end double"))
    assert got.columns == ["doc_id", "offset", "tag", "page"]
    assert {r["tag"]: r["page"] for r in got.collect()} == {"a": 0, "b": 0, "c": 2, "d": 2, "e": 0, "f": 0, "g": 5, "h": 5, "i": 0}


def test_long_numbers_in_ranges(spark):
    specs = [(1, "1-9999999999", 3), (2, "99999999999999999999, 2", 3), (3, "0000000000000000000001-2,5-", 3), (4, "77777777777777777777777-1", 2)]
    got = P.parse_page_ranges(spark.createDataFrame(specs, "doc_id long, spec string, page_count int"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0), (1, 0, 1), (1, 0, 2), (2, 0, 1), (3, 0, 0), (3, 0, 1), (4, 0, 0), (4, 0, 1)]


def test_names_of_exports(spark):
    names = ["report.v2", "a.PDF", "b.pdf.pdf", "c", ".pdf"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(X.export_name(F.col("n")).alias("e"), X.base_name(F.col("n")).alias("b")).collect()
    assert [r["e"] for r in got] == ["report.v2.edited.pdf", "a.edited.pdf", "b.pdf.edited.pdf", "c.edited.pdf", ".edited.pdf"]
    assert [r["b"] for r in got] == ["report", "a", "b.pdf", "c", ""]


def test_defaults_of_a_new_box(spark):
    rows = [(None, None, None, None), (5.0, "existing", "#000000", [("x", True, None, None, None, None)])]
    df = spark.createDataFrame(rows, f"width double, origin string, cover_color string, runs array<{STYLED_RUN}>")
    a, b = E.with_edit_defaults(df).collect()
    assert (a["width"], a["origin"], a["cover_color"], [r["text"] for r in a["runs"]]) == (None, "added", "#ffffff", ["Your text"])
    assert (b["width"], b["origin"], b["cover_color"], b["runs"][0]["text"]) == (5.0, "existing", "#000000", "x")


def test_lines_keep_no_white_space_at_their_ends(spark, tmp_path):
    rows = [(1, 0, 1, " a, \"b\"　"), (1, 0, 2, "﻿\t x\r y "), (2, 1, 1, "#c \\ d")]
    writers.write_lines_csv(spark.createDataFrame(rows, "doc_id long, page int, line int, str string"), str(tmp_path / "l"))
    got = writers.read_lines_csv(spark, str(tmp_path / "l")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, 'a, "b"'), (1, 1, 2, "x\r y"), (2, 2, 1, "#c \\ d")]


def test_parts_are_few_files_and_commits_repeat(spark, tmp_path):
    pages = spark.range(2000).select(F.floor(F.col("id") / 4).alias("doc_id"), (F.col("id") % 4).cast("int").alias("page"))
    for commit in ("a", "b", "a"):
        parts = P.split_every(pages.where(F.col("doc_id") % 2 == (0 if commit == "a" else 1)), 3)
        writers.write_parts(parts, str(tmp_path / "p"), commit)
    assert len(list((tmp_path / "p").rglob("part-*.parquet"))) <= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert writers.read_parts(spark, str(tmp_path / "p")).count() == 2000 and writers.read_manifest(spark, str(tmp_path / "p")).count() == 1000
    one = writers.read_parts(spark, str(tmp_path / "p"), 7, "p1-3")
    assert sorted(r["page"] for r in one.collect()) == [0, 1, 2]
    assert "EqualTo(doc_id,7)" in one._jdf.queryExecution().toString()
    writers.write_ordered(pages.withColumn("part", F.lit("x")), str(tmp_path / "p" / "pages"), ["doc_id"], "lost")  # its manifest never came
    assert writers.read_parts(spark, str(tmp_path / "p")).count() == 2000
    # names that are numbers in one table and not in the other
    for commit in ("1", "007"):
        writers.write_parts(P.split_every(pages.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + int(commit)), 3), str(tmp_path / "q"), commit)
    writers.write_ordered(pages.withColumn("part", F.lit("x")), str(tmp_path / "q" / "pages"), ["doc_id"], "lost")
    assert writers.read_parts(spark, str(tmp_path / "q")).count() == 40
    assert {r["commit"] for r in writers.read_manifest(spark, str(tmp_path / "q")).select("commit").collect()} == {"1", "007"}


def test_files_of_a_folder(spark, tmp_path):
    for name in ("a/2.PDF", "a/1.png", "a/deep/x.csv", "b/10.docx", "b/9.jpg", "b/note.txt", "c/none"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    files = readers.list_files(spark, str(tmp_path))
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan and "content" not in plan
    got = {r["batch"].removeprefix(f"file:{tmp_path}/"): (r["ord"], r["route"], r["length"]) for r in readers.route_files(files).collect()}
    assert got == {"a": ("2.PDF", "pdf", 5), "a/deep": ("x.csv", "convert", 5), "b": ("10.docx", "convert", 5)}


def test_sheets_in_order(spark):
    a, b = spark.createDataFrame([(10, "x"), (9, None), (None, None)], "k int, v string"), spark.createDataFrame([(2**40,)], "k long")
    out = readers.fixed_width_sheets([("one", a, ["k"]), ("two", b, ["k"])]).orderBy("sheet", "part", "key").collect()
    assert [r["text"].rstrip() for r in out] == ["# one", "9", "10               x", "", "# two", str(2**40), ""]


def test_engines_by_name(spark, tmp_path):
    def loading(name):
        def load():
            with open(tmp_path / f"loads-{name}", "a") as f:
                f.write(".")

            def call(contents):
                if "bad" in contents:
                    raise ValueError("no")
                return [[{"text": f"{name}:{c}:{len(contents)}", "quad": [0.0] * 8}] for c in contents]

            return call

        return load

    rows = [(i, 0, ["a", "b", "c", None][i % 4], "bad" if i == 8 else f"t{i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "doc_id long, page int, engine string, content string").repartition(2).cache()
    out = {r["doc_id"]: r for r in regions.recognize_by_name(pages, {"a": regions.Engine(loading("a"), 5), "b": regions.Engine(loading("b"), 1)}).collect()}
    assert len(out) == 40 and out[8]["error"] == "no" and out[8]["regions"] == []
    assert all(out[i]["regions"][0]["text"].startswith(f"a:t{i}:") for i in range(0, 40, 4) if i != 8) and out[1]["regions"][0]["text"] == "b:t1:1"
    assert out[2]["error"] == "no engine c" and out[3]["error"] == "no engine is named"
    # a worker loads an engine once, however many tasks it runs
    assert len((tmp_path / "loads-a").read_text()) <= 4
    pages.unpersist()
