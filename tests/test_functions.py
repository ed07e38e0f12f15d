import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import runs as R
from quire.functions import text as X
from quire.functions.stats import modal_first, upper_median


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_trim_markers_and_labels(spark):
    texts = ["  a﻿ ", "• x", "1. x", "iv. x", "- x", "-x", "« Abc", "« abc", "Date signed", "SIGN HERE ▼", "designation", "éSign", "my initials"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    rows = {r[0]: r for r in df.select("t", X.js_trim(c), X.is_list_marker(c), X.is_misread_bullet(c), X.label_kind(c), X.canonical_bullet(c), X.strip_bullet(c)).collect()}
    assert rows["  a﻿ "][1] == "a"
    assert [t for t in texts if rows[t][2]] == ["• x", "1. x", "iv. x", "- x"]
    assert [t for t in texts if rows[t][3]] == ["« Abc"] and rows["« Abc"][5] == "• Abc"
    assert rows["Date signed"][4] == "date" and rows["SIGN HERE ▼"][4] == "signature" and rows["designation"][4] is None
    assert rows["éSign"][4] == "signature" and rows["my initials"][4] == "initials"
    assert rows["• x"][6] == "x" and rows["1. x"][6] == "1. x"


def test_text_helpers(spark):
    r = one(
        spark, X.normalize_ligatures(F.lit("éﬁn ﬃ")), X.sanitize(F.lit("a\tb\x01c")), X.wrap_text(F.lit("aaa bbb ccc"), 7), X.wrap_text(F.lit("  "), 7), X.wrap_text(F.lit("x abcdefghij y"), 4), X.join_wrapped(F.lit("inter-"), F.lit("national")),
        X.join_wrapped(F.lit("A"), F.lit("b")), X.hex_to_rgb(F.lit("#1af")), X.rgb_to_hex(F.lit(1), F.lit(171), F.lit(255)), X.data_url_bytes(F.lit("data:x;base64,aGk=")), X.url_filename(F.lit("http://a/b?q=1")), X.url_filename(F.lit("http://a/b.PDF#x")), X.ext_of(F.lit("A.b.CSV")), X.is_truncated(F.lit("ab</s> ")),
    )
    assert list(r) == ["éfin ffi", "a    bc", ["aaa bbb", "ccc"], [""], ["x", "abcdefghij", "y"], "international", "A b", (17, 170, 255), "#01abff", bytearray(b"hi"), "b.pdf", "b.PDF", "csv", False]
    sizes = spark.createDataFrame([(0,), (512,), (1024,), (1536,), (1 << 20,), (20 << 20,)], "n long")
    assert [x[0] for x in sizes.select(X.format_bytes(F.col("n"))).collect()] == ["0 B", "512 B", "1.0 KB", "1.5 KB", "1.0 MB", "20 MB"]
    assert one(spark, X.infer_font(F.lit("Georgia-BoldItalic")))[0] == ("Times", True, True)
    assert one(spark, X.standard_font_key(F.lit("Times"), F.lit(True), F.lit(False)))[0] == "Times-b"


def test_geometry(spark):
    q = F.array(*(F.lit(float(v)) for v in (10, 100, 210, 110, 208, 130, 8, 120)))
    assert one(spark, G.quad_rect(q))[0] == (8.0, 100.0, 202.0, 30.0)
    flat = F.array(*(F.lit(5.0) for _ in range(8)))
    assert min(one(spark, G.quad_dims(flat))[0]) > 0
    n = F.lit
    assert one(spark, G.estimate_font_px(n("one"), n(18.0), n(18.0), n(200.0)), G.estimate_font_px(n("a"), n(1.0), n(1.0), n(9.0)), G.estimate_font_px(n("a"), n(400.0), n(400.0), n(400.0)))[:] == (15.0, 4.0, 96.0)
    assert one(spark, G.to_pdf_rect(n(100.0), n(50.0), n(200.0), n(40.0), n(400.0), n(600.0)))[0] == (50.0, 555.0, 100.0, 20.0)
    placed = one(spark, G.place_in_zone(G.box(n(300.0), n(120.0), n(220.0), n(48.0)), n(220.0), n(120.0)), G.place_in_zone(F.lit(None).cast("struct<x:double,y:double,width:double,height:double>"), n(10.0), n(20.0)))
    assert placed[0][:3] == (300.0, 120.0, pytest.approx(88.0)) and placed[1] == (100.0, 100.0, 10.0, 20.0)
    assert one(spark, G.normal_rotation(n(-90)), G.normal_rotation(n(450)), G.js_round(n(-2.5)))[:] == (270, 90, -2)
    assert one(spark, G.crop_region(n(-5.0), n(0.0), n(10.0), n(10.0), n(100.0), n(100.0)), G.crop_region(n(200.0), n(0.0), n(10.0), n(10.0), n(100.0), n(100.0)))[:] == ((0.0, 0.0, 5.0, 10.0), None)
    b = F.struct(n(20.0).alias("x0"), n(30.0).alias("y0"), n(120.0).alias("x1"), n(90.0).alias("y1"))
    assert one(spark, G.ocr_box(b, n(0.5), n(0.25), n(10.0), n(5.0), n(1)))[0] == (20.0, 12.5, 50.0, 15.0, 12.5)
    assert one(spark, G.zone_box(n("date"), n(10.0), n(20.0), n(50.0), n(16.0)))[0] == (72.0, 10.0, 140.0, 36.0)


def test_statistics(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([10.0, 20.0, 30.0, 40.0])], "k int, ord int, v double")
    assert df.agg(upper_median(F.col("v"))).first()[0] == 30.0 and df.where("v > 99").agg(upper_median(F.col("v"))).first()[0] == 0.0
    ties = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 2, 2, 1])], "k int, ord int, v int")
    assert modal_first(ties, ["k"], "v", ["ord"], "m").first()["m"] == 2


def test_runs(spark):
    def runs(*parts):
        none = [F.lit(None).alias(k) for k in ("italic", "color", "font_size", "font_family")]
        return F.array(*(F.struct(F.lit(t).alias("text"), F.lit(b).cast("boolean").alias("bold"), *none) for t, b in parts)).cast(f"array<{R.STYLED_RUN}>")

    patch = F.struct(F.lit(True).alias("bold"), *(F.lit(None).alias(k) for k in ("italic", "color", "font_size", "font_family")))
    text = runs(("Hello world", None))
    formatted = R.apply_format(text, F.lit(6), F.lit(11), patch)
    r = one(spark, formatted, R.apply_format(text, F.lit(3), F.lit(3), patch), R.normalize_runs(runs(("", True))), R.normalize_runs(runs(("a", True), ("", None), ("b", True), ("c", None))), R.split_runs_at(runs(("ab", True), ("cd", None)), F.lit(3)))
    short = lambda rs: [(x["text"], x["bold"]) for x in rs]
    assert short(r[0]) == [("Hello ", None), ("world", True)] and short(r[1]) == [("Hello world", None)]
    assert short(r[2]) == [("", None)] and short(r[3]) == [("ab", True), ("c", None)]
    assert short(r[4]["left"]) == [("ab", True), ("c", None)] and short(r[4]["right"]) == [("d", None)]
    assert one(spark, R.style_active(formatted, F.lit(6), F.lit(9), "bold"), R.style_active(formatted, F.lit(4), F.lit(9), "bold"))[:] == (True, False)
