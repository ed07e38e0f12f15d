"""More registered queries: page elements, marks, page operations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import runs as R
from quire.functions import text as X
from quire.operators import fonts, pages, raster, regions
from quire.plans.layout_queries import _PIXELS, BOXES, boxes, pixels, query, rounded, styled_turns, table
from quire.sources import readers

_RECT = ("x", "y", "width", "height")


def _named(df, rect, *keys):
    """``keys`` and the rounded fields of ``rect``, where there is one."""
    return df.select(*keys, rect.alias("r")).where("r is not null").select(*keys, *(F.round(f"r.{c}", 6).alias(c) for c in _RECT))


def _rect():
    return [F.col(c) for c in _RECT]


@query(
    f"WITH {BOXES}, c AS (SELECT doc_id, page, ord, greatest(x - 20, 0) AS l, greatest(least(y - 20, 700), 0) AS t, least(x - 20 + 3 * width, 700) AS r, greatest(least(y - 20 + 2 * height, 700), 0) AS b FROM boxes)"
    " SELECT doc_id, page, ord, round(l, 6) AS x, round(t, 6) AS y, round(r - l, 6) AS width, round(b - t, 6) AS height FROM c WHERE r > l AND b > t"
)
def crop_regions(spark, sf_dir):
    x, y, width, height = _rect()
    return _named(boxes(spark, sf_dir), G.crop_region(x - 20, y - 20, width * 3, height * 2, F.lit(700.0), F.lit(700.0)), "doc_id", "page", "ord")


@query(
    f"WITH {BOXES}, m AS (SELECT *, ['highlight', 'underline', 'strikeout', 'comment'][supp % 4 + 1] AS kind, greatest(1, 0.08e0 * height) AS thick FROM boxes)"
    " SELECT doc_id, page, ord, kind, CASE WHEN kind = 'highlight' THEN 0.4e0 END AS opacity, CASE WHEN kind IN ('underline', 'strikeout') THEN round(thick, 6) END AS thickness,"
    " CASE kind WHEN 'underline' THEN round(y + thick, 6) WHEN 'strikeout' THEN round(y + height / 2, 6) END AS rule_y, CASE WHEN kind = 'comment' THEN greatest(least(width, 22), 14)::DOUBLE END AS pin FROM m"
)
def markup_rules(spark, sf_dir):
    kind = F.element_at(F.array(*(F.lit(k) for k in ("highlight", "underline", "strikeout", "comment"))), (F.col("supp") % 4 + 1).cast("int"))
    df = boxes(spark, sf_dir).withColumn("kind", kind).withColumn("m", G.markup(F.col("kind"), G.box(*_rect())))
    return df.select("doc_id", "page", "ord", "kind", "m.opacity", F.round("m.thickness", 6).alias("thickness"), F.round("m.rule_y", 6).alias("rule_y"), F.col("m.pin").cast("double").alias("pin"))


@query(
    f"WITH {BOXES}, s AS (SELECT *, least(width / 220, height / 120, 1) AS s FROM boxes) SELECT doc_id, page, ord, x, y, round(220 * s, 6) AS width, round(120 * s, 6) AS height FROM s"
)
def zone_placements(spark, sf_dir):
    return _named(boxes(spark, sf_dir), G.place_in_zone(G.box(*_rect()), F.lit(220.0), F.lit(120.0)), "doc_id", "page", "ord")


@query(
    f"WITH {BOXES} SELECT doc_id, page, ord, round(x * 800 / 612, 6) AS x, round((792 - y - height) * 800 / 612, 6) AS y, round(width * 800 / 612, 6) AS width, round(height * 800 / 612, 6) AS height FROM boxes WHERE width * 800 / 612 >= 8 AND height * 800 / 612 >= 8"
)
def image_boxes(spark, sf_dir):
    zero = F.lit(0.0)
    ctm = F.array(*(F.col(c).cast("double") if isinstance(c, str) else c for c in ("width", zero, zero, "height", "x", "y")))
    return _named(boxes(spark, sf_dir), G.image_box(ctm, F.lit(612.0), F.lit(792.0)), "doc_id", "page", "ord")


@query(
    """WITH p AS (SELECT o_orderkey AS doc_id, (o_custkey % 4 * 90)::INT AS src, ((floor(o_orderkey % 8 * 45 / 90.0 + 0.5) * 90) % 360)::INT AS norm, o_custkey % 500 AS l, o_orderkey % 300 AS b,
  o_custkey % 5 = 0 AS own FROM orders
), r AS (SELECT *, CASE WHEN norm <> 0 THEN norm ELSE src END AS rot, CASE WHEN own THEN 10 ELSE 0 END AS ox, CASE WHEN own THEN 20 ELSE 0 END AS oy, CASE WHEN own THEN 500 ELSE 612 END AS ow, CASE WHEN own THEN 700 ELSE 792 END AS oh FROM p
), s AS (SELECT *, CASE WHEN rot % 180 = 0 THEN 612 ELSE 792 END / 800.0e0 AS s FROM r
), c AS (SELECT *, ow - 2 * l * s AS w, oh - b * s AS h FROM s)
SELECT doc_id, rot AS rotation_out, CASE WHEN w > 0 AND h > 0 THEN round(ox + l * s, 6) END AS crop_x, CASE WHEN w > 0 AND h > 0 THEN round(oy + b * s, 6) END AS crop_y,
  CASE WHEN w > 0 AND h > 0 THEN round(w, 6) END AS crop_width, CASE WHEN w > 0 AND h > 0 THEN round(h, 6) END AS crop_height FROM c"""
)
def page_operations(spark, sf_dir):
    """Turned and cropped sheets; one in five has a crop box of its own."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page"), "o_custkey")
    own = F.when(F.col("o_custkey") % 5 == 0, G.box(F.lit(10.0), F.lit(20.0), F.lit(500.0), F.lit(700.0)))
    sheets = o.select("doc_id", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), (F.col("o_custkey") % 4 * 90).cast("int").alias("source_rotation"), own.alias("source_crop"))
    side, low = (F.col("o_custkey") % 500).cast("double"), (F.col("doc_id") % 300).cast("double")
    crop = F.struct(F.lit(0.0).alias("top"), side.alias("right"), low.alias("bottom"), side.alias("left"))
    ops = o.select("doc_id", "page", (F.col("doc_id") % 8 * 45).alias("rotation"), crop.alias("crop"))
    done = pages.apply_page_ops(sheets, ops)
    return done.select("doc_id", "rotation_out", *(F.round(f"crop_box.{c}", 6).alias(f"crop_{c}") for c in _RECT))


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id").withColumn("page", F.col("turn").cast("int"))


@query("SELECT conv_id AS doc_id, turn::INT AS page, role = 'user' AS live FROM conversations")
def live_and_deleted_pages(spark, sf_dir):
    every = _turns(spark, sf_dir)
    order, every = every.where("role = 'user'"), every.select("doc_id", "page")
    return pages.live_pages(every, order).withColumn("live", F.lit(True)).union(pages.live_pages(every, order, live=False).withColumn("live", F.lit(False)))


@query("SELECT conv_id AS doc_id, conv_id % 3 = 0 AND count(*) > 1 AS reordered FROM conversations GROUP BY conv_id")
def reordered_docs(spark, sf_dir):
    """Every third document has its pages in reverse."""
    every = _turns(spark, sf_dir)
    counts = every.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    page = F.when(F.col("doc_id") % 3 == 0, F.col("page_count") - 1 - F.col("page")).otherwise(F.col("page"))
    order = every.join(counts, "doc_id").select("doc_id", F.col("page").alias("pos"), page.alias("page"))
    return pages.is_reordered(order, counts)


@query(
    "WITH c AS (SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY conv_id), o AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [n, 0, n] ELSE range(0, n) END AS o FROM c) SELECT doc_id, unnest(range(0, len(o)))::INT AS pos, unnest(o)::INT AS page FROM o"
)
def seeded_orders(spark, sf_dir):
    """Every third document has an order already, which stays as it is."""
    docs = _turns(spark, sf_dir).groupBy("doc_id").agg(F.count("*").cast("int").alias("pages"))
    return pages.seed_order(docs.withColumn("order", F.when(F.col("doc_id") % 3 == 0, F.array(F.col("pages"), F.lit(0), F.col("pages")))))


@query(
    "WITH g AS (SELECT conv_id AS doc_id, count(*) FILTER (length(text) % 11 <> 0) AS done, count(*) FILTER (length(text) % 11 = 0) AS failed, count(*) + conv_id % 2 AS total, coalesce(list_sort(list(turn + 1) FILTER (length(text) % 3 <> 0)), []) AS cut FROM conversations GROUP BY conv_id)"
    " SELECT doc_id, done, failed, total, concat(array_to_string(cut[1:5], ', '), CASE WHEN len(cut) > 5 THEN '…' ELSE '' END) AS truncated, done + failed < total AS cancelled FROM g"
)
def recognition_report(spark, sf_dir):
    every, size = _turns(spark, sf_dir), F.length("text")
    results = every.select("doc_id", "page", F.when(size % 11 == 0, "bad").alias("error"), (size % 3 != 0).alias("truncated"))
    totals = every.groupBy("doc_id").agg(F.count("*").alias("page_count")).withColumn("page_count", F.col("page_count") + F.col("doc_id") % 2)
    return regions.ocr_report(results, totals)


@query(
    "WITH c AS (SELECT conv_id AS doc_id, role = 'user' AS bold, sum(length(text)) OVER w AS stop, sum(length(text)) OVER w - length(text) AS start FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
    " SELECT doc_id, coalesce(bool_and(bold) FILTER (stop > 5 AND start < 900), false) AS bold FROM c GROUP BY doc_id"
)
def bold_ranges(spark, sf_dir):
    return styled_turns(spark, sf_dir).select("doc_id", R.style_active(F.col("runs"), F.lit(5), F.lit(900), "bold").alias("bold"))


@query("SELECT DISTINCT p_size AS doc_id, unnest([p_brand, p_type]) AS family FROM part")
def embedded_families(spark, sf_dir):
    run = F.struct(F.col("p_type").alias("font_family"))
    return fonts.families_used(table(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), F.col("p_brand").alias("font_family"), F.array(run).alias("runs")))


@query(
    "WITH n AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT * o_custkey * 2 + 1 AS n FROM orders), v AS (SELECT *, CASE WHEN n >= 1024 ** 3 THEN n / 1024 ** 3 WHEN n >= 1024 ** 2 THEN n / 1024 ** 2 ELSE n / 1024 END AS v, CASE WHEN n >= 1024 ** 3 THEN 'GB' WHEN n >= 1024 ** 2 THEN 'MB' ELSE 'KB' END AS u FROM n)"
    " SELECT o_orderkey, CASE WHEN n < 1024 THEN concat(n, ' B') WHEN v < 10 THEN concat(printf('%.1f', v), ' ', u) ELSE concat(printf('%.0f', v), ' ', u) END AS size_text FROM v"
)
def size_texts(spark, sf_dir):
    n = F.floor("o_totalprice").cast("long") * F.col("o_custkey") * 2 + 1
    return table(spark, sf_dir, "orders").select("o_orderkey", X.format_bytes(n).alias("size_text"))


_EXT = {"signup": ".docx", "click": ".PNG", "view": ".txt", "purchase": ".pdf", "error": ".csv"}


@query(
    "WITH l AS (SELECT user_id AS batch, event_id AS ord, CASE event_type WHEN 'signup' THEN 'docx' WHEN 'click' THEN 'png' WHEN 'purchase' THEN 'pdf' WHEN 'error' THEN 'csv' END AS ext FROM events)"
    " SELECT batch, ord, CASE ext WHEN 'pdf' THEN 'pdf' WHEN 'png' THEN 'image' ELSE 'convert' END AS route FROM l WHERE ext IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch ORDER BY CASE ext WHEN 'pdf' THEN 0 WHEN 'png' THEN 1 ELSE 2 END, ord) = 1"
)
def file_routes(spark, sf_dir):
    """One user's events as files that are opened together."""
    ext = F.lit(".txt")
    for kind, end in _EXT.items():
        ext = F.when(F.col("event_type") == kind, F.lit(end)).otherwise(ext)
    listing = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("ord"), F.concat(F.lit("f."), F.col("event_id").cast("string"), ext).alias("path"))
    return readers.route_files(listing, has_document=True).select("batch", "ord", "route")


@query(
    "WITH s AS (SELECT o_orderkey, 100 + o_custkey % 5000 AS w, 100 + o_orderkey % 7000 AS h FROM orders) SELECT o_orderkey, round(least(greatest(least(300 / (w / 8.5e0), 4), 1), 4800.0e0 / greatest(w, h)), 6) AS scale, round(800.0e0 / w, 6) AS shown_x, round(1035.0e0 / h, 6) AS shown_y FROM s"
)
def image_scales(spark, sf_dir):
    w, h = (F.lit(100) + F.col("o_custkey") % 5000).cast("double"), (F.lit(100) + F.col("o_orderkey") % 7000).cast("double")
    shown = G.display_scale(F.lit(800.0), F.lit(1035.0), w, h)
    return table(spark, sf_dir, "orders").select("o_orderkey", G.ocr_scale(w, h, F.lit(8.5)).alias("scale"), shown["x"].alias("shown_x"), shown["y"].alias("shown_y")).select("o_orderkey", *rounded("scale", "shown_x", "shown_y"))


@query(f"WITH {_PIXELS} SELECT img_id, x - 2 AS x, y - 3 AS y FROM px WHERE x >= 2 AND x < 9 AND y >= 3 AND y < 8")
def cropped_pixels(spark, sf_dir):
    return raster.crop_pixels(pixels(spark, sf_dir), 2, 3, 7, 5).select("img_id", "x", "y")
