"""Joins by overlap, nearness and interval. Each keeps (doc_id, page) as equality keys, and
joins of boxes a tile of the page too, so that no plan is a nested loop and a dense page costs
no more than its boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quire.functions.geometry import page_height

PAGE = ["doc_id", "page"]
#: Sides of the tiles, finest first; an item belongs to the finest grid whose tiles are larger
#: than it is, a still larger one to the page as a whole.
TILES = (64.0, 1024.0)
#: A cover that touches more tiles of a grid than this meets all items of its page.
MAX_TILES = 1024


def _covers(covers: DataFrame) -> DataFrame:
    return covers.select(F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), *(F.col(k).alias(f"_{k}") for k in ("x", "y", "width", "height")))


def _tile(level: Column | int, x: Column, y: Column) -> Column:
    return F.xxhash64(F.lit(level), x, y)  # tiles of one number meet, but only boxes that overlap count


def _own_tile(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The one tile that an item belongs to: where its upper left corner lies."""
    out = F.lit(0).cast("long")
    for level in reversed(range(len(TILES))):
        side = TILES[level]
        out = F.when(F.greatest(width, height) <= side, _tile(level, F.floor(x / side), F.floor(y / side))).otherwise(out)
    return out


def _span(low: Column, size: Column, side: float) -> tuple[Column, Column]:
    """First and last tile whose items may reach into [low, low + size]."""
    return F.floor(low / side) - 1, F.floor((low + size) / side)


def _rectangle(level: int, across: Column, down: Column) -> Column:
    return F.flatten(F.transform(across, lambda i: F.transform(down, lambda j: _tile(level, i, j))))


def _tiles_of(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The tiles, of all grids, that may hold an item which overlaps the cover; null if they
    are too many."""
    parts, many = [F.array(F.lit(0).cast("long"))], F.lit(False)
    for level, side in enumerate(TILES):
        (x0, x1), (y0, y1) = _span(x, width, side), _span(y, height, side)
        many = many | ((x1 - x0 + 1).cast("double") * (y1 - y0 + 1) > MAX_TILES) | F.coalesce((x1 < x0) | (y1 < y0), F.lit(True))
        parts.append(_rectangle(level, F.when(~many, F.sequence(x0, x1)), F.sequence(y0, y1)))
    return F.when(~many, F.concat(*parts))


def uncovered_items(items: DataFrame, covers: DataFrame) -> DataFrame:
    """Items that no cover box of their page overlaps (touching edges do not count).

    An item lies in one tile; covers are copied to the tiles around them, of each of two grids,
    so that an item meets covers near it only."""
    c = _covers(covers)
    box = [F.col(f"_{k}") for k in ("x", "y", "width", "height")]
    tiled = c.withColumn("_tiles", _tiles_of(*box))
    near = tiled.select("*", F.explode("_tiles").alias("_at")).drop("_tiles")
    wide = tiled.where("_tiles is null").drop("_tiles")
    overlap = (F.col("x") < F.col("_x") + F.col("_width")) & (F.col("x") + F.col("width") > F.col("_x")) & (F.col("y") < F.col("_y") + F.col("_height")) & (F.col("y") + F.col("height") > F.col("_y"))
    own = items.withColumn("_tile", _own_tile(*(F.col(k) for k in ("x", "y", "width", "height"))))
    page = (own["doc_id"] == F.col("_doc")) & (own["page"] == F.col("_page"))
    left = own.join(near.hint("merge"), page & (F.col("_tile") == F.col("_at")) & overlap, "left_anti")
    return left.join(wide.hint("merge"), page & overlap, "left_anti").drop("_tile")


def unreplaced_images(images: DataFrame, covers: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Image boxes without a cover that begins within ``tolerance`` px of theirs. Corners lie
    in cells as wide as the tolerance; a cover is copied to its cell's neighbours."""
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    c = _covers(covers).withColumn("_n", F.explode(around))
    c = c.select("*", (F.floor(F.col("_x") / tolerance) + F.col("_n.i")).alias("_i"), (F.floor(F.col("_y") / tolerance) + F.col("_n.j")).alias("_j")).drop("_n")
    near = (F.abs(F.col("x") - F.col("_x")) < tolerance) & (F.abs(F.col("y") - F.col("_y")) < tolerance)
    cell = (F.floor(images["x"] / tolerance) == F.col("_i")) & (F.floor(images["y"] / tolerance) == F.col("_j"))
    return images.join(c.hint("merge"), (images["doc_id"] == F.col("_doc")) & (images["page"] == F.col("_page")) & cell & near, "left_anti")


def pick_sub_item(points: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Points (doc_id, page, block, x) with the sub item under x, else the first one. Points
    that carry their block's ``sub_items`` need no blocks, and no join."""
    keys = [*PAGE, "block"]
    under = F.filter("sub_items", lambda s: (F.col("px") >= s["x"]) & (F.col("px") <= s["x"] + s["width"]))
    joined = points.withColumnRenamed("x", "px")
    if blocks is not None:
        joined = joined.join(blocks.select(*keys, "sub_items").hint("merge"), keys)
    return joined.withColumn("picked", F.coalesce(F.get(under, F.lit(0)), F.get("sub_items", F.lit(0)))).drop("sub_items")


def page_offsets(pages: DataFrame, gap: float = 24.0) -> DataFrame:
    """Pages (doc_id, page, width, height) with screen height, top and end."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    sized = pages.withColumn("screen_height", page_height(F.col("width"), F.col("height")))
    top = F.coalesce(F.sum(F.col("screen_height") + gap).over(w), F.lit(0.0))
    return sized.withColumn("top", top).withColumn("end", F.col("top") + F.col("screen_height") + gap)


def page_at_offset(offsets: DataFrame, pages: DataFrame) -> DataFrame:
    """For each (doc_id, offset) the first page that ends beyond it, else the document's first
    page, and page 0 where there is none. Pages and offsets are sorted together from the last
    one back, and each offset takes what was seen last: a document is read once, and neither
    its pages nor its offsets are gathered."""
    carried = [c for c in offsets.columns if c not in ("doc_id", "offset")]
    asked = offsets.select("doc_id", F.col("offset").cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_page"), F.struct(F.col("offset").alias("offset"), *carried).alias("_row"))
    none = F.lit(None).cast(asked.schema["_row"].dataType).alias("_row")
    ends = pages.select("doc_id", F.col("end").cast("double").alias("_at"), F.lit(2).alias("_kind"), F.col("page").cast("int").alias("_page"), none)
    first = pages.groupBy("doc_id").agg(F.min("page").cast("int").alias("_page")).select("doc_id", F.lit(float("inf")).alias("_at"), F.lit(0).alias("_kind"), "_page", none)
    # a page that ends at the offset itself comes after it, and of pages with one end the first comes last
    back = Window.partitionBy("doc_id").orderBy(F.desc("_at"), "_kind", F.desc("_page")).rowsBetween(Window.unboundedPreceding, 0)
    seen = first.unionByName(ends).unionByName(asked).withColumn("page", F.last("_page", ignorenulls=True).over(back))
    return seen.where("_kind = 1").select("doc_id", "_row.*", F.coalesce("page", F.lit(0)).alias("page"))


#: Cells of a page's sums that are held at a time; a larger page is summed in strips.
MAX_CELLS = 4_000_000


def _shares(boxes: np.ndarray, pixels: np.ndarray, dark: int) -> np.ndarray:
    """The share of dark pixels (rows x, y, r) of each box (rows x0, y0, x1, y1) of a page, from
    sums over all pixels above and to the left of a place: four of them give a box's count,
    whatever its area."""
    count, hits = np.zeros(len(boxes), np.int64), np.zeros(len(boxes), np.int64)
    if not len(pixels):
        return np.zeros(len(boxes))
    columns, x = np.unique(pixels[:, 0], return_inverse=True)
    rows, y = np.unique(pixels[:, 1], return_inverse=True)
    is_dark = pixels[:, 2] < dark
    left, right = (np.searchsorted(columns, v) for v in (np.floor(boxes[:, 0]), np.ceil(boxes[:, 2])))
    top, end = (np.searchsorted(rows, v) for v in (np.floor(boxes[:, 1]), np.ceil(boxes[:, 3])))
    right, end = np.maximum(left, right), np.maximum(top, end)
    step, order = max(1, MAX_CELLS // (len(columns) + 1)), np.argsort(y, kind="stable")
    bounds = np.searchsorted(y[order], np.arange(0, len(rows) + step, step))
    for k, low in enumerate(range(0, len(rows), step)):
        part = order[bounds[k] : bounds[k + 1]]
        n = min(step, len(rows) - low)
        t, e = (np.clip(v - low, 0, n) for v in (top, end))
        places = (y[part] - low + 1) * (len(columns) + 1) + x[part] + 1
        for out, weight in ((count, None), (hits, is_dark[part])):
            sums = np.bincount(places, weight, (n + 1) * (len(columns) + 1)).astype(np.int64).reshape(n + 1, -1)
            sums = sums.cumsum(0).cumsum(1)
            out += sums[e, right] - sums[t, right] - sums[e, left] + sums[t, left]
    return hits / np.maximum(count, 1)


def ink_density(boxes: DataFrame, pixels: DataFrame, dark: int = 128) -> DataFrame:
    """Adds ``density``, the share of dark pixels in each box (doc_id, page, box, x0..y1); 0 for
    a box without pixels. A page's pixels are summed once, for all its boxes: both come to a
    task in order of the pages, and it holds one page at a time."""
    values = ["_0", "_1", "_2", "_3"]
    keys = boxes.select(*PAGE, "box").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def shares(t: pa.Table) -> pa.RecordBatch:
            numbers = np.column_stack([t.column(c).to_numpy() for c in values])
            is_box = t.column("_box").to_numpy()
            at = np.flatnonzero(is_box)
            found = _shares(numbers[at], numbers[~is_box], dark)
            kept = t.select([*PAGE, "box"]).take(pa.array(at)).combine_chunks()
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in kept.columns), pa.array(found)], names=[*PAGE, "box", "density"])

        for b in batches:
            t = pa.Table.from_batches([b])
            ends = [0]
            if t.num_rows:
                before = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), t.slice(0, t.num_rows - 1)]) if held else t.slice(0, t.num_rows - 1)
                after = t if held else t.slice(1)
                turn = np.zeros(after.num_rows, bool)
                for c in PAGE:
                    turn |= pc.not_equal(before.column(c), after.column(c)).to_numpy()
                ends = [0, *(np.flatnonzero(turn) + (0 if held else 1)).tolist()]
            for i, j in zip(ends, ends[1:]):
                held.append(t.slice(i, j - i))
                whole = pa.concat_tables(held)
                held = []
                if whole.num_rows:
                    yield shares(whole)
            held.append(t.slice(ends[-1]))
        if held:
            yield shares(pa.concat_tables(held))

    asked = boxes.where(F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("y0").isNotNull() & F.col("y1").isNotNull() & F.col("doc_id").isNotNull() & F.col("page").isNotNull())
    inked = pixels.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("r").isNotNull() & F.col("doc_id").isNotNull() & F.col("page").isNotNull())
    number = lambda *cs: [F.col(c).cast("double").alias(v) for c, v in zip(cs, values)]
    rows = asked.select(*PAGE, "box", F.lit(True).alias("_box"), *number("x0", "y0", "x1", "y1"))
    dots = inked.select(*(F.col(c).cast(keys[c].dataType).alias(c) for c in PAGE), F.lit(None).cast(keys["box"].dataType).alias("box"), F.lit(False).alias("_box"), *number("x", "y", "r"), F.lit(0.0).alias("_3"))
    both = rows.unionByName(dots).repartition(*PAGE).sortWithinPartitions(*PAGE)
    found = both.mapInArrow(run, StructType([*keys, StructField("density", DoubleType())]))
    return boxes.join(found.hint("merge"), [*PAGE, "box"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))
