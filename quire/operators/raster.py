"""Column arithmetic and aggregates over pixel tables (img_id, x, y, r, g, b, a)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.geometry import clamp, js_round
from quire.functions.stats import counted_middle
from quire.functions.text import hex_to_rgb, rgb_to_hex


def luminance() -> Column:
    return F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114


def key_out(pixels: DataFrame, threshold: float = 0.6, softness: float = 0.25, ink: str = "#111827", contrast: float = 0.35) -> DataFrame:
    """Paper becomes transparent and ink takes one colour; between the two a soft band."""
    low, high = max(0.0, threshold - max(softness, 0.001)), threshold
    gamma = 1 / (1 + max(0.0, min(1.0, contrast)) * 3)
    lum = luminance() / 255
    ramp = 1 - (lum - low) / (high - low)
    alpha = F.when(lum <= low, 1.0).when(lum >= high, 0.0).otherwise(F.pow(ramp, F.lit(gamma)))
    colour = hex_to_rgb(F.lit(ink))
    a = js_round(alpha * (F.col("a") / 255) * 255).cast("int")
    return pixels.select("img_id", "x", "y", *(colour[k].alias(k) for k in "rgb"), a.alias("a"))


def grayscale_contrast(pixels: DataFrame, k: float = 1.35) -> DataFrame:
    v = clamp((luminance() - 128) * k + 128, 0.0, 255.0)
    return pixels.select("img_id", "x", "y", *(js_round(v).cast("int").alias(c) for c in "rgb"), "a")


def crop_pixels(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    inside = (F.col("x") >= max(0, x)) & (F.col("x") < x + width) & (F.col("y") >= max(0, y)) & (F.col("y") < y + height)
    return pixels.where(inside).withColumn("x", F.col("x") - max(0, x)).withColumn("y", F.col("y") - max(0, y))


def ink_bounds(pixels: DataFrame, alpha_floor: int = 8) -> DataFrame:
    """(img_id, x, y, width, height) of the visible ink; images without any have no row."""
    g = pixels.where(F.col("a") > alpha_floor).groupBy("img_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("_x"), F.max("y").alias("_y"))
    return g.select("img_id", "x", "y", (F.col("_x") - F.col("x") + 1).alias("width"), (F.col("_y") - F.col("y") + 1).alias("height"))


def padded_bounds(bounds: DataFrame, sizes: DataFrame, pad: float = 0.04) -> DataFrame:
    """Ink bounds widened by ``pad`` of their own size on each side, within the image
    (img_id, image_width, image_height); an image without ink has its whole area."""
    joined = sizes.join(bounds, "img_id", "left")
    px, py = F.col("width") * pad, F.col("height") * pad
    left, top = F.greatest(F.lit(0.0), F.col("x") - px), F.greatest(F.lit(0.0), F.col("y") - py)
    return joined.select(
        "img_id", F.coalesce(left, F.lit(0.0)).alias("x"), F.coalesce(top, F.lit(0.0)).alias("y"),
        F.coalesce(F.least(F.col("image_width") - left, F.col("width") + 2 * px), F.col("image_width").cast("double")).alias("width"),
        F.coalesce(F.least(F.col("image_height") - top, F.col("height") + 2 * py), F.col("image_height").cast("double")).alias("height"),
    )


#: Pixels of a stretch of a row; a strip meets the pixels of its own rows and stretches only.
STRETCH = 64


def background_color(boxes: DataFrame, pixels: DataFrame) -> DataFrame:
    """Adds ``background`` to boxes (img_id, box, x, y, width, height): the upper median of
    each channel in a strip just above the box; white where there is no pixel. Values are
    counted, 256 at most for each channel, and never listed."""
    top = F.greatest(F.lit(0), js_round(F.col("y") - 4))
    left = F.greatest(F.lit(0), js_round(F.col("x")))
    spans = boxes.select("img_id", "box", left.alias("_l"), (left + F.greatest(F.lit(1), js_round(F.col("width")))).alias("_r"), top.alias("_t"), (top + F.greatest(F.lit(1), js_round(F.least(F.col("height"), F.lit(6.0))))).alias("_b"))
    spans = spans.withColumn("_y", F.explode(F.sequence("_t", F.col("_b") - 1))).withColumn("_s", F.explode(F.sequence(F.floor(F.col("_l") / STRETCH), F.floor((F.col("_r") - 1) / STRETCH))))
    p = pixels.select("img_id", F.col("x").alias("_x"), F.col("y").cast("long").alias("_y"), F.floor(F.col("x") / STRETCH).alias("_s"), "r", "g", "b")
    hits = p.join(spans.hint("merge"), ["img_id", "_y", "_s"]).where((F.col("_x") >= F.col("_l")) & (F.col("_x") < F.col("_r")))
    channels = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("int").alias("v")) for c in "rgb")))
    counted = hits.select("img_id", "box", channels.alias("_c")).groupBy("img_id", "box", "_c.c", "_c.v").agg(F.count("*").alias("n"))
    values = counted.groupBy("img_id", "box", "c").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("_h"), F.sum("n").alias("_n"))
    middle = values.select("img_id", "box", "c", counted_middle(F.col("_h"), F.col("_n")).alias("v"))
    one = lambda c: F.max(F.when(F.col("c") == c, F.col("v"))).alias(c)
    named = middle.groupBy("img_id", "box").agg(*(one(c) for c in "rgb")).select("img_id", "box", rgb_to_hex(*(F.col(c) for c in "rgb")).alias("background"))
    return boxes.join(named.hint("merge"), ["img_id", "box"], "left").withColumn("background", F.coalesce("background", F.lit("#ffffff")))
