"""Column functions over boxes, quads and pages. Screen coordinates grow downwards on a
page 800 px wide; PDF coordinates grow upwards in points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schemas import LINE_GAP, VIEWER_WIDTH

MIN_FONT, MAX_FONT, BOLD_SIZE_RATIO = 4.0, 96.0, 1.35


def js_round(c: Column) -> Column:
    """Half goes up, also below zero."""
    return F.floor(c + 0.5)


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def to_pdf_rect(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    s = page_width / VIEWER_WIDTH
    return box(x * s, page_height - (y + height) * s, width * s, height * s)


def run_box(matrix: Column, advance: Column, page_width: Column, page_height: Column) -> Column:
    """A text matrix (six numbers) and an advance width as a screen run."""
    b, d, e, f = (F.element_at(matrix, k) for k in (2, 4, 5, 6))
    s = F.lit(VIEWER_WIDTH) / page_width
    size = F.when(F.hypot(b, d) > 0, F.hypot(b, d)).otherwise(F.abs(d)) * s
    baseline = (page_height - f) * s
    return F.struct(
        (e * s).alias("x"), (baseline - size).alias("y"), F.greatest(advance * s, size * 0.4).alias("width"), (size * LINE_GAP).alias("height"), baseline.alias("baseline"), size.alias("font_size")
    )


def _corner(quad: Column, k: int) -> tuple[Column, Column]:
    return F.element_at(quad, 2 * k + 1), F.element_at(quad, 2 * k + 2)


def quad_rect(quad: Column) -> Column:
    xs, ys = (F.transform(F.sequence(F.lit(s), F.lit(6 + s), F.lit(2)), lambda i: F.get(quad, i)) for s in (0, 1))
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def quad_dims(quad: Column) -> Column:
    """struct(line_height, run_length): the short and the long axis of a quad."""
    tl, tr, br, bl = (_corner(quad, k) for k in range(4))

    def dist(a, b):
        return F.hypot(a[0] - b[0], a[1] - b[1])

    along, across = (dist(tl, tr) + dist(bl, br)) / 2, (dist(tl, bl) + dist(tr, br)) / 2
    rect = quad_rect(quad)
    minor, major = F.least(rect["width"], rect["height"]), F.greatest(rect["width"], rect["height"])

    def positive(value: Column, bound: Column) -> Column:
        bound = F.when(bound != 0, bound).otherwise(value)
        top = F.when(bound * 1.5 != 0, bound * 1.5).otherwise(value)
        return F.when(F.isnan(value) | (value <= 0), F.greatest(bound, F.lit(1.0))).otherwise(F.least(value, top))

    return F.struct(positive(F.least(along, across), minor).alias("line_height"), positive(F.greatest(along, across), major).alias("run_length"))


def estimate_lines(text: Column, run_length: Column, line_height: Column, char_ratio: float = 0.5) -> Column:
    chars = F.length(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", ""))
    explicit = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?U)[^\s\uFEFF]")))
    char_width = F.greatest(F.lit(1.0), line_height / LINE_GAP * char_ratio)
    per_line = F.greatest(F.lit(1.0), run_length / char_width)
    return F.when((chars == 0) | (line_height <= 0), 1).otherwise(F.greatest(F.lit(1), explicit, F.ceil(chars / per_line).cast("int")))


def estimate_font_px(text: Column, rect_height: Column, line_height: Column, run_length: Column) -> Column:
    stacked = F.when(line_height > 0, F.greatest(F.lit(1), js_round(rect_height / F.when(line_height > 0, line_height)).cast("int"))).otherwise(1)
    lines = F.greatest(stacked, estimate_lines(text, run_length, line_height))
    return clamp(rect_height / lines / LINE_GAP, MIN_FONT, MAX_FONT)


def bold_by_size(size: Column, median: Column) -> Column:
    return (median > 0) & (size >= median * BOLD_SIZE_RATIO)


def ocr_box(b: Column, scale_x: Column, scale_y: Column, offset_x: Column, offset_y: Column, line_count: Column) -> Column:
    """A recognised box as a screen item; the font size is for one of its lines."""
    height = (b["y1"] - b["y0"]) * scale_y
    return F.struct(
        (b["x0"] * scale_x + offset_x).alias("x"), (b["y0"] * scale_y + offset_y).alias("y"), ((b["x1"] - b["x0"]) * scale_x).alias("width"), height.alias("height"),
        (height / F.greatest(line_count, F.lit(1)) / LINE_GAP).alias("font_size"),
    )


def crop_region(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """The box clamped to the page; null if nothing is left of it."""
    left, top = clamp(x, 0.0, page_width), clamp(y, 0.0, page_height)
    right, bottom = clamp(x + width, 0.0, page_width), clamp(y + height, 0.0, page_height)
    return F.when((right > left) & (bottom > top), box(left, top, right - left, bottom - top))


def crop_image_px(region: Column, ratio: Column, image_width: Column, image_height: Column) -> Column:
    """A screen region as whole pixels of an image that has ``ratio`` pixels for each
    screen pixel, cut at the image's edges; null if nothing is left of it."""
    x, y = (F.greatest(F.lit(0), js_round(region[c] * ratio)) for c in ("x", "y"))
    width, height = (F.greatest(F.lit(1), js_round(region[c] * ratio)) for c in ("width", "height"))
    width, height = F.least(width, image_width - x), F.least(height, image_height - y)
    return F.when((width > 0) & (height > 0), box(*(v.cast("double") for v in (x, y, width, height))))


def display_scale(shown_width: Column, shown_height: Column, natural_width: Column, natural_height: Column) -> Column:
    """Screen px per image px on each axis."""
    return F.struct((shown_width / natural_width).alias("x"), (shown_height / natural_height).alias("y"))


def ocr_scale(width: Column, height: Column, page_inches: Column, dpi: float = 300.0, most: float = 4.0, longest: float = 4800.0) -> Column:
    """Upscale factor towards ``dpi``, with the longest side bounded."""
    wanted = clamp(F.lit(dpi) / (width / page_inches), 1.0, most)
    return F.least(wanted, F.lit(longest) / F.greatest(width, height))


def overlay_box(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The box of a text that is laid over an item and hides nothing."""
    return box(x, y, F.greatest(width + 8, F.lit(40.0)), F.greatest(height, F.lit(16.0)))


def cover_image(x: Column, y: Column, width: Column, height: Column) -> Column:
    """struct(edit, cover) of an image that replaces another: both are its box as it is."""
    return F.struct(box(x, y, width, height).alias("edit"), box(x, y, width, height).alias("cover"))


def cover_boxes(x: Column, y: Column, width: Column, height: Column) -> Column:
    """struct(edit, cover): the edit box over an item and the padded box that hides it."""
    return F.struct(overlay_box(x, y, width, height).alias("edit"), box(x - 2, y - 2, width + 4, height + 4).alias("cover"))


def image_box(ctm: Column, page_width: Column, page_height: Column) -> Column:
    """The unit square under a six-number matrix as a screen box; null below 8 x 8."""
    a, b, c, d, e, f = (F.element_at(ctm, k) for k in range(1, 7))
    s = F.lit(VIEWER_WIDTH) / page_width
    xs, ys = (e, e + a, e + c, e + a + c), (f, f + b, f + d, f + b + d)
    width, height = (F.greatest(*xs) - F.least(*xs)) * s, (F.greatest(*ys) - F.least(*ys)) * s
    return F.when((width >= 8) & (height >= 8), box(F.least(*xs) * s, (page_height - F.greatest(*ys)) * s, width, height))


# Fixed zone sizes by kind of label, and the gap to the label.
ZONE_SIZES = {"signature": (220.0, 48.0), "initials": (80.0, 40.0), "date": (140.0, 36.0)}
ZONE_GAP = 12.0


def zone_box(kind: Column, x: Column, y: Column, width: Column, height: Column, sizes: dict[str, tuple[float, float]] | None = None) -> Column:
    w = h = F.lit(None).cast("double")
    for name, (sw, sh) in (sizes or ZONE_SIZES).items():
        w, h = F.when(kind == name, F.lit(sw)).otherwise(w), F.when(kind == name, F.lit(sh)).otherwise(h)
    return box(x + width + ZONE_GAP, y + height / 2 - h / 2, w, h)


def place_in_zone(zone: Column, width: Column, height: Column) -> Column:
    """An image fitted into a zone, never enlarged; without a zone at (100, 100)."""
    s = F.least(zone["width"] / width, zone["height"] / height, F.lit(1.0))
    return F.when(zone.isNull(), box(F.lit(100.0), F.lit(100.0), width, height)).otherwise(box(zone["x"], zone["y"], width * s, height * s))


def normal_rotation(c: Column) -> Column:
    return F.pmod(js_round(c / 90) * 90, F.lit(360)).cast("int")


def page_height(width: Column, height: Column) -> Column:
    """Screen height of a page; Letter if the size is not known."""
    return F.coalesce(F.lit(VIEWER_WIDTH) / F.nullif(width, F.lit(0.0)) * height, F.lit(1035.0))


def markup(kind: Column, rect: Column) -> Column:
    """struct(opacity, thickness, rule_y, pin) of a mark on a PDF rect."""
    thick = F.greatest(F.lit(1.0), rect["height"] * 0.08)
    return F.struct(
        F.when(kind == "highlight", 0.4).alias("opacity"),
        F.when(kind.isin("underline", "strikeout"), thick).alias("thickness"),
        F.when(kind == "underline", rect["y"] + thick).when(kind == "strikeout", rect["y"] + rect["height"] / 2).alias("rule_y"),
        F.when(kind == "comment", clamp(rect["width"], 14.0, 22.0)).alias("pin"),
    )


def align_offset(align: Column, box_width: Column, line_width: Column) -> Column:
    free = box_width - line_width
    return F.when(align == "center", free / 2).when(align == "right", free).otherwise(F.lit(0.0))


def baseline_y(page_height: Column, y: Column, scale: Column, font_size: Column, line: Column) -> Column:
    """PDF baseline of a box's line (from 0): one font size below the box's top, then 1.15
    font sizes a line, whatever the sizes of its runs."""
    size = font_size * scale
    return page_height - y * scale - size - line * size * 1.15
