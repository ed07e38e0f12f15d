"""Styled runs wrapped into lines of a box."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from quire.functions.geometry import align_offset, baseline_y
from quire.functions.runs import STYLE, resolve_style
from quire.functions.text import hex_to_rgb, standard_font_key

#: More (font, character) widths than this, some 30 MB in a worker, are not sent to all tasks.
MAX_WIDTHS = 200_000
#: Segments, and characters of them, that a worker gathers before it gives them on.
OUT_ROWS, OUT_CHARS = 5_000, 1 << 20
#: Tokens whose widths a worker remembers, and the most characters of such a token.
SEEN_TOKENS, SEEN_CHARS = 100_000, 64
#: Tokens that a worker takes out of a run at a time.
TAKEN = 1_000
#: A line break, white space without one, or a word.
_TOKEN = r"(?U)\n|[\s\uFEFF&&[^\n]]+|[^\s\uFEFF]+"
_SEGMENT = {"line": pa.int32(), "segment": pa.int32(), "text": pa.string(), "font": pa.string(), "font_size": pa.float64(), "color": pa.string(), "width": pa.float64()}
_BLANK = re.compile(r"[\s\uFEFF]+")


def _lines(tokens: Iterator[tuple[str, tuple, float]], room: float) -> Iterator[tuple[int, list[tuple[str, tuple, float]]]]:
    """(line, its tokens) for (token, look, width) in order, the last of them a line break.
    White space at a line's end or behind a soft break is dropped. A line break is on its
    line only if nothing else is; a line of white space before a soft break is not given."""
    line, used, held = 0, 0.0, []
    for token, look, width in tokens:
        hard, blank = token == "\n", bool(_BLANK.fullmatch(token))
        soft = not hard and used > 0 and used + width > room
        if hard or soft:
            while held and _BLANK.fullmatch(held[-1][0]):
                held.pop()
            if hard and not held:
                held.append((token, look, width))
            if held:
                yield line, held
            line, used, held = line + 1, 0.0, []
            if hard or blank:
                continue
        held.append((token, look, width))
        used += width


def _segments(tokens: list[tuple[str, tuple, float]]) -> Iterator[tuple[str, tuple, float]]:
    """(text, look, width) of neighbours of one look; a colour's own text is no part of it."""
    parts, own, wide = [], None, 0.0
    for token, look, width in tokens:
        if parts and look[:3] == own[:3]:
            parts.append(token)
            wide += width
            continue
        if parts:
            yield "".join(parts), own, wide
        parts, own, wide = [token], look, width
    yield "".join(parts), own, wide


def _runs(column: pa.ListArray, k: int) -> Iterator[tuple[tuple, Iterator[str]]]:
    """(look, tokens) of each run of row ``k``; tokens become Python's a thousand at a time."""
    if not column[k].is_valid:
        return
    every = column.values
    font, size, tint, colour, tokens = (every.field(c) for c in ("font", "font_size", "tint", "color", "tokens"))

    def some(start: int, end: int) -> Iterator[str]:
        for at in range(start, end, TAKEN):
            yield from tokens.values.slice(at, min(TAKEN, end - at)).to_pylist()

    for j in range(column.offsets[k].as_py(), column.offsets[k + 1].as_py()):
        start, end = (tokens.offsets[j].as_py(), tokens.offsets[j + 1].as_py()) if tokens[j].is_valid else (0, 0)
        yield (font[j].as_py(), size[j].as_py(), tint[j].as_py(), colour[j].as_py()), some(start, end)


def wrap_runs(boxes: DataFrame, widths: DataFrame, room: Column, *, keys: tuple[str, ...] = ("doc_id", "id"), scale: float = 1.0, default_em: float = 0.6) -> DataFrame:
    """(keys, line, segment, text, font, font_size, color, width) of the lines of ``boxes``
    (keys, runs and the box's own style): greedy word wrap to ``room``, hard line breaks
    kept, neighbours of one look joined. An empty line is one row with an empty text.

    ``widths`` (font, char, em) is sent to the tasks after its rows are counted; what it
    does not hold is ``default_em`` wide. A box's row is enough for its lines: nothing is
    shuffled. Beside the Arrow batch that Spark sends (``maxBytesPerBatch``, or one larger
    box) a worker holds one line and what it gathers to give on."""
    if widths.limit(MAX_WIDTHS + 1).count() > MAX_WIDTHS:
        raise ValueError(f"more than {MAX_WIDTHS} widths")
    ems: dict[str, dict[str, float]] = {}
    for r in widths.select("font", "char", "em").toLocalIterator():
        ems.setdefault(r["font"], {})[r["char"]] = r["em"]
    held = boxes.sparkSession.sparkContext.broadcast(ems)

    def tokens_of(r: Column) -> Column:
        font, colour = standard_font_key(r["font_family"], r["bold"], r["italic"]), hex_to_rgb(r["color"])
        look = [font.alias("font"), (r["font_size"] * scale).alias("font_size"), r["color"].alias("color"), F.hash(colour["r"], colour["g"], colour["b"]).alias("tint")]
        return F.struct(*look, F.regexp_extract_all(r["text"], F.lit(_TOKEN), F.lit(0)).alias("tokens"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], float] = {}

        def em(font: str, token: str) -> float:
            if (font, token) in seen:
                return seen[font, token]
            own = held.value.get(font, {})
            wide = 0.0 if token == "\n" else sum(own.get(c, default_em) for c in token)
            if len(token) <= SEEN_CHARS:
                if len(seen) >= SEEN_TOKENS:
                    seen.clear()
                seen[font, token] = wide
            return wide

        def measured(column: pa.ListArray, k: int) -> Iterator[tuple[str, tuple, float]]:
            last = (None, None, None, None)
            for look, tokens in _runs(column, k):
                for token in tokens:
                    last = look
                    yield token, look, em(look[0], token) * (look[1] or 0.0)
            yield "\n", last, 0.0

        for b in batches:
            owner, chars, found = [], 0, [[] for _ in _SEGMENT]

            def gathered() -> pa.RecordBatch:
                at = pa.array(owner, pa.int64())
                out = pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keys), *(pa.array(c, kind) for c, kind in zip(found, _SEGMENT.values()))], names=[*keys, *_SEGMENT])
                for column in (owner, *found):
                    column.clear()
                return out

            for k in range(b.num_rows):
                for line, tokens in _lines(measured(b.column("_t"), k), b.column("_room")[k].as_py()):
                    for segment, (text, (font, size, _, colour), width) in enumerate(_segments(tokens)):
                        if len(owner) >= OUT_ROWS or chars >= OUT_CHARS:
                            yield gathered()
                            chars = 0
                        for column, v in zip(found, (line, segment, text.strip("\n"), font, size, colour, width)):
                            column.append(v)
                        owner.append(k)
                        chars += len(text)
            yield gathered()

    df = boxes.withColumn("_runs", resolve_style(F.col("runs"), {k: F.col(k) for k in STYLE})).select(*keys, room.cast("double").alias("_room"), F.transform("_runs", tokens_of).alias("_t"))
    kinds = T.StructType([*(df.schema[c] for c in keys), *(T.StructField(c, from_arrow_type(k)) for c, k in _SEGMENT.items())])
    return df.mapInArrow(place, kinds)


def draw_positions(segments: DataFrame, boxes: DataFrame, *, keys: tuple[str, ...] = ("doc_id", "id"), scale: float = 1.0) -> DataFrame:
    """Adds ``draw_x`` and ``draw_y``, the PDF start of each segment, from boxes with x, y,
    width, align, font_size and page_height (screen units but for the last)."""
    line = Window.partitionBy(*keys, "line")
    before = line.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    own = boxes.select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("width").alias("_w"), F.col("align").alias("_align"), F.col("font_size").alias("_size"), F.col("page_height").alias("_ph"))
    df = segments.withColumn("_line_width", F.sum("width").over(line)).withColumn("_before", F.coalesce(F.sum("width").over(before), F.lit(0.0))).join(own.hint("merge"), list(keys))
    x = F.col("_x") * scale + align_offset(F.col("_align"), F.col("_w") * scale, F.col("_line_width")) + F.col("_before")
    y = baseline_y(F.col("_ph"), F.col("_y"), F.lit(scale), F.col("_size"), F.col("line"))
    return df.withColumn("draw_x", x).withColumn("draw_y", y).drop("_x", "_y", "_w", "_align", "_size", "_ph", "_line_width", "_before")
