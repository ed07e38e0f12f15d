"""Explicit schemas of the tables that the operators take."""

from __future__ import annotations

RECT = "STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>"
STYLED_RUN = "STRUCT<text: STRING, bold: BOOLEAN, italic: BOOLEAN, color: STRING, font_size: DOUBLE, font_family: STRING>"
BBOX = "STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"

RUNS = "doc_id BIGINT, page INT, ord INT, str STRING, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, baseline DOUBLE, font_size DOUBLE, font_family STRING, bold BOOLEAN, italic BOOLEAN"
OCR_TREE = (
    "doc_id BIGINT, page INT, blocks ARRAY<STRUCT<paragraphs: ARRAY<STRUCT<lines: ARRAY<STRUCT<text: STRING, "
    f"bbox: {BBOX}, rowAttributes: STRUCT<row_height: DOUBLE>, words: ARRAY<STRUCT<text: STRING, bbox: {BBOX}, is_bold: BOOLEAN>>>>>>>>"
)
EDITS = (
    "doc_id BIGINT, ord INT, id STRING, type STRING, page INT, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, "
    f"runs ARRAY<{STYLED_RUN}>, font_size DOUBLE, font_family STRING, bold BOOLEAN, italic BOOLEAN, color STRING, align STRING, "
    f"origin STRING, cover_color STRING, cover_rect {RECT}, data_url STRING, text STRING, points ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, stroke_width DOUBLE"
)
PAGE_OPS = "doc_id BIGINT, page INT, rotation INT, crop STRUCT<top: DOUBLE, right: DOUBLE, bottom: DOUBLE, left: DOUBLE>"
EDIT_LOG = "doc_id BIGINT, seq BIGINT, ts TIMESTAMP, action STRING, edit_id STRING, page INT, payload STRING"
ASSETS = "ARRAY<STRUCT<id: STRING, dataUrl: STRING>>"

#: Page width in screen pixels: every stored coordinate is on this scale.
VIEWER_WIDTH = 800.0
#: Height of a line box in font sizes.
LINE_GAP = 1.2
