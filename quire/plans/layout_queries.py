"""Registered queries of the layout library, each with the SQL that DuckDB runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import runs as R
from quire.functions import text as X
from quire.functions.stats import modal_first, upper_median
from quire.operators import edits as E
from quire.operators import fonts, pages, paragraphs, raster, regions, search, spatial
from quire.operators.layout import cluster_lines, line_blocks, number_lines, paginate
from quire.operators.longlogs import fold_long_logs
from quire.sources import readers

_FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _FOUND[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(*names: str) -> list:
    return [F.round(F.col(c), 6).alias(c) for c in names]


# Boxes: line items as positioned runs, twenty orders a document, so that pages stay small.
_BOX = {
    "doc_id": "cast(floor(l_orderkey / 20) as bigint)",
    "page": "cast(l_linenumber - 1 as int)",
    "x": "cast(l_partkey % 700 as double)",
    "baseline": "cast(20 * (l_suppkey % 40) + (l_partkey % 2) as double)",
    "width": "2 * l_quantity",
    "font_size": "cast(10 + l_suppkey % 5 as double)",
    "y": "cast(20 * (l_suppkey % 40) + (l_partkey % 2) - 10 - l_suppkey % 5 as double)",
    "height": "1.2e0 * (10 + l_suppkey % 5)",
    "str": "concat('p', cast(l_partkey as varchar(20)), case when l_partkey % 9 = 0 then ' ' else '' end)",
    "flag": "l_returnflag",
    "supp": "l_suppkey",
    "part": "l_partkey",
    "bold": "l_partkey % 2 = 0",
}
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
BOXES = (
    "boxes AS (SELECT *, cast(row_number() OVER (PARTITION BY doc_id, page ORDER BY "
    + ", ".join(_KEYS)
    + ") as int) AS ord FROM (SELECT "
    + ", ".join(f"{v} AS {k}" for k, v in _BOX.items())
    + ", "
    + ", ".join(_KEYS)
    + " FROM lineitem))"
)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").selectExpr(*(f"{v} AS {k}" for k, v in _BOX.items()), *_KEYS)
    ord_ = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*_KEYS))
    return df.withColumn("ord", ord_.cast("int")).drop(*_KEYS).withColumn("font_family", F.lit("Helvetica")).withColumn("italic", F.lit(False))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.text_lines(table(spark, sf_dir, "documents"))


_LINES = r"""lines AS (SELECT doc_id, cast(line AS INT) AS line, text FROM (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x) <> '') AS ls FROM documents)))"""
_MARK = r"'^\s*([-•◦▪*–—]|[0-9]+[.):]|[A-Za-z][.):]|[ivxlcdmIVXLCDM]+\.)\s+'"
_WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"


@query(f"WITH {_LINES} SELECT * FROM lines")
def reading_lines(spark, sf_dir):
    return document_lines(spark, sf_dir)


@query(
    f"WITH {_LINES}, kinds AS (SELECT *, CASE WHEN regexp_matches(text, {_MARK}) THEN 'list' WHEN line = 1 AND {_WORDS.format('text')} BETWEEN 1 AND 8 THEN 'heading' ELSE 'body' END AS kind FROM lines) "
    f"SELECT doc_id, kind, count(*) AS n, sum({_WORDS.format('text')})::BIGINT AS n_words, md5(string_agg(CASE WHEN kind = 'list' THEN ltrim(regexp_replace(text, '^\\s*[-•◦▪*–—]\\s+', '')) ELSE text END, chr(10) ORDER BY line)) AS content FROM kinds GROUP BY ALL"
)
def outline_kinds(spark, sf_dir):
    """Lines by kind; a first line counts as bold."""
    lines = paragraphs.classify_blocks(document_lines(spark, sf_dir).withColumn("bold", F.col("line") == 1))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda r: r["content"]), "\n")
    return lines.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(X.word_count(F.col("text"))).alias("n_words"), F.md5(content).alias("content"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS doc_id", "cast(turn AS int) AS page", "role", "text AS str")


@query(
    r"SELECT doc_id, page, cast(row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS INT) AS line, str FROM (SELECT conv_id AS doc_id, cast(turn AS INT) AS page, unnest(range(0, len(ls))) AS i, unnest(ls) AS str "
    r"FROM (SELECT *, regexp_split_to_array(text, '\r?\n') AS ls FROM conversations)) WHERE trim(str) <> ''"
)
def conversation_lines(spark, sf_dir):
    lines = turns(spark, sf_dir).select("doc_id", "page", F.posexplode(F.split("str", "\r?\n")).alias("ord", "str"))
    return number_lines(lines, ("ord",)).select("doc_id", "page", "line", "str")


@query(
    "SELECT conv_id AS doc_id, coalesce(sum(length(trim(text))) FILTER (WHERE turn < 3), 0)::BIGINT AS chars, coalesce(sum(length(trim(text))) FILTER (WHERE turn < 3), 0) < 800 AS scanned FROM conversations GROUP BY conv_id"
)
def scanned_docs(spark, sf_dir):
    df = turns(spark, sf_dir)
    return pages.scanned_docs(df, df.groupBy("doc_id").agg(F.count("*").alias("page_count")), limit=800)


def ocr_like_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines laid out: a gap after lines that end a short paragraph. Some lines get
    a misread bullet, a ligature, a letter with a mark of its own, or a hyphen at the end
    with the next line in small letters."""
    text = (
        F.when(F.col("line") % 7 == 2, F.concat(F.lit("« A"), "text")).when(F.col("line") % 7 == 4, F.concat("text", F.lit(" ﬁne-"))).when(F.col("line") % 7 == 5, F.concat(F.lit("ze\u0301ro "), "text"))
        .when(F.col("line") % 7 == 6, F.concat("text", F.lit(" oﬃce e\u0308")))
        .otherwise(F.col("text"))
    )
    lines = document_lines(spark, sf_dir).withColumn("text", text)
    y = F.col("line") * 30 + F.floor(F.col("line") / 3) * 40
    return lines.select(
        "doc_id", F.lit(0).alias("page"), F.col("line").alias("ord"), "text", F.lit(72.0).alias("x0"), y.cast("double").alias("y0"), (F.lit(72.0) + F.length("text")).alias("x1"), (y + 20).cast("double").alias("y1"),
        (F.lit(72.0) + F.when(F.col("line") % 5 == 0, 12).otherwise(0)).alias("first_x"), F.lit(20.0).alias("row_height"), (F.col("line") % 2 == 0).alias("all_words_bold"),
    )


_PLANTED = (
    "pl AS (SELECT doc_id, line, CASE line % 7 WHEN 2 THEN '« A' || text WHEN 4 THEN text || ' ﬁne-' WHEN 5 THEN 'ze\u0301ro ' || text WHEN 6 THEN text || ' oﬃce e\u0308' ELSE text END AS text FROM lines)"
)
_OCR = f"""WITH {_LINES}, {_PLANTED}, o AS (SELECT doc_id, line AS ord, text, line * 30 + floor(line / 3) * 40 AS y0, line * 30 + floor(line / 3) * 40 + 20 AS y1, 72.0 + CASE WHEN line % 5 = 0 THEN 12 ELSE 0 END AS fx,
  line % 2 = 0 AS bold, 72.0 + length(text) AS x1, regexp_matches(text, {_MARK}) OR regexp_matches(text, '^\\s*[«»‹›·°] +[A-Z0-9]') AS m FROM pl
), c AS (SELECT doc_id, fx, ord, row_number() OVER (PARTITION BY doc_id, fx ORDER BY ord) AS n FROM o
), md AS (SELECT doc_id, arg_max(fx, n * 1000000 - ord) AS modal FROM c GROUP BY doc_id
), f AS (SELECT o.*, md.modal, lag(y1) OVER w AS py, lag(ord) OVER w IS NULL AS first, coalesce(lead(m) OVER w, false) AS nm FROM o JOIN md USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)
), s AS (SELECT *, first OR coalesce(y0 - py > 26, false) OR (NOT m AND nm) OR m AS st, m OR fx - modal > 8 AS li FROM f
), g AS (SELECT *, sum(st::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS paragraph,
  regexp_replace(replace(replace(replace(replace(replace(nfc_normalize(text), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '^\\s*[«»‹›·°] +([A-Z0-9])', '• \\1') AS t FROM s)"""


@query(
    _OCR
    + """ SELECT doc_id, paragraph::BIGINT AS paragraph, count(*) AS line_count, min(y0)::DOUBLE AS y0, max(y1)::DOUBLE AS y1, max(x1)::DOUBLE AS x1, arg_min(li, ord) AS is_list_item, bool_and(bold) AS is_bold,
  regexp_replace(string_agg(t, chr(1) ORDER BY ord), '([A-Za-z])-' || chr(1) || '([a-z])', '\\1\\2', 'g').replace(chr(1), ' ') AS text FROM g GROUP BY doc_id, paragraph"""
)
def paragraph_groups(spark, sf_dir):
    out = paragraphs.build_paragraphs(ocr_like_lines(spark, sf_dir))
    return out.select("doc_id", "paragraph", "line_count", "y0", "y1", "x1", "is_list_item", "is_bold", "text")


@query(f"WITH {BOXES} SELECT doc_id, page, list_sort(list(font_size))[len(list(font_size)) // 2 + 1] AS median_size, count(*) AS n FROM boxes GROUP BY doc_id, page")
def upper_medians(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("doc_id", "page").agg(upper_median(F.col("font_size")).alias("median_size"), F.count("*").alias("n"))


@query(
    f"WITH {BOXES}, c AS (SELECT doc_id, page, ord, floor(x / 50 + 0.5)::BIGINT AS v FROM boxes), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, v ORDER BY ord) AS k FROM c) SELECT doc_id, page, arg_max(v, k * 100000 - ord) AS modal FROM n GROUP BY doc_id, page"
)
def modal_left(spark, sf_dir):
    return modal_first(boxes(spark, sf_dir).withColumn("v", G.js_round(F.col("x") / 50)), ["doc_id", "page"], "v", ["ord"], "modal")


@query(
    r"""WITH RECURSIVE p AS (SELECT doc_id, unnest(range(0, len(ps))) AS ord, unnest(ps) AS raw FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS ps FROM documents)
), t AS (SELECT doc_id, ord, regexp_replace(replace(raw, chr(9), '    '), '[\x00-\x1F\x7F]', '', 'g') AS t FROM p
), w(doc_id, ord, part, line, rest) AS (SELECT doc_id, ord, 0, '', t FROM t
  UNION ALL SELECT doc_id, ord, part + 1, line, ltrim(substr(rest, length(line) + 1)) FROM (
    SELECT doc_id, ord, part, rest, CASE WHEN length(rest) <= 70 THEN rtrim(rest) ELSE coalesce(nullif(regexp_extract(substr(rest, 1, 71), '^([\s\S]*\S)\s', 1), ''), regexp_extract(rest, '^\s*\S+')) END AS line FROM w WHERE rtrim(rest) <> '')
), l AS (SELECT doc_id, ord, part, line FROM w WHERE part > 0 UNION ALL SELECT doc_id, ord, 1, '' FROM t WHERE trim(t) = ''
), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, part) - 1 AS k FROM l)
SELECT doc_id, floor(k / 43)::INT AS sheet, count(*) AS n, sum(length(line))::BIGINT AS chars, max(length(line))::INT AS longest, md5(string_agg(line, chr(10) ORDER BY k)) AS content FROM n GROUP BY ALL"""
)
def wrap_paginate(spark, sf_dir):
    """Documents as sheets of 43 lines of at most 70 characters."""
    paras = readers.text_paragraphs(table(spark, sf_dir, "documents"))
    lines = paras.select("doc_id", "ord", F.posexplode(X.wrap_text(X.sanitize(F.col("text")))).alias("part", "text"))
    numbered = lines.withColumn("ord", F.struct("ord", "part"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "text"))), lambda r: r["text"]), "\n")
    return paginate(numbered).groupBy("doc_id", "sheet").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"), F.md5(content).alias("content"))


@query(
    f"WITH {BOXES}, l AS (SELECT *, floor(baseline / 20) AS line FROM boxes), b AS (SELECT *, x - lag(x + width) OVER (PARTITION BY doc_id, page, line ORDER BY x, baseline, ord) AS gap FROM l"
    "), n AS (SELECT *, sum((gap IS NULL OR gap > 1.5 * font_size)::INT) OVER (PARTITION BY doc_id, page ORDER BY line, x, baseline, ord) - 1 AS block FROM b"
    "), t AS (SELECT *, CASE WHEN x - lag(x + width) OVER w > 0.15 * font_size AND NOT suffix(lag(str) OVER w, ' ') THEN ' ' || str ELSE str END AS t FROM n WINDOW w AS (PARTITION BY doc_id, page, block ORDER BY x, baseline, ord))"
    " SELECT doc_id, page, block::BIGINT AS block, string_agg(t, '' ORDER BY x, baseline, ord) AS str, min(x) AS x, round(max(x + width) - min(x), 6) AS width, round(max(y + height) - min(y), 6) AS height, max(font_size) AS font_size, bool_and(bold) AS bold, count(*) AS n_runs FROM t GROUP BY doc_id, page, block"
)
def line_block_rows(spark, sf_dir):
    out = line_blocks(boxes(spark, sf_dir))
    return out.select("doc_id", "page", "block", "str", "x", *rounded("width", "height"), "font_size", "bold", F.size("runs").cast("long").alias("n_runs"))


@query(f"WITH {BOXES} SELECT doc_id, page, cast(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY floor(baseline / 20)) - 1 AS INT) AS line, ord FROM boxes")
def clustered_lines(spark, sf_dir):
    return cluster_lines(boxes(spark, sf_dir)).select("doc_id", "page", "line", "ord")


@query(
    f"""WITH RECURSIVE {BOXES}, v AS (SELECT DISTINCT doc_id, page, floor(x / 3) * 2 AS b FROM boxes), a(doc_id, page, b, line) AS (
  SELECT doc_id, page, min(b), 0 FROM v GROUP BY doc_id, page UNION ALL
  SELECT doc_id, page, min(nb), any_value(line) + 1 FROM (SELECT a.doc_id, a.page, a.line, v.b AS nb FROM a JOIN v ON v.doc_id = a.doc_id AND v.page = a.page AND v.b >= a.b + 3) GROUP BY doc_id, page)
SELECT doc_id, page, ord, max(a.line)::INT AS line FROM boxes JOIN a USING (doc_id, page) WHERE floor(x / 3) * 2 >= a.b GROUP BY ALL"""
)
def drifting_lines(spark, sf_dir):
    """Baselines two px apart or more: a line takes what is near its first run only, so that
    a slow drift does not join many lines."""
    drifting = boxes(spark, sf_dir).withColumn("baseline", F.floor(F.col("x") / 3) * F.lit(2.0))
    return cluster_lines(drifting).select("doc_id", "page", "line", "ord")


_PATTERNS = [("initials", "and|und"), ("date", "la|der"), ("signature", "the")]


@query(
    f"WITH {_LINES}, k AS (SELECT *, CASE WHEN regexp_matches(text, '\\b(and|und)\\b', 'i') THEN 'initials' WHEN regexp_matches(text, '\\b(la|der)\\b', 'i') THEN 'date' WHEN regexp_matches(text, '\\b(the)\\b', 'i') THEN 'signature' END AS kind FROM lines)"
    " SELECT doc_id, line, kind, 84.0 + length(text) AS x, 20.0 * line + 10 - (CASE kind WHEN 'initials' THEN 40 WHEN 'date' THEN 36 ELSE 48 END) / 2 AS y FROM k WHERE kind IS NOT NULL"
)
def label_zones(spark, sf_dir):
    """Zones beside every line that holds a label."""
    lines = document_lines(spark, sf_dir)
    zoned = lines.withColumn("kind", X.label_kind(F.col("text"), _PATTERNS)).where("kind is not null")
    z = G.zone_box(F.col("kind"), F.lit(72.0), F.col("line") * F.lit(20.0), F.length("text").cast("double"), F.lit(20.0))
    return zoned.select("doc_id", "line", "kind", z["x"].alias("x"), z["y"].alias("y"))


@query(f"WITH {_LINES} SELECT doc_id, line, text FROM lines WHERE contains(lower(text), 'inor')")
def find_text(spark, sf_dir):
    return search.find_text(document_lines(spark, sf_dir), "  InOr ", F.col("text"))


@query(
    f"WITH {_LINES}, m AS (SELECT doc_id, line FROM lines WHERE contains(lower(text), 'inor')) SELECT doc_id, line, coalesce(lead(line) OVER w, first_value(line) OVER w) AS next_match, coalesce(lag(line) OVER w, last_value(line) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_match FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line)"
)
def find_ring(spark, sf_dir):
    found = search.find_text(document_lines(spark, sf_dir), "inor", F.col("text")).select("doc_id", "line")
    return search.match_ring(found, ["doc_id"], ["line"], "line")


@query(f"WITH {BOXES} SELECT doc_id, page, ord, round(x * 612 / 800, 6) AS x, round(792 - (y + height) * 612 / 800, 6) AS y, round(width * 612 / 800, 6) AS width, round(height * 612 / 800, 6) AS height FROM boxes")
def pdf_rects(spark, sf_dir):
    r = G.to_pdf_rect(*(F.col(c) for c in ("x", "y", "width", "height")), F.lit(612.0), F.lit(792.0))
    return boxes(spark, sf_dir).select("doc_id", "page", "ord", r.alias("r")).select("doc_id", "page", "ord", *(F.round(f"r.{c}", 6).alias(c) for c in ("x", "y", "width", "height")))


@query(
    f"WITH {BOXES} SELECT doc_id, page, ord, greatest(width + 8, 40) AS edit_width, round(greatest(height, 16), 6) AS edit_height, x - 2 AS cover_x, y - 2 AS cover_y, width + 4 AS cover_width, round(height + 4, 6) AS cover_height FROM boxes"
)
def cover_boxes(spark, sf_dir):
    c = G.cover_boxes(*(F.col(k) for k in ("x", "y", "width", "height")))
    named = boxes(spark, sf_dir).select("doc_id", "page", "ord", c.alias("c"))
    return named.select("doc_id", "page", "ord", F.col("c.edit.width").alias("edit_width"), F.round("c.edit.height", 6).alias("edit_height"), F.col("c.cover.x").alias("cover_x"), F.col("c.cover.y").alias("cover_y"), F.col("c.cover.width").alias("cover_width"), F.round("c.cover.height", 6).alias("cover_height"))


@query(
    f"""WITH {BOXES}, q AS (SELECT *, supp % 5 AS s FROM boxes
), d AS (SELECT *, width AS rw, height + s AS rh, sqrt(width * width + s * s) AS along, height AS across FROM q
), e AS (SELECT *, least(least(along, across), least(rw, rh) * 1.5) AS lh, least(greatest(along, across), greatest(rw, rh) * 1.5) AS rl FROM d
), f AS (SELECT *, greatest(greatest(1, floor(rh / lh + 0.5)), greatest(1, ceil(length(trim(str)) / greatest(1, 2 * rl / greatest(1, 2 * lh / 1.2 * 0.5))))) AS n FROM e
), g AS (SELECT *, greatest(4, least(96, 2 * rh / n / 1.2)) AS fs FROM f
), m AS (SELECT doc_id, page, list_sort(list(fs))[len(list(fs)) // 2 + 1] AS md FROM g GROUP BY doc_id, page)
SELECT g.doc_id, g.page, g.ord, x * 2 + 7 AS x, y * 2 - 3 AS y, round(rw * 2, 6) AS width, round(rh * 2, 6) AS height, round(fs, 6) AS font_size, fs >= md * 1.35 AS bold FROM g JOIN m USING (doc_id, page)"""
)
def quad_regions(spark, sf_dir):
    s = (F.col("supp") % 5).cast("double")
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    df = boxes(spark, sf_dir).select("doc_id", "page", "ord", F.col("str").alias("text"), F.array(x, y, x + w, y + s, x + w, y + s + h, x, y + h).alias("quad"))
    return regions.regions_to_items(df, 2.0, 2.0, 7.0, -3.0).select("doc_id", "page", "ord", "x", "y", *rounded("width", "height", "font_size"), "bold")


_COVERS = "covers AS (SELECT doc_id, page, x - 2 AS x, y - 2 AS y, width + 4 AS width, height + 4 AS height FROM boxes WHERE flag = 'R' AND supp % 4 = 0)"


def _covers(b: DataFrame) -> DataFrame:
    return b.where("flag = 'R' and supp % 4 = 0").selectExpr("doc_id", "page", "x - 2 as x", "y - 2 as y", "width + 4 as width", "height + 4 as height")


@query(
    f"WITH {BOXES}, {_COVERS} SELECT doc_id, page, ord, str FROM boxes b WHERE flag <> 'R' AND NOT EXISTS (SELECT 1 FROM covers c WHERE c.doc_id = b.doc_id AND c.page = b.page AND b.x < c.x + c.width AND b.x + b.width > c.x AND b.y < c.y + c.height AND b.y + b.height > c.y)"
)
def uncovered_items(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return spatial.uncovered_items(b.where("flag <> 'R'"), _covers(b)).select("doc_id", "page", "ord", "str")


@query(
    f"WITH {BOXES}, {_COVERS} SELECT doc_id, page, ord FROM boxes b WHERE flag <> 'R' AND NOT EXISTS (SELECT 1 FROM covers c WHERE c.doc_id = b.doc_id AND c.page = b.page AND abs(b.x - c.x) < 40 AND abs(b.y - c.y) < 40)"
)
def unreplaced_images(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return spatial.unreplaced_images(b.where("flag <> 'R'"), _covers(b), 40.0).select("doc_id", "page", "ord")


_SIZES = "p AS (SELECT doc_id, page, 500.0 + max(supp % 3) * 50 AS width, 700.0 + max(part % 2) * 100 AS height FROM boxes GROUP BY doc_id, page)"


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = boxes(spark, sf_dir).groupBy("doc_id", "page").agg(F.max(F.col("supp") % 3).alias("_w"), F.max(F.col("part") % 2).alias("_h"))
    return g.select("doc_id", "page", (F.lit(500.0) + F.col("_w") * 50).alias("width"), (F.lit(700.0) + F.col("_h") * 100).alias("height"))


_OFFSETS = "o AS (SELECT *, 800 / width * height AS sh, coalesce(sum(800 / width * height + 24) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM p)"


@query(f"WITH {BOXES}, {_SIZES}, {_OFFSETS} SELECT doc_id, page, round(sh, 6) AS screen_height, round(top, 6) AS top FROM o")
def page_offsets(spark, sf_dir):
    return spatial.page_offsets(page_sizes(spark, sf_dir)).select("doc_id", "page", *rounded("screen_height", "top"))


@query(
    f"WITH {BOXES}, {_SIZES}, {_OFFSETS}, q AS (SELECT DISTINCT doc_id, cast(unnest([0, 1500, 4000, 99999]) AS DOUBLE) AS off FROM p) SELECT q.doc_id, q.off AS \"offset\", coalesce(min(o.page) FILTER (WHERE top + sh + 24 > off), min(o.page)) AS page FROM q JOIN o USING (doc_id) GROUP BY q.doc_id, q.off"
)
def page_at_offset(spark, sf_dir):
    sized = spatial.page_offsets(page_sizes(spark, sf_dir))
    offsets = sized.select("doc_id").distinct().select("doc_id", F.explode(F.array(*(F.lit(float(v)) for v in (0, 1500, 4000, 99999)))).alias("offset"))
    return spatial.page_at_offset(offsets, sized).select("doc_id", "offset", "page")


@query(
    f"WITH {BOXES}, {_SIZES}, s AS (SELECT *, concat(floor(width + 0.5)::BIGINT, ' × ', floor(height + 0.5)::BIGINT, ' pt') AS z FROM p) SELECT doc_id, count(*) AS page_count, CASE WHEN min(z) = max(z) THEN min(z) ELSE concat(arg_min(z, page), ' (mixed)') END AS sizes FROM s GROUP BY doc_id"
)
def page_size_summary(spark, sf_dir):
    return pages.page_size_summary(page_sizes(spark, sf_dir))


def order_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a document's pages, by a scrambled key; one page in five is dropped, one in
    four is listed twice, and so is a page that does not exist."""
    p = boxes(spark, sf_dir).select("doc_id", "page").distinct().where("(doc_id + page) % 5 <> 0")
    times = F.when((F.col("doc_id") + F.col("page")) % 4 == 1, F.array(F.lit(0), F.lit(5))).otherwise(F.array(F.lit(0)))
    p = p.withColumn("again", F.explode(times)).unionByName(p.select("doc_id").distinct().select("doc_id", F.lit(99).alias("page"), F.lit(1).alias("again")))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy((F.col("page") * 7 + F.col("doc_id") + F.col("again")) % 11, "page", "again")) - 1
    return p.select("doc_id", "page", place.cast("int").alias("pos"))


_ORDER = """pq AS (SELECT DISTINCT doc_id, page FROM boxes WHERE (doc_id + page) % 5 <> 0
), pa AS (SELECT doc_id, page, 0 AS again FROM pq UNION ALL SELECT doc_id, page, 5 FROM pq WHERE (doc_id + page) % 4 = 1 UNION ALL SELECT DISTINCT doc_id, 99, 1 FROM pq
), pl AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY (page * 7 + doc_id + again) % 11, page, again) - 1 AS pos FROM pa
), po AS (SELECT doc_id, page, max(pos)::INT AS pos FROM pl GROUP BY doc_id, page
), pv AS (SELECT doc_id, page, max(k)::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM pl WHERE page < 7) GROUP BY doc_id, page)"""


@query(
    f"WITH {BOXES}, {_ORDER} SELECT doc_id, page, ord, cast(row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(pos, page), y, ord, page) AS INT) AS rank FROM boxes LEFT JOIN po USING (doc_id, page)"
)
def ordered_edits(spark, sf_dir):
    # the input order is unique within a page only: the page makes it so within a document
    b = boxes(spark, sf_dir).withColumn("ord", F.struct("ord", "page"))
    return pages.order_edits(b, order_of_pages(spark, sf_dir)).select("doc_id", "page", F.col("ord.ord").alias("ord"), "rank")


@query(f"WITH {BOXES}, {_ORDER} SELECT doc_id, page, ord, pos AS out_page FROM boxes JOIN pv USING (doc_id, page)")
def remapped_edits(spark, sf_dir):
    """Documents of seven pages; the entry for a hundredth page is dropped first."""
    b = boxes(spark, sf_dir)
    counts = b.select("doc_id").distinct().withColumn("page_count", F.lit(7))
    return pages.remap_edits(b, order_of_pages(spark, sf_dir), counts).select("doc_id", "page", "ord", "out_page")


@query("SELECT conv_id AS doc_id, cast(turn AS INT) AS page, cast(floor(turn / 3) AS INT) AS part FROM conversations")
def split_every(spark, sf_dir):
    return pages.split_every(turns(spark, sf_dir), 3.7).select("doc_id", "page", "part")


@query(
    "WITH c AS (SELECT conv_id AS doc_id, cast(turn AS INT) AS page, conv_id % 5 < 2 AS bare FROM conversations) SELECT doc_id, page, 0 AS part FROM c WHERE page <= 1 AND NOT bare UNION ALL SELECT doc_id, page, 1 AS part FROM c WHERE page BETWEEN 1 AND 2 AND NOT bare UNION ALL SELECT doc_id, page, page FROM c WHERE bare"
)
def split_ranges(spark, sf_dir):
    """Every conversation has a second turn, so both parts exist; some have a blank range, or none."""
    p = turns(spark, sf_dir).select("doc_id", "page")
    spec = F.when(F.col("doc_id") % 5 == 0, "  ").when(F.col("doc_id") % 5 == 2, "2-1, 99999999999999999999, 3-0000000000000000000000002, 88888888888888888888-77777777777").when(F.col("doc_id") % 5 != 1, "1-2, junk, 0, 3-2")
    specs = p.select("doc_id").distinct().withColumn("spec", spec)
    return pages.split_by_ranges(p, specs).select("doc_id", "page", "part")


@query(
    "WITH c AS (SELECT conv_id AS doc_id, turn AS page, floor(conv_id / 3)::BIGINT AS target FROM conversations) SELECT target, doc_id, page::INT AS page, row_number() OVER (PARTITION BY target ORDER BY doc_id DESC, page) - 1 AS new_page FROM c"
)
def merged_docs(spark, sf_dir):
    p = turns(spark, sf_dir).select("doc_id", "page")
    order = p.select("doc_id").distinct().select(F.floor(F.col("doc_id") / 3).alias("target"), F.negative("doc_id").alias("place"), "doc_id")
    return pages.merge_docs(p, order).select("target", "doc_id", "page", "new_page")


@query(
    """WITH c AS (SELECT conv_id AS doc_id, cast(turn AS INT) AS page, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT doc_id, page, 'later' AS way, cast(CASE WHEN last < 2 THEN page WHEN page = 0 THEN 2 WHEN page <= 2 THEN page - 1 ELSE page END AS INT) AS pos FROM c
UNION ALL SELECT doc_id, page, 'sooner', cast(CASE WHEN last < 2 THEN page WHEN page = 2 THEN 0 WHEN page < 2 THEN page + 1 ELSE page END AS INT) FROM c"""
)
def moved_pages(spark, sf_dir):
    """A page moved both ways; documents without both places stay as they are."""
    order = turns(spark, sf_dir).select("doc_id", F.col("page").alias("pos"), "page")
    later = pages.move_page(order, 0, pages.gap_target(3, 0)).withColumn("way", F.lit("later"))
    return later.unionByName(pages.move_page(order, 2, pages.gap_target(0, 2)).withColumn("way", F.lit("sooner"))).select("doc_id", "page", "way", "pos")


@query(
    "WITH c AS (SELECT conv_id AS doc_id, cast(turn AS INT) AS page, role, (conv_id % 7 = 0) OR turn = 1 AS gone FROM conversations), a AS (SELECT doc_id, bool_and(gone) AS whole FROM c GROUP BY doc_id) SELECT doc_id, page FROM c JOIN a USING (doc_id) WHERE whole OR NOT gone"
)
def deleted_pages(spark, sf_dir):
    p = turns(spark, sf_dir).select("doc_id", "page")
    gone = p.where("doc_id % 7 = 0 or page = 1")
    return pages.delete_pages(p, gone, p.withColumn("pos", F.col("page"))).select("doc_id", "page")


_POINTS = "pt AS (SELECT user_id, cast(cast(ts AS DATE) AS VARCHAR) AS day, ts, event_id, value AS x, cast(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "ts", "event_id", F.col("value").alias("x"), k.alias("y"))


@query(
    f"WITH {_POINTS} SELECT user_id, day, round(min(x) - 4, 6) AS \"left\", round(min(y) - 4, 6) AS top, round(max(x) - min(x) + 8, 6) AS width, round(max(y) - min(y) + 8, 6) AS height, count(*) AS n FROM pt GROUP BY user_id, day HAVING count(*) >= 2"
)
def ink_strokes(spark, sf_dir):
    s = search.ink_strokes(points(spark, sf_dir), ["user_id", "day"], ["ts", "event_id"])
    return s.select("user_id", "day", *rounded("left", "top", "width", "height"), F.size("points").cast("long").alias("n"))


@query(
    f"WITH {_POINTS}, s AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w - 1 AS segment, min(x) OVER (PARTITION BY user_id, day) - 4 AS lx, min(y) OVER (PARTITION BY user_id, day) - 4 AS ly FROM pt WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id))"
    " SELECT user_id, day, cast(segment AS INT) AS segment, round(x - lx, 6) AS x0, round(y - ly, 6) AS y0, round(x1 - lx, 6) AS x1, round(y1 - ly, 6) AS y1 FROM s WHERE x1 IS NOT NULL"
)
def ink_segments(spark, sf_dir):
    s = search.ink_strokes(points(spark, sf_dir), ["user_id", "day"], ["ts", "event_id"])
    return search.ink_segments(s, ["user_id", "day"]).select("user_id", "day", "segment", *rounded("x0", "y0", "x1", "y1"))


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type").isin("click", "view"), "update").when(F.col("event_type") == "purchase", "undo").otherwise("delete")
    key = F.floor(F.col("value") / 10).cast("long").cast("string")
    payload = F.concat(F.lit('{"v":'), F.col("event_id").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), action.alias("action"), key.alias("edit_id"), F.lit(0).alias("page"), payload.alias("payload"))


@query(
    """WITH l AS (SELECT user_id AS doc_id, event_id AS seq, ts, CASE WHEN event_type = 'signup' THEN 'add' WHEN event_type IN ('click', 'view') THEN 'update' WHEN event_type = 'purchase' THEN 'undo' ELSE 'delete' END AS action, floor(value / 10)::BIGINT::VARCHAR AS edit_id FROM events
), f AS (SELECT *, coalesce(action = 'update' AND lag(action) OVER w = 'update' AND edit_id = lag(edit_id) OVER w AND epoch_ms(ts) - epoch_ms(lag(ts) OVER w) < 86400000, false) AS same FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ts, seq))
SELECT doc_id, seq, action, sum((NOT same)::INT) OVER (PARTITION BY doc_id ORDER BY ts, seq)::BIGINT AS burst FROM f"""
)
def edit_bursts(spark, sf_dir):
    return E.edit_bursts(edit_log(spark, sf_dir), 86_400_000).select("doc_id", "seq", "action", "burst")


#: The log folded with whole snapshots on both stacks; the newest state of each document is kept.
_FOLD = """WITH RECURSIVE l AS (SELECT user_id AS doc_id, event_id AS ev, epoch_ms(ts) AS ms, {action} AS action, floor(value / 10)::BIGINT::VARCHAR AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), f AS (SELECT *, coalesce(action = 'update' AND lag(action) OVER w = 'update' AND k = lag(k) OVER w AND ms - lag(ms) OVER w < 7200000, false) AS near FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), s(doc_id, i, nxt, cur, past, future) USING KEY (doc_id) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, 0, []::STRUCT(k VARCHAR, p INT, v BIGINT)[], []::STRUCT(k VARCHAR, p INT, v BIGINT)[][], []::STRUCT(k VARCHAR, p INT, v BIGINT)[][] FROM l
  UNION SELECT s.doc_id, f.i, CASE WHEN action = 'add' THEN nxt + 1 ELSE nxt END,
    CASE action WHEN 'add' THEN list_append(list_filter(cur, lambda x: x.k <> f.k), {{'k': f.k, 'p': nxt + 1, 'v': f.ev}})
      WHEN 'update' THEN list_transform(cur, lambda x: {{'k': x.k, 'p': x.p, 'v': CASE WHEN x.k = f.k THEN f.ev ELSE x.v END}})
      WHEN 'delete' THEN list_filter(cur, lambda x: x.k <> f.k)
      WHEN 'undo' THEN CASE WHEN len(past) > 0 THEN past[-1] ELSE cur END
      ELSE CASE WHEN len(future) > 0 THEN future[1] ELSE cur END END,
    CASE WHEN action = 'undo' THEN past[:greatest(len(past) - 1, 0)] WHEN action = 'redo' THEN CASE WHEN len(future) > 0 THEN list_append(past, cur) ELSE past END
      WHEN near AND len(past) > 0 THEN past ELSE list_append(past[greatest(1, len(past) - 98):], cur) END,
    CASE WHEN action = 'undo' THEN CASE WHEN len(past) > 0 THEN list_prepend(cur, future) ELSE future END WHEN action = 'redo' THEN future[2:]
      WHEN near AND len(past) > 0 THEN future ELSE [] END
  FROM s JOIN f ON f.doc_id = s.doc_id AND f.i = s.i + 1
)"""
_ACTION = "CASE WHEN event_type = 'signup' THEN 'add' WHEN event_type IN ('click', 'view') THEN 'update' WHEN event_type = 'purchase' THEN 'undo' ELSE '{0}' END"


@query(
    _FOLD.format(action=_ACTION.format("delete"))
    + """, e AS (SELECT doc_id, len(past) AS past, len(future) AS future, unnest(CASE WHEN len(cur) > 0 THEN cur ELSE [{'k': '', 'p': 0, 'v': 0}] END, recursive := true) FROM s)
SELECT doc_id, CASE WHEN k = '' THEN 'empty' ELSE 'edit' END AS kind, k AS key, p::BIGINT AS place, CASE WHEN k = '' THEN '{}' ELSE concat('{"page": 0, "v": ', v, '}') END AS value, past::INT AS past, future::INT AS future FROM e"""
)
def edit_state(spark, sf_dir):
    return E.fold_edits(edit_log(spark, sf_dir), burst_ms=7_200_000)


@query(_FOLD.format(action=_ACTION.format("redo")) + " SELECT doc_id, len(past)::INT AS past, len(future)::INT AS future, len(cur) AS edits FROM s")
def undo_redo(spark, sf_dir):
    """The log with every error taken as a redo: depths of both stacks."""
    log = edit_log(spark, sf_dir).withColumn("action", F.when(F.col("action") == "delete", "redo").otherwise(F.col("action")))
    return E.fold_edits(log, burst_ms=7_200_000).groupBy("doc_id").agg(F.max("past").alias("past"), F.max("future").alias("future"), F.count_if(F.col("kind") == "edit").alias("edits"))


def full_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all users as the logs of three documents, with every action there is: the count of
    pages comes again and again, and now and then a document is opened anew."""
    k, ev, page = F.col("event_id") % 16, F.col("event_id"), (F.col("user_id") % 4).cast("int")
    names = ["add", "add", "update", "update", "update", "update", "update", "delete", "undo", "undo", "redo", "set_page_op", "rotate", "set_page_order", "delete_page"]
    action = F.when(k < 15, F.get(F.array(*(F.lit(n) for n in names)), k.cast("int"))).when(ev % 2048 == 15, "open").otherwise("seed_order")
    one = lambda name, value: F.concat(F.lit('{"' + name + '": '), value.cast("string"), F.lit("}"))
    patch = F.when(ev % 3 == 0, one("v", ev)).when(ev % 3 == 1, one("w", ev)).otherwise(one("page", ev % 4))
    payload = (
        F.when(action == "add", one("v", ev)).when(action == "update", patch).when(action == "set_page_op", F.when(ev % 3 == 0, one("rotation", ev % 4 * 90)).otherwise(one("crop", ev)))
        .when(action == "rotate", F.when(ev % 5 == 0, one("delta", F.lit(-90))).otherwise("{}")).when(action == "set_page_order", F.concat(F.lit("["), (ev % 4).cast("string"), F.lit(", "), ((ev + 1) % 4).cast("string"), F.lit("]"))).when(action == "seed_order", F.lit('{"pages": 4}'))
    )
    placed = action.isin("add", "set_page_op", "rotate", "delete_page")
    key = F.when(action.isin("add", "update", "delete"), (F.floor("value") % 20).cast("long").cast("string"))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("doc_id"), ev.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), action.alias("action"), key.alias("edit_id"), F.when(placed, page).alias("page"), payload.alias("payload"))


#: The same log folded with whole snapshots (edits, page operations, order) on both stacks; an
#: order is a list, or the pages that were taken from those that the count gives.
_FULL = """WITH RECURSIVE l AS (SELECT user_id % 3 AS doc_id, event_id AS ev, epoch_ms(ts) AS ms, floor(value)::BIGINT % 20 AS k, (user_id % 4)::INT AS pg, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS i,
  CASE WHEN event_id % 16 < 15 THEN ['add', 'add', 'update', 'update', 'update', 'update', 'update', 'delete', 'undo', 'undo', 'redo', 'set_page_op', 'rotate', 'set_page_order', 'delete_page'][event_id % 16 + 1] WHEN event_id % 2048 = 15 THEN 'open' ELSE 'seed_order' END AS action FROM events
), b AS (SELECT doc_id, i, coalesce(action = 'update' AND lag(action) OVER w = 'update' AND k = lag(k) OVER w AND ms - lag(ms) OVER w < 7200000, false) AS near FROM l WHERE action <> 'seed_order' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), f AS (SELECT l.*, coalesce(near, false) AS near FROM l LEFT JOIN b USING (doc_id, i)
), none AS (SELECT {'e': []::STRUCT(k BIGINT, p INT, g INT, v BIGINT, w BIGINT)[], 'o': []::STRUCT(g INT, p INT, r BIGINT, c BIGINT)[], 'l': NULL::INT[], 'm': []::INT[]} AS s
), s(doc_id, i, nxt, seeded, cur, past, future) USING KEY (doc_id) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, 0, false, none.s, list_filter([none.s], lambda x: false), list_filter([none.s], lambda x: false) FROM l, none
  UNION SELECT s.doc_id, f.i, CASE WHEN action = 'open' THEN 0 WHEN action IN ('add', 'set_page_op', 'rotate') THEN nxt + 1 ELSE nxt END, CASE action WHEN 'open' THEN false WHEN 'seed_order' THEN true ELSE seeded END,
    CASE action
      WHEN 'add' THEN {'e': list_append(list_filter(cur.e, lambda x: x.k <> f.k), {'k': f.k, 'p': nxt + 1, 'g': f.pg, 'v': f.ev, 'w': NULL}), 'o': cur.o, 'l': cur.l, 'm': cur.m}
      WHEN 'update' THEN {'e': list_transform(cur.e, lambda x: {'k': x.k, 'p': x.p, 'g': CASE WHEN x.k = f.k AND f.ev % 3 = 2 THEN (f.ev % 4)::INT ELSE x.g END, 'v': CASE WHEN x.k = f.k AND f.ev % 3 = 0 THEN f.ev ELSE x.v END, 'w': CASE WHEN x.k = f.k AND f.ev % 3 = 1 THEN f.ev ELSE x.w END}), 'o': cur.o, 'l': cur.l, 'm': cur.m}
      WHEN 'delete' THEN {'e': list_filter(cur.e, lambda x: x.k <> f.k), 'o': cur.o, 'l': cur.l, 'm': cur.m}
      WHEN 'set_page_op' THEN {'e': cur.e, 'o': list_append(list_filter(cur.o, lambda x: x.g <> f.pg), {'g': f.pg, 'p': nxt + 1,
          'r': CASE WHEN f.ev % 3 = 0 THEN f.ev % 4 * 90 ELSE coalesce(list_filter(cur.o, lambda x: x.g = f.pg)[1].r, 0) END, 'c': CASE WHEN f.ev % 3 = 0 THEN list_filter(cur.o, lambda x: x.g = f.pg)[1].c ELSE f.ev END}), 'l': cur.l, 'm': cur.m}
      WHEN 'rotate' THEN {'e': cur.e, 'o': list_append(list_filter(cur.o, lambda x: x.g <> f.pg), {'g': f.pg, 'p': nxt + 1,
          'r': coalesce(list_filter(cur.o, lambda x: x.g = f.pg)[1].r, 0) + CASE WHEN f.ev % 5 = 0 THEN -90 ELSE 90 END, 'c': list_filter(cur.o, lambda x: x.g = f.pg)[1].c}), 'l': cur.l, 'm': cur.m}
      WHEN 'set_page_order' THEN {'e': cur.e, 'o': cur.o, 'l': [(f.ev % 4)::INT, ((f.ev + 1) % 4)::INT], 'm': []::INT[]}
      WHEN 'delete_page' THEN {'e': list_filter(cur.e, lambda x: x.g <> f.pg), 'o': list_filter(cur.o, lambda x: x.g <> f.pg), 'l': list_filter(cur.l, lambda x: x <> f.pg), 'm': CASE WHEN cur.l IS NULL THEN list_append(cur.m, f.pg) ELSE cur.m END}
      WHEN 'undo' THEN CASE WHEN len(past) > 0 THEN past[-1] ELSE cur END WHEN 'redo' THEN CASE WHEN len(future) > 0 THEN future[1] ELSE cur END
      WHEN 'open' THEN (SELECT s FROM none) ELSE cur END,
    CASE WHEN action = 'open' THEN past[:0] WHEN action = 'seed_order' THEN past WHEN action = 'undo' THEN past[:greatest(len(past) - 1, 0)] WHEN action = 'redo' THEN CASE WHEN len(future) > 0 THEN list_append(past, cur) ELSE past END
      WHEN near AND len(past) > 0 THEN past ELSE list_append(past[greatest(1, len(past) - 18):], cur) END,
    CASE WHEN action = 'open' THEN future[:0] WHEN action = 'seed_order' THEN future WHEN action = 'undo' THEN CASE WHEN len(past) > 0 THEN list_prepend(cur, future) ELSE future END WHEN action = 'redo' THEN future[2:]
      WHEN near AND len(past) > 0 THEN future ELSE future[:0] END
  FROM s JOIN f ON f.doc_id = s.doc_id AND f.i = s.i + 1
), e AS (SELECT doc_id, len(past)::INT AS past, len(future)::INT AS future, unnest(cur.e, recursive := true) FROM s
), o AS (SELECT doc_id, len(past)::INT AS past, len(future)::INT AS future, unnest(cur.o, recursive := true) FROM s
), r AS (SELECT doc_id, len(past)::INT AS past, len(future)::INT AS future, CASE WHEN cur.l IS NOT NULL THEN cur.l WHEN seeded THEN list_filter([0, 1, 2, 3], lambda x: NOT list_contains(cur.m, x)) END AS l FROM s)
SELECT doc_id, 'edit' AS kind, k::VARCHAR AS key, p::BIGINT AS place, concat('{"page": ', g, CASE WHEN v IS NOT NULL THEN concat(', "v": ', v) ELSE '' END, CASE WHEN w IS NOT NULL THEN concat(', "w": ', w) ELSE '' END, '}') AS value, past, future FROM e
UNION ALL SELECT doc_id, 'page_op', g::VARCHAR, p, concat('{', CASE WHEN c IS NOT NULL THEN concat('"crop": ', c, ', ') ELSE '' END, '"rotation": ', r, '}'), past, future FROM o
UNION ALL SELECT doc_id, 'order', '', 0, concat('[', array_to_string(l, ', '), ']'), past, future FROM r WHERE l IS NOT NULL"""


@query(_FULL)
def full_log_state(spark, sf_dir):
    """Every action, folded from end to end; twenty versions can be undone."""
    return E.fold_edits(full_log(spark, sf_dir), history=20, burst_ms=7_200_000)


@query(_FULL)
def long_log_state(spark, sf_dir):
    """The same in segments of a few hundred actions, that are folded side by side."""
    return fold_long_logs(full_log(spark, sf_dir), history=20, burst_ms=7_200_000, segment_rows=500)


@query(
    "WITH a AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 72 ELSE 36 END AS h FROM events), m AS (SELECT DISTINCT user_id, date_trunc('month', ts) + INTERVAL 10 DAY AS moment FROM events) SELECT user_id, event_id, moment FROM a JOIN m USING (user_id) WHERE ts <= moment AND moment < ts + to_hours(h)"
)
def active_alerts(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    alerts = ev.select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("variant"), F.lit(False).alias("sticky"), F.lit(None).cast("long").alias("duration_ms"))
    moments = ev.select(F.col("user_id").alias("key"), F.expr("timestamp(date_trunc('month', ts)) + interval 10 days").alias("at")).distinct()
    out = search.active_alerts(alerts, moments, error_ms=72 * 3_600_000, other_ms=36 * 3_600_000)
    return out.select(F.col("key").alias("user_id"), "event_id", F.col("at").cast("timestamp_ntz").alias("moment"))


@query(
    "WITH n AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL) SELECT user_id, event_type, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS INT) AS place FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) <= 3"
)
def recent_assets(spark, sf_dir):
    return search.recent_distinct(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", 3).select("user_id", "event_type", "place")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as font families with regular and, some, bold files."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS ord", "p_brand AS family", "p_type AS category", "p_size AS size")
    first = fonts.first_by_key(p, "family", ["ord"])
    url = F.concat(F.lit("f/"), F.col("ord").cast("string"))
    return first.withColumn("variants", F.when(F.col("size") % 2 == 0, F.create_map(F.lit("r"), url, F.lit("b"), F.concat(url, F.lit("b")))).otherwise(F.create_map(F.lit("r"), url)))


@query(
    "WITH c AS (SELECT p_brand AS family, arg_min(p_partkey, p_partkey) AS k, arg_min(p_size, p_partkey) AS size FROM part GROUP BY p_brand), s AS (SELECT DISTINCT CASE WHEN p_size % 9 = 0 THEN 'Times' WHEN p_size % 11 = 0 THEN 'Nowhere' ELSE p_brand END AS family, p_size % 2 = 0 AS bold, p_size % 3 = 0 AS italic FROM part)"
    " SELECT s.family, bold, italic, CASE WHEN s.family <> 'Times' AND k IS NOT NULL THEN concat('f/', k, CASE WHEN bold AND size % 2 = 0 THEN 'b' ELSE '' END) END AS url, CASE WHEN s.family = 'Times' OR k IS NOT NULL THEN s.family ELSE 'Helvetica' END AS resolved_family FROM s LEFT JOIN c USING (family)"
)
def catalog_lookup(spark, sf_dir):
    size = F.col("p_size")
    family = F.when(size % 9 == 0, "Times").when(size % 11 == 0, "Nowhere").otherwise(F.col("p_brand"))
    styles = table(spark, sf_dir, "part").select(family.alias("family"), (size % 2 == 0).alias("bold"), (size % 3 == 0).alias("italic")).distinct()
    return fonts.resolve_fonts(styles, catalog(spark, sf_dir)).select("family", "bold", "italic", "url", "resolved_family")


@query(r"SELECT DISTINCT p_brand AS family, concat('\"', p_brand, '\", sans-serif') AS stack FROM part".replace('\\"', '"'))
def font_stacks(spark, sf_dir):
    families = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family")).distinct()
    return fonts.font_stack(families, catalog(spark, sf_dir)).select("family", "stack")


@query(
    r"WITH u AS (SELECT page_id, url, string_split(regexp_split_to_array(url, '[?#]')[1], '/')[-1] AS n FROM pages) SELECT page_id, CASE WHEN n = '' THEN 'document.pdf' WHEN regexp_matches(n, '(?i)\.pdf$') THEN n ELSE n || '.pdf' END AS name, CASE WHEN contains(n, '.') THEN lower(string_split(n, '.')[-1]) ELSE '' END AS ext, regexp_matches(url, '(?i)\.pdf(\?|#|$)') AS accepted FROM u"
)
def url_filenames(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    last = F.element_at(F.split(F.element_at(F.split("url", "[?#]"), 1), "/"), -1)
    return p.select("page_id", X.url_filename(F.col("url")).alias("name"), X.ext_of(last).alias("ext"), X.accept_pdf(F.col("url"), F.lit("text/html")).alias("accepted"))


@query(
    """SELECT 0 AS sheet, 1 AS part, o_orderkey::BIGINT AS key, concat_ws(' ', rpad(o_orderkey::VARCHAR, 16, ' '), rpad(o_orderstatus, 16, ' '), rpad(o_orderpriority, 16, ' ')) AS text FROM orders UNION ALL SELECT 0, 0, NULL, '# orders' UNION ALL SELECT 0, 2, NULL, ''
UNION ALL SELECT 1, 1, n_nationkey, concat_ws(' ', rpad(n_nationkey::VARCHAR, 16, ' '), rpad(n_name, 16, ' ')) FROM nation UNION ALL SELECT 1, 0, NULL, '# nation' UNION ALL SELECT 1, 2, NULL, ''"""
)
def fixed_width(spark, sf_dir):
    """Two sheets, one after another."""
    orders, nation = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sheets = readers.fixed_width_sheets([("orders", orders, ["o_orderkey"]), ("nation", nation, ["n_nationkey"])])
    return sheets.select("sheet", "part", F.col("key.k0").cast("long").alias("key"), "text")


def styled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as styled runs; users are bold."""
    run = F.struct("page", F.col("str").alias("text"), (F.col("role") == "user").alias("bold"), *(F.lit(None).alias(k) for k in ("italic", "color", "font_size", "font_family")))
    rows = F.array_sort(F.collect_list(run))
    plain = F.transform(rows, lambda r: F.struct(r["text"].alias("text"), *(r[k].alias(k) for k in R.STYLE)))
    return turns(spark, sf_dir).groupBy("doc_id").agg(plain.alias("runs")).withColumn("runs", F.col("runs").cast(f"array<{R.STYLED_RUN}>"))


@query(
    "WITH c AS (SELECT conv_id, turn, text, role = 'user' AS bold FROM conversations WHERE text <> ''), f AS (SELECT *, coalesce(bold <> lag(bold) OVER w, true)::INT AS s FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM f) SELECT conv_id AS doc_id, k::INT AS run, string_agg(text, '' ORDER BY turn) AS text, any_value(bold) AS bold FROM g GROUP BY conv_id, k"
)
def runs_normalized(spark, sf_dir):
    df = styled_turns(spark, sf_dir).select("doc_id", F.posexplode(R.normalize_runs(F.col("runs"))).alias("run", "r"))
    return df.select("doc_id", "run", "r.text", "r.bold")


@query(
    """WITH c AS (SELECT conv_id AS doc_id, turn, text, role = 'user' AS bold, sum(length(text)) OVER w - length(text) AS s, sum(length(text)) OVER w AS e FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), k AS (SELECT *, unnest([0, 1, 2]) AS part FROM c
), p AS (SELECT doc_id, turn, part, bold, CASE WHEN part = 1 THEN true END AS italic, text, s, greatest(s, [0, 5, 25][part + 1]) AS low, least(e, [5, 25, 2147483647][part + 1]) AS high FROM k
), q AS (SELECT *, substr(text, (low - s + 1)::BIGINT, (high - low)::BIGINT) AS t FROM p WHERE high > low
), f AS (SELECT *, (bold IS DISTINCT FROM lag(bold) OVER w OR italic IS DISTINCT FROM lag(italic) OVER w OR lag(turn) OVER w IS NULL)::INT AS new FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY turn, part)
), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY turn, part) - 1 AS run FROM f)
SELECT doc_id, run::INT AS run, string_agg(t, '' ORDER BY turn, part) AS text, any_value(bold) AS bold, any_value(italic) AS italic FROM g GROUP BY doc_id, run"""
)
def runs_formatted(spark, sf_dir):
    """Characters 5 to 25 of every conversation made italic."""
    patch = F.struct(F.lit(None).cast("boolean").alias("bold"), F.lit(True).alias("italic"), *(F.lit(None).alias(k) for k in ("color", "font_size", "font_family")))
    done = styled_turns(spark, sf_dir).withColumn("runs", R.apply_format(F.col("runs"), F.lit(5), F.lit(25), patch))
    return done.select("doc_id", F.posexplode("runs").alias("run", "r")).select("doc_id", "run", "r.text", "r.bold", "r.italic")


_PIXELS = "px AS (SELECT DISTINCT floor(l_orderkey / 20)::BIGINT AS img_id, cast(l_partkey % 40 AS INT) AS x, cast(l_suppkey % 40 AS INT) AS y, cast((l_partkey % 40 * 7 + l_suppkey % 40 * 13) % 256 AS INT) AS v FROM lineitem)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").selectExpr("cast(floor(l_orderkey / 20) as bigint) AS img_id", "cast(l_partkey % 40 as int) AS x", "cast(l_suppkey % 40 as int) AS y", "cast((l_partkey % 40 * 7 + l_suppkey % 40 * 13) % 256 as int) AS v").distinct()
    return p.select("img_id", "x", "y", *(F.col("v").alias(c) for c in "rgb"), F.lit(255).alias("a"))


_ALPHA = "CASE WHEN v / 255 <= 0.35 THEN 1.0 WHEN v / 255 >= 0.6 THEN 0.0 ELSE pow(1 - (v / 255 - 0.35) / 0.25, 1 / 2.05) END"


@query(f"WITH {_PIXELS} SELECT img_id, x, y, 17 AS r, 24 AS g, 39 AS b, cast(floor(({_ALPHA}) * 255 + 0.5) AS INT) AS a FROM px")
def pixel_key_out(spark, sf_dir):
    return raster.key_out(pixels(spark, sf_dir))


@query(f"WITH {_PIXELS}, k AS (SELECT *, floor(({_ALPHA}) * 255 + 0.5) AS a FROM px) SELECT img_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM k WHERE a > 8 GROUP BY img_id")
def ink_bounds(spark, sf_dir):
    return raster.ink_bounds(raster.key_out(pixels(spark, sf_dir)))


@query(
    f"WITH {_PIXELS}, b AS (SELECT DISTINCT img_id, unnest([0, 1, 2]) AS box FROM px), s AS (SELECT img_id, box, list_sort(list(v))[len(list(v)) // 2 + 1] AS m FROM b JOIN px USING (img_id) WHERE x >= box * 10 AND x < box * 10 + 12 AND y >= box * 8 AND y < box * 8 + 6 GROUP BY ALL)"
    " SELECT img_id, box, CASE WHEN m IS NULL THEN '#ffffff' ELSE concat('#', repeat(lower(lpad(to_hex(m), 2, '0')), 3)) END AS background FROM b LEFT JOIN s USING (img_id, box)"
)
def background_color(spark, sf_dir):
    p = pixels(spark, sf_dir)
    b = p.select("img_id").distinct().select("img_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("box"))
    b = b.select("img_id", "box", (F.col("box") * 10.0).alias("x"), (F.col("box") * 8.0 + 4).alias("y"), F.lit(12.0).alias("width"), F.lit(20.0).alias("height"))
    return raster.background_color(b, p).select("img_id", "box", "background")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
