"""Scans into the layout tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.geometry import run_box
from quire.functions.text import CONVERTIBLE, ext_of, js_trim
from quire.schemas import ASSETS, OCR_TREE, RUNS


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Positioned runs; items without text, and blank ones, are dropped."""
    runs = spark.read.schema(RUNS).parquet(path)
    return runs.where(F.col("str").isNotNull() & (js_trim(F.col("str")) != ""))


def project_runs(items: DataFrame) -> DataFrame:
    """Text items (doc_id, page, str, matrix, advance, page_width, page_height) as screen
    runs; marks without text, and blank ones, are dropped."""
    shown = items.where(F.col("str").isNotNull() & (js_trim(F.col("str")) != ""))
    placed = run_box(F.col("matrix"), F.col("advance"), F.col("page_width"), F.col("page_height"))
    return shown.withColumn("_r", placed).select("*", "_r.*").drop("_r", "matrix", "advance", "page_width", "page_height")


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OCR_TREE).json(path)


def ocr_lines(tree: DataFrame, words: bool = True) -> DataFrame:
    """Lines of a recognised tree in tree order: trailing newlines cut, blank lines and
    lines without a box skipped. ``words`` takes the first word's left edge and boldness
    from the words; without it the line's own box stands for both."""
    lines = F.flatten(F.flatten(F.transform("blocks", lambda b: F.transform(b["paragraphs"], lambda p: p["lines"]))))
    rows = tree.select("doc_id", "page", F.posexplode(lines).alias("ord", "l")).withColumn("text", F.regexp_replace("l.text", r"\n+$", ""))
    rows = rows.where(F.col("l.bbox").isNotNull() & (js_trim(F.col("text")) != ""))
    inked = F.filter("l.words", lambda w: js_trim(w["text"]) != "")
    first = F.coalesce(F.get(inked, F.lit(0))["bbox"]["x0"], F.col("l.bbox.x0")) if words else F.col("l.bbox.x0")
    bold = F.exists(inked, lambda w: F.lit(True)) & F.forall(inked, lambda w: F.coalesce(w["is_bold"], F.lit(False))) if words else F.lit(False)
    height = F.coalesce("l.rowAttributes.row_height", F.col("l.bbox.y1") - F.col("l.bbox.y0"))
    return rows.select("doc_id", "page", "ord", "text", *(F.col(f"l.bbox.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")), first.alias("first_x"), height.alias("row_height"), F.coalesce(bold, F.lit(False)).alias("all_words_bold"))


def text_paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, ord, text): a row a line, blank ones too."""
    return docs.select("doc_id", F.posexplode(F.split(text, "\r?\n")).alias("ord", "text"))


def text_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line, text) of the non-blank lines, numbered from 1 within the row: no
    shuffle is needed."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: js_trim(x) != "")
    return docs.select("doc_id", F.posexplode(lines).alias("_at", "text")).select("doc_id", (F.col("_at") + 1).alias("line"), "text")


def fixed_width_row(columns: list[Column], width: int = 16) -> Column:
    """Cells as text, null as blank, padded and cut to ``width`` and joined by one space."""
    return F.concat_ws(" ", *(F.rpad(F.coalesce(c.cast("string"), F.lit("")), width, " ") for c in columns))


def fixed_width_rows(df: DataFrame, name: str, order: list[str], width: int = 16) -> DataFrame:
    """(part, key, text): a heading row, the rows that are not all null, a blank row. The order
    is told by ``part`` and ``key``, a struct of the order columns in their own types; nothing is
    sorted in one task."""
    blank = F.lit(True)
    for c in df.columns:
        blank = blank & F.col(c).isNull()
    key = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order)))
    body = df.where(~blank).select(F.lit(1).alias("part"), key.alias("key"), fixed_width_row([F.col(c) for c in df.columns], width).alias("text"))
    ends = df.sparkSession.createDataFrame([(0, f"# {name}"), (2, "")], "part int, text string")
    return body.unionByName(ends.select("part", F.lit(None).cast(body.schema["key"].dataType).alias("key"), "text"))


def fixed_width_sheets(sheets: list[tuple[str, DataFrame, list[str]]], width: int = 16) -> DataFrame:
    """(sheet, part, key, text) of several (name, table, order columns), one after another;
    the order columns agree in number and, but for widening, in type."""
    out = None
    for i, (name, df, order) in enumerate(sheets):
        rows = fixed_width_rows(df, name, order, width).select(F.lit(i).alias("sheet"), "part", "key", "text")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no sheet is given")
    return out


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, ord, path, length, modified) of the files in and below ``folder``; what lies in
    one folder is a batch, in order of names. Contents are not read, and what is wanted of the
    names and lengths is filtered before ``route_files``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    cut = F.regexp_extract("path", r"^(.*)/([^/]*)$", 1), F.regexp_extract("path", r"^(.*)/([^/]*)$", 2)
    return files.select(cut[0].alias("batch"), cut[1].alias("ord"), "path", "length", F.col("modificationTime").alias("modified"))


def route_files(listing: DataFrame, has_document: bool = False) -> DataFrame:
    """For each batch the one file that is opened, and how: the first PDF, else the first
    image if a document is open, else the first convertible file. PDFs and images are told
    by a column ``mime``, where there is one, else by the file's ending; convertible files
    always by the ending."""
    ext = ext_of(F.col("path"))
    mime = F.col("mime") if "mime" in listing.columns else F.when(ext == "pdf", "application/pdf").when(ext.isin("png", "jpg", "jpeg"), "image/png")
    route = F.when(mime == "application/pdf", "pdf").when(mime.isin("image/png", "image/jpeg") & F.lit(has_document), "image").when(ext.isin(CONVERTIBLE), "convert")
    rank = F.when(F.col("route") == "pdf", 0).when(F.col("route") == "image", 1).otherwise(2)
    routed = listing.withColumn("route", route).where("route is not null")
    return routed.withColumn("_n", F.row_number().over(Window.partitionBy("batch").orderBy(rank, "ord"))).where("_n = 1").drop("_n")


def read_assets(df: DataFrame) -> DataFrame:
    """(owner, pos, id, data_url) of stored JSON lists; what is not a list is empty, and
    entries without both strings are dropped."""
    items = F.from_json("json", ASSETS, {"mode": "PERMISSIVE"})
    rows = df.select("owner", F.posexplode(items).alias("pos", "_a"))
    return rows.where("_a.id is not null and _a.dataUrl is not null").select("owner", "pos", F.col("_a.id").alias("id"), F.col("_a.dataUrl").alias("data_url"))
