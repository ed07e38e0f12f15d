"""Recognised lines to paragraphs, and paragraphs to a classified outline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.geometry import js_round
from quire.functions.stats import modal_first_over, upper_median_over

PAGE = ["doc_id", "page"]


def marker(c: Column) -> Column:
    return X.is_list_marker(c) | X.is_misread_bullet(c)


def paragraph_starts(lines: DataFrame, gap_ratio: float = 1.3, indent: float = 8.0) -> DataFrame:
    """Adds ``starts`` and ``is_list_item``. A wide gap, a list marker, and a line right
    above a marker start a paragraph; so does an indent that a gap precedes. What is known of
    a page comes from windows over it, so that one exchange on (doc_id, page) serves all. A
    column ``_marker``, where there is one, tells which lines have a marker."""
    df = modal_first_over("_x", PAGE, ["ord"], lines.withColumn("_x", js_round(F.col("first_x"))), "_modal")
    page = Window.partitionBy(*PAGE).orderBy("ord")
    whole = page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tall = F.when(F.col("row_height") > 0, F.col("row_height"))
    df = upper_median_over(df, tall, PAGE, "_median").withColumn("_n", F.count(tall).over(whole)).withColumn("_first", F.first(F.col("y1") - F.col("y0")).over(whole))
    median = F.when(F.col("_n") > 0, F.col("_median")).otherwise(F.col("_first"))
    gap = F.coalesce(F.col("y0") - F.lag("y1").over(page) > median * gap_ratio, F.lit(False))
    is_marker = F.col("_marker") if "_marker" in lines.columns else marker(F.col("text"))
    heading = ~is_marker & F.coalesce(F.lead(is_marker).over(page), F.lit(False))
    indented = F.col("first_x") - F.col("_modal") > indent
    first = F.lag("ord").over(page).isNull()
    return df.withColumn("starts", first | gap | heading | is_marker | (indented & gap)).withColumn("is_list_item", is_marker | indented).drop("_x", "_modal", "_median", "_n", "_first")


def group_ids(df: DataFrame, flag: str, keys: list[str], order: list[str], name: str = "group") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.col(flag).cast("int")).over(w))


def build_paragraphs(lines: DataFrame, gap_ratio: float = 1.3, indent: float = 8.0, compose: bool = True) -> DataFrame:
    """(doc_id, page, paragraph, text, x0, y0, x1, y1, is_list_item, is_bold, line_count):
    lines are joined in order, a hyphen before a small letter going."""
    # texts are cleaned where they are: Python between two windows would cost another exchange
    marked = lines.withColumn("_marker", marker(F.col("text"))).withColumn("_text", X.canonical_bullet(X.normalize_ligatures(F.col("text"), compose))).drop("text")
    cleaned = group_ids(paragraph_starts(marked, gap_ratio, indent), "starts", PAGE, ["ord"], "paragraph")
    # a line's part of the paragraph depends on its neighbours only
    w = Window.partitionBy(*PAGE, "paragraph").orderBy("ord")
    after, before = F.lead("_text").over(w), F.lag("_text").over(w)
    soft = F.col("_text").rlike("[A-Za-z]-$") & F.coalesce(after.rlike("^[a-z]"), F.lit(False))
    kept = F.when(soft, F.expr("left(_text, length(_text) - 1)")).otherwise(F.col("_text"))
    glued = before.isNull() | (before.rlike("[A-Za-z]-$") & F.col("_text").rlike("^[a-z]"))
    parts = cleaned.withColumn("_part", F.concat(F.when(glued, F.lit("")).otherwise(F.lit(" ")), kept))
    grouped = parts.groupBy(*PAGE, "paragraph").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_part"))), lambda r: r["_part"]), "").alias("text"), *union_bbox(),
        F.min_by("is_list_item", "ord").alias("is_list_item"), F.bool_and("all_words_bold").alias("is_bold"), F.count("*").alias("line_count"),
    )
    return grouped


def union_bbox() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def bold_by_density(paragraphs: DataFrame, ratio: float = 1.45, min_words: int = 2) -> DataFrame:
    """Sets ``is_bold`` where ``density`` stands out on its page; never clears it."""
    rated = upper_median_over(paragraphs, F.when(F.col("density") > 0, F.col("density")), PAGE, "_median")
    dense = (F.col("_median") > 0) & (F.col("density") > F.col("_median") * ratio) & (X.word_count(F.col("text")) >= min_words) & ~F.col("is_list_item")
    return rated.withColumn("is_bold", F.col("is_bold") | F.coalesce(dense, F.lit(False))).drop("_median")


def block_kind(text: Column, bold: Column) -> Column:
    """list, heading (bold, one to eight words) or body."""
    return F.when(X.is_list_marker(text), "list").when(bold & X.word_count(text).between(1, 8), "heading").otherwise("body")


def classify_blocks(df: DataFrame, text: str = "text", bold: str = "bold") -> DataFrame:
    """Adds ``kind`` and ``content``, a list item's without its bullet."""
    kind = block_kind(F.col(text), F.col(bold))
    return df.withColumn("kind", kind).withColumn("content", F.when(F.col("kind") == "list", X.strip_bullet(F.col(text))).otherwise(F.col(text)))
