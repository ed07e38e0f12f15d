"""Reading order: runs to lines, lines to blocks, blocks to numbered text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import js_trim

PAGE = ["doc_id", "page"]


def cluster_lines(runs: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Adds ``line``: runs less than ``threshold`` from the line's first baseline share a
    line. A page's sorted baselines are folded with the anchor as state, so drift does not
    chain; the fold is bounded by a page, and made once for it, in its first row."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<double>").alias("all"))

    def step(acc, b):
        new = acc["anchor"].isNull() | (F.abs(b - acc["anchor"]) >= threshold)
        return F.struct(F.when(new, b).otherwise(acc["anchor"]).alias("anchor"), F.when(new, F.concat(acc["all"], F.array(b))).otherwise(acc["all"]).alias("all"))

    page = Window.partitionBy(*PAGE)
    ordered = runs.withColumn("_levels", F.collect_set("baseline").over(page)).withColumn("_first", F.row_number().over(page.orderBy("baseline")) == 1)
    folded = F.when(F.col("_first"), F.aggregate(F.array_sort("_levels"), start, step, lambda acc: acc["all"]))
    anchored = ordered.withColumn("_anchors", folded).withColumn("_anchors", F.first("_anchors", ignorenulls=True).over(page))
    return anchored.withColumn("line", F.size(F.filter("_anchors", lambda a: a <= F.col("baseline"))) - 1).drop("_levels", "_first", "_anchors")


def split_line_gaps(runs: DataFrame, ratio: float = 1.5) -> DataFrame:
    """Adds ``block``, the number of the block on its page: a gap wider than ``ratio``
    font sizes splits a line."""
    line = Window.partitionBy(*PAGE, "line").orderBy("x", "baseline", "ord")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(line)
    flagged = runs.withColumn("_new", (gap.isNull() | (gap > F.col("font_size") * ratio)).cast("int"))
    page = Window.partitionBy(*PAGE).orderBy("line", "x", "baseline", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return flagged.withColumn("block", F.sum("_new").over(page) - 1).drop("_new")


def space_runs(runs: DataFrame, ratio: float = 0.15) -> DataFrame:
    """Adds ``text``: a run's string with a space in front where a visible gap wants one."""
    w = Window.partitionBy(*PAGE, "block").orderBy("x", "baseline", "ord")
    gap, before = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w), F.lag("str").over(w)
    wants = (gap > F.col("font_size") * ratio) & ~before.endswith(" ") & ~F.col("str").startswith(" ")
    return runs.withColumn("text", F.when(wants, F.concat(F.lit(" "), "str")).otherwise(F.col("str")))


def build_blocks(runs: DataFrame) -> DataFrame:
    """One row a block: joined text, union box, dominant size, style and nested runs."""
    order = ["x", "baseline", "ord"]
    ink = js_trim(F.col("str")) != ""
    run = F.struct(*order, "text", "str", "y", "width", "height", "font_size", "font_family", "bold", "italic")
    rows = F.array_sort(F.collect_list(run))
    right, bottom = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    grouped = runs.groupBy(*PAGE, "block").agg(
        rows.alias("_rows"), F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("width"), (bottom - F.min("y")).alias("height"), F.max("font_size").alias("font_size"),
        F.coalesce(F.bool_and(F.when(ink, F.col("bold"))), F.lit(False)).alias("bold"), F.coalesce(F.bool_and(F.when(ink, F.col("italic"))), F.lit(False)).alias("italic"),
    )
    return grouped.select(
        *PAGE, "block", F.array_join(F.transform("_rows", lambda r: r["text"]), "").alias("str"), "x", "y", "width", "height", "font_size", F.get("_rows", F.lit(0))["font_family"].alias("font_family"), "bold", "italic",
        F.transform("_rows", lambda r: F.struct(r["text"].alias("text"), *(r[k].alias(k) for k in ("bold", "italic", "font_size", "font_family")))).alias("runs"),
        F.transform("_rows", lambda r: F.struct(*(r[k].alias(k) for k in ("str", "x", "y", "width", "height", "font_size", "font_family", "bold", "italic")))).alias("sub_items"),
    )


def line_blocks(runs: DataFrame) -> DataFrame:
    """Runs to blocks. Every key begins with (doc_id, page), so that one exchange on it, that of
    the first window or one that the runs have already, serves the whole chain."""
    return build_blocks(space_runs(split_line_gaps(cluster_lines(runs))))


def number_lines(blocks: DataFrame, order: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Non-blank blocks with ``line``, 1-based in reading order on their page."""
    w = Window.partitionBy(*PAGE).orderBy(*order, *(["ord"] if "ord" in blocks.columns else []))
    return blocks.where(js_trim(F.col("str")) != "").withColumn("line", F.row_number().over(w))


def paginate(lines: DataFrame, slots: int = 43) -> DataFrame:
    """Adds ``sheet`` and ``slot`` to a document's lines (doc_id, ord): blank lines use a
    slot, and so open the next sheet when they fall on its last."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return lines.withColumn("sheet", F.floor(n / slots).cast("int")).withColumn("slot", F.pmod(n, F.lit(slots)).cast("int"))
