"""Sinks of the layout tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import js_trim
from quire.operators.pages import order_edits, part_labels
from quire.operators.paragraphs import classify_blocks


def write_lines_csv(lines: DataFrame, path: str) -> None:
    """Page, Line, Text in reading order within each file, and from file to file. Texts lose
    the white space, of any kind, at their ends; a quote in a text is doubled."""
    rows = lines.select("doc_id", (F.col("page") + 1).alias("Page"), F.col("line").alias("Line"), js_trim(F.col("str")).alias("Text"))
    order = ["doc_id", "Page", "Line"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_lines_csv(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_lines_csv`` wrote; a text may hold any character but a line feed."""
    return spark.read.schema("doc_id bigint, Page int, Line int, Text string").options(header=True, escape='"', lineSep="\n").csv(path)


def documents_without_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    return docs.join(lines.select("doc_id").hint("merge"), "doc_id", "left_anti")


def write_ordered(df: DataFrame, path: str, order: list[str], commit: str, max_rows: int = 10_000_000) -> None:
    """``df`` as the folder ``commit=...`` of a table, in order over all its files: their number
    follows the bytes, whatever the keys, and a reader that asks for a few keys skips the others by
    the files' own statistics. A commit that is repeated replaces what it wrote before."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode("overwrite").option("maxRecordsPerFile", max_rows).parquet(f"{path}/commit={commit}")


def outline(edits: DataFrame, page_order: DataFrame) -> DataFrame:
    """Text edits as ordered list, heading and body rows."""
    return classify_blocks(order_edits(edits.where("type = 'text'"), page_order))


def write_outline(edits: DataFrame, page_order: DataFrame, path: str, commit: str = "0") -> None:
    """The outline in reading order; commits stand side by side in one table."""
    write_ordered(outline(edits, page_order), path, ["doc_id", "rank"], commit)


def write_parts(parts: DataFrame, path: str, commit: str = "0") -> None:
    """Pages by part under ``pages``, and under ``manifest`` each part's label with its first and
    last page and their number. The manifest comes last: a commit that it does not list, because a
    job was lost, is no part of the set."""
    labels = part_labels(parts)
    named = parts.join(labels.select("doc_id", "part", "label").hint("merge"), ["doc_id", "part"]).drop("part").withColumnRenamed("label", "part")
    write_ordered(named, f"{path}/pages", ["doc_id", "part", "page"], commit)
    write_ordered(labels.drop("part").withColumnRenamed("label", "part"), f"{path}/manifest", ["doc_id", "part"], commit)


def _by_commit(df: DataFrame) -> DataFrame:
    """``commit`` as the text in the file's path: Spark reads a folder's name as a number where
    all of a table's are numbers, and two tables may differ in that."""
    return df.withColumn("commit", F.regexp_extract(F.col("_metadata.file_path"), "/commit=([^/]*)/", 1))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, first, last, pages, commit) of all parts that were written whole."""
    return _by_commit(spark.read.parquet(f"{path}/manifest"))


def read_parts(spark: SparkSession, path: str, doc_id: int | None = None, part: str | None = None) -> DataFrame:
    """Pages of the parts that the manifest lists, all or those of one document or part."""
    wanted = F.lit(True)
    for c, v in (("doc_id", doc_id), ("part", part)):
        wanted = wanted & (F.col(c) == v) if v is not None else wanted
    commits = read_manifest(spark, path).where(wanted).select("commit").distinct()
    return _by_commit(spark.read.parquet(f"{path}/pages").where(wanted)).join(commits, "commit", "left_semi")
