"""From documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept; a stage but the last returns the columns it
was given, whatever their names and types. Nulls, empty tables, repeated rows, ties, and
empty and very long texts are treated as its operator says; the stages that drop documents
take each row by its own verdict, whatever its doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import discard, passing, read_table, without, written
from quire.llm.decontaminate import decontaminate
from quire.llm.hostrules import keep_good
from quire.llm.neardup import near_duplicates
from quire.llm.packing import pack, token_pieces
from quire.llm.queries import TOKENIZER
from quire.llm.substring import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host does, go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the least doc_id stays."""
    return without(docs, near_duplicates(docs, with_row=True).where(~F.col("kept")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has are cut out of the text; the rest
    is joined by one space. A text that loses nothing stays as it was, a document that
    loses all its words stays with an empty text. ``n_chars`` follows the text."""
    row = F.struct(F.col("text").isNull().alias("null_text"), F.struct(*(c for c in docs.columns if c != "text")).alias("others"))
    found = remove_repeats(docs.select("doc_id", "text", row.alias("row")), carry=("row",), raw=True)
    row = F.col("carried")["row"]
    columns = {c: row["others"][c] for c in docs.columns if c != "text"} | {"text": F.when(~row["null_text"], F.col("kept"))}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*(columns[c].alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark item go."""
    return without(docs, decontaminate(docs, read_table(spark, sf_dir, "benchmark"), with_row=True).where("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return pack(token_pieces(docs, tokenizer=TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: Minhash groups and packing have no SQL form; ``tests/llm/test_stages.py`` compares each
#: stage with a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again. What a stage
    wrote on its way, and its input, are deleted when its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing(spark) as keep:
            before, docs = docs, written(stage(spark, docs, sf_dir), name)
            keep.append(docs)
        if hasattr(before, "written_to"):
            discard(spark, before.written_to)
    return STAGES[-1][1](spark, docs, sf_dir)
