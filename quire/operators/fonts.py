"""Font catalog lookups. The catalog is a table (ord, family, category, variants)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import is_standard_font

#: A larger catalog is joined by a shuffle.
MAX_BROADCAST_FONTS = 100_000

# Generic families by category, and the stacks of the standard fonts.
GENERIC = {"sans-serif": "sans-serif", "serif": "serif", "display": "sans-serif", "handwriting": "cursive", "monospace": "monospace"}
STACKS = {"Times": '"Times New Roman", Times, serif', "Courier": '"Courier New", Courier, monospace', "Helvetica": "Helvetica, Arial, sans-serif"}


def first_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def sized(catalog: DataFrame) -> DataFrame:
    few = catalog.limit(MAX_BROADCAST_FONTS + 1).count() <= MAX_BROADCAST_FONTS
    return catalog.hint("broadcast" if few else "merge")


def resolve_fonts(styles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``url`` and ``resolved_family`` to (family, bold, italic): the variant asked for,
    else the bold (of bold italic), else the regular one; Helvetica without any."""
    fonts = sized(catalog.select("family", "variants"))
    v = F.col("variants")
    url = F.when(F.col("bold") & F.col("italic"), F.coalesce(v["bi"], v["b"], v["r"])).when(F.col("bold"), F.coalesce(v["b"], v["r"])).when(F.col("italic"), F.coalesce(v["i"], v["r"])).otherwise(v["r"])
    joined = styles.join(fonts, "family", "left").withColumn("url", F.when(~is_standard_font(F.col("family")), url)).drop("variants")
    return joined.withColumn("resolved_family", F.when(is_standard_font(F.col("family")) | F.col("url").isNotNull(), F.col("family")).otherwise("Helvetica"))


def font_stack(families: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``stack``, the CSS value of a family."""
    joined = families.join(sized(catalog.select("family", "category")), "family", "left")
    generic = F.lit("sans-serif")
    for category, name in GENERIC.items():
        generic = F.when(F.col("category") == category, F.lit(name)).otherwise(generic)
    stack = F.concat(F.lit('"'), F.col("family"), F.lit('", '), generic)
    for family, value in STACKS.items():
        stack = F.when(F.col("family") == family, F.lit(value)).otherwise(stack)
    return joined.withColumn("stack", stack).drop("category")


def families_used(edits: DataFrame) -> DataFrame:
    """Distinct families of boxes and runs outside the standard ones."""
    named = F.array_union(F.array("font_family"), F.coalesce(F.transform("runs", lambda r: r["font_family"]), F.array().cast("array<string>")))
    return edits.select("doc_id", F.explode(named).alias("family")).where(F.col("family").isNotNull() & ~is_standard_font(F.col("family"))).distinct()
