"""Page sets: order, ranges, splits, merges and their edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import box, normal_rotation
from quire.schemas import RECT, VIEWER_WIDTH


def order_edits(edits: DataFrame, page_order: DataFrame) -> DataFrame:
    """Adds ``rank``, the place in reading order: by the page's place (its own number if
    it has none; its last one if it is listed twice), then y, then input order."""
    places = page_order.groupBy("doc_id", "page").agg(F.max("pos").alias("_pos"))
    placed = edits.join(places.hint("merge"), ["doc_id", "page"], "left").withColumn("page_rank", F.coalesce("_pos", "page"))
    return placed.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_rank", "y", "ord"))).drop("_pos")


def valid_order(page_order: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, pos, page) without entries out of range, numbered anew; ``counts`` is
    (doc_id, page_count)."""
    valid = page_order.join(counts.select("doc_id", "page_count").hint("merge"), "doc_id").where((F.col("page") >= 0) & (F.col("page") < F.col("page_count")))
    return valid.select("doc_id", "page", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).alias("pos"))


def remap_edits(edits: DataFrame, page_order: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Edits on their output page; those of dropped pages vanish, and of a page that is
    listed twice the last place counts. With ``counts`` the order is first rid of entries
    out of range."""
    if counts is not None:
        page_order = valid_order(page_order, counts)
    places = page_order.groupBy("doc_id", "page").agg(F.max("pos").alias("out_page"))
    return edits.join(places.hint("merge"), ["doc_id", "page"])


def pages_with_ops(pages: DataFrame, ops: DataFrame) -> DataFrame:
    return pages.join(ops, ["doc_id", "page"], "left")


def apply_page_ops(pages: DataFrame, ops: DataFrame) -> DataFrame:
    """Adds ``rotation_out`` and ``crop_box`` in PDF units; a crop that leaves nothing is
    dropped. The page is turned first: insets are on the scale of the width that is then
    seen. They are taken off the page's own crop box, a struct column ``source_crop`` (x, y,
    width, height), or off the whole page where there is none."""
    df = pages_with_ops(pages, ops)
    norm = normal_rotation(F.col("rotation"))
    rotation = F.when(norm != 0, norm).otherwise(F.coalesce("source_rotation", F.lit(0)))
    turned = F.pmod(rotation, F.lit(180)) != 0
    s = F.when(turned, F.col("height")).otherwise(F.col("width")) / VIEWER_WIDTH
    whole = box(F.lit(0.0), F.lit(0.0), F.col("width").cast("double"), F.col("height").cast("double"))
    b = F.coalesce(F.col("source_crop").cast(RECT), whole) if "source_crop" in pages.columns else whole
    c = F.col("crop")
    width, height = b["width"] - (c["left"] + c["right"]) * s, b["height"] - (c["top"] + c["bottom"]) * s
    crop = F.when((width > 0) & (height > 0), box(b["x"] + c["left"] * s, b["y"] + c["bottom"] * s, width, height))
    return df.withColumn("rotation_out", rotation).withColumn("crop_box", crop)


def live_pages(pages: DataFrame, page_order: DataFrame, live: bool = True) -> DataFrame:
    return pages.join(page_order.select("doc_id", "page"), ["doc_id", "page"], "left_semi" if live else "left_anti")


def merge_docs(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Pages of the documents listed in (target, place, doc_id), one after another, with
    ``new_page``; page counts are summed first, so no window spans a merged document."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("target").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    base = order.join(counts, "doc_id").withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    return pages.withColumn("_at", place).join(base.select("target", "place", "doc_id", "_base"), "doc_id").withColumn("new_page", F.col("_base") + F.col("_at")).drop("_base", "_at")


def parse_page_ranges(specs: DataFrame) -> DataFrame:
    """(doc_id, part, page) for (doc_id, spec, page_count): ranges are 1-based, reversed
    ones are swapped, pages out of range and junk are ignored, empty parts dropped. Numbers
    may have any number of digits."""

    def number(digits: Column) -> Column:
        value = F.regexp_replace(digits, "^0+(?=[0-9])", "")
        return F.when(F.length(value) > 18, F.lit(10**18)).otherwise(F.nullif(value, F.lit("")).cast("long"))

    tokens = specs.select("*", F.posexplode(F.split("spec", ",")).alias("_token", "_text"))
    text = F.regexp_replace("_text", r"(?U)^\s+|\s+$", "")
    pattern = r"^([0-9]+)(?:(?U:\s)*-(?U:\s)*([0-9]+))?$"
    a = number(F.regexp_extract(text, pattern, 1))
    b = F.coalesce(number(F.regexp_extract(text, pattern, 2)), a)
    low, high = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), F.col("page_count").cast("long"))
    found = tokens.withColumn("_low", low).withColumn("_high", high).where(a.isNotNull() & (low <= high))
    found = found.withColumn("part", F.row_number().over(Window.partitionBy("doc_id").orderBy("_token")) - 1)
    return found.select("doc_id", "part", F.explode(F.sequence((F.col("_low") - 1).cast("int"), (F.col("_high") - 1).cast("int"))).alias("page"))


def split_by_ranges(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Pages with their part; a document with an empty spec has one part a page."""
    # the pages of a range come from a generator, so that Spark cannot know their number
    counted = specs.join(pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count")), "doc_id")
    named = parse_page_ranges(counted)
    empty = F.regexp_replace(F.coalesce("spec", F.lit("")), r"(?U)\s+", "") == ""
    single = pages.join(specs.where(empty).select("doc_id"), "doc_id", "left_semi").withColumn("part", F.col("page"))
    return pages.join(named.hint("merge"), ["doc_id", "page"]).unionByName(single)


def split_every(pages: DataFrame, n: float) -> DataFrame:
    return pages.withColumn("part", F.floor(F.col("page") / max(1, int(n))).cast("int"))


def part_label(first: Column, last: Column) -> Column:
    """p3, or p3-7 for a part of several pages; pages are 0-based."""
    one = F.concat(F.lit("p"), (first + 1).cast("string"))
    return F.when(first == last, one).otherwise(F.concat(one, F.lit("-"), (last + 1).cast("string")))


def part_labels(parts: DataFrame) -> DataFrame:
    grouped = parts.groupBy("doc_id", "part").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count("*").alias("pages"))
    return grouped.withColumn("label", part_label(F.col("first"), F.col("last")))


def move_page(order: DataFrame, source: int, target: int) -> DataFrame:
    """(doc_id, pos, page) with the page at ``source`` moved to ``target``; documents
    without both places stay as they are."""
    last = Window.partitionBy("doc_id")
    ok = (F.max("pos").over(last) >= max(source, target)) & F.lit(min(source, target) >= 0)
    p = F.col("pos")
    if source < target:
        moved = F.when(p == source, target).when((p > source) & (p <= target), p - 1).otherwise(p)
    else:
        moved = F.when(p == source, target).when((p < source) & (p >= target), p + 1).otherwise(p)
    return order.withColumn("_ok", ok).withColumn("pos", F.when(F.col("_ok"), moved).otherwise(p).cast("int")).drop("_ok")


def gap_target(gap: int, source: int) -> int:
    """Place of a page that is dropped into the gap before place ``gap``."""
    return gap - 1 if gap > source else gap


def delete_pages(table: DataFrame, gone: DataFrame, order: DataFrame) -> DataFrame:
    """Rows of ``table`` whose page is not deleted; a document never loses its last page:
    where all pages of its order are listed, none goes."""
    hit = order.join(gone.distinct().withColumn("_gone", F.lit(1)), ["doc_id", "page"], "left")
    whole = hit.groupBy("doc_id").agg((F.count("*") == F.count("_gone")).alias("_all")).where("_all").select("doc_id")
    return table.join(gone.join(whole, "doc_id", "left_anti"), ["doc_id", "page"], "left_anti")


def is_reordered(order: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, reordered) after entries out of range are dropped."""
    placed = valid_order(order, counts).withColumnRenamed("pos", "_at").join(counts, "doc_id").groupBy("doc_id", "page_count").agg((F.bool_or(F.col("_at") != F.col("page")) | (F.count("*") != F.first("page_count"))).alias("reordered"))
    return placed.select("doc_id", "reordered")


def seed_order(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, page) of documents (doc_id, pages, order array or null)."""
    seeded = F.coalesce("order", F.when(F.col("pages") > 0, F.sequence(F.lit(0), F.col("pages") - 1)).otherwise(F.array().cast("array<int>")))
    return docs.select("doc_id", F.posexplode(seeded).alias("pos", "page"))


def page_size_summary(pages: DataFrame) -> DataFrame:
    """(doc_id, page_count, sizes): the first page's rounded size, "(mixed)" unless all agree."""
    w, h = F.floor(F.col("width") + 0.5).cast("long"), F.floor(F.col("height") + 0.5).cast("long")
    sized = pages.withColumn("_size", F.concat(w.cast("string"), F.lit(" × "), h.cast("string"), F.lit(" pt")))
    grouped = sized.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.min_by("_size", "page").alias("_first"), F.min("_size").alias("_low"), F.max("_size").alias("_high"))
    return grouped.select("doc_id", "page_count", F.when(F.col("_low") == F.col("_high"), F.col("_first")).otherwise(F.concat("_first", F.lit(" (mixed)"))).alias("sizes"))


def doc_metadata(meta: DataFrame, pages: DataFrame) -> DataFrame:
    """Metadata rows with blank strings null, dates parsed, and the page summary."""
    from quire.functions.text import clean, format_bytes, safe_date

    texts = ["title", "author", "subject", "keywords", "creator", "producer"]
    out = meta.select("doc_id", *(clean(F.col(c)).alias(c) for c in texts), *(safe_date(F.col(c)).alias(c) for c in ("created", "modified")), "file_size", format_bytes(F.col("file_size")).alias("size_text"), "field_count")
    return out.join(page_size_summary(pages), "doc_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0))).withColumn("sizes", F.coalesce("sizes", F.lit("—")))


def scanned_docs(text: DataFrame, docs: DataFrame, limit: int = 12, pages: int = 3) -> DataFrame:
    """(doc_id, chars, scanned): a document with pages whose first pages hold less than
    ``limit`` trimmed characters. ``docs`` is (doc_id, page_count)."""
    from quire.functions.text import js_trim

    sampled = text.where(F.col("page") < pages).groupBy("doc_id").agg(F.sum(F.length(js_trim(F.col("str")))).alias("chars"))
    joined = docs.join(sampled, "doc_id", "left").withColumn("chars", F.coalesce("chars", F.lit(0)))
    return joined.select("doc_id", "chars", ((F.col("page_count") > 0) & (F.col("chars") < limit)).alias("scanned"))
