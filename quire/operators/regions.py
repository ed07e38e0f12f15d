"""Regions from recognition engines: scans, projection and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions.stats import upper_median_over
from quire.functions.text import js_trim

PAGE = ["doc_id", "page"]


def regions_from_vlm(df: DataFrame) -> DataFrame:
    """(doc_id, page, ord, text, quad) from arrays ``boxes`` and ``labels``: pairs up to the
    shorter length, with eight numbers at least, marks and blanks stripped, empties dropped."""
    n = F.least(F.size("boxes"), F.size("labels"))
    pairs = F.arrays_zip(F.slice("boxes", 1, n).alias("quad"), F.slice("labels", 1, n).alias("text"))
    rows = df.where(n > 0).select(*PAGE, F.posexplode(pairs).alias("ord", "_r"))
    text = js_trim(F.regexp_replace("_r.text", "</?s>", ""))
    return rows.where(F.size("_r.quad") >= 8).select(*PAGE, "ord", text.alias("text"), F.slice("_r.quad", 1, 8).alias("quad")).where("text != ''")


def regions_from_polygons(df: DataFrame) -> DataFrame:
    """(doc_id, page, ord, text, quad): the first four points, a short polygon padded with
    its last point; fewer than two points, and blank texts, are dropped."""
    points = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.element_at("poly", F.least(i, F.size("poly"))))
    rows = df.where((F.size("poly") >= 2) & (js_trim(F.col("text")) != ""))
    return rows.select(*PAGE, "ord", "text", F.flatten(points).alias("quad"))


def regions_to_items(regions: DataFrame, scale_x: float = 1.0, scale_y: float = 1.0, offset_x: float = 0.0, offset_y: float = 0.0) -> DataFrame:
    """Screen items with font size and boldness, told by the page's median size."""
    rect = F.struct((F.col("_r.x") * scale_x + offset_x).alias("x"), (F.col("_r.y") * scale_y + offset_y).alias("y"), (F.col("_r.width") * scale_x).alias("width"), (F.col("_r.height") * scale_y).alias("height"))
    df = regions.withColumn("_r", G.quad_rect(F.col("quad"))).withColumn("_d", G.quad_dims(F.col("quad"))).withColumn("_b", rect)
    size = G.estimate_font_px(F.col("text"), F.col("_b.height"), F.col("_d.line_height") * scale_y, F.col("_d.run_length") * scale_x)
    df = df.select(*PAGE, "ord", "text", F.col("_b.x").alias("x"), F.col("_b.y").alias("y"), F.col("_b.width").alias("width"), F.col("_b.height").alias("height"), size.alias("font_size"))
    return upper_median_over(df, F.col("font_size"), PAGE, "_median").withColumn("bold", G.bold_by_size(F.col("font_size"), F.col("_median"))).drop("_median")


def paragraphs_to_items(paragraphs: DataFrame, scale_x: float = 1.0, scale_y: float = 1.0, offset_x: float = 0.0, offset_y: float = 0.0) -> DataFrame:
    """Recognised paragraphs as screen items: ``font_size`` of the joined text, and
    ``font_size_per_line`` by the lines that were joined."""
    b = F.struct("x0", "y0", "x1", "y1")
    at = [F.lit(v) for v in (scale_x, scale_y, offset_x, offset_y)]
    item, per_line = G.ocr_box(b, *at, F.lit(1)), G.ocr_box(b, *at, F.col("line_count"))
    return paragraphs.withColumn("_i", item).select("*", "_i.*").withColumn("font_size_per_line", per_line["font_size"]).drop("_i")


@dataclass(frozen=True)
class Engine:
    """A recognition engine: ``load`` gives a function from a batch of page contents to a list
    of regions for each, once in a worker; ``batch`` pages are given at a time, in stages with
    the given resources (null: the session's own)."""

    load: Callable[[], Callable[[list], list[list[dict]]]]
    batch: int = 8
    resources: ResourceProfile | None = None


_PAGES = "doc_id bigint, page int, regions array<struct<text: string, quad: array<double>>>, truncated boolean, error string"
_REGIONS = pa.list_(pa.struct([("text", pa.string()), ("quad", pa.list_(pa.float64()))]))
#: Engines that this worker has loaded, by the plan that they belong to.
_LOADED: dict[str, Callable] = {}


def _loaded(run_id: str, load: Callable[[], Callable]) -> Callable:
    if run_id not in _LOADED:
        _LOADED[run_id] = load()
    return _LOADED[run_id]


def _recognized(contents: list, call: Callable[[list], list[list[dict]]], size: int) -> Iterator[tuple]:
    """(regions, truncated, error) of each page; a batch that fails is taken page by page."""
    for i in range(0, len(contents), size):
        part = contents[i : i + size]
        try:
            found = call(part)
            if len(found) != len(part):
                raise ValueError(f"{len(found)} results for {len(part)} pages")
            yield from [([{"text": r["text"], "quad": r["quad"]} for r in got if "quad" in r], any(r.get("truncated") for r in got), None) for got in found]
        except Exception as e:  # one bad page is reported, not fatal
            if len(part) == 1:
                yield [], False, str(e)
            else:
                yield from _recognized(part, call, 1)


def _run_engine(pages: DataFrame, name: str, engine: Engine, content: str) -> DataFrame:
    load, size, run_id = engine.load, max(1, engine.batch), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = list(zip(*_recognized(b.column(content).to_pylist(), _loaded(run_id, load), size))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("page"), pa.array(out[0], _REGIONS), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.string())], names=["doc_id", "page", "regions", "truncated", "error"])

    return pages.select("doc_id", F.col("page").cast("int").alias("page"), content).mapInArrow(run, _PAGES, profile=engine.resources)


def recognize_by_name(pages: DataFrame, engines: dict[str, Engine], name: str = "engine", content: str = "content") -> DataFrame:
    """(doc_id, page, regions, truncated, error) of pages, each by the engine that its column
    ``name`` tells. A page whose engine fails is a row with ``error``, and so is one whose engine
    is not known; the others go on."""
    known = F.coalesce(F.col(name).isin(*engines), F.lit(False)) if engines else F.lit(False)
    what = F.concat(F.lit("no engine "), F.coalesce(F.col(name).cast("string"), F.lit("is named")))
    out = pages.where(~known).select("doc_id", F.col("page").cast("int").alias("page"), F.array().cast("array<struct<text: string, quad: array<double>>>").alias("regions"), F.lit(False).alias("truncated"), what.alias("error"))
    for k, engine in engines.items():
        out = out.unionByName(_run_engine(pages.where(F.col(name) == k), k, engine, content))
    return out


def recognize(pages: DataFrame, engine: Callable[[bytes], list[dict]], content: str = "content") -> DataFrame:
    """``recognize_by_name`` with one engine, a function of one page's content."""
    return _run_engine(pages, "engine", Engine(lambda: lambda contents: [engine(x) for x in contents]), content)


def ocr_report(results: DataFrame, totals: DataFrame, shown: int = 5) -> DataFrame:
    """(doc_id, done, failed, total, truncated, cancelled) of recognised pages. The list of
    truncated pages shows the first five, then an ellipsis."""
    cut = F.array_sort(F.collect_list(F.when(F.col("truncated"), F.col("page") + 1)))
    grouped = results.groupBy("doc_id").agg(F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed"), cut.alias("_cut"))
    text = F.array_join(F.transform(F.slice("_cut", 1, shown), lambda p: p.cast("string")), ", ")
    joined = totals.join(grouped, "doc_id", "left").na.fill(0, ["done", "failed"])
    more = F.when(F.size("_cut") > shown, F.concat(text, F.lit("…"))).otherwise(F.coalesce(text, F.lit("")))
    return joined.select("doc_id", "done", "failed", F.col("page_count").alias("total"), more.alias("truncated"), (F.col("done") + F.col("failed") < F.col("page_count")).alias("cancelled"))
