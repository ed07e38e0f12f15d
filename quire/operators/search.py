"""Find, catalog search, recent lists and strokes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.runs import runs_text


def find_text(edits: DataFrame, query: str, text: Column | None = None) -> DataFrame:
    """Text edits that hold the query, whatever its case; none for a blank query."""
    q = query.strip().lower()
    body = text if text is not None else runs_text(F.col("runs"))
    return edits.where(F.lit(bool(q)) & F.contains(F.lower(body), F.lit(q)))


def search_catalog(df: DataFrame, query: str, name: str = "family") -> DataFrame:
    q = query.strip().lower()
    return df.where(F.contains(F.lower(F.col(name)), F.lit(q))) if q else df


def match_pages(matches: DataFrame, edits: DataFrame) -> DataFrame:
    return matches.join(edits.select("doc_id", "id", "page").hint("merge"), ["doc_id", "id"])


def match_ring(matches: DataFrame, keys: list[str], order: list[str], item: str) -> DataFrame:
    """Adds ``next_match`` and ``previous_match``, going round at the ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    all_rows = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return matches.withColumn("next_match", F.coalesce(F.lead(item).over(w), F.first(item).over(all_rows))).withColumn("previous_match", F.coalesce(F.lag(item).over(w), F.last(item).over(all_rows)))


def recent_distinct(df: DataFrame, owner: str, key: str, ts: str, n: int = 10) -> DataFrame:
    """Each owner's ``n`` newest distinct keys with ``place``; adding again moves to the front."""
    newest = df.groupBy(owner, key).agg(F.max(ts).alias(ts))
    return newest.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(ts), key))).where(F.col("place") <= n)


def ink_strokes(points: DataFrame, keys: list[str], order: list[str], pad: float = 4.0) -> DataFrame:
    """Strokes with a padded box and points relative to it; fewer than two points go."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "x", "y")))
    g = points.groupBy(*keys).agg(rows.alias("_p"), (F.min("x") - pad).alias("left"), (F.min("y") - pad).alias("top"), (F.max("x") - F.min("x") + 2 * pad).alias("width"), (F.max("y") - F.min("y") + 2 * pad).alias("height"))
    g = g.where(F.size("_p") >= 2)
    relative = F.transform("_p", lambda p: F.struct((p["x"] - F.col("left")).alias("x"), (p["y"] - F.col("top")).alias("y")))
    return g.select(*keys, "left", "top", "width", "height", relative.alias("points"))


def ink_segments(strokes: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each pair of neighbouring points."""
    n = F.size("points") - 1
    pairs = F.arrays_zip(F.slice("points", 1, n).alias("a"), F.slice("points", 2, n).alias("b"))
    return strokes.select(*keys, F.posexplode(pairs).alias("segment", "_s")).select(*keys, "segment", *(F.col(f"_s.{p}.{c}").alias(f"{c}{i}") for i, p in enumerate("ab") for c in "xy"))


def active_alerts(alerts: DataFrame, moments: DataFrame, error_ms: int = 5000, other_ms: int = 2500) -> DataFrame:
    """Alerts shown at each (key, at): from their time until their time to live ends; a
    sticky one never ends. ``key`` is an equality key of both tables. An alert that ends
    meets the moments of the stretches of time that it touches only; a stretch is as long
    as the longest time to live that is not an alert's own."""
    ttl = F.coalesce("duration_ms", F.when(F.col("variant") == "error", F.lit(error_ms)).otherwise(F.lit(other_ms)))
    until = F.when(F.col("sticky"), F.lit(None).cast("timestamp")).otherwise(F.timestamp_millis(F.unix_millis("ts") + ttl))
    timed, stretch = alerts.withColumn("until", until), max(1, error_ms, other_ms)

    def nth(c: str) -> Column:
        return F.floor(F.unix_millis(c) / stretch)

    ends = timed.where("until is not null").withColumn("_stretch", F.explode(F.sequence(nth("ts"), F.greatest(nth("ts"), nth("until")))))
    shown = ends.hint("merge").join(moments.withColumn("_stretch", nth("at")), ["key", "_stretch"]).where((F.col("ts") <= F.col("at")) & (F.col("at") < F.col("until"))).drop("_stretch")
    stays = timed.where("until is null").join(moments, "key").where(F.col("ts") <= F.col("at"))
    return shown.unionByName(stays)
