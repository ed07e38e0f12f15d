"""Registered queries that run a stream to its end: each writes its rows to a folder in the order
of their time, slice by slice, and starts the stream anew for each slice."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.layout_queries import _SQL, edit_log, query, table, turns
from quire.sources.shared import shared_dir
from quire.streaming import states


def streamed(rows: DataFrame, slices: list, transform: Callable[[DataFrame], DataFrame], mode: str, sink: Callable[[str], Callable[[DataFrame, int], None]]) -> DataFrame:
    """What a stream over ``rows``, which come in the given slices (conditions), has put into its
    sink; before each slice the stream is stopped and started again from its checkpoint."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for part in slices:
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = transform(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        run = stream.writeStream.foreachBatch(sink(f"{folder}/out")).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _batches(path: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def _by_time(rows: DataFrame, n: int = 3) -> list:
    """Conditions that cut rows into ``n`` slices of time."""
    cuts = rows.select(F.expr(f"percentile_approx(ts, array({', '.join(str(i / n) for i in range(1, n))}))")).first()[0] or []
    edges = [None, *cuts, None]
    return [(F.lit(True) if a is None else F.col("ts") > F.lit(a)) & (F.lit(True) if b is None else F.col("ts") <= F.lit(b)) for a, b in zip(edges, edges[1:])]


@query(_SQL["edit_state"])
def streamed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of all documents as the changes of a stream add up to it."""
    log = edit_log(spark, sf_dir)
    return states.latest(streamed(log, _by_time(log), lambda s: states.stream_edits(s, burst_ms=7_200_000), "update", _batches))


@query(
    "SELECT conv_id AS doc_id, count(*) FILTER (length(text) % 11 <> 0) AS done, count(*) FILTER (length(text) % 11 = 0) AS failed, count(*) FILTER (length(text) % 3 <> 0) AS truncated FROM conversations"
    " WHERE conv_id % 7 <> 0 OR turn < 2 GROUP BY conv_id"
)
def streamed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as recognised pages that come two by two; every seventh document is cancelled after
    the first two."""
    size = F.length("str")
    pages = turns(spark, sf_dir).select("doc_id", "page", F.when(size % 11 == 0, "bad").alias("error"), (size % 3 != 0).alias("truncated"))
    stopped = f"{shared_dir(spark)}/stopped-{uuid.uuid4().hex}"
    pages.select("doc_id").limit(0).write.parquet(stopped)

    def sink(path: str) -> Callable[[DataFrame, int], None]:
        put = states.page_sink(path, lambda session: session.read.schema("doc_id long").parquet(stopped))

        def then(batch: DataFrame, number: int) -> None:
            put(batch, number)
            if not number:
                pages.where("doc_id % 7 = 0").select("doc_id").distinct().write.mode("append").parquet(stopped)

        return then

    return states.page_progress(streamed(pages, [F.col("page") < 2, F.col("page").between(2, 3), F.col("page") > 3], lambda s: s, "append", sink))


@query(
    "WITH a AS (SELECT user_id, epoch_ms(ts) + CASE WHEN event_type = 'error' THEN 259200000 ELSE 129600000 END AS until, event_id % 5 = 0 AS sticky FROM events), m AS (SELECT max(epoch_ms(ts)) AS now FROM events)"
    " SELECT user_id AS owner, count(*) AS shown, count(*) FILTER (NOT sticky AND until < now) AS expired FROM a, m GROUP BY user_id"
)
def streamed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts that were shown, and that ended before the last one came."""
    alerts = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("owner"), F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("variant"),
        F.lit("m").alias("message"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 5 == 0).alias("sticky"), F.lit(None).cast("long").alias("duration_ms"),
    )
    events = streamed(alerts, _by_time(alerts), lambda s: states.stream_alerts(s, 259_200_000, 129_600_000), "append", _batches)
    return events.groupBy(F.col("owner").cast("long").alias("owner")).agg(F.count_if(F.col("event") == "shown").alias("shown"), F.count_if(F.col("event") == "expired").alias("expired"))
