"""Streaming queries, run over the event table until it is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.streaming import bars as live
from workload.base import FIELDS, hourly, query, r6, rounded, scratch, sql


def _events(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select("event_id", "ts", F.col("event_type").alias("symbol"), F.col("value").alias("price"))


def _drain(spark, stream):
    """Run to the end into a parquet table and read it back."""
    path = scratch(spark)
    query_ = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


# a window is closed once the newest event is ten minutes past its end
CLOSED = "date + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@query("stream_bars", sql(f"SELECT symbol, date, {r6(*FIELDS)} FROM hourly WHERE {CLOSED}"))
def _(spark, sf):
    out = _drain(spark, live.stream_bars(_events(spark, sf)))
    return rounded(out.withColumn("date", F.col("date").cast(T.TimestampNTZType())))


@query(
    "stream_complete_dates",
    sql(
        """SELECT CAST(ts AS DATE) AS date, user_id AS symbol, round(arg_max(value, struct_pack(a := ts, b := value)), 6) AS score FROM events
  GROUP BY CAST(ts AS DATE), user_id HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR"""
    ),
)
def _(spark, sf):
    """The complete cross-section of users of each closed day."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = raw.select("ts", F.col("user_id").alias("symbol"), F.col("value").alias("score"))
    return rounded(_drain(spark, live.stream_complete_dates(rows, "6 hours")))


@query("stream_upsert", sql(f"SELECT symbol, date, {r6('open', 'high', 'low', 'close * 2 AS close', 'volume', 'amount')} FROM hourly"))
def _(spark, sf):
    """Version 2 in the first batch, the older version 1 in later ones; folded after every second batch."""
    path = scratch(spark)
    bars = hourly(spark, sf)
    versions = [bars.withColumns({"close": F.col("close") * 2, "seq": F.lit(2)})] + [bars.withColumn("seq", F.lit(1))] * 2
    schema = versions[0].schema
    for version in versions:  # one file a batch: the stream ends between them
        version.coalesce(1).write.parquet(f"{path}/in/{uuid.uuid4().hex}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/in")
        live.stream_upsert(stream, f"{path}/table", f"{path}/progress", fold=2).awaitTermination()
    return rounded(live.current_bars(spark, f"{path}/table"))
