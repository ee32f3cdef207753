"""Bars from event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def stream_bars(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events (ts, event_id, symbol, price) to bars per tumbling window; works on a stream or a table.

    An event late by less than ``delay`` still amends its bar; a bar is emitted once its window is closed.
    """
    order = F.struct("ts", "event_id")
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", delay)
    bars = timed.groupBy(F.window("ts", width), "symbol").agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
        F.sum("price").alias("amount"),
    )
    return bars.select("symbol", F.col("window.start").alias("date"), "open", "high", "low", "close", "volume", "amount")


def stream_complete_dates(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """The rows of closed cross-sections, each date once and whole. Rows (ts, symbol, score), one symbol once a date.

    A symbol's row leaves the state when the watermark has passed its date, so a date's rows come out together. Of
    several rows of a symbol the last by ts counts. Rows that come later are dropped by the engine; see ``LateRows``.
    State is keyed by (date, symbol): a large cross-section is spread.
    """
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        timed = timed.withWatermark("ts", delay)
    last = timed.groupBy(F.window("ts", "1 day"), "symbol").agg(F.max_by("score", F.struct("ts", "score")).alias("score"))
    return last.select(F.to_date("window.start").alias("date"), "symbol", "score")


class LateRows(StreamingQueryListener):
    """Counts rows dropped behind the watermark, over all micro-batches of one query.

    ``recentProgress`` keeps the last reports only. Register with ``spark.streams.addListener`` before the start.
    """

    def __init__(self, name: str):
        self.name, self.dropped = name, 0

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name:
            self.dropped += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)


FOLD = 20


def stream_upsert(bars: DataFrame, path: str, checkpoint: str, seq: str = "seq", fold: int = FOLD) -> StreamingQuery:
    """Merge a stream of bar versions on (symbol, date): the highest ``seq`` wins, whatever batch brings it.

    Each micro-batch is reduced to one version per key and written as its own delta ``path/batch=<id>``; a replayed
    batch overwrites its own delta. Every ``fold``-th batch also folds what lies below it into a new base, so that readers
    resolve one base and at most ``fold`` deltas. A fold is written whole before it counts, and what it
    replaces stays until the next fold, for readers that are under way.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        newest_version(batch, F.col(seq)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if fold and (batch_id + 1) % fold == 0:
            spark = batch.sparkSession
            current = _versions(spark, path)
            newest_version(current, F.struct(seq, "batch")).drop("batch").write.mode("overwrite").parquet(f"{path}/base={batch_id}")

    return bars.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str) -> DataFrame:
    """The last finished base and the deltas after it, with ``batch``."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"base": [], "batch": []}
    for status in fs.listStatus(folder):
        kind, _, number = status.getPath().getName().partition("=")
        if kind in found and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[kind].append(int(number))
    base = max(found["base"], default=-1)
    parts = [f"{path}/base={base}"] * (base >= 0) + [f"{path}/batch={n}" for n in sorted(found["batch"]) if n > base]
    number = F.regexp_extract(F.input_file_name(), r"/(?:base|batch)=(\d+)/", 1).cast("long")
    return spark.read.parquet(*parts).withColumn("batch", number)


def newest_version(rows: DataFrame, order: Column) -> DataFrame:
    """One row per (symbol, date): the one with the highest ``order``; reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in ("symbol", "date")]
    return rows.groupBy("symbol", "date").agg(F.max_by(F.struct(*rest), order).alias("_row")).select("symbol", "date", "_row.*")


def current_bars(spark: SparkSession, path: str, seq: str = "seq") -> DataFrame:
    """The bar table as of the last finished micro-batch: the highest ``seq`` wins, then the latest batch."""
    return newest_version(_versions(spark, path), F.struct(seq, "batch")).drop("batch", seq)


def compact_bars(spark: SparkSession, path: str, target: str, seq: str = "seq") -> None:
    """Write the resolved table as the first delta of a new path."""
    newest_version(_versions(spark, path), F.struct(seq, "batch")).drop("batch").write.mode("overwrite").parquet(f"{target}/batch=0")
