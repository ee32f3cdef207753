"""Reading, merging and summarising bar tables (symbol, date, open, high, low, close, volume, amount)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.expr import BAR_FIELDS, PRICE_FIELDS, nan_to_null

BAR_SCHEMA = "symbol string, date date, " + ", ".join(f"{c} double" for c in BAR_FIELDS)
KEY = ["symbol", "date"]


def _within(df: DataFrame, start, end) -> DataFrame:
    """Inclusive bounds; on a panel stored by year they also prune its directories."""
    for bound, op in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            limit = F.lit(bound).cast("date")
            df = df.where(getattr(F.col("date"), op)(limit))
            if "year" in df.columns:
                df = df.where(getattr(F.col("year"), op)(F.year(limit)))
    return df


def open_panel(spark: SparkSession, path: str) -> DataFrame:
    """A bar table written by ``write_panel``, with its ``year`` directories; NaN becomes NULL."""
    rows = spark.read.schema(f"{BAR_SCHEMA}, year int").parquet(path)
    return rows.withColumns({c: nan_to_null(c) for c in BAR_FIELDS})


def read_bars(spark: SparkSession, source: DataFrame | str, symbol: str, start=None, end=None) -> DataFrame:
    """One symbol's bars by date, bounds inclusive. ``source`` is a bar table or the path of a stored panel."""
    bars = source if isinstance(source, DataFrame) else open_panel(spark, source)
    return _within(bars.where(F.col("symbol") == symbol), start, end).drop("year").orderBy("date")


def read_window(bars: DataFrame, symbols: DataFrame | list[str], start=None, end=None) -> DataFrame:
    """Bars of many symbols; an empty list gives an empty table."""
    if not isinstance(symbols, DataFrame):
        symbols = bars.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
    return _within(bars, start, end).drop("year").join(symbols.select("symbol"), "symbol", "left_semi")


def symbol_stats(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n_bars")
    )


def upsert_bars(base: DataFrame, updates: DataFrame, seq: str = "seq") -> DataFrame:
    """Insert or replace on (symbol, date); among updates the highest ``seq`` wins.

    Only the updates are aggregated. The base is filtered by an anti-join, which needs no
    shuffle of the base while the updates are small.
    """
    latest = _latest(updates, F.col(seq))
    return base.select(*KEY, *BAR_FIELDS).join(latest, KEY, "left_anti").unionByName(latest)


def _latest(rows: DataFrame, order) -> DataFrame:
    """Last version per key as an aggregate, so repeated keys shrink before the shuffle."""
    return (
        rows.groupBy(*KEY)
        .agg(F.max_by(F.struct(*BAR_FIELDS), order).alias("_bar"))
        .select(*KEY, "_bar.*")
    )


def incremental_slice(source: DataFrame, stats: DataFrame, start) -> DataFrame:
    """Rows from the last stored date of the symbol on (inclusive, to catch amendments), else from ``start``."""
    return (
        source.join(stats.select("symbol", "last_date"), "symbol", "left")
        .where(F.col("date") >= F.coalesce("last_date", F.lit(start).cast("date")))
        .drop("last_date")
    )


def source_fallback(sources: list[tuple[int, DataFrame]]) -> DataFrame:
    """Per symbol, the rows of the lowest-numbered source that has any."""
    tagged = reduce(
        DataFrame.unionByName,
        [df.select(*KEY, *BAR_FIELDS).withColumn("source", F.lit(p)) for p, df in sources],
    )
    first = tagged.groupBy("symbol").agg(F.min("source").alias("source"))
    return tagged.join(first, ["symbol", "source"], "left_semi")


def dedupe_bars(pages: DataFrame, start, end, order: str = "page") -> DataFrame:
    """Union of pages, one row per (symbol, date) from the first page, clipped to [start, end]."""
    first = _within(pages, start, end).groupBy(*KEY).agg(F.min_by(F.struct(*BAR_FIELDS), order).alias("_bar"))
    return first.select(*KEY, "_bar.*")


def describe_bars(bars: DataFrame, time: str = "date") -> DataFrame:
    """Rows, range, price range and the mean of the first nine gaps in seconds, per symbol."""
    lowest, highest = F.min(F.least(*PRICE_FIELDS)), F.max(F.greatest(*PRICE_FIELDS))
    summary = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(time).alias("start_time"),
        F.max(time).alias("end_time"),
        lowest.alias("price_min"),
        highest.alias("price_max"),
    )
    w = Window.partitionBy("symbol").orderBy(F.col(time))
    head = bars.select("symbol", time).withColumn("_n", F.row_number().over(w)).where("_n <= 10")
    gaps = head.groupBy("symbol").agg(
        F.min(time).alias("_first"), F.max(time).alias("_tenth"), F.count(F.lit(1)).alias("_n")
    )
    # the mean of consecutive gaps is the covered span over their number
    span = F.unix_timestamp(F.col("_tenth").cast("timestamp")) - F.unix_timestamp(F.col("_first").cast("timestamp"))
    return summary.join(
        gaps.select("symbol", F.try_divide(span.cast("double"), F.col("_n") - 1).alias("bar_seconds")), "symbol"
    )


def history_cutoff(bars: DataFrame, years: int) -> DataFrame:
    """Keep the last ``years`` * 365 days before the newest bar of the table."""
    newest = bars.agg(F.max("date")).scalar()
    return bars.where(F.col("date") >= F.date_sub(newest, years * 365))
