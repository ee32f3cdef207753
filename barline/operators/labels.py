"""Forward returns and realised paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.expr import BAR_FIELDS, change
from barline.functions.groups import range_join
from barline.functions.timeline import along
from barline.operators.calendar import numbered


def forward_open_return(bars: DataFrame, h: int, out: str = "label") -> DataFrame:
    """Add ``out``: open[t + h + 1] / open[t + 1] - 1 over the symbol's own rows; NULL when the history is too short.

    The bars are kept, so labels and features of one table share one shuffle by symbol.
    """
    return along(
        bars,
        lambda df, w: df.withColumn(out, change(F.lead("open", h + 1).over(w), F.lead("open", 1).over(w))),
        back=0,
        ahead=h + 1,
    )


def forward_open_return_at(bars: DataFrame, refs: DataFrame, h: int) -> DataFrame:
    """The same for any reference (symbol, date), traded or not: the first bar after it is t + 1."""
    coming = _first_after(bars, refs, lambda w: change(F.lead("open", h).over(w), F.col("open")).alias("label"), h)
    return coming.where(F.col("label").isNotNull()).select("symbol", "date", "label")


def actual_path(bars: DataFrame, refs: DataFrame, n: int, field: str = "close") -> DataFrame:
    """(symbol, date, h, value): the next ``n`` own rows after each reference date."""
    value = lambda w: F.collect_list(F.col(field)).over(w.rowsBetween(0, n - 1)).alias("_path")
    coming = _first_after(bars, refs, value, n - 1)
    return coming.select("symbol", "date", F.posexplode("_path").alias("h", "value")).withColumn("h", F.col("h") + 1)


def own_path(bars: DataFrame, n: int, field: str = "close") -> DataFrame:
    """``actual_path`` where the reference dates are the bars themselves: a frame instead of a range join."""
    following = lambda df, w: df.withColumn("_path", F.collect_list(F.col(field)).over(w.rowsBetween(1, n)))
    rows = along(bars.select("symbol", "date", field), following, back=0, ahead=n)
    return rows.select("symbol", "date", F.posexplode("_path").alias("h", "value")).withColumn("h", F.col("h") + 1)


def with_own_path(bars: DataFrame, n: int, field: str = "close", out: str = "actual") -> DataFrame:
    """bars with the array ``out`` of the next up to ``n`` values of a field: ``own_path`` packed, beside its bar."""
    return along(bars, lambda df, w: df.withColumn(out, F.collect_list(F.col(field)).over(w.rowsBetween(1, n))), back=0, ahead=n)


def _first_after(bars: DataFrame, refs: DataFrame, value, ahead: int) -> DataFrame:
    """Match each (symbol, date) with the symbol's first bar after it, carrying ``value`` of that bar.

    A bar answers for the days from the previous bar up to the day before itself.
    """
    refs = refs.select("symbol", "date").distinct()
    earliest = refs.agg(F.min("date")).scalar()

    def step(df, w):
        return df.select("symbol", "date", F.lag("date").over(w).alias("_prev"), value(w))

    at = along(bars.select("symbol", "date", *BAR_FIELDS), step, back=1, ahead=ahead)
    spans = (
        at.withColumn("_high", F.date_sub("date", 1))
        .withColumn("_low", F.coalesce("_prev", F.least(earliest, F.col("_high"))))
        .drop("date", "_prev")
    )
    return range_join(refs, spans, "date", "_low", "_high", 32, on=["symbol"])


def composite_label(df: DataFrame, w1: float = 0.5, w3: float = 0.3, w5: float = 0.2) -> DataFrame:
    """Weighted sum of the horizons 1, 3 and 5; where one is missing, the plain label."""
    mix = F.col("label_h1") * F.lit(w1) + F.col("label_h3") * F.lit(w3) + F.col("label_h5") * F.lit(w5)
    return df.withColumn("label", F.coalesce(mix, F.col("label")))


def calendar_forward_return(bars: DataFrame, cal: DataFrame, h: int) -> DataFrame:
    """open on calendar day i + h + 1 over open on day i + 1, minus 1, as (symbol, date, idx, ret).

    Only days where both opens exist have a row, so the date x symbol grid is never built: a frame over the
    calendar index finds the bar exactly ``h`` days on, or nothing.
    """
    days = F.broadcast(numbered(cal).select("date", "idx", "prev_date"))
    placed = bars.select("symbol", "date", "open").join(days, "date")
    exact = Window.partitionBy("symbol").orderBy("idx").rangeBetween(h, h)
    return (
        placed.withColumn("ret", change(F.first("open").over(exact), F.col("open")))
        .where(F.col("ret").isNotNull() & F.col("prev_date").isNotNull())
        .select("symbol", F.col("prev_date").alias("date"), (F.col("idx") - 1).alias("idx"), "ret")
    )
