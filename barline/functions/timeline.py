"""Row-based windows along one symbol's history.

(symbol, date) is a key, so with a DATE column a symbol has at most one row per day and an
ordinary window partition is small. Timestamps carry no such bound: there, symbols above ``limit``
rows are cut into blocks of consecutive rows, each block carrying the ``back`` rows before it and
the ``ahead`` rows after it, which makes every bounded frame exact inside one block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.groups import GROUP_LIMIT, split_hot

Step = Callable[[DataFrame, WindowSpec], DataFrame]


def along(df: DataFrame, step: Step, back: int, ahead: int = 0, order: str = "date", limit: int | None = GROUP_LIMIT) -> DataFrame:
    """Apply ``step(df, window)`` where the window runs along each symbol."""
    whole = Window.partitionBy("symbol").orderBy(order)
    if isinstance(df.schema[order].dataType, T.DateType):
        return step(df, whole)
    short, long = split_hot(df, ["symbol"], limit)
    done = step(short, whole)
    return done if long is None else done.unionByName(_along_blocks(long, step, back, ahead, order, limit))


def _along_blocks(df: DataFrame, step: Step, back: int, ahead: int, order: str, limit: int) -> DataFrame:
    size = max(limit, 2 * (back + ahead))
    at = _positions(df, order)
    own = F.floor(F.col("_pos") / F.lit(size))
    offset = F.pmod(F.col("_pos"), F.lit(size))
    homes = F.array_compact(
        F.array(own, F.when(offset >= size - back, own + 1), F.when((offset < ahead) & (own > 0), own - 1))
    )
    blocks = at.withColumn("_own", own).withColumn("_block", F.explode(homes))
    done = step(blocks, Window.partitionBy("symbol", "_block").orderBy(order))
    return done.where("_block = _own").drop("_pos", "_own", "_block")


def _positions(df: DataFrame, order: str) -> DataFrame:
    """0-based row number per symbol from day counts, so no task sees a whole history."""
    daily = df.withColumn("_day", F.to_date(order))
    counts = daily.groupBy("symbol", "_day").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("symbol", "_day", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    row = F.row_number().over(Window.partitionBy("symbol", "_day").orderBy(order))
    return daily.join(offsets, ["symbol", "_day"]).withColumn("_pos", F.col("_o") + row - 1).drop("_day", "_o")


def carry(df: DataFrame, cols: list[str], order: str = "date") -> DataFrame:
    """Last non-NULL value so far. Works day by day, then carries the last value of earlier days."""
    if isinstance(df.schema[order].dataType, T.DateType):
        w = Window.partitionBy("symbol").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    daily = df.withColumn("_day", F.to_date(order))
    last = daily.groupBy("symbol", "_day").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_l_{c}") for c in cols]
    )
    earlier = Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("symbol", "_day", *[F.last(f"_l_{c}", ignorenulls=True).over(earlier).alias(f"_e_{c}") for c in cols])
    w = Window.partitionBy("symbol", "_day").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = daily.join(last, ["symbol", "_day"]).withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_e_{c}")) for c in cols}
    )
    return filled.select(*df.columns)
