"""Trading calendars, schedules and date filters.

A calendar has one row per day, so ordering or broadcasting one is bounded by the number of days.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.expr import ratio


def trading_days(bars: DataFrame, benchmark: str = "^TWII", min_symbols: int = 500) -> DataFrame:
    """Dates with a benchmark row and at least ``min_symbols`` rows, the benchmark's included."""
    return (
        bars.groupBy("date")
        .agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("symbol") == benchmark).alias("_bench"))
        .where(F.col("_bench") & (F.col("_n") >= min_symbols))
        .select("date")
    )


def benchmark_calendar(bars: DataFrame, benchmark: str, start=None, end=None) -> DataFrame:
    """The benchmark's dates; an empty calendar is an error, so this looks at the data once."""
    cal = bars.where(F.col("symbol") == benchmark).select("date")
    if start is not None:
        cal = cal.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        cal = cal.where(F.col("date") <= F.lit(end).cast("date"))
    if cal.isEmpty():
        raise ValueError(f"no rows for benchmark {benchmark} between {start} and {end}")
    return cal.distinct()


def numbered(cal: DataFrame) -> DataFrame:
    """(date, idx, prev_date, next_date) with idx from 0."""
    w = Window.orderBy("date")
    return cal.select(
        "date",
        (F.row_number().over(w) - 1).alias("idx"),
        F.lag("date").over(w).alias("prev_date"),
        F.lead("date").over(w).alias("next_date"),
    )


def schedule(cal: DataFrame, hold_days: list[int]) -> DataFrame:
    """(variant, signal_date, exec_date): every hold-th date signals, the next date executes."""
    if any(h <= 0 for h in hold_days):
        raise ValueError(f"hold_days must be positive, got {hold_days}")
    return (
        numbered(cal)
        .withColumn("variant", F.explode(F.array(*[F.lit(h) for h in sorted(set(hold_days))])))
        .where((F.col("idx") % F.col("variant") == 0) & F.col("next_date").isNotNull())
        .select("variant", F.col("date").alias("signal_date"), F.col("next_date").alias("exec_date"))
    )


def _between(start, end) -> Column:
    return F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def _on_calendar(df: DataFrame, cal: DataFrame | None) -> DataFrame:
    return df if cal is None else df.join(F.broadcast(cal.select("date").distinct()), "date", "left_semi")


def date_filter(df: DataFrame, start=None, end=None, cal: DataFrame | None = None) -> DataFrame:
    """Inclusive range cut with the calendar; without bounds the calendar alone."""
    if (start is None) != (end is None):
        raise ValueError("date filter requires both start and end")
    if start is None:
        return _on_calendar(df, cal)
    if str(start) > str(end):
        raise ValueError(f"date filter start must be <= end, got {start!r} > {end!r}")
    return _on_calendar(df.where(_between(start, end)), cal)


def multi_range_filter(df: DataFrame, include: list, exclude: list = (), cal: DataFrame | None = None) -> DataFrame:
    """Union of ranges minus excluded ranges, as one pushed-down predicate."""
    if include:
        df = df.where(reduce(Column.__or__, [_between(*r) for r in include]))
    for r in exclude:
        df = df.where(~_between(*r))
    return _on_calendar(df, cal)


def _weekdays(low: Column, high: Column) -> Column:
    return F.filter(F.sequence(low, high), lambda d: F.weekday(d) < 5)


def business_dates(bounds: DataFrame, step: int = 1) -> DataFrame:
    """Every ``step``-th weekday between the ``start`` and ``end`` of each row."""
    days = F.filter(_weekdays(F.col("start"), F.col("end")), lambda d, i: i % step == 0)
    return bounds.withColumn("date", F.explode(days))


def even_dates(bounds: DataFrame, n: int) -> DataFrame:
    """``n`` evenly spaced weekdays between ``start`` and ``end`` of each row, ends included."""
    days = bounds.withColumn("_days", _weekdays(F.col("start"), F.col("end")))
    if n == 1:
        spots = F.array(F.lit(0.0))
    else:
        last = (F.size("_days") - 1).cast("double")
        spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * last / F.lit(float(n - 1))))
    picked = F.array_distinct(F.transform(spots, lambda p: F.get(F.col("_days"), p.cast("int"))))
    chosen = F.when(F.size("_days") <= n, F.col("_days")).otherwise(picked)
    return days.withColumn("date", F.explode(chosen)).drop("_days")


def sample_universe(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` symbols, the same for every run and partitioning: smallest hash first."""
    tagged = F.md5(F.concat_ws("#", F.col("symbol"), F.lit(str(seed))))
    return df.select("symbol").distinct().orderBy(tagged, "symbol").limit(n)


def future_dates(last_dates: DataFrame, n: int, holidays: DataFrame) -> DataFrame:
    """The next ``n`` weekdays after each row's ``date`` that are not in ``holidays``."""
    days_off = holidays.select("date").distinct().where(F.col("date") > last_dates.agg(F.min("date")).scalar())
    # n + holidays weekdays are certain to hold n open ones
    reach = days_off.agg(F.count(F.lit(1))).scalar() + F.lit(n)
    horizon = F.ceil(reach / 5).cast("int") * 7 + 7
    ahead = (
        last_dates.withColumnRenamed("date", "last_date")
        .withColumn("date", F.explode(F.sequence(F.date_add("last_date", 1), F.date_add("last_date", horizon))))
        .where(F.weekday("date") < 5)
    )
    w = Window.partitionBy("symbol").orderBy("date")
    return ahead.join(days_off, "date", "left_anti").withColumn("step", F.row_number().over(w)).where(F.col("step") <= n)


def phantom_days(df: DataFrame, cal: DataFrame, split: Column | None = None) -> DataFrame:
    """Dates of the panel that the calendar does not know, counted per ``split``."""
    known = F.broadcast(cal.select("date", F.lit(True).alias("_known")).distinct())
    days = df.groupBy("date").agg(F.count(F.lit(1)).alias("_rows")).join(known, "date", "left")
    phantom = F.col("_known").isNull()
    grouped = days.groupBy((F.lit("all") if split is None else split).alias("split"))
    return grouped.agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.count(F.when(phantom, 1)).alias("n_phantom"),
        F.coalesce(F.sum(F.when(phantom, F.col("_rows"))), F.lit(0)).alias("n_rows"),
        ratio(F.count(F.when(phantom, 1)), F.count(F.lit(1))).alias("share"),
    )
