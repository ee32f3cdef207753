"""Backtests and parameter sweeps: every variant in one job, ``variant`` as a grouping column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions.groups import best_k
from barline.operators.calendar import schedule
from barline.operators.portfolio import (
    benchmark_returns,
    close_moves,
    close_periods,
    close_to_close_returns,
    compound_legs,
    next_open_returns,
    performance,
    prefix_means,
    priced_legs,
    return_legs,
)
from barline.operators.scores import aligned, zscore_by_date
from barline.operators.select import holdings


def _returns(bars: DataFrame, hold: DataFrame, sched: DataFrame, cal: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    if mode == "next_open":
        return next_open_returns(bars, hold, sched, cal)
    if mode == "close":
        at_signal = sched.withColumn("exec_date", F.col("signal_date"))
        return close_to_close_returns(bars, hold, at_signal)
    raise ValueError(f"mode must be 'next_open' or 'close', got {mode!r}")


def run_backtest(
    curves: DataFrame,
    bars: DataFrame,
    cal: DataFrame,
    holds: list[int],
    k: int,
    mode: str = "next_open",
    threshold: float = 0.0,
    benchmark: str | None = None,
) -> dict[str, DataFrame]:
    """Daily returns, period returns and metrics per hold, from predicted return curves (date, symbol, h, value).

    With ``benchmark`` its own returns join the daily table as variant 'benchmark'. A hold without any daily
    return fails the job that reads its metrics; ``missing_variants`` looks at once.
    """
    sched = schedule(cal, holds)
    if mode == "close":
        sched_used = sched.withColumn("exec_date", F.col("signal_date"))
    else:
        sched_used = sched
    hold = holdings(curves, sched_used, k, threshold)
    period, daily = _returns(bars, hold, sched, cal, mode)
    period = period.withColumn("variant", F.col("variant").cast("string"))
    daily = daily.withColumn("variant", F.col("variant").cast("string"))
    if benchmark is not None:
        daily = daily.unionByName(benchmark_returns(bars, benchmark, cal))
    names = [str(h) for h in holds] + (["benchmark"] if benchmark is not None else [])
    return {"daily": daily, "period": period, "metrics": _all_present(performance(daily), names)}


def _all_present(metrics: DataFrame, names: list[str]) -> DataFrame:
    """metrics of all names; one that is missing fails the job."""
    wanted = metrics.sparkSession.createDataFrame([(n,) for n in names], "variant string")
    missing = F.raise_error(F.concat(F.lit("no daily returns for variant "), F.col("variant"))).cast("long")
    return wanted.join(metrics, "variant", "left").withColumn("n_days", F.coalesce("n_days", missing))


def missing_variants(daily: DataFrame, holds: list[int]) -> None:
    """Raise ValueError when a hold produced no daily returns; one row per variant is looked at."""
    found = {r["variant"] for r in daily.select("variant").distinct().collect()}
    missing = [h for h in holds if str(h) not in found]
    if missing:
        raise ValueError(f"no daily returns for hold {missing}")


PARAMS = "variant int, top_k int, hold int, threshold double, rank_h int"
PARAM_NAMES = ["top_k", "hold", "threshold", "rank_h"]


def parameter_table(spark: SparkSession, params: list[tuple]) -> DataFrame:
    """One row for each distinct (top_k, hold, threshold, rank_h), numbered as ``variant``; ``rank_h`` None means the hold."""
    full = dict.fromkeys((int(k), int(h), float(t), int(h if r is None else r)) for k, h, t, r in params)
    return spark.createDataFrame([(i, *p) for i, p in enumerate(full)], PARAMS)


ORDER = ["hold", "rank_h", "set_date"]


def sweep_orders(curves: DataFrame, sched: DataFrame, params: DataFrame, k_max: int) -> tuple[DataFrame, DataFrame]:
    """The ranked symbols of each (hold, rank_h, set_date) down to ``k_max``, and how many of them each variant holds.

    The panel is ranked once per (date, horizon). top_k and threshold both keep a prefix of that order, so a variant is one
    number a date: ``place``, its last place. Parameter rows come from the caller's code, a schedule has at most a row a
    day: their product is broadcast. Variants that hold nothing on a date have no row there.
    """
    plan = sched.withColumnRenamed("variant", "hold").join(F.broadcast(params), "hold").withColumnRenamed("exec_date", "set_date")
    wanted = plan.select(*ORDER, F.col("signal_date").alias("date"), F.col("rank_h").alias("h")).distinct()
    dates = F.broadcast(wanted.select("date", "h").distinct())
    ranked = best_k(curves.select("date", "symbol", "h", "value").join(dates, ["date", "h"], "left_semi"), ["date", "h"], "value", k_max)
    orders = ranked.join(F.broadcast(wanted), ["date", "h"]).select(*ORDER, "symbol", "place", "value")
    values = orders.groupBy(*ORDER).agg(F.collect_list("value").alias("_values"))
    kept = F.least(F.col("top_k"), F.size(F.filter("_values", lambda v: v >= F.col("threshold"))))
    prefixes = values.join(F.broadcast(plan.select("variant", *ORDER, "top_k", "threshold")), ORDER).select("variant", *ORDER, kept.alias("place"))
    return orders.drop("value"), prefixes.where("place > 0")


def sweep_daily(bars: DataFrame, orders: DataFrame, prefixes: DataFrame, sched: DataFrame, cal: DataFrame, mode: str, k_max: int) -> DataFrame:
    """(variant, date, ret) of all variants from one table of prefix means: bars meet each order once, however many variants cut it."""
    if mode == "next_open":
        legs = return_legs(sched, cal).where("leg <> 'period'").withColumnRenamed("variant", "hold")
        rows = priced_legs(bars, legs.join(orders, ["hold", "set_date"]))
        means = prefix_means(rows, [*ORDER, "day", "leg", "first"], k_max)
        return compound_legs(means.join(prefixes, [*ORDER, "place"]))
    periods = close_periods(sched).withColumnRenamed("variant", "hold")
    rows = close_moves(bars, orders.join(F.broadcast(periods), ["hold", "set_date"]), ORDER)
    means = prefix_means(rows, [*ORDER, "date"], k_max)
    return means.join(prefixes, [*ORDER, "place"]).select("variant", "date", "ret")


def sweep(curves: DataFrame, bars: DataFrame, cal: DataFrame, params: list[tuple], mode: str = "close") -> DataFrame:
    """Metrics per (top_k, hold, threshold, rank_h), best Sharpe first. ``rank_h`` None means the hold.

    Parameters are joined back by number, so they come out as they went in. A row without any daily return stays, with
    0 days and no metrics, at the end.
    """
    table = parameter_table(curves.sparkSession, params)
    if mode not in ("close", "next_open"):
        raise ValueError(f"mode must be 'next_open' or 'close', got {mode!r}")
    sched = schedule(cal, sorted({p[1] for p in params}))
    if mode == "close":
        sched = sched.withColumn("exec_date", F.col("signal_date"))
    k_max = max(1, *(p[0] for p in params))
    orders, prefixes = sweep_orders(curves, sched, table, k_max)
    daily = sweep_daily(bars, orders, prefixes, sched, cal, mode, k_max)
    out = table.join(performance(daily), "variant", "left").drop("variant").withColumn("n_days", F.coalesce("n_days", F.lit(0).cast("long")))
    return out.select(*PARAM_NAMES, "n_days", "annualised_return", "sharpe", "max_drawdown").orderBy(F.col("sharpe").desc_nulls_last(), *PARAM_NAMES)


def sweep_next_open(curves: DataFrame, bars: DataFrame, cal: DataFrame, ks: list[int], holds: list[int], metric: str = "sharpe") -> DataFrame:
    """Grid of one metric: a row per top_k, a column per hold."""
    out = sweep(curves, bars, cal, [(k, h, 0.0, None) for k in ks for h in holds], "next_open")
    return out.groupBy("top_k").pivot("hold", holds).agg(F.first(metric)).withColumnsRenamed({str(h): f"hold_{h}" for h in holds})


def sweep_blend(
    a: DataFrame, b: DataFrame, bars: DataFrame, cal: DataFrame, weights: list[float], k: int, hold: int, threshold: float = 0.0, ddof: int = 1
) -> DataFrame:
    """Next-open metrics per blend weight w of w z(a) + (1 - w) z(b)."""
    sched = schedule(cal, [hold]).drop("variant")
    dates = F.broadcast(sched.select(F.col("signal_date").alias("date")))  # at most a row a day
    both = aligned(a.join(dates, "date", "left_semi"), b.join(dates, "date", "left_semi"))
    z = zscore_by_date(both, ddof, ["score_a", "score_b"])
    on_signal = z.join(F.broadcast(sched), z["date"] == sched["signal_date"])
    w = F.col("w")
    mixed = on_signal.withColumn("w", F.explode(F.array(*[F.lit(float(x)) for x in weights]))).withColumn(
        "value", w * F.col("score_a") + (F.lit(1.0) - w) * F.col("score_b")
    )
    picked = best_k(mixed.where(F.col("value") >= threshold), ["w", "exec_date"], "value", k)
    plan = sched.withColumn("variant", F.explode(F.array(*[F.lit(float(x)) for x in weights])))
    _, daily = next_open_returns(bars, picked.select(F.col("w").alias("variant"), "exec_date", "symbol"), plan, cal)
    return performance(daily).withColumnRenamed("variant", "weight")
