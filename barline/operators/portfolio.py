"""Portfolio returns and performance.

Tables here are small by nature: holdings have k rows per date and variant, returns one row per
day and variant. Only ``bars`` is large, and it is always joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.expr import change, count_if, drawdown, pearson, ratio
from barline.functions.groups import range_join
from barline.functions.timeline import carry
from barline.operators.calendar import numbered


def _weighted(hold: DataFrame) -> DataFrame:
    return hold if "weight" in hold.columns else hold.withColumn("weight", F.lit(None).cast("double"))


def _average(value: str) -> Column:
    """Plain mean without weights, else the mean over positive weights."""
    w = F.when(F.col("weight") > 0, F.col("weight"))
    weighted = ratio(F.sum(F.col(value) * w), F.sum(F.when(F.col(value).isNotNull(), w)))
    return F.when(F.count("weight") > 0, weighted).otherwise(F.avg(value))


def close_periods(sched: DataFrame, on: str = "exec_date") -> DataFrame:
    """(variant, set_date, end_date) from each rebalance date to the next; the last one opens no period."""
    w = Window.partitionBy("variant").orderBy(on)
    return sched.select("variant", F.col(on).alias("set_date"), F.lead(on).over(w).alias("end_date")).where("end_date is not null")


def close_to_close_returns(bars: DataFrame, hold: DataFrame, sched: DataFrame, on: str = "exec_date") -> tuple[DataFrame, DataFrame]:
    """Period and daily returns when trading at the close of the rebalance dates.

    A period runs from one date to the next, both included. Daily returns fall on the days after the first,
    so periods never share a day. A period without any priced holding returns 0.
    """
    periods = close_periods(sched, on)
    sets = _weighted(hold).withColumnRenamed("exec_date", "set_date").join(F.broadcast(periods), ["variant", "set_date"])
    own = ["variant", "set_date", "symbol"]
    moves = close_moves(bars, sets, own[:2])
    daily = moves.where(F.col("ret").isNotNull()).groupBy("variant", "date").agg(_average("ret").alias("ret")).where("ret is not null")
    per_symbol = moves.groupBy(*own).agg(
        change(F.max_by("close", "date"), F.min_by("close", "date")).alias("ret"), F.count("close").alias("_n"), F.max("weight").alias("weight")
    ).where("_n >= 2")
    per_set = per_symbol.groupBy("variant", "set_date").agg(_average("ret").alias("ret"))
    period = periods.join(per_set, ["variant", "set_date"], "left").select(
        "variant", F.col("set_date").alias("date"), F.coalesce("ret", F.lit(0.0)).alias("ret")
    )
    return period, daily


def return_legs(sched: DataFrame, cal: DataFrame) -> DataFrame:
    """(variant, set_date, day, leg, num_date, den_date, first) that make up next-open returns.

    open: close over open on an execution day, of the new set. mid: close over the previous close on the days
    between. gap: next execution open over the previous close. period: open over open.
    """
    days = numbered(cal)
    w = Window.partitionBy("variant").orderBy("exec_date")
    at = days.select(F.col("date").alias("exec_date"), F.col("idx").alias("_from"))
    sets = sched.select("variant", "exec_date").join(F.broadcast(at), "exec_date").select(
        "variant",
        F.col("exec_date").alias("set_date"),
        "_from",
        F.lead("_from").over(w).alias("_to"),
        F.lead("exec_date").over(w).alias("_next"),
        F.lag("exec_date").over(w).isNull().alias("first"),
    )
    walked = sets.withColumn("idx", F.explode(F.sequence("_from", F.coalesce("_to", "_from")))).join(
        F.broadcast(days.select("idx", "date", "prev_date")), "idx"
    )
    start, end = F.col("idx") == F.col("_from"), F.col("idx") == F.col("_to")

    def leg(name: str, num: str, den: str) -> Column:
        return F.struct(F.lit(name).alias("leg"), F.col(num).alias("num_date"), F.col(den).alias("den_date"))

    legs = F.array(
        F.when(start, leg("open", "date", "date")),
        F.when(start & F.col("_next").isNotNull(), leg("period", "_next", "date")),
        F.when(end & ~start, leg("gap", "date", "prev_date")),
        F.when(~start & ~end, leg("mid", "date", "prev_date")),
    )
    exploded = walked.select("variant", "set_date", "first", F.col("date").alias("day"), F.explode(F.array_compact(legs)).alias("_l"))
    return exploded.select("variant", "set_date", "first", "day", "_l.*")


def priced_legs(bars: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (symbol, leg, num_date, den_date, ..) with ``ret``; rows without a price on either end are gone.

    Holdings are k rows a date and variant, so the keys asked for are broadcast: bars no leg needs go before any shuffle,
    and where the bars are aggregates their rows go before those.
    """
    ends = F.explode(F.array("num_date", "den_date")).alias("date")
    keys = F.broadcast(asked.select("symbol", ends).distinct())
    quotes = bars.select("symbol", "date", "open", "close").join(keys, ["symbol", "date"], "left_semi")
    num = quotes.select("symbol", F.col("date").alias("num_date"), F.col("open").alias("num_open"), F.col("close").alias("num_close"))
    den = quotes.select("symbol", F.col("date").alias("den_date"), F.col("open").alias("den_open"), F.col("close").alias("den_close"))
    top = F.when(F.col("leg").isin("gap", "period"), F.col("num_open")).otherwise(F.col("num_close"))
    bottom = F.when(F.col("leg").isin("open", "period"), F.col("den_open")).otherwise(F.col("den_close"))
    return asked.join(num, ["symbol", "num_date"]).join(den, ["symbol", "den_date"]).withColumn("ret", change(top, bottom))


def compound_legs(per_leg: DataFrame) -> DataFrame:
    """Daily returns (variant, date, ret) from the mean return of each (variant, set_date, day, leg, first)."""
    value = lambda leg: F.max(F.when(F.col("leg") == leg, F.col("ret")))
    by_day = per_leg.where("leg <> 'period'").groupBy("variant", "day").agg(
        value("open").alias("_open"),
        value("mid").alias("_mid"),
        value("gap").alias("_gap"),
        F.bool_or((F.col("leg") == "open") & F.col("first")).alias("_first"),
    )
    both = (F.lit(1.0) + F.col("_gap")) * (F.lit(1.0) + F.col("_open")) - F.lit(1.0)
    # a day between executions has only a mid leg, an execution day only open and gap
    ret = F.coalesce("_mid", F.when(F.col("_first"), F.col("_open")), both)
    return by_day.select("variant", F.col("day").alias("date"), ret.alias("ret")).where("ret is not null")


def prefix_means(rows: DataFrame, keys: list[str], k_max: int) -> DataFrame:
    """(keys.., place, ret): the mean of ``ret`` over the places 1..place, for every place up to ``k_max``.

    rows (keys.., place, ret) hold a place at most once for each key; a place without a return counts for nothing, and
    places before the first return have no row. One shuffle by the keys, ``k_max`` rows a group at most. NULL returns
    are left out; an empty table gives no rows.
    """
    w = Window.partitionBy(*keys).orderBy("place")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = rows.where("ret is not null").select(
        *keys, "place", F.avg("ret").over(upto).alias("ret"), (F.coalesce(F.lead("place").over(w), F.lit(k_max + 1)) - 1).alias("_until")
    )
    return steps.select(*keys, F.explode(F.sequence("place", "_until")).alias("place"), "ret")


def close_moves(bars: DataFrame, sets: DataFrame, own: list[str]) -> DataFrame:
    """Daily moves of held symbols: sets (own.., symbol, set_date, end_date) with date and ``ret``, NULL on a first day."""
    held = range_join(bars.select("symbol", "date", "close"), sets, "date", "set_date", "end_date", 32, on=["symbol"])
    return held.withColumn("ret", change("close", F.lag("close").over(Window.partitionBy(*own, "symbol").orderBy("date"))))


def next_open_returns(bars: DataFrame, hold: DataFrame, sched: DataFrame, cal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Period and daily returns when trading at the open of the execution dates.

    An execution day compounds the old set's gap and the new set's day, and is left out unless both exist.
    A symbol without a price on either end of a leg does not count for it. Nothing follows the last
    execution day but its own day leg.
    """
    asked = return_legs(sched, cal).join(_weighted(hold).withColumnRenamed("exec_date", "set_date"), ["variant", "set_date"])
    per_leg = (
        priced_legs(bars, asked)
        .where(F.col("ret").isNotNull())
        .groupBy("variant", "set_date", "day", "leg", "first")
        .agg(_average("ret").alias("ret"))
        .where("ret is not null")
    )
    daily = compound_legs(per_leg)
    w = Window.partitionBy("variant").orderBy("exec_date")
    sets = sched.select("variant", F.col("exec_date").alias("date"), F.lead("exec_date").over(w).alias("_next"))
    whole = per_leg.where("leg = 'period'").select("variant", F.col("day").alias("date"), "ret")
    period = sets.where("_next is not null").join(whole, ["variant", "date"], "left").select(
        "variant", "date", F.coalesce("ret", F.lit(0.0)).alias("ret")
    )
    return period, daily


def benchmark_returns(bars: DataFrame, benchmark: str, cal: DataFrame) -> DataFrame:
    """One-step changes of the benchmark's close laid on the calendar, gaps carried forward."""
    closes = bars.where(F.col("symbol") == benchmark).select("date", "close")  # a row a day
    line = cal.select("date").distinct().join(F.broadcast(closes), "date", "left").withColumn("symbol", F.lit(benchmark))
    w = Window.partitionBy("symbol").orderBy("date")
    filled = carry(line, ["close"]).withColumn("ret", change("close", F.lag("close").over(w)))
    return filled.where("ret is not null").select(F.lit("benchmark").alias("variant"), "date", "ret")


def equity_curve(ret: DataFrame, include_start: bool = False) -> DataFrame:
    """Compounded value, its running peak and the drawdown per variant.

    The peak starts at the first compounded value; ``include_start`` counts the initial 1.0 as well.
    """
    w = Window.partitionBy("variant").orderBy("date")
    peak = F.max("equity").over(w)
    if include_start:
        peak = F.greatest(peak, F.lit(1.0))
    curve = ret.withColumn("equity", F.product(F.lit(1.0) + F.col("ret")).over(w)).withColumn("peak", peak)
    return curve.withColumn("drawdown", drawdown(F.col("equity"), F.col("peak")))


def performance(ret: DataFrame, periods: int = 252) -> DataFrame:
    """Annualised return, Sharpe ratio and largest drawdown per variant."""
    n = F.count(F.lit(1))
    growth = F.max_by("equity", "date")
    sharpe = F.avg("ret") / (F.stddev_samp("ret") + F.lit(1e-9)) * F.sqrt(F.lit(float(periods)))
    return equity_curve(ret).groupBy("variant").agg(
        n.alias("n_days"),
        (F.pow(growth, F.lit(float(periods)) / n) - F.lit(1.0)).alias("annualised_return"),
        sharpe.alias("sharpe"),
        F.max("drawdown").alias("max_drawdown"),
    )


def performance_ext(ret: DataFrame, bench: DataFrame | None = None, rf: float = 0.03, periods: int = 252) -> DataFrame:
    """Total and annual return, volatility, Sharpe over a risk-free rate, drawdown (negative), and the
    excess over holding the benchmark when ``bench`` (date, ret) is given."""
    n = F.count(F.lit(1))
    base = equity_curve(ret).groupBy("variant").agg(
        n.alias("n_days"),
        (F.max_by("equity", "date") - F.lit(1.0)).alias("total_return"),
        (F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))).alias("volatility"),
        (-F.max("drawdown")).alias("max_drawdown"),
    )
    annual = F.pow(F.lit(1.0) + F.col("total_return"), F.lit(float(periods)) / F.col("n_days")) - F.lit(1.0)
    out = base.withColumn("annual_return", annual)
    out = out.withColumn("sharpe", F.coalesce(ratio(F.col("annual_return") - F.lit(rf), "volatility"), F.lit(0.0)))
    if bench is None:
        return out
    held = bench.agg((F.product(F.lit(1.0) + F.col("ret")) - F.lit(1.0))).scalar()
    return out.withColumn("buy_hold_return", held).withColumn("excess_return", F.col("total_return") - F.col("buy_hold_return"))


def excess_curve(ret: DataFrame, bench: DataFrame, cost: float = 0.0) -> DataFrame:
    """Running sums of benchmark, return after cost, and excess after cost. ``ret`` may carry its own ``cost``."""
    rows = ret if "cost" in ret.columns else ret.withColumn("cost", F.lit(cost))
    rows = rows.join(bench.select("date", F.col("ret").alias("bench")), "date")
    w = Window.partitionBy("variant").orderBy("date")
    net = F.col("ret") - F.col("cost")
    return rows.select(
        "variant",
        "date",
        F.sum("bench").over(w).alias("cum_bench"),
        F.sum(net).over(w).alias("cum_return_w_cost"),
        F.sum(net - F.col("bench")).over(w).alias("cum_ex_return_w_cost"),
    )


def trade_stats(trades: DataFrame) -> DataFrame:
    """Pairs the n-th buy of a symbol with its n-th sell. ``trades`` has (symbol, date, action, price)."""
    w = Window.partitionBy("symbol", "action").orderBy("date")
    numbered_trades = trades.withColumn("_n", F.row_number().over(w))
    side = lambda a: F.max(F.when(F.col("action") == a, F.col("price")))
    pairs = numbered_trades.groupBy("symbol", "_n").agg(side("BUY").alias("_buy"), side("SELL").alias("_sell"), F.count(F.lit(1)).alias("_c"))
    ret = change("_sell", "_buy")
    return pairs.withColumn("_ret", ret).groupBy("symbol").agg(
        F.sum("_c").alias("n_trades"),
        F.count("_ret").alias("n_pairs"),
        F.coalesce(ratio(count_if(F.col("_ret") > 0), F.count("_ret")), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.avg("_ret"), F.lit(0.0)).alias("mean_return"),
    )


def strategy_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Correlation of two daily return series on their common dates."""
    pair = a.select("date", F.col("ret").alias("ret_a")).join(b.select("date", F.col("ret").alias("ret_b")), "date")
    return pair.agg(F.count(F.lit(1)).alias("n"), pearson("ret_a", "ret_b", 2).alias("correlation"))
