"""Portfolio returns, performance, sweeps and result documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.operators import portfolio as pf
from barline.operators import select as sel
from barline.plans import backtest as bt
from barline.sources import sinks
from workload.base import (
    BENCHMARK,
    W,
    all_bars,
    bars,
    calendar,
    cte,
    curves,
    logged,
    market,
    query,
    r6,
    rounded,
    score_a,
    score_b,
    scratch,
    sql,
)
from workload.ranking import held, positions, sched, weights, z_sql

MEAN = "avg(r)"
WEIGHTED = "sum(r * weight) FILTER (weight > 0) / nullif(sum(weight) FILTER (weight > 0), 0)"


def next_open_sql(name: str, hold: str, plan: str, mean: str = MEAN) -> None:
    """Register <name>_period and <name>_daily for holdings and a schedule."""
    cte(f"{name}_steps", f"SELECT variant, exec_date, lead(exec_date) OVER (PARTITION BY variant ORDER BY exec_date) AS next_exec FROM {plan}")
    cte(
        f"{name}_legs",
        f"""SELECT variant, exec_date AS day, 'open' AS leg, exec_date AS set_date, exec_date AS num_date, exec_date AS den_date FROM {name}_steps
  UNION ALL SELECT variant, n.date, 'mid', exec_date, n.date, n.prev_date FROM {name}_steps s JOIN numbered n ON n.date > s.exec_date AND n.date < s.next_exec
  UNION ALL SELECT variant, n.date, 'gap', exec_date, n.date, n.prev_date FROM {name}_steps s JOIN numbered n ON n.date = s.next_exec
  UNION ALL SELECT variant, exec_date, 'period', exec_date, next_exec, exec_date FROM {name}_steps WHERE next_exec IS NOT NULL""",
    )
    cte(
        f"{name}_values",
        f"""SELECT variant, day, leg, {mean} AS v FROM (SELECT l.variant, l.day, l.leg, h.*,
   CASE WHEN leg IN ('gap', 'period') THEN a.open ELSE a.close END / nullif(CASE WHEN leg IN ('open', 'period') THEN z.open ELSE z.close END, 0) - 1 AS r
   FROM {name}_legs l JOIN {hold} h ON h.variant = l.variant AND h.exec_date = l.set_date JOIN bars a ON a.symbol = h.symbol AND a.date = l.num_date
   JOIN bars z ON z.symbol = h.symbol AND z.date = l.den_date) WHERE r IS NOT NULL GROUP BY variant, day, leg""",
    )
    cte(
        f"{name}_daily",
        f"""SELECT variant, day AS date, v AS ret FROM {name}_values WHERE leg = 'mid' AND v IS NOT NULL
  UNION ALL SELECT o.variant, o.day, o.v FROM {name}_values o WHERE leg = 'open' AND v IS NOT NULL AND day = (SELECT min(exec_date) FROM {plan} p WHERE p.variant = o.variant)
  UNION ALL SELECT o.variant, o.day, (1 + g.v) * (1 + o.v) - 1 FROM {name}_values o JOIN {name}_values g ON o.variant = g.variant AND o.day = g.day
   AND o.leg = 'open' AND g.leg = 'gap' WHERE o.v IS NOT NULL AND g.v IS NOT NULL""",
    )
    cte(
        f"{name}_period",
        f"""SELECT s.variant, s.exec_date AS date, coalesce(v, 0) AS ret FROM {name}_steps s LEFT JOIN {name}_values x
  ON x.variant = s.variant AND x.day = s.exec_date AND x.leg = 'period' WHERE s.next_exec IS NOT NULL""",
    )


def close_sql(name: str, hold: str, plan: str, mean: str = MEAN) -> None:
    cte(f"{name}_steps", f"SELECT variant, exec_date, lead(exec_date) OVER (PARTITION BY variant ORDER BY exec_date) AS next_exec FROM {plan}")
    cte(
        f"{name}_held",
        f"""SELECT s.next_exec, h.*, b.date, b.close, b.close / nullif(lag(b.close) OVER (PARTITION BY h.variant, h.exec_date, h.symbol ORDER BY b.date), 0) - 1 AS r
  FROM {name}_steps s JOIN {hold} h ON s.variant = h.variant AND s.exec_date = h.exec_date JOIN bars b ON b.symbol = h.symbol AND b.date BETWEEN s.exec_date AND s.next_exec""",
    )
    cte(f"{name}_daily", f"SELECT variant, date, {mean} AS ret FROM {name}_held WHERE r IS NOT NULL GROUP BY variant, exec_date, date HAVING {mean} IS NOT NULL")
    keep = "max(weight) AS weight" if mean == WEIGHTED else "1 AS weight"
    cte(
        f"{name}_sym",
        f"""SELECT variant, exec_date, symbol, arg_max(close, date) / nullif(arg_min(close, date), 0) - 1 AS r, {keep}
  FROM {name}_held GROUP BY variant, exec_date, symbol HAVING count(*) >= 2""",
    )
    cte(
        f"{name}_period",
        f"""SELECT s.variant, s.exec_date AS date, coalesce(v, 0) AS ret FROM {name}_steps s LEFT JOIN
  (SELECT variant, exec_date, {mean} AS v FROM {name}_sym GROUP BY variant, exec_date) x ON x.variant = s.variant AND x.exec_date = s.exec_date WHERE s.next_exec IS NOT NULL""",
    )


def both_sql(name: str) -> str:
    return f"""SELECT 'period' AS kind, variant, date, round(ret, 6) AS ret FROM {name}_period
  UNION ALL SELECT 'daily', variant, date, round(ret, 6) FROM {name}_daily"""


def both(pair):
    period, daily = pair
    return rounded(period.withColumn("kind", F.lit("period")).unionByName(daily.withColumn("kind", F.lit("daily"))))


next_open_sql("no", "held", "sched")
next_open_sql("now", "weighted", "sched", WEIGHTED)
close_sql("cc", "held", "sched")
close_sql("ccw", "weighted", "sched", WEIGHTED)


@query("next_open_returns", sql(both_sql("no")))
def _(spark, sf):
    return both(pf.next_open_returns(bars(spark, sf), held(spark, sf), sched(spark, sf), calendar(spark, sf)))


@query("next_open_weighted", sql(both_sql("now")))
def _(spark, sf):
    hold = sel.period_weights(held(spark, sf), weights(spark, sf))
    return both(pf.next_open_returns(bars(spark, sf), hold, sched(spark, sf), calendar(spark, sf)))


@query("close_to_close_returns", sql(both_sql("cc")))
def _(spark, sf):
    return both(pf.close_to_close_returns(bars(spark, sf), held(spark, sf), sched(spark, sf)))


@query("close_to_close_weighted", sql(both_sql("ccw")))
def _(spark, sf):
    hold = sel.period_weights(held(spark, sf), weights(spark, sf))
    return both(pf.close_to_close_returns(bars(spark, sf), hold, sched(spark, sf)))


def daily(spark, sf):
    return pf.next_open_returns(bars(spark, sf), held(spark, sf), sched(spark, sf), calendar(spark, sf))[1]


def stored_daily(spark, sf):
    """``daily`` written once, a row a day and variant, for queries that read it several times."""
    return sinks.cached_scores(daily(spark, sf), scratch(spark) + "/daily")


# the benchmark is missing in one week of seven, so the carry is exercised
cte("thin_market", "SELECT date, close FROM market WHERE weekofyear(date) % 7 <> 0")
cte(
    "bench_ret",
    """SELECT date, c / nullif(lag(c) OVER (ORDER BY date), 0) - 1 AS ret FROM
  (SELECT n.date, last_value(close IGNORE NULLS) OVER (ORDER BY n.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
   FROM calendar n LEFT JOIN thin_market m ON n.date = m.date)""",
)


def bench(spark, sf):
    thin = market(spark, sf).where("weekofyear(date) % 7 <> 0")
    return pf.benchmark_returns(thin, BENCHMARK, calendar(spark, sf))


@query("benchmark_returns", sql("SELECT 'benchmark' AS variant, date, round(ret, 6) AS ret FROM bench_ret WHERE ret IS NOT NULL"))
def _(spark, sf):
    return rounded(bench(spark, sf))


def curve_sql(name: str, source: str, start: str = "") -> None:
    peak = "max(equity) OVER (PARTITION BY variant ORDER BY date)"
    cte(f"{name}_eq", f"SELECT variant, date, ret, product(1 + ret) OVER (PARTITION BY variant ORDER BY date) AS equity FROM {source}")
    cte(f"{name}_curve", f"SELECT *, {f'greatest({peak}, 1.0)' if start else peak} AS peak FROM {name}_eq")


def perf_sql(source: str) -> str:
    return f"""SELECT variant, count(*) AS n_days, round(slog(arg_max(equity, date) ** (252.0 / count(*)) - 1), 6) AS annualised_return,
  round(avg(ret) / (stddev_samp(ret) + 0.000000001) * sqrt(252.0), 6) AS sharpe, round(max((peak - equity) / nullif(peak, 0)), 6) AS max_drawdown
  FROM {source}_curve GROUP BY variant"""


curve_sql("no", "no_daily")
curve_sql("nos", "no_daily", "start")


ANN = "annualised_return"


@query("equity_curve", sql("SELECT variant, date, " + r6("ret", "ln(1 + equity) AS equity", "ln(1 + peak) AS peak", "(peak - equity) / nullif(peak, 0) AS drawdown") + " FROM nos_curve"))
def _(spark, sf):
    return rounded(logged(pf.equity_curve(daily(spark, sf), include_start=True), "equity", "peak"))


@query("performance", sql(perf_sql("no")))
def _(spark, sf):
    return rounded(logged(pf.performance(daily(spark, sf)), ANN))


@query(
    "performance_ext",
    sql(
        """SELECT variant, n_days, """
        + r6(
            "slog(total_return) AS total_return",
            "volatility",
            "max_drawdown",
            "slog(annual) AS annual_return",
            "slog(coalesce((annual - 0.03) / nullif(volatility, 0), 0)) AS sharpe",
            "buy_hold_return",
            "slog(total_return - buy_hold_return) AS excess_return",
        )
        + """ FROM (SELECT *, (1 + total_return) ** (252.0 / n_days) - 1 AS annual FROM (SELECT variant, count(*) AS n_days, arg_max(equity, date) - 1 AS total_return,
   stddev_samp(ret) * sqrt(252.0) AS volatility, -max((peak - equity) / nullif(peak, 0)) AS max_drawdown,
   (SELECT product(1 + ret) - 1 FROM bench_ret WHERE ret IS NOT NULL) AS buy_hold_return FROM no_curve GROUP BY variant))"""
    ),
)
def _(spark, sf):
    out = pf.performance_ext(daily(spark, sf), bench(spark, sf))
    return rounded(logged(out, "total_return", "annual_return", "sharpe", "excess_return"))


@query(
    "excess_curve",
    sql(
        """SELECT d.variant, d.date, round(sum(b.ret) OVER w, 6) AS cum_bench, round(sum(d.ret - 0.001) OVER w, 6) AS cum_return_w_cost,
  round(sum(d.ret - 0.001 - b.ret) OVER w, 6) AS cum_ex_return_w_cost FROM no_daily d JOIN bench_ret b ON d.date = b.date AND b.ret IS NOT NULL
  WINDOW w AS (PARTITION BY d.variant ORDER BY d.date)"""
    ),
)
def _(spark, sf):
    return rounded(pf.excess_curve(daily(spark, sf), bench(spark, sf), 0.001))


cte(
    "trades",
    f"""SELECT p.symbol, p.date, CASE WHEN position > prev THEN 'BUY' ELSE 'SELL' END AS action, b.close AS price FROM
  (SELECT symbol, date, position, coalesce(lag(position) OVER ({W}), 0) AS prev FROM positions) p JOIN bars b ON b.symbol = p.symbol AND b.date = p.date WHERE position <> prev""",
)
cte("numbered_trades", "SELECT *, row_number() OVER (PARTITION BY symbol, action ORDER BY date) AS n FROM trades")


@query(
    "trade_stats",
    sql(
        """SELECT symbol, CAST(sum(c) AS BIGINT) AS n_trades, count(r) AS n_pairs, round(coalesce(count(*) FILTER (r > 0) / nullif(count(r), 0), 0), 6) AS win_rate,
  round(coalesce(avg(r), 0), 6) AS mean_return FROM (SELECT symbol, n, count(*) AS c, max(price) FILTER (action = 'SELL') / nullif(max(price) FILTER (action = 'BUY'), 0) - 1 AS r
  FROM numbered_trades GROUP BY symbol, n) GROUP BY symbol"""
    ),
)
def _(spark, sf):
    w = Window.partitionBy("symbol").orderBy("date")
    moves = positions(spark, sf).withColumn("prev", F.coalesce(F.lag("position").over(w), F.lit(0))).where("position <> prev")
    trades = moves.select("symbol", "date", F.when(F.col("position") > F.col("prev"), "BUY").otherwise("SELL").alias("action"), F.col("value").alias("price"))
    return rounded(pf.trade_stats(trades))


@query(
    "strategy_correlation",
    sql(
        """SELECT count(*) AS n, round(covar_pop(a.ret, b.ret) / (stddev_pop(a.ret) * stddev_pop(b.ret)), 6) AS correlation
  FROM no_daily a JOIN no_daily b ON a.date = b.date AND a.variant = 3 AND b.variant = 5"""
    ),
)
def _(spark, sf):
    d = stored_daily(spark, sf)
    return rounded(pf.strategy_correlation(d.where("variant = 3"), d.where("variant = 5")))


# ---- backtests and sweeps -------------------------------------------------------------------

cte("sched_close", "SELECT variant, signal_date, signal_date AS exec_date FROM sched")
cte("held_close", "SELECT h.variant, s.signal_date AS exec_date, h.symbol FROM held h JOIN sched s ON h.variant = s.variant AND h.exec_date = s.exec_date")
close_sql("bc", "held_close", "sched_close")
cte("full_bench", "SELECT date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS ret FROM market")
for mode, source in (("next_open", "no"), ("close", "bc")):
    cte(
        f"bt_{mode}",
        f"""SELECT CAST(variant AS VARCHAR) AS variant, date, ret FROM {source}_daily UNION ALL
  SELECT 'benchmark', date, ret FROM full_bench WHERE ret IS NOT NULL""",
    )
    curve_sql(f"bt_{mode}", f"bt_{mode}")


def _backtest(mode):
    def run(spark, sf):
        out = bt.run_backtest(curves(spark, sf), all_bars(spark, sf), calendar(spark, sf), [3, 5], 10, mode, 0.0, BENCHMARK)
        return rounded(logged(out["metrics"], ANN))

    return run


query("run_backtest", sql(perf_sql("bt_next_open")))(_backtest("next_open"))
query("run_backtest_close", sql(perf_sql("bt_close")))(_backtest("close"))

PARAMS = [(k, h, t, r) for k in (5, 10) for h in (3, 5) for t in (0.0001, 0.0004, 0.02, 1e9) for r in (None, 1)]
cte(
    "params",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({k}, {h}, CAST({t} AS DOUBLE), {r or h}, {i})" for i, (k, h, t, r) in enumerate(PARAMS))
    + ") v(top_k, hold, threshold, rank_h, variant)",
)
for mode, exec_date in (("close", "signal_date"), ("open", "exec_date")):
    cte(f"sweep_plan_{mode}", f"SELECT p.variant, s.signal_date, s.{exec_date} AS exec_date FROM sched s JOIN params p ON p.hold = s.variant")
    cte(
        f"sweep_held_{mode}",
        f"""SELECT variant, exec_date, symbol FROM (SELECT p.variant, p.top_k, s.{exec_date} AS exec_date, c.symbol,
   row_number() OVER (PARTITION BY p.variant, s.signal_date ORDER BY c.value DESC, c.symbol) AS place FROM sched s JOIN params p ON p.hold = s.variant
   JOIN curves c ON c.date = s.signal_date AND c.h = p.rank_h WHERE c.value >= p.threshold) WHERE place <= top_k""",
    )
close_sql("sw", "sweep_held_close", "sweep_plan_close")
next_open_sql("swo", "sweep_held_open", "sweep_plan_open")
curve_sql("sw", "sw_daily")
curve_sql("swo", "swo_daily")


def sweep_sql(source: str, params: str = "params") -> str:
    return f"""SELECT top_k, hold, CAST(threshold AS DOUBLE) AS threshold, rank_h, coalesce(n_days, 0) AS n_days, annualised_return, sharpe, max_drawdown
  FROM {params} p LEFT JOIN ({perf_sql(source)}) m ON m.variant = p.variant"""


@query("sweep", sql(sweep_sql("sw")))
def _(spark, sf):
    return rounded(logged(bt.sweep(curves(spark, sf), bars(spark, sf), calendar(spark, sf), PARAMS, "close"), ANN))


@query("sweep_thresholds_open", sql(sweep_sql("swo")))
def _(spark, sf):
    return rounded(logged(bt.sweep(curves(spark, sf), bars(spark, sf), calendar(spark, sf), PARAMS, "next_open"), ANN))


GRID = [(k, h) for k in (5, 10, 20) for h in (3, 5)]
cte("grid", "SELECT * FROM (VALUES " + ", ".join(f"({k}, {h}, '{k}|{h}')" for k, h in GRID) + ") v(top_k, hold, variant)")
cte("grid_plan", "SELECT g.variant, s.exec_date FROM sched s JOIN grid g ON g.hold = s.variant")
cte(
    "grid_held",
    """SELECT variant, exec_date, symbol FROM (SELECT g.variant, g.top_k, s.exec_date, c.symbol,
   row_number() OVER (PARTITION BY g.variant, s.exec_date ORDER BY c.value DESC, c.symbol) AS place FROM sched s JOIN grid g ON g.hold = s.variant
   JOIN curves c ON c.date = s.signal_date AND c.h = s.variant WHERE c.value >= 0) WHERE place <= top_k""",
)
next_open_sql("gr", "grid_held", "grid_plan")
curve_sql("gr", "gr_daily")


@query(
    "sweep_next_open",
    sql(
        f"""SELECT top_k, max(CASE WHEN hold = 3 THEN sharpe END) AS hold_3, max(CASE WHEN hold = 5 THEN sharpe END) AS hold_5
  FROM ({perf_sql('gr')}) m JOIN grid g ON m.variant = g.variant GROUP BY top_k"""
    ),
)
def _(spark, sf):
    return rounded(bt.sweep_next_open(curves(spark, sf), bars(spark, sf), calendar(spark, sf), [5, 10, 20], [3, 5]))


DEPTHS = [(k, 5, 0.0, None) for k in range(1, 101)]
cte("depths", "SELECT k AS variant, k AS top_k, 5 AS hold, CAST(0 AS DOUBLE) AS threshold, 5 AS rank_h FROM range(1, 101) t(k)")
for mode, exec_date in (("close", "signal_date"), ("open", "exec_date")):
    cte(f"depth_plan_{mode}", f"SELECT p.variant, s.signal_date, s.{exec_date} AS exec_date FROM sched s JOIN depths p ON p.hold = s.variant")
    cte(
        f"depth_held_{mode}",
        f"""SELECT p.variant, c.exec_date, c.symbol FROM depths p JOIN (SELECT s.{exec_date} AS exec_date, c.symbol,
   row_number() OVER (PARTITION BY s.signal_date ORDER BY c.value DESC, c.symbol) AS place FROM sched s
   JOIN curves c ON c.date = s.signal_date AND c.h = s.variant WHERE s.variant = 5 AND c.value >= 0) c ON c.place <= p.top_k""",
    )
close_sql("dc", "depth_held_close", "depth_plan_close")
next_open_sql("dno", "depth_held_open", "depth_plan_open")
curve_sql("dc", "dc_daily")
curve_sql("dno", "dno_daily")


@query("sweep_depths", sql(sweep_sql("dc", "depths")))
def _(spark, sf):
    return rounded(logged(bt.sweep(curves(spark, sf), bars(spark, sf), calendar(spark, sf), DEPTHS, "close"), ANN))


@query("sweep_depths_open", sql(sweep_sql("dno", "depths")))
def _(spark, sf):
    return rounded(logged(bt.sweep(curves(spark, sf), bars(spark, sf), calendar(spark, sf), DEPTHS, "next_open"), ANN))


cte("blend_weights", "SELECT k / 10.0::DOUBLE AS w FROM range(0, 11) t(k)")
cte(
    "blend_z",
    f"SELECT date, symbol, {z_sql('score_a', 'stddev_samp')} AS za, {z_sql('score_b', 'stddev_samp')} AS zb FROM aligned",
)
cte("sched5", "SELECT signal_date, exec_date FROM sched WHERE variant = 5")
cte("blend_plan", "SELECT w AS variant, exec_date FROM sched5, blend_weights")
cte(
    "blend_held",
    """SELECT variant, exec_date, symbol FROM (SELECT *, row_number() OVER (PARTITION BY variant, exec_date ORDER BY value DESC, symbol) AS place FROM
  (SELECT w AS variant, exec_date, symbol, w * za + (1.0::DOUBLE - w) * zb AS value FROM blend_z z JOIN sched5 s ON z.date = s.signal_date, blend_weights) WHERE value >= 0) WHERE place <= 10""",
)
next_open_sql("bl", "blend_held", "blend_plan")
curve_sql("bl", "bl_daily")


@query("sweep_blend", sql(f"SELECT variant AS weight, m.* EXCLUDE (variant) FROM ({perf_sql('bl')}) m"))
def _(spark, sf):
    ws = [k / 10 for k in range(11)]
    return rounded(logged(bt.sweep_blend(score_a(spark, sf), score_b(spark, sf), bars(spark, sf), calendar(spark, sf), ws, 10, 5), ANN))


# ---- documents and caches -------------------------------------------------------------------


def _docs(spark, sf):
    path = scratch(spark)
    d = stored_daily(spark, sf)
    metrics = pf.performance(d).drop("n_days")
    for run, sign in (("long", 1.0), ("short", -1.0)):
        signed = d.withColumn("ret", F.col("ret") * F.lit(sign))
        sinks.write_result_doc(signed, metrics, f"{path}/{run}", run)
    return sinks.read_result_docs(spark, [f"{path}/long", f"{path}/short"])


@query(
    "write_result_doc",
    sql(
        """SELECT 'long' AS run, CAST(variant AS VARCHAR) AS variant, date, round(ret, 6) AS ret FROM no_daily UNION ALL
  SELECT 'short', CAST(variant AS VARCHAR), date, round(-ret, 6) FROM no_daily"""
    ),
)
def _(spark, sf):
    return rounded(_docs(spark, sf).drop("metrics"))


METRICS = ["annualised_return", "sharpe", "max_drawdown"]


@query(
    "compare_runs",
    sql(
        " UNION ALL ".join(
            f"SELECT '{run}' AS run, CAST(variant AS VARCHAR) AS variant, '{m}' AS metric, {m} AS value FROM ({perf_sql('no')})"
            for run in ("long", "short")
            for m in METRICS
        )
    ),
)
def _(spark, sf):
    out = sinks.compare_runs(_docs(spark, sf))
    value = F.when(F.col("metric") == ANN, F.signum("value") * F.log1p(F.abs("value"))).otherwise(F.col("value"))
    return rounded(out.withColumn("value", value))


@query("cached_scores", sql("SELECT date, symbol, h, round(value, 5) AS value FROM curves"))
def _(spark, sf):
    stored = sinks.cached_scores(curves(spark, sf), scratch(spark) + "/curves")
    return rounded(stored.select("date", "symbol", "h", "value"), 5)
