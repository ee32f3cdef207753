"""Small cases with values worked out by hand."""

from __future__ import annotations

import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import day, days, flat_bars, rows

from barline.operators import calendar as cal_ops
from barline.operators import clean, evaluate, features, labels, portfolio, postprocess, scores, select, windows
from barline.plans import backtest
from barline.sources import bars as src
from barline.sources import parsing
from workload import base, ranking


def test_upsert_is_idempotent_and_last_write_wins(spark, bars_of):
    ds = days(3)
    base = bars_of({"A": flat_bars(ds)})
    new = bars_of({"A": flat_bars(ds[1:2], 110.0), "B": flat_bars(ds[:1], 5.0)})
    updates = new.withColumn("seq", F.lit(1)).unionByName(new.where("symbol = 'A'").withColumns({"close": F.lit(120.0), "seq": F.lit(2)}))
    once = src.upsert_bars(base, updates)
    twice = src.upsert_bars(once, updates)
    assert rows(once, "symbol", "date", "close") == rows(twice, "symbol", "date", "close")
    assert rows(once, "symbol", "date", "close") == [("A", ds[0], 100.0), ("A", ds[1], 120.0), ("A", ds[2], 100.0), ("B", ds[0], 5.0)]


def test_read_window_without_symbols_is_empty(bars_of):
    assert src.read_window(bars_of({"A": flat_bars(days(3))}), []).count() == 0


def test_exchange_rows(spark):
    data = [
        (["113/01/02", "10,000", "5,800,000", "580.00", "590.00", "575.00", "588.00"],),
        (["113/01/03", "--", "1", "1", "1", "1", "1"],),
        (["bad", "1", "1", "1", "1", "1", "1"],),
        (["113/01/04", "1"],),
    ]
    out = parsing.parse_exchange_rows(spark.createDataFrame(data, "row array<string>"))
    assert rows(out, "date", "volume", "open", "close") == [(day("2024-01-02"), 10000.0, 580.0, 588.0)]


def test_packed_bars(spark):
    plain = '{"data":{"klines":["2024-01-02,1,2,3,0.5,100","2024-01-03,1,x,3,0.5,100","2024-01-04,1,2,3,0.5,100,250,1.5"]}}'
    raw = spark.createDataFrame([("A", plain), ("B", f"/**/cb({plain});"), ("C", "cb(nonsense)")], "symbol string, payload string")
    out = parsing.parse_packed_bars(raw)
    expected = [(day("2024-01-02"), 2.0, 0.0, 0.0), (day("2024-01-04"), 2.0, 250.0, 1.5)]
    for s in ("A", "B"):
        assert rows(out.where(F.col("symbol") == s), "date", "close", "amount", "amplitude") == expected
    assert out.where("symbol = 'C'").count() == 0


def test_bar_file_without_time_gets_an_hourly_clock(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    (tmp_path / "x.csv").write_text("open,high,low,close\n1,2,0.5,1.5\n2,3,1,n/a\n3,4,2,3.5\n")
    out = parsing.load_bar_file(spark, path)
    assert rows(out, "timestamps", "close") == [(dt.datetime(2024, 1, 1, 0), 1.5), (dt.datetime(2024, 1, 1, 2), 3.5)]
    (tmp_path / "y.csv").write_text("open,high\n1,2\n")
    with pytest.raises(ValueError):
        parsing.load_bar_file(spark, str(tmp_path / "y.csv"))


def test_repairs(spark, bars_of):
    ds = days(3)
    b = bars_of({"A": [(ds[0], 0.0, 1.0, 1.0, 5.0, 10.0, None), (ds[1], None, 1.0, 1.0, 6.0, 10.0, None), (ds[2], 3.0, 1.0, 1.0, 7.0, 10.0, None)]})
    assert rows(clean.repair_open(b), "date", "open") == [(ds[0], 5.0), (ds[1], 5.0), (ds[2], 3.0)]
    assert rows(clean.repair_amount(b), "date", "amount") == [(ds[0], 50.0), (ds[1], 60.0), (ds[2], 70.0)]
    with pytest.raises(ValueError):
        clean.validate_fields(b, ["vwap"])


def test_trading_days(bars_of):
    ds = days(4)
    data = {f"S{i}": flat_bars(ds[:3]) for i in range(20)}
    data["^B"] = flat_bars([ds[0], ds[1], ds[3]])
    data["LONE"] = flat_bars([ds[3]])
    assert rows(cal_ops.trading_days(bars_of(data), "^B", 10), "date") == [(ds[0],), (ds[1],)]


def test_schedule(spark):
    ds = [day(f"2024-01-0{i}") for i in (2, 3, 4, 5, 8)]
    cal = spark.createDataFrame([(d,) for d in ds], "date date")
    assert rows(cal_ops.schedule(cal, [2]), "signal_date", "exec_date") == [(ds[0], ds[1]), (ds[2], ds[3])]
    with pytest.raises(ValueError):
        cal_ops.schedule(cal, [0])
    with pytest.raises(ValueError):
        cal_ops.benchmark_calendar(cal.withColumn("symbol", F.lit("A")), "B")
    with pytest.raises(ValueError):
        cal_ops.date_filter(cal, "2024-01-01")


def _random_bars(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for d in days(n):
        o, c = rng.uniform(90, 110, 2)
        out.append((d, float(o), float(max(o, c) + 1), float(min(o, c) - 1), float(c), float(rng.integers(1, 99)), 1.0))
    return out


def _window_features(rs):
    """Features of one history by plain arithmetic."""
    close, vol = [r[4] for r in rs], [r[5] for r in rs]
    hl = [(r[2] - r[3]) / r[4] for r in rs]
    ret = [b / a - 1 for a, b in zip(close, close[1:])]
    mean = lambda x: sum(x) / len(x)
    out = {f"feat_ma{n}_dist": close[-1] / mean(close[-n:]) - 1 for n in (5, 20, 60)}
    out |= {f"feat_momentum_{n}": close[-1] / close[-n - 1] - 1 if len(close) > n else 0.0 for n in (3, 5, 10, 20, 60)}
    out |= {f"feat_vol_{n}": float(np.std(ret[-n:])) if len(ret) >= n else 0.0 for n in (10, 30)}
    out["feat_volume_ratio"] = vol[-1] / mean(vol[-20:])
    out["feat_volume_trend"] = mean(vol[-5:]) / mean(vol[-20:]) if len(vol) >= 20 else 1.0
    out["feat_hl_spread_5"] = mean(hl[-5:])
    return out


@pytest.mark.parametrize("n", [3, 25, 70])
def test_features_equal_plain_arithmetic(bars_of, n):
    data = _random_bars(n, n)
    got = {r["date"]: r for r in features.technical_features(bars_of({"A": data, "B": _random_bars(5, 1)})).where("symbol = 'A'").collect()}
    for k in (1, n // 2, n):
        for name, v in _window_features(data[:k]).items():
            assert got[data[k - 1][0]][name] == pytest.approx(v, abs=1e-12), name


def test_future_bars_change_no_earlier_feature(bars_of):
    data = _random_bars(70, 2)
    early = features.technical_features(bars_of({"A": data[:60]}))
    late = features.technical_features(bars_of({"A": data})).where(F.col("date") <= data[59][0])
    assert early.exceptAll(late).isEmpty() and late.count() == 60


def test_cross_sectional_rank_with_ties(spark):
    d1, d2 = days(2)
    df = spark.createDataFrame([(d1, "A", 2.0), (d1, "B", 1.0), (d2, "A", 3.0), (d2, "B", 3.0), (d2, "C", None)], "date date, symbol string, x double")
    got = rows(features.cs_rank(df, ["x"]).where("x is not null"), "date", "symbol", "x_cs_rank")
    assert got == [(d1, "A", 1.0), (d1, "B", 0.5), (d2, "A", 0.75), (d2, "B", 0.75)]


def test_features_at_strict_and_enrich(spark, bars_of):
    data = _random_bars(10, 4)
    b = bars_of({"A": data, "B": _random_bars(10, 5)})
    keys = spark.createDataFrame([(data[9][0], "A"), (data[9][0], "B"), (day("2030-01-01"), "A")], "date date, symbol string")
    assert features.features_at(b, keys, strict=False).count() == 2
    with pytest.raises(Exception, match="no bar for A on 2030-01-01"):
        features.features_at(b, keys).collect()
    panel = keys.withColumns({"label": F.lit(1.0), "feat_old": F.lit(9.0)})
    out = features.enrich(panel, b)
    assert out.columns[:3] == ["date", "symbol", "label"] and "feat_old" not in out.columns
    assert out.columns[3:5] == ["feat_ma5_dist", "feat_ma5_dist_cs_rank"] and out.count() == 2
    with pytest.raises(Exception, match="repeated key"):
        features.enrich(panel.unionByName(panel), b).collect()
    # with a number of partitions given, the deals by key and by date take it; results and the check of keys stay
    wide = features.enrich(panel, b, parts=9)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    by_date = re.findall(r"Exchange hashpartitioning\(date#\d+[^)]*\b(\d+)\)", plan)
    assert by_date and set(by_date) == {"9"}, by_date
    assert rows(wide, *out.columns) == rows(out, *out.columns)
    with pytest.raises(Exception, match="repeated key"):
        features.enrich(panel.unionByName(panel), b, parts=9).collect()


def test_feature_columns():
    cols = ["date", "emb_10", "emb_2", "feat_vol_10", "feat_zzz", "feat_ma5_dist_cs_rank", "feat_ma5_dist"]
    raw = ["feat_ma5_dist", "feat_ma5_dist_cs_rank", "feat_vol_10", "feat_zzz"]
    assert features.feature_columns(cols, "emb") == ["emb_2", "emb_10"]
    assert features.feature_columns(cols, "raw") == raw
    assert features.feature_columns(cols) == ["emb_2", "emb_10", *raw]
    with pytest.raises(ValueError):
        features.feature_columns(cols, "none")


def test_contexts_skip_short_and_incomplete_histories(spark, bars_of):
    ds = days(6)
    bar = lambda i, close=1.0: (ds[i], 10.0 + i, 1.0, 1.0, close, 1.0, 1.0)
    b = bars_of({"GOOD": [bar(i) for i in range(6)], "SHORT": [bar(0), bar(1)], "HOLE": [bar(i, None if i == 4 else 1.0) for i in range(6)]})
    rebal = spark.createDataFrame([(ds[5],)], "date date")
    assert rows(windows.contexts(b, rebal, 3), "symbol", "pos", "open") == [("GOOD", 1, 13.0), ("GOOD", 2, 14.0), ("GOOD", 3, 15.0)]


def test_windows_never_cross_symbols_and_see_no_future(bars_of):
    b = bars_of({"A": _random_bars(6, 1), "B": _random_bars(4, 2)})
    w = windows.sliding_windows(b, 5)
    assert rows(w, "symbol") == [("A",), ("A",)]
    spiked = b.withColumn("close", F.when(F.col("date") == days(6)[4], 1e9).otherwise(F.col("close")))
    n1 = windows.normalise_window(windows.sliding_windows(b, 5), 4).select("stats", F.get("win", F.lit(0))["close"].alias("c")).first()
    n2 = windows.normalise_window(windows.sliding_windows(spiked, 5), 4).select("stats", F.get("win", F.lit(0))["close"].alias("c"), F.get("win", F.lit(4))["close"].alias("z")).first()
    assert n1["stats"] == n2["stats"] and n1["c"] == n2["c"] and n2["z"] == 5.0


def test_forward_return_and_overlay_leakage(spark, bars_of):
    ds = days(100)
    b = bars_of({"A": [(d, 100.0 + i, 1.0, 1.0, 1.0, 1.0, 1.0) for i, d in enumerate(ds)], "B": flat_bars(ds)})
    got = labels.forward_open_return(b, 2).where(f"symbol = 'A' and date = '{ds[0]}'").first()["label"]
    assert got == pytest.approx(103 / 101 - 1)
    cal = b.select("date").distinct()
    s = spark.createDataFrame([(ds[80], "A", 1.0), (ds[10], "A", 1.0), (day("2030-01-01"), "A", 1.0)], "date date, symbol string, score double")
    base = rows(scores.momentum_overlay(s, b, cal), "date", "score")
    mean = sum((101 + i + 5) / (101 + i) - 1 for i in range(15, 75)) / 60
    assert base == [(ds[10], 1.0), (ds[80], pytest.approx(1 + 2 * mean)), (day("2030-01-01"), 1.0)]
    spiked = b.withColumn("open", F.when(F.col("date") > ds[80], 1e6).otherwise(F.col("open")))
    assert rows(scores.momentum_overlay(s, spiked, cal), "date", "score") == base
    with pytest.raises(ValueError):
        scores.momentum_overlay(s, b, cal, gap=3, hold=5)


def test_calendar_return_needs_both_days(bars_of):
    ds = days(8)
    b = bars_of({"A": flat_bars([d for i, d in enumerate(ds) if i != 4]), "B": flat_bars(ds)})
    cal = b.select("date").distinct()
    got = rows(labels.calendar_forward_return(b, cal, 2).where("symbol = 'A'"), "idx")
    # open at i + 1 and i + 3, neither of them day 4
    assert got == [(0,), (2,), (4,)]


def test_zscore_of_a_constant_is_zero(spark):
    (d,) = days(1)
    df = spark.createDataFrame([(d, "A", 2.0), (d, "B", 2.0)], "date date, symbol string, score double")
    assert rows(scores.zscore_by_date(df), "score") == [(0.0,), (0.0,)]
    assert rows(scores.zscore_by_date(df.where("symbol = 'A'"), ddof=1), "score") == [(0.0,)]


def _brute_gradients(s, y, sigma):
    rank = np.empty(len(y))
    rank[np.argsort(y, kind="stable")] = np.arange(1, len(y) + 1)
    g, h = np.zeros(len(y)), np.zeros(len(y))
    for i in range(len(y)):
        for j in range(len(y)):
            if y[i] > y[j]:
                rho, dist = 1 / (1 + math.exp(sigma * (s[i] - s[j]))), abs(rank[i] - rank[j])
                g[i] -= sigma * rho * dist
                g[j] += sigma * rho * dist
                for k in (i, j):
                    h[k] += sigma**2 * rho * (1 - rho) * dist
    return g, np.maximum(h, 1e-6)


def test_gradients_equal_brute_force(spark):
    d1, d2 = days(2)
    s, y = [0.3, -0.2, 0.9, 0.1], [1.0, 2.0, 0.0, 2.0]
    data = [(d1, f"S{i}", s[i], y[i]) for i in range(4)] + [(d2, "X", 1.0, 1.0)]
    got = {(r["date"], r["symbol"]): (r["grad"], r["hess"]) for r in scores.rank_gradients(spark.createDataFrame(data, "date date, symbol string, score double, label double"), 2.0).collect()}
    g, h = _brute_gradients(s, y, 2.0)
    for i in range(4):
        assert got[(d1, f"S{i}")] == (pytest.approx(g[i]), pytest.approx(h[i]))
    assert got[(d2, "X")] == (0.0, 0.0)


def test_top_k_threshold_and_ties(spark):
    (d,) = days(1)
    df = spark.createDataFrame([(d, "A", 0.05), (d, "B", 0.02), (d, "C", 0.10), (d, "D", -0.01), (d, "E", None)], "date date, symbol string, score double")
    assert rows(select.top_k(df, 2), "symbol") == [("A",), ("C",)]
    assert rows(select.top_k(df, 9), "symbol") == [("A",), ("B",), ("C",)]
    tie = df.withColumn("score", F.lit(1.0))
    assert rows(select.top_k(tie, 2), "symbol") == [("A",), ("B",)]


def test_rank_h_picks_another_set(spark):
    d1, d2 = days(2)
    data = [(d1, s, h, v) for s, path in {"A": [0.9, 0.1], "B": [0.1, 0.9]}.items() for h, v in enumerate(path, 1)]
    paths = spark.createDataFrame(data, "date date, symbol string, h int, value double")
    sched = spark.createDataFrame([(2, d1, d2)], "variant int, signal_date date, exec_date date")
    assert rows(select.holdings(paths, sched, 1), "symbol") == [("B",)]
    assert rows(select.holdings(paths, sched, 1, rank_h=1), "symbol") == [("A",)]


def test_advice(spark):
    now = spark.createDataFrame([("A",), ("B",)], "symbol string")
    then = spark.createDataFrame([("B",), ("C",)], "symbol string")
    assert rows(select.rebalance_advice(now, then), "symbol", "action") == [("A", "sell"), ("B", "hold"), ("C", "buy")]


NO_BARS = {
    "A": [(100.0, 110.0), (110.0, 110.0), (121.0, 121.0)],
    "B": [(100.0, 110.0), (110.0, 110.0), (99.0, 99.0)],
    "C": [(50.0, 50.0), (50.0, 50.0), (50.0, 55.0)],
}


def _next_open(bars_of, spark, hold, execs):
    ds = days(3)
    b = bars_of({s: [(ds[i], o, 1.0, 1.0, c, 1.0, 1.0) for i, (o, c) in enumerate(p)] for s, p in NO_BARS.items()})
    cal = b.select("date").distinct()
    sched = spark.createDataFrame([("v", ds[i]) for i in execs], "variant string, exec_date date")
    h = spark.createDataFrame([("v", ds[i], s, w) for i, s, w in hold], "variant string, exec_date date, symbol string, weight double")
    return ds, portfolio.next_open_returns(b, h, sched, cal)


def test_next_open_legs(bars_of, spark):
    # day 0: (10 % + 10 %) / 2; day 1: flat; day 2: gap of A and B is 0 on average, then C gains 10 %
    ds, (period, daily) = _next_open(bars_of, spark, [(0, "A", None), (0, "B", None), (2, "C", None)], [0, 2])
    assert rows(daily, "date", "ret") == [(ds[0], pytest.approx(0.1)), (ds[1], pytest.approx(0.0)), (ds[2], pytest.approx(0.1))]
    assert rows(period, "date", "ret") == [(ds[0], pytest.approx(0.1))]


def test_next_open_weights_missing_prices_and_empty_sets(bars_of, spark):
    ds, (period, daily) = _next_open(bars_of, spark, [(0, "A", 3.0), (0, "B", 1.0), (0, "C", 0.0), (2, "C", 1.0)], [0, 2])
    assert rows(period, "ret") == [(pytest.approx((3 * 0.21 - 0.01) / 4),)]
    ds, (period, daily) = _next_open(bars_of, spark, [(0, "NONE", None), (2, "C", None)], [0, 2])
    assert rows(period, "ret") == [(0.0,)] and daily.count() == 0
    ds, (period, daily) = _next_open(bars_of, spark, [(2, "C", None)], [2])
    assert period.count() == 0 and rows(daily, "date", "ret") == [(ds[2], pytest.approx(0.1))]


def test_close_to_close(bars_of, spark):
    ds = days(10)
    price = lambda p, d: (d, p, p, p, p, 1.0, 1.0)
    b = bars_of({"A": [price(100.0 + i, d) for i, d in enumerate(ds)], "B": [price(200.0 - i, d) for i, d in enumerate(ds)]})
    sched = spark.createDataFrame([("v", d) for d in ds], "variant string, exec_date date")
    hold = spark.createDataFrame([("v", d, s) for d in ds for s in "AB"], "variant string, exec_date date, symbol string")
    period, daily = portfolio.close_to_close_returns(b, hold, sched)
    p = rows(period, "date", "ret")
    assert len(p) == 9 and p[0][1] == pytest.approx((0.01 - 0.005) / 2) and daily.count() == 9


def test_performance(spark):
    ds = days(252)
    ret = spark.createDataFrame([("flat", d, 0.0) for d in ds] + [("up", d, 0.001 + 0.0001 * (i % 2)) for i, d in enumerate(ds)] + [("dip", d, -0.5 if i == 0 else 0.0) for i, d in enumerate(ds)], "variant string, date date, ret double")
    m = {r["variant"]: r for r in portfolio.performance(ret).collect()}
    assert m["flat"]["annualised_return"] == pytest.approx(0.0) and m["flat"]["max_drawdown"] == 0.0
    assert m["up"]["sharpe"] > 0 and m["up"]["max_drawdown"] == 0.0
    # the curve starts at its first value, so a loss on the first day is no drawdown unless asked for
    assert m["dip"]["max_drawdown"] == 0.0
    start = portfolio.equity_curve(ret.where("variant = 'dip'"), include_start=True).agg(F.max("drawdown")).first()[0]
    assert start == pytest.approx(0.5)


def test_rank_ic_edges(spark):
    ds = days(4)
    data = [(ds[0], f"S{i}", float(i), float(i)) for i in range(5)] + [(ds[1], f"S{i}", float(i), float(-i)) for i in range(5)]
    data += [(ds[2], f"S{i}", 1.0, float(i)) for i in range(5)] + [(ds[3], f"S{i}", float(i), float(i) if i < 2 else None) for i in range(5)]
    df = spark.createDataFrame(data, "date date, symbol string, score double, label double")
    assert rows(evaluate.rank_ic(df, "score", "label", ["date"]), "date", "rank_ic") == [(ds[0], pytest.approx(1.0)), (ds[1], pytest.approx(-1.0)), (ds[2], None), (ds[3], None)]


def test_perfect_and_reversed_rankings(spark):
    (d,) = days(1)
    df = spark.createDataFrame([(d, f"S{i:02d}", float(i), float(i)) for i in range(30)], "date date, symbol string, score double, label double")
    day_row = evaluate.per_day_metrics(df, 10).first()
    assert day_row["rank_ic"] == pytest.approx(1.0) and day_row["overlap_topk"] == 1.0 and day_row["top_excess"] == pytest.approx(10.0)
    assert evaluate.ndcg_at_k(df, 2).first()["ndcg"] == pytest.approx(1.0)
    worse = evaluate.ndcg_at_k(df.withColumn("score", -F.col("score")), 2).first()["ndcg"]
    assert worse < 0.2
    assert evaluate.per_day_metrics(df, 16).count() == 0


def test_early_stop(spark):
    data = [(i, v) for i, v in enumerate([0.1, 0.3, float("nan"), 0.2, 0.25, 0.4])]
    out = scores.early_stop_trace(spark.createDataFrame(data, "step int, value double"), 2).orderBy("step").collect()
    assert [r["is_best"] for r in out] == [True, True, False, False, False, True]
    assert [r["should_stop"] for r in out] == [False, False, False, False, True, False]


def test_price_limit_chains(spark):
    (d,) = days(1)
    path = spark.createDataFrame([(d, "A", h, v, v, v, v) for h, v in enumerate([200.0, 200.0, 50.0], 1)], "date date, symbol string, h int, open double, high double, low double, close double")
    last = spark.createDataFrame([(d, "A", 100.0)], "date date, symbol string, close double")
    assert rows(postprocess.price_limit(path, last), "h", "close") == [(1, pytest.approx(110.0)), (2, pytest.approx(121.0)), (3, pytest.approx(108.9))]


def test_smoother_widens_with_the_path(bars_of, spark):
    ds = days(30)
    b = bars_of({"A": flat_bars(ds)})  # no trend, so no tilt
    for n, size in ((10, 3), (20, 4), (25, 5), (30, 6), (35, 7), (50, 7)):
        values = [float(i * i % 17) for i in range(n)]
        path = spark.createDataFrame([(ds[-1], "A", h, v) for h, v in enumerate(values, 1)], "date date, symbol string, h int, close double")
        want = [values[max(0, i - size // 2) : i + (size - 1) // 2 + 1] for i in range(n)]
        got = postprocess.smooth_path(path, b).orderBy("h").collect()
        assert [r["close"] for r in got] == pytest.approx([sum(w) / len(w) for w in want]), n


def test_factor_bounds(spark):
    cols = "symbol string, uptrend boolean, trend_strength double, sector_hot boolean, resonance double, sector_count double, macro double, expected_cuts double, fundamental double"
    t = spark.createDataFrame([("A", True, 1.0, True, 1.0, 5.0, 1.0, 4.0, 1.0), ("B", False, 0.5, False, 0.5, 0.0, 0.5, None, 0.5)], cols)
    assert rows(t.select("symbol", postprocess.adjustment_factor().alias("f")), "symbol", "f") == [("A", 1.1), ("B", 1.0)]


def test_sweep_equals_single_backtests(bars_of, spark):
    data = {f"S{i}": _random_bars(40, i) for i in range(6)}
    b = bars_of(data)
    cal = b.select("date").distinct()
    paths = b.select("date", "symbol", F.explode(F.array(F.lit(2), F.lit(3))).alias("h"), (F.col("close") / F.col("open") - 1).alias("value"))
    swept = backtest.sweep(paths, b, cal, [(2, 2, 0.0, None), (2, 3, 0.0, None), (1, 2, 0.01, 3)], "next_open")
    assert swept.count() == 3
    one = backtest.run_backtest(paths, b, cal, [2, 3], 2)
    backtest.missing_variants(one["daily"], [2, 3])
    with pytest.raises(ValueError):
        backtest.missing_variants(one["daily"], [2, 7])
    with pytest.raises(Exception, match="no daily returns for variant 2"):
        backtest.run_backtest(paths, b, cal, [2, 3], 2, threshold=1e9)["metrics"].collect()
    want = {int(r["variant"]): r["sharpe"] for r in one["metrics"].collect()}
    got = {r["hold"]: r["sharpe"] for r in swept.where("top_k = 2").collect()}
    assert got[2] == pytest.approx(want[2]) and got[3] == pytest.approx(want[3])


def test_sweep_keeps_fine_thresholds_apart(bars_of):
    b = bars_of({f"S{i}": _random_bars(60, i) for i in range(6)})
    cal = b.select("date").distinct()
    paths = b.select("date", "symbol", F.lit(2).alias("h"), ((F.col("close") / F.col("open") - 1) / 100).alias("value"))
    steps = [0.0001, 0.0004, 0.00041, 0.02]
    for mode in ("close", "next_open"):
        both = {r["threshold"]: tuple(r) for r in backtest.sweep(paths, b, cal, [(2, 2, t, None) for t in steps], mode).collect()}
        assert sorted(both) == steps and both[0.02][4] == 0 and both[0.02][6] is None
        for t in steps:
            assert tuple(backtest.sweep(paths, b, cal, [(2, 2, t, None)], mode).first()) == pytest.approx(both[t])


def test_sweep_over_every_depth_equals_single_backtests(bars_of):
    data = {f"S{i}": _random_bars(30, i) for i in range(7)}
    data["S3"] = [r for n, r in enumerate(data["S3"]) if n % 3]  # symbols without a price on some days
    b = bars_of(data)
    cal = b.select("date").distinct()
    paths = b.select("date", "symbol", F.lit(2).alias("h"), (F.col("close") / F.col("open") - 1).alias("value"))
    for mode in ("close", "next_open"):
        swept = {r["top_k"]: tuple(r)[4:] for r in backtest.sweep(paths, b, cal, [(k, 2, -1.0, None) for k in range(1, 11)], mode).collect()}
        assert sorted(swept) == list(range(1, 11)) and swept[7] == pytest.approx(swept[10])
        for k in (1, 4, 7):
            one = backtest.run_backtest(paths, b, cal, [2], k, mode, threshold=-1.0)["metrics"].first()
            assert swept[k] == pytest.approx((one["n_days"], one["annualised_return"], one["sharpe"], one["max_drawdown"]))
    assert backtest.sweep(paths.limit(0), b, cal, [(3, 2, 0.0, None)]).first()["n_days"] == 0
    with pytest.raises(ValueError, match="mode"):
        backtest.sweep(paths, b, cal, [(3, 2, 0.0, None)], "other")


def test_prefix_means_fill_places_without_returns(spark):
    t = spark.createDataFrame([("a", 2, 1.0), ("a", 3, None), ("a", 4, 3.0), ("b", 1, None)], "g string, place int, ret double")
    assert rows(portfolio.prefix_means(t, ["g"], 5), "g", "place", "ret") == [("a", 2, 1.0), ("a", 3, 1.0), ("a", 4, 2.0), ("a", 5, 2.0)]
    assert portfolio.prefix_means(t.limit(0), ["g"], 5).count() == 0


def test_known_amounts_stay(spark):
    data = [("A", 1.0, 3.0, 1.0, 3.0, None, 500.0), ("B", 1.0, 3.0, 1.0, 3.0, 10.0, None), ("C", 1.0, 3.0, 1.0, 3.0, None, None), ("D", 1.0, 3.0, 1.0, 3.0, 10.0, 7.0)]
    df = spark.createDataFrame(data, "symbol string, open double, high double, low double, close double, volume double, amount double")
    assert rows(clean.fill_amount(df), "symbol", "volume", "amount") == [("A", 0.0, 500.0), ("B", 10.0, 20.0), ("C", 0.0, 0.0), ("D", 10.0, 7.0)]


def test_written_days(spark):
    good = ["2024-01-02", "2024/1/2", "20240102", "2024.01.02", "2024-01-02T23:30:00+08:00", "2024-1-2 09:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*good, "2024-13-01", "today", None])], "i int, date string")
    got = [r["date"] for r in clean.normalise_date(df).orderBy("i").collect()]
    assert got == [day("2024-01-02")] * len(good) + [None] * 3
    with pytest.raises(Exception, match="no day in date"):
        clean.normalise_date(df, strict=True).collect()
    assert clean.normalise_date(df.where("i < 6"), strict=True).count() == 6


def test_ranker_learns(spark):
    rng = np.random.default_rng(0)
    data = []
    for d in days(30):
        for i in range(40):
            x, noise = float(rng.normal()), float(rng.normal())
            data.append((d, f"S{i}", x, noise, x + 0.3 * float(rng.normal())))
    panel = spark.createDataFrame(data, "date date, symbol string, x double, noise double, label double")
    split = days(30)[22]
    model, summary = scores.fit_ranker(panel, ["x", "noise"], F.col("date") >= split, rounds=8, eta=0.3)
    assert summary["rank_ic"] > 0.2 and summary["val"]["dates"] == 8 and summary["n_trees"] >= 1


def _walk(node, x):
    """A tree of Spark by hand: nulls, which are NaN in the vector, go right."""
    while node.numDescendants():
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def test_ranker_scores_walk_its_trees(spark):
    rng = np.random.default_rng(1)
    data = [(d, f"S{i}", x, noise, 2 * x + 0.1 * noise) for d in days(20) for i in range(20) for x, noise in [map(float, rng.normal(size=2))]]
    data.append((days(20)[3], "null", None, 0.1, 0.0))
    panel = spark.createDataFrame(data, "date date, symbol string, feat_x double, feat_n double, label double")
    cols = ["feat_x", "feat_n"]
    gbt = scores.GBTRegressor(featuresCol="features", labelCol="label", maxDepth=3, maxIter=6, stepSize=0.3, seed=1)
    model = gbt.fit(scores.assemble_features(panel.where("feat_x IS NOT NULL"), cols))
    assert model.getNumTrees == 6
    trees = [(t._call_java("rootNode"), w) for t, w in zip(model.trees, model.treeWeights)]
    got = {(r.date, r.symbol): r for r in ranking.tree_scores(panel, model, cols).collect()}
    assert len(got) == len(data)
    for d, symbol, x, noise, _ in data:
        each = [w * _walk(root, [float("nan") if x is None else x, noise]) for root, w in trees]
        r = got[d, symbol]
        assert r.score_full == pytest.approx(sum(each)) and r.score_half == pytest.approx(sum(each[: len(each) // 2]))


def test_tree_prefixes_add_up_along_the_trees(spark):
    rng = np.random.default_rng(2)
    data = [(d, f"S{i}", x, noise, x + noise) for d in days(8) for i in range(12) for x, noise in [map(float, rng.normal(size=2))]]
    data += [(days(8)[2], "null", None, 0.1, 0.0), (days(8)[3], "nan", float("nan"), 0.1, float("nan"))]
    panel = spark.createDataFrame(data, "date date, symbol string, feat_x double, feat_n double, label double")
    cols = ["feat_x", "feat_n"]
    gbt = scores.GBTRegressor(featuresCol="features", labelCol="label", maxDepth=3, maxIter=5, stepSize=0.3, seed=1)
    model = gbt.fit(scores.assemble_features(panel.where("feat_x IS NOT NULL AND NOT isnan(feat_x)"), cols))
    roots = [(t._call_java("rootNode"), w) for t, w in zip(model.trees, model.treeWeights)]
    ready = scores.assemble_features(panel, cols)
    got = {(r.date, r.symbol): r.prefixes for r in scores.tree_prefix_scores(ready, model).collect()}
    assert len(got) == len(data)
    for d, symbol, x, noise, _ in data:
        each = [w * _walk(root, [float("nan") if x is None else x, noise]) for root, w in roots]
        assert got[d, symbol] == pytest.approx(list(np.cumsum(each)))
    whole = {}
    for n in range(1, 6):
        cut = scores.first_trees(model, n)
        assert cut.getNumTrees == n
        whole[n] = cut.transform(ready).withColumnRenamed("prediction", "score")
        assert {(r.date, r.symbol): pytest.approx(r.score) for r in whole[n].collect()} == {k: v[n - 1] for k, v in got.items()}
    for limit in (5, scores.GROUP_LIMIT):
        figures = {r.trees: (r.n_dates, r.rank_ic) for r in scores.prefix_metrics(ready, model, limit=limit).collect()}
        assert figures == {n: (8, pytest.approx(evaluate.select_metric(rows_, "rank_ic").first().value)) for n, rows_ in whole.items()}
    assert scores.prefix_metrics(ready.where("false"), model).count() == 0


def test_prefix_figures_make_no_row_for_each_prefix(spark):
    """40 prefixes of 600 rows: the plan has one row for each row, and the figures equal ranks of pandas; few scores mean many ties."""
    rng = np.random.default_rng(7)
    data = [(d, f"S{i}", x, float(round(x + noise, 1))) for d in days(6) for i in range(100) for x, noise in [map(float, rng.normal(size=2))]]
    data += [(d, f"T{i}", 0.0, 1.0) for d in days(8)[6:] for i in range(5)]  # every label and score alike: no IC
    panel = spark.createDataFrame(data, "date date, symbol string, x double, label double")
    ready = scores.assemble_features(panel, ["x"])
    model = scores.GBTRegressor(featuresCol="features", labelCol="label", maxDepth=1, maxIter=40, stepSize=0.1, seed=1).fit(ready)
    figures = scores.prefix_metrics(ready, model)
    plan = figures._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    got = {r.trees: (r.n_dates, r.rank_ic) for r in figures.collect()}
    pdf = scores.tree_prefix_scores(ready, model).select("date", "label", "prefixes").toPandas()
    assert sorted(got) == list(range(1, model.getNumTrees + 1))
    for n in got:
        each = [g["label"].rank().corr(g["prefixes"].str[n - 1].rank()) for _, g in pdf.groupby("date") if g["label"].nunique() > 1]
        assert got[n] == (6, pytest.approx(np.mean(each)))


def test_best_prefix_is_the_first_best_before_patience_ends():
    nan = float("nan")
    assert scores.best_prefix([0.1, 0.3, 0.2, 0.3, 0.9], 2) == (2, True)
    assert scores.best_prefix([0.1, 0.3, 0.2, 0.4], 2) == (4, False)
    assert scores.best_prefix([None, nan, 0.1], 3) == (3, False)
    assert scores.best_prefix([None, nan, None], 2) == (1, True)
    assert scores.best_prefix([], 2) == (1, False)


def test_ranker_growth_by_doubling_equals_one_tree_at_a_time(spark):
    rng = np.random.default_rng(5)
    data = [(d, f"S{i}", x, noise, x * x + 0.3 * noise) for d in days(30) for i in range(15) for x, noise in [map(float, rng.normal(size=2))]]
    panel = spark.createDataFrame(data, "date date, symbol string, x double, noise double, label double")
    val = F.col("date") >= F.lit(days(30)[20])
    short, figures = scores.fit_ranker(panel, ["x", "noise"], val, rounds=12, eta=0.3, depth=2, patience=2)
    long, whole = scores.fit_ranker(panel, ["x", "noise"], val, rounds=12, eta=0.3, depth=2, patience=12)
    want, _ = scores.best_prefix(whole["trace"], 2)
    assert len(whole["trace"]) == 12 and figures["n_trees"] == want == short.getNumTrees > 1
    assert figures["trace"] == pytest.approx(whole["trace"][: len(figures["trace"])])
    assert figures["rank_ic"] == pytest.approx(whole["trace"][want - 1])
    assert [t.toDebugString.split("\n", 1)[1] for t in short.trees] == [t.toDebugString.split("\n", 1)[1] for t in long.trees[:want]] or want > long.getNumTrees


def test_registered_ranker_scores_every_validation_row(spark):
    assert len(ranking.RANKER_COLS) == 26
    sf = "/root/testdata/sf0.001"
    out = base.QUERIES["score_ranker"](spark, sf)
    want = ranking.labelled(spark, sf).where(ranking.VALIDATE).count()
    assert out.count() == want and out.where("score_full IS NULL OR score_half IS NULL").count() == 0


def test_sources_do_not_depend_on_partitioning(bars_of):
    b = bars_of({f"S{i}": _random_bars(30, i) for i in range(4)})
    a = features.cs_rank(features.technical_features(b.repartition(1)), ["feat_ma5_dist"])
    z = features.cs_rank(features.technical_features(b.orderBy(F.rand(1)).repartition(7)), ["feat_ma5_dist"])
    assert a.exceptAll(z).isEmpty()


def test_nan_is_never_picked_nor_ranked(spark):
    (d,) = days(1)
    nan, inf = float("nan"), float("inf")
    data = [(d, "A", nan, 1.0), (d, "B", 0.1, 2.0), (d, "C", 0.2, 3.0), (d, "D", 0.3, 4.0), (d, "E", 0.4, inf)]
    df = spark.createDataFrame(data, "date date, symbol string, score double, label double")
    assert rows(select.top_k(df, 2), "symbol") == [("D",), ("E",)]
    assert rows(evaluate.rank_ic(df, "score", "label", ["date"]), "n", "rank_ic") == [(3, pytest.approx(1.0))]


def test_window_moments_equal_folded_windows(bars_of):
    """Frame aggregates against array folds: short symbols, constant prices, values beyond the clip."""
    ds = days(30)
    noisy = [(d, 10.0 + i % 7, 12.0 + i % 5, 9.0, 10.0 + (i * 37) % 11, 1000.0 * (i % 4), 5.0) for i, d in enumerate(ds)]
    noisy[20] = (ds[20], 1e9, 1e9, 1.0, 1e9, 1e12, 5.0)
    b = bars_of({"A": noisy, "B": flat_bars(ds), "C": flat_bars(ds[:5])})
    folded = windows.normalise_window(windows.sliding_windows(b, 10), 7, clip=3.0)
    framed = windows.normalised_windows(b, 10, 7, clip=3.0)
    key = lambda r: (r.symbol, r.start_date)
    want, got = sorted(folded.collect(), key=key), sorted(framed.collect(), key=key)
    assert [key(r) for r in got] == [key(r) for r in want] and len(got) == 42
    for x, y in zip(got, want):
        assert x.stats.asDict() == pytest.approx(y.stats.asDict(), rel=1e-9, abs=1e-6)
        for p, q in zip(x.win, y.win):
            assert p.date == q.date and p[1:] == pytest.approx(q[1:], rel=1e-6, abs=1e-3)
