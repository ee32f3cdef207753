"""What large tables need: one deal by symbol, ranks in one pass over a group, paths that stay packed."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tests.conftest import days, rows

from barline.functions import groups as g
from barline.operators.features import TECH_FEATURES, technical_features
from workload.base import bars

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_and_windows_share_one_exchange(spark):
    assert plan(technical_features(bars(spark, SF))).count("Exchange hashpartitioning") == 1


def test_ranks_sort_no_rows_once_per_column(spark):
    text = plan(g.with_ranks(technical_features(bars(spark, SF)), ["date"], TECH_FEATURES, limit=None))
    assert text.count("RunningWindowFunction") + text.count("rank(") <= 1 and text.count("Sort [date") <= 1


@pytest.mark.parametrize("turns", [False, True])
def test_ranks_by_array_equal_ranks_by_window(spark, turns):
    rng = random.Random(3)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.0, 1e300]
    data = [(d, f"S{i}é"[: 2 + i % 5] + f"-{i}", rng.choice(odd), rng.choice([None, i % 3, 2**60 + i % 2])) for d in [*days(2), None] for i in range(200)]
    df = spark.createDataFrame(data, "date date, symbol string, a double, b long")
    fields = ["n", "below", "equal", *(["turn"] if turns else [])]
    pick = ["date", "symbol", *[F.col(f"{c}_rk.{f}").alias(f"{c}_{f}") for c in ("a", "b") for f in fields]]
    by_array = g._ranks_by_array(df, ["date"], ["a", "b"], "symbol", turns).select(*pick)
    by_window = g._ranks_by_window(df, ["date"], ["a", "b"], "symbol", turns).select(*pick)
    assert by_array.exceptAll(by_window).isEmpty() and by_window.exceptAll(by_array).isEmpty()


def test_packed_paths_need_one_exchange_and_give_what_long_ones_give(spark):
    from barline.operators import postprocess as post
    from barline.operators import scores as sc
    from workload import base, ranking

    drawn = base.paths(spark, SF).withColumn("values", F.array(*[F.col("value") * x for x in (1.0, 3.0, 2.0, 8.0)], F.lit(None)))
    long = drawn.withColumn("value", F.explode("values")).drop("values")
    cols = ["date", "symbol", "h", *[F.round(c, 6).alias(c) for c in ("value", "spread", "q10", "q50", "q90")]]
    whole, split = sc.sample_mean(drawn).select(*cols), sc.sample_mean(long).select(*cols)
    assert plan(sc.sample_mean(drawn)).count("Exchange") == 1
    assert whole.exceptAll(split).isEmpty() and split.exceptAll(whole).isEmpty()
    b = bars(spark, SF)
    packed = ranking.packed_bar_paths(spark, SF)
    for name, one, two in (
        ("limit", post.price_limit(packed), post.price_limit(ranking.bar_paths(spark, SF), b)),
        ("smooth", post.smooth_path(packed, b), post.smooth_path(ranking.bar_paths(spark, SF), b)),
    ):
        pick = ["date", "symbol", "h", *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")]]
        assert one.select(*pick).exceptAll(two.select(*pick)).isEmpty() and one.count() == two.count() > 0, name
    assert plan(post.price_limit(packed)).count("Exchange") == 1


@pytest.mark.parametrize("limit", [None, 4])
def test_ic_by_step_equals_rank_ic(spark, limit):
    from barline.operators.evaluate import ic_by_step, rank_ic

    rng = random.Random(9)
    pick = lambda: rng.choice([None, float("nan"), float("inf"), 0.0, 1.0, 2.0, rng.random()])
    data = [(d, f"S{i}", [pick() for _ in range(rng.choice([0, 2, 3]))], [pick() for _ in range(3)]) for d, n in zip(days(3), (2, 6, 9)) for i in range(n)]
    packed = spark.createDataFrame([*data, (days(1)[0], "T", None, None)], "date date, symbol string, pred array<double>, actual array<double>")
    steps = F.posexplode(F.arrays_zip("pred", "actual")).alias("i", "s")
    long = packed.select("date", "symbol", steps).select("date", "symbol", (F.col("i") + 1).alias("h"), "s.pred", "s.actual")
    want = rank_ic(long, "pred", "actual", ["date", "h"], limit=None)
    short = lambda df: rows(df.select("date", "h", "n", F.coalesce(F.round("rank_ic", 9), F.lit(9.0)).alias("ic")), "date", "h", "n", "ic")
    assert short(ic_by_step(packed, limit=limit)) == short(want)


def test_windows_are_scaled_as_arrays_and_keep_what_is_unknown(spark, bars_of):
    from barline.operators import windows

    ds = days(12)
    bad = [(d, 10.0 + i, 12.0, 9.0, 10.0 + i, None if i == 9 else 5.0 * i, 1.0) for i, d in enumerate(ds)]
    got = windows.normalised_windows(bars_of({"A": bad, "B": bad[:5]}), 6, 4, clip=1.0, at_once=2)
    assert "RunningWindowFunction" not in plan(got) and "collect_list" not in plan(got)
    found = sorted(got.collect(), key=lambda r: r.start_date)
    assert [(r.symbol, r.start_date) for r in found] == [("A", d) for d in ds[:7]]
    by_start = {r.start_date: r for r in found}
    last = by_start[ds[6]]  # the hole is among the bars that the statistics see
    assert last.stats.mean_volume is None and last.stats.std_volume is None and {b.volume for b in last.win} == {None}
    near = by_start[ds[4]]  # it is behind them
    assert near.stats.mean_volume == 27.5 and [b.volume is None for b in near.win] == [False] * 5 + [True]
    assert [b.date for b in near.win] == ds[4:10] and near.win[5].close == 1.0 and near.win[0].high == 0.0


def test_gradients_of_far_and_tied_scores_equal_all_pairs(spark):
    """Scores beyond what one exponential holds, labels tied across tiles, and no Python object per row."""
    import numpy as np

    from barline.operators.scores import rank_gradients

    rng = np.random.default_rng(4)
    n, (d,) = 90, days(1)
    for scale in (1.0, 400.0):
        score, label = rng.normal(size=n) * scale, rng.integers(0, 12, n).astype(float)
        df = spark.createDataFrame([(d, f"S{i:03d}", float(s), float(y)) for i, (s, y) in enumerate(zip(score, label))], "date date, symbol string, score double, label double")
        out = rank_gradients(df, 2.0, tile=20)
        assert "FlatMapGroupsInArrow" in plan(out) and "FlatMapGroupsInPandas" not in plan(out)
        got = {r.symbol: (r.grad, r.hess) for r in out.collect()}
        place = np.argsort(np.lexsort((np.arange(n), label)))
        dist = np.abs(place[:, None] - place[None, :]) * (label[:, None] > label[None, :])
        rho = 1 / (1 + np.exp(np.clip(2.0 * (score[:, None] - score[None, :]), -700, 700)))
        grad = 2.0 * (-(rho * dist).sum(1) + (rho * dist).sum(0))
        hess = np.maximum(4.0 * ((rho * (1 - rho) * dist).sum(1) + (rho * (1 - rho) * dist).sum(0)), 1e-6)
        for i in range(n):
            assert got[f"S{i:03d}"] == pytest.approx((grad[i], hess[i]), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("spread, labels", [(0.1, 0), (1.0, 40), (0.3, 2), (1e-9, 900), (300.0, 0)])
def test_pairs_of_a_date_are_met_in_blocks_only(monkeypatch, spread, labels):
    """All pairs count, with ties across blocks and far scores, but few are met one by one unless scores spread very far."""
    import numpy as np

    from barline.operators import pairs

    met, sums = [], pairs.strip_sums
    monkeypatch.setattr(pairs, "strip_sums", lambda up, down, *rest: (met.append(len(up) * len(down)), sums(up, down, *rest))[1])
    rng, n, sigma = np.random.default_rng(8), 2500, 10.0
    score = rng.normal(size=n) * spread
    label = np.sort(rng.integers(0, labels, n).astype(float) if labels else rng.normal(size=n))
    place = np.cumsum(rng.integers(1, 3, n))
    grad, hess = pairs.pair_sums(score, label, place, sigma, 8192)
    dist = np.abs(place[:, None] - place[None, :]) * (label[:, None] > label[None, :])
    x = np.clip(sigma * (score[:, None] - score[None, :]), -700, 700)
    rho, both = 1 / (1 + np.exp(x)), 1 / ((1 + np.exp(x)) * (1 + np.exp(-x)))
    up, down = (rho * dist).sum(1), (rho * dist).sum(0)
    assert np.abs(grad - sigma * (down - up)).max() < 1e-12 * sigma * (down + up).max()
    assert hess == pytest.approx(sigma**2 * ((both * dist).sum(1) + (both * dist).sum(0)), rel=1e-11, abs=1e-9)
    assert (sum(met) < n * n / 2) == (spread < 100)


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_deal_by_symbol_follows_the_lines(spark, monkeypatch):
    from workload import base

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = base.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(base, "LINES", lines // (n + 3))
    assert f", {-(-lines // base.LINES)})" in plan(bars(spark, SF)) and bars(spark, SF).count() == 2898
    monkeypatch.setattr(base, "LINES", lines)
    assert f", {n})" in plan(bars(spark, SF))


def test_the_market_orders_lines_of_outer_days_only(spark):
    from workload.base import _bar_columns, _lines, market

    assert "(l_shipdate" in optimized(market(spark, SF)) and "_from" in optimized(market(spark, SF))
    want = _lines(spark, SF).groupBy("date").agg(*_bar_columns()).select("date", "open", "high", "low", "close")
    got = market(spark, SF).select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_legs_drop_bars_before_they_are_dealt(spark):
    from barline.operators.portfolio import priced_legs

    asked = spark.createDataFrame([("S1", "open", *days(2))], "symbol string, leg string, num_date date, den_date date")
    text = optimized(priced_legs(bars(spark, SF), asked))
    assert text.count("RepartitionByExpression") == 2 and text.count("Join LeftSemi") == 2
    assert text.index("RepartitionByExpression") < text.index("Join LeftSemi")


def test_correlation_reads_returns_that_are_made_once(spark):
    from workload.catalog import QUERIES

    assert not [f for f in QUERIES["strategy_correlation"](spark, SF).inputFiles() if "lineitem" in f]


def test_documents_are_written_from_returns_that_are_made_once(spark, monkeypatch):
    from workload import returns

    read, write = [], returns.sinks.write_result_doc
    monkeypatch.setattr(returns.sinks, "write_result_doc", lambda ret, metrics, *rest: (read.extend([*ret.inputFiles(), *metrics.inputFiles()]), write(ret, metrics, *rest)))
    assert returns._docs(spark, SF).count() and read and not [f for f in read if "lineitem" in f]


def test_daily_figures_sort_by_date_only_and_agree_with_ranges(spark):
    from barline.operators import evaluate as ev

    rng = random.Random(5)
    data = [(d, f"S{i}é", rng.choice([None, float("nan"), 0.0, -0.0, 1.5, rng.random()]), rng.choice([None, float(i % 4), rng.random()])) for d in [*days(2), None] for i in range(120)]
    df = spark.createDataFrame(data, "date date, symbol string, score double, label double")
    for fn in (ev.ndcg_at_k, ev.per_day_metrics):
        few = fn(df, 5, limit=None)
        assert "Window" not in plan(few) and plan(few).count("Sort [") == 1
        near = lambda out: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in out.where("date is not null").collect())
        assert near(few) == near(fn(df, 5, limit=20)) and len(near(few)) == 2


def test_feature_diagnostics_deal_out_wide_rows_and_agree_with_long_ones(spark):
    """A row stays one row: no feature is exploded before the deal by date, and odd values count as they do one feature at a time."""
    from barline.operators import evaluate as ev

    rng = random.Random(6)
    odd = lambda: rng.choice([None, float("nan"), float("inf"), 0.0, -0.0, 1.5, rng.random(), rng.random()])
    data = [(d, f"S{i}é", odd(), odd(), float(i % 3), odd()) for d in [*days(3), None] for i in range(90)]
    df = spark.createDataFrame([*data, (days(4)[3], "S1", 1.0, 1.0, 1.0, 1.0)], "date date, symbol string, a double, b double, c double, label double")
    few = ev.feature_diagnostics(df, ["a", "b", "c"], 5, ["all"], limit=None)
    assert "Expand" not in plan(few) and "Generate explode(array(a" not in plan(few)
    long = df.unpivot(["date", "symbol", "label"], ["a", "b", "c"], "feature", "score")
    want = ev.aggregate_period(ev.per_day_metrics(long, 5, ["feature", "date"], limit=None), ["all"], ["feature"])
    near = lambda out: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in out.where("period is not null").collect())
    assert near(few) == near(want) == near(ev.feature_diagnostics(df, ["a", "b", "c"], 5, ["all"], limit=20)) and len(near(few)) == 3


def test_weeks_of_few_lines_need_no_look_at_the_bars(spark, monkeypatch):
    from workload import base

    assert base.limit_of_dates(spark, SF) is None
    monkeypatch.setattr(base, "GROUP_LIMIT", 3)
    assert base.limit_of_dates(spark, SF) == 3


def test_features_of_arrays_equal_those_of_windows(spark):
    """Holes, zeros and NaN, symbols shorter than a frame and cut by batches; and the labelled panel has no frame of many rows left."""
    from barline.operators.features import technical_arrays
    from workload.ranking import labelled

    rng = random.Random(2)
    odd = lambda: rng.choice([None, 0.0, float("nan"), 5.0, 5.0, *[rng.random() * 10 for _ in range(5)]])
    full = lambda: 1 + rng.random()
    data = [(s, d, *[(odd if s < "C" else full)() for _ in range(4)], None if i % 3 else 1.5) for s, n in (("A", 100), ("B", 30), ("C", 90), ("D", 1), ("E", 20)) for i, d in enumerate(days(n))]
    rng.shuffle(data)
    bars = spark.createDataFrame(data, "symbol string, date date, high double, low double, close double, volume double, label double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        near = lambda df: sorted(tuple(round(v, 9) + 0.0 if isinstance(v, float) else str(v) for v in r) for r in df.collect())
        got, want = (near(fn(bars, keep=["label"]).na.fill(-9.0)) for fn in (technical_arrays, technical_features))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == 241 and got == want
    assert technical_arrays(bars.where("false")).count() == 0
    text = plan(labelled(spark, SF, ranks=False))
    assert "MapInArrow" in text and "specifiedwindowframe(RowFrame, -59" not in text and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("limit", [None, 30])
def test_shares_equal_percent_ranks(spark, limit):
    rng = random.Random(4)
    odd = lambda: rng.choice([None, float("nan"), float("-inf"), 0.0, -0.0, 1.0, rng.random()])
    data = [(d, f"S{i}", odd(), i % 3) for d, n in zip(days(3), (80, 20, 1)) for i in range(n)] + [(days(4)[3], "S1", None, None)]
    df = spark.createDataFrame(data, "date date, symbol string, a double, b long")
    ranked = g.with_ranks(df, ["date"], ["a", "b"], limit=None)
    want = ranked.select("date", "symbol", *[F.round(g.percent_rank(c), 12).alias(c) for c in ("a", "b")], F.col("b_rk")["n"].alias("n"))
    found = g.with_shares(df, ["date"], ["a", "b"], limit=limit, sized=["b"])
    got = found.select("date", "symbol", *[F.round(f"{c}_share", 12).alias(c) for c in ("a", "b")], F.when(F.col("b").isNotNull(), F.col("b_n")).alias("n"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
