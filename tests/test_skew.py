"""The ways around large groups give the same rows as the ordinary ways."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tests.conftest import days

from barline.functions import groups as g
from barline.functions.timeline import along, carry
from barline.operators.features import TECH_FEATURES, technical_features
from barline.operators.scores import rank_gradients


@pytest.fixture(scope="module")
def cross(spark):
    """One date with most rows and a massive tie, one small date, and missing values."""
    rng = random.Random(7)
    d1, d2 = days(2)
    rows = []
    for i in range(3000):
        x = 0.0 if i % 3 == 0 else rng.gauss(0, 1)
        rows.append((d1, f"S{i:05d}"[: 3 + i % 4] + f"-{i}", x, None if i % 50 == 0 else float(i % 7)))
    rows += [(d2, f"T{i}", float(i % 4), float(i)) for i in range(20)]
    return spark.createDataFrame(rows, "date date, symbol string, a double, b double").cache()


@pytest.mark.parametrize("limit", [0, 100])
def test_ranks_by_range_equal_ranks_by_window(cross, limit):
    cols = ["a", "b"]
    pick = ["date", "symbol", *[F.col(f"{c}_rk.{f}").alias(f"{c}_{f}") for c in cols for f in ("n", "below", "equal", "turn")]]
    plain = g.with_ranks(cross, ["date"], cols, limit=None, turns=True).select(*pick)
    split = g.with_ranks(cross, ["date"], cols, limit=limit, turns=True).select(*pick)
    assert plain.count() == split.count() == cross.count()
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_ranks_match_pandas(cross):
    got = g.with_ranks(cross, ["date"], ["a"], limit=100).select("date", "symbol", "a", g.percent_rank("a").alias("p")).toPandas()
    want = got.groupby("date")["a"].rank(pct=True)
    assert abs(got["p"] - want).max() < 1e-12


def test_ranks_keep_longs_and_decimals_apart(spark):
    (d,) = days(1)
    big = 2**53
    rows = [(d, f"S{i}", big + i % 3, i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "date date, symbol string, a long, i int").withColumn("b", F.lit(big).cast("decimal(30,10)") + F.col("i") / F.lit(10**9).cast("decimal(20,0)"))
    pick = ["symbol", *[F.col(f"{c}_rk.{f}").alias(f"{c}_{f}") for c in ("a", "b") for f in ("n", "below", "equal", "turn")]]
    plain = g.with_ranks(df, ["date"], ["a", "b"], limit=None, turns=True).select(*pick)
    split = g.with_ranks(df, ["date"], ["a", "b"], limit=50, turns=True).select(*pick)
    assert plain.select("a_below").distinct().count() == plain.select("b_below").distinct().count() == 3
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_a_massive_tie_of_similar_keys_is_spread(spark):
    """Half of 200,000 rows share a value and the first bytes of their key: no window gets more than the limit."""
    n, limit = 200_000, 10_000
    df = spark.range(n).select(
        F.lit("2024-01-01").cast("date").alias("date"),
        F.format_string("SYMBOL%012d", F.col("id")).alias("symbol"),
        F.when(F.col("id") % 2 == 0, F.lit(1.0)).otherwise(F.col("id").cast("double")).alias("a"),
    )
    out = g.with_ranks(df, ["date"], ["a"], limit=limit, turns=True).select("symbol", "a", "a_rk.*")
    ties = out.where("a = 1.0")
    assert ties.agg(F.count(F.lit(1)), F.min("turn"), F.max("turn"), F.countDistinct("turn")).first()[:] == (n // 2 + 1, 1, n // 2 + 1, n // 2 + 1)
    assert ties.where("below <> 0 OR equal <> 100001").isEmpty()
    order = ties.select(F.corr("turn", F.substring("symbol", 7, 12).cast("double"))).first()[0]
    assert order > 0.999999
    text = out._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in text
    rest = out.where("a <> 1.0").agg(F.min("below"), F.max("below"), F.countDistinct("below")).first()
    assert rest[:] == (n // 2 + 1, n - 1, n // 2 - 1)


def test_sizes_are_looked_at_once(cross):
    hot = g.hot_groups(cross, ["date"], 100)
    one = g.with_ranks(cross, ["date"], ["a"], limit=100, hot=hot).select("date", "symbol", "a_rk.below")
    two = g.with_ranks(cross, ["date"], ["a"], limit=100).select("date", "symbol", "a_rk.below")
    assert one.exceptAll(two).isEmpty() and hot.collect()[0]["_rows"] == 3000
    assert g.hot_groups(cross, ["date"], 10**6) is None


def _ticks(spark, n=4000):
    rng = random.Random(3)
    rows = []
    for s in ("HOT", "COLD"):
        for i in range(n if s == "HOT" else 50):
            p = 100 + rng.random()
            v = None if rng.random() < 0.3 else float(rng.randrange(100))
            rows.append((s, i * 97, p, p + 1, p - 1, p + 0.5, v))
    df = spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, volume double")
    stamp = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t")).cast(T.TimestampNTZType())
    return df.withColumns({"date": stamp, "amount": F.lit(1.0)}).drop("t")


def test_features_in_blocks_equal_features_in_one_window(spark):
    bars = _ticks(spark).na.fill(1.0)
    plain = technical_features(bars, limit=None)
    blocks = technical_features(bars, limit=200)
    joined = plain.alias("p").join(blocks.alias("b"), ["symbol", "date"])
    assert joined.count() == bars.count() == blocks.count()
    worst = joined.agg(*[F.max(F.abs(F.col(f"p.{c}") - F.col(f"b.{c}"))).alias(c) for c in TECH_FEATURES]).first()
    assert max(worst) < 1e-9


def test_blocks_look_ahead_too(spark):
    bars = _ticks(spark)
    step = lambda df, w: df.withColumn("x", F.lead("open", 3).over(w))
    a = along(bars, step, back=0, ahead=3, limit=None).select("symbol", "date", "x")
    b = along(bars, step, back=0, ahead=3, limit=100).select("symbol", "date", "x")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_carry_across_days(spark):
    from pyspark.sql import Window

    bars = _ticks(spark)
    w = Window.partitionBy("symbol").orderBy("date")
    want = bars.withColumn("volume", F.last("volume", True).over(w)).select("symbol", "date", "volume")
    got = carry(bars, ["volume"]).select("symbol", "date", "volume")
    assert want.exceptAll(got).isEmpty() and got.count() == bars.count()


def test_gradients_do_not_depend_on_the_tile(spark):
    rng = random.Random(5)
    (d,) = days(1)
    rows = [(d, f"S{i}", rng.gauss(0, 1), float(rng.randrange(30))) for i in range(150)]
    df = spark.createDataFrame(rows, "date date, symbol string, score double, label double")
    one = rank_gradients(df, tile=1000).toPandas().set_index("symbol").sort_index()
    many = rank_gradients(df, tile=40, limit=10).toPandas().set_index("symbol").sort_index()
    assert len(one) == len(many) == 150
    assert abs(one["grad"] - many["grad"]).max() < 1e-9 and abs(one["hess"] - many["hess"]).max() < 1e-9


def test_range_join_equals_nested_loop(spark):
    ds = days(60)
    left = spark.createDataFrame([(d, i) for i, d in enumerate(ds)], "date date, i int")
    right = spark.createDataFrame([(ds[3], ds[20], "a"), (ds[10], ds[10], "b"), (ds[0], ds[59], "c")], "lo date, hi date, name string")
    got = g.range_join(left, right, "date", "lo", "hi", 7).select("i", "name")
    want = left.join(right, F.col("date").between(F.col("lo"), F.col("hi"))).select("i", "name")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
