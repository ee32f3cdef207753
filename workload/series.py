"""Windows, features and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.operators import features as feat
from barline.operators import labels as lab
from barline.operators import windows as win
from barline.operators.calendar import schedule
from barline.sources.bars import symbol_stats
from workload.base import (
    FEATURE_SQL,
    W,
    bars,
    calendar,
    cte,
    holes,
    hourly,
    market,
    paths,
    query,
    r6,
    rounded,
    sql,
    table,
    wide_deal,
)
from workload.tables import NOT_NULL, traded

# rebalance dates: two days after every 8th week, so no bar falls on them
cte("rebal", "SELECT date + 2 AS date FROM numbered WHERE idx % 8 = 0 AND next_date IS NOT NULL")


def rebal(spark, sf):
    return schedule(calendar(spark, sf), [8]).select(F.date_add("signal_date", 2).alias("date"))


# bars with holes for one symbol of ten, whole ones for the rest: both outcomes occur with 90 bars
cte("some_holes", "SELECT * FROM holes WHERE symbol LIKE '%7' UNION ALL BY NAME SELECT * FROM bars WHERE symbol NOT LIKE '%7'")


def some_holes(spark, sf):
    seven = F.col("symbol").endswith("7")
    return holes(spark, sf).where(seven).unionByName(bars(spark, sf).where(~seven), allowMissingColumns=True)


cte(
    "context_rows",
    f"""SELECT r.date AS rebal_date, b.*, row_number() OVER (PARTITION BY r.date, symbol ORDER BY b.date DESC) AS back
  FROM some_holes b JOIN rebal r ON b.date BETWEEN r.date - 810 AND r.date""",
)
cte(
    "contexts",
    f"""SELECT * FROM (SELECT *, 91 - back AS pos, count(*) FILTER ({NOT_NULL}) OVER (PARTITION BY rebal_date, symbol) AS whole
  FROM context_rows WHERE back <= 90) WHERE whole = 90""",
)


@query(
    "contexts",
    sql("SELECT rebal_date, symbol, count(*) AS n, min(date) AS first_date, round(sum(close * pos) / 4095, 6) AS weighted FROM contexts GROUP BY rebal_date, symbol"),
)
def _(spark, sf):
    rows = win.contexts(some_holes(spark, sf), rebal(spark, sf), lookback=90, recency_factor=9)
    return rounded(
        rows.groupBy("rebal_date", "symbol").agg(
            F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), (F.sum(F.col("close") * F.col("pos")) / 4095).alias("weighted")
        )
    )


def _ahead(n: int) -> str:
    return f"OVER ({W} ROWS BETWEEN CURRENT ROW AND {n} FOLLOWING)"


def _lead(c: str, n: int) -> str:
    return f"lead({c}, {n}) OVER ({W})"


@query(
    "sliding_windows",
    sql(
        f"""SELECT symbol, start_date, round(first_close, 6) AS first_close, round(last_close, 6) AS last_close, round(volume, 6) AS volume FROM
  (SELECT symbol, date AS start_date, close AS first_close, {_lead('close', 99)} AS last_close, sum(volume) {_ahead(99)} AS volume,
   count(*) {_ahead(99)} AS n FROM bars) WHERE n = 100"""
    ),
)
def _(spark, sf):
    w = win.sliding_windows(bars(spark, sf), 100)
    total = F.aggregate("win", F.lit(0.0), lambda a, b: a + b["volume"])
    at = lambda i: F.get("win", F.lit(i))["close"]
    return rounded(w.select("symbol", "start_date", at(0).alias("first_close"), at(99).alias("last_close"), total.alias("volume")))


@query(
    "inference_windows",
    sql(
        f"""SELECT symbol, date, round(x_close, 6) AS x_close, round(y_close, 6) AS y_close FROM (SELECT symbol, {_lead('date', 89)} AS date,
  sum(close) {_ahead(89)} AS x_close, sum(close) OVER ({W} ROWS BETWEEN 90 FOLLOWING AND 99 FOLLOWING) AS y_close, count(*) {_ahead(99)} AS n FROM bars) WHERE n = 100"""
    ),
)
def _(spark, sf):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b["close"])
    w = win.inference_windows(bars(spark, sf), 90, 10)
    return rounded(w.select("symbol", "date", total("x").alias("x_close"), total("y").alias("y_close")))


def _norm(c: str, k: int) -> str:
    x = c if k == 0 else _lead(c, k)
    return f"least(greatest(({x} - avg({c}) {_ahead(89)}) / (stddev_pop({c}) {_ahead(89)} + 0.00001::DOUBLE), -2.0), 2.0)"


@query(
    "normalise_window",
    sql(
        "SELECT symbol, start_date, "
        + r6("c0", "c7", "c10", "v10", "std_close / mean_close AS spread")
        + f""" FROM (SELECT symbol, date AS start_date, {_norm('close', 0)} AS c0, {_norm('close', 89)} AS c7, {_norm('close', 99)} AS c10,
  {_norm('volume', 99)} AS v10, avg(close) {_ahead(89)} AS mean_close, stddev_pop(close) {_ahead(89)} AS std_close, count(*) {_ahead(99)} AS n FROM bars) WHERE n = 100"""
    ),
)
def _(spark, sf):
    w = win.normalised_windows(bars(spark, sf), 100, 90, clip=2.0)
    at = lambda i, c: F.get("win", F.lit(i))[c]
    return rounded(
        w.select(
            "symbol",
            "start_date",
            at(0, "close").alias("c0"),
            at(89, "close").alias("c7"),
            at(99, "close").alias("c10"),
            at(99, "volume").alias("v10"),
            (F.col("stats.std_close") / F.col("stats.mean_close")).alias("spread"),
        )
    )


@query(
    "denormalise",
    sql("SELECT date, symbol, round(sum(value * h) / 7.3::DOUBLE, 3) AS weighted FROM paths GROUP BY date, symbol"),
)
def _(spark, sf):
    last10 = Window.partitionBy("symbol").orderBy("date").rowsBetween(-9, 0)
    stats = bars(spark, sf).select("date", "symbol", F.avg("close").over(last10).alias("mean"), F.stddev_pop("close").over(last10).alias("std"))
    scaled = paths(spark, sf).join(stats, ["date", "symbol"]).select(
        "date", "symbol", "h", ((F.col("value") - F.col("mean")) / (F.col("std") + F.lit(1e-5))).alias("value")
    )
    back = win.denormalise(scaled, stats)
    return rounded(back.groupBy("date", "symbol").agg((F.sum(F.col("value") * F.col("h")) / 7.3).alias("weighted")), 3)


@query(
    "time_stamps",
    sql(
        """SELECT symbol, date, extract(minute FROM date) AS minute, extract(hour FROM date) AS hour, isodow(date) - 1 AS weekday,
  extract(day FROM date) AS day, extract(month FROM date) AS month FROM hourly UNION ALL
  SELECT symbol, CAST(date AS TIMESTAMP), 0, 9, isodow(date) - 1, extract(day FROM date), extract(month FROM date) FROM bars"""
    ),
)
def _(spark, sf):
    cols = ["symbol", "date", "minute", "hour", "weekday", "day", "month"]
    daily = win.time_stamps(bars(spark, sf)).withColumn("date", F.col("date").cast("timestamp_ntz"))
    return rounded(win.time_stamps(hourly(spark, sf), daily=False).select(*cols).unionByName(daily.select(*cols)))


SPLITS = {"train": ("1995-01-01", "1999-06-30"), "val": ("1999-03-01", "2000-06-30"), "test": ("2000-03-01", "2001-12-31")}


@query(
    "split_by_dates",
    sql(
        " UNION ALL ".join(
            f"SELECT symbol, '{n}' AS split, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM bars WHERE date BETWEEN '{a}' AND '{b}' GROUP BY symbol"
            for n, (a, b) in SPLITS.items()
        )
    ),
)
def _(spark, sf):
    return rounded(
        win.split_by_dates(bars(spark, sf), SPLITS)
        .groupBy("symbol", "split")
        .agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    )


@query(
    "split_by_ratio",
    sql(
        f"""SELECT symbol, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split,
  count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM
  (SELECT symbol, date, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars) GROUP BY ALL"""
    ),
)
def _(spark, sf):
    return rounded(
        win.split_by_ratio(bars(spark, sf))
        .groupBy("symbol", "split")
        .agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    )


@query(
    "epoch_order",
    sql(
        f"""SELECT symbol, idx, (idx * 9973 + 3 * 104729) % n_windows AS start FROM
  (SELECT symbol, row_number() OVER ({W}) - 1 AS idx, count(*) OVER (PARTITION BY symbol) - 10 AS n_windows FROM bars) WHERE idx < n_windows"""
    ),
)
def _(spark, sf):
    w = Window.partitionBy("symbol").orderBy("date")
    sizes = symbol_stats(bars(spark, sf)).select("symbol", (F.col("n_bars") - 10).alias("n_windows"))
    rows = bars(spark, sf).select("symbol", (F.row_number().over(w) - 1).alias("idx")).join(sizes, "symbol").where("idx < n_windows")
    return rounded(win.epoch_order(rows, 2).select("symbol", "idx", "start"))


@query(
    "resolve_lookback",
    sql(
        """SELECT symbol, n AS n_bars, greatest(100, least(look, 400)) AS lookback, greatest(20, least(want, n - look, 120)) AS pred_len FROM
  (SELECT *, least(want * 3, CAST(floor(n * 0.7::DOUBLE) AS BIGINT), n - want) AS look FROM
   (SELECT symbol, count(*) AS n, CAST(floor(360.0::DOUBLE * coalesce(count(*)::DOUBLE / nullif(max(date) - min(date), 0), 0.7)) AS BIGINT) AS want FROM bars GROUP BY symbol))"""
    ),
)
def _(spark, sf):
    return rounded(win.resolve_lookback(bars(spark, sf), target_days=360))


# ---- features -------------------------------------------------------------------------------

SINGLE = {
    "ma_dist": (["feat_ma5_dist", "feat_ma20_dist", "feat_ma60_dist"], lambda b: feat.ma_dist(feat.ma_dist(feat.ma_dist(b, 5), 20), 60)),
    "momentum": (
        ["feat_momentum_3", "feat_momentum_60"],
        lambda b: feat.momentum(feat.momentum(b, 3), 60),
    ),
    "volatility": (["feat_vol_10", "feat_vol_30"], lambda b: feat.volatility(feat.volatility(b, 10), 30)),
    "volume_ratio": (["feat_volume_ratio"], feat.volume_ratio),
    "volume_trend": (["feat_volume_trend"], feat.volume_trend),
    "hl_spread": (["feat_hl_spread_5"], feat.hl_spread),
}


def _single(names, fn):
    return lambda spark, sf: rounded(fn(bars(spark, sf)).select("symbol", "date", *names))


for _name, (_cols, _fn) in SINGLE.items():
    query(_name, sql(f"SELECT symbol, date, {r6(*_cols)} FROM features"))(_single(_cols, _fn))


@query("technical_features", sql(f"SELECT symbol, date, {r6(*FEATURE_SQL)} FROM features"))
def _(spark, sf):
    return rounded(feat.technical_features(bars(spark, sf)))


def rank_sql(c: str, by: str = "date") -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE) / count({c}) OVER (PARTITION BY {by})"


ALL_RANKS = ", ".join(f"round({rank_sql(c)}, 6) AS {c}_cs_rank" for c in FEATURE_SQL)


@query("cs_rank", sql(f"SELECT date, symbol, {ALL_RANKS} FROM features"))
def _(spark, sf):
    ranked = feat.cs_rank(feat.technical_features(bars(spark, sf)), feat.TECH_FEATURES)
    return rounded(ranked.select("date", "symbol", *[f"{c}_cs_rank" for c in feat.TECH_FEATURES]))


# keys: every 4th week's bars, and for each of them a key two days later that has no bar
cte(
    "keys",
    """SELECT b.date, symbol FROM bars b JOIN numbered n ON b.date = n.date WHERE idx % 4 = 0 AND next_date IS NOT NULL
  UNION ALL SELECT b.date + 2, symbol FROM bars b JOIN numbered n ON b.date = n.date WHERE idx % 4 = 0 AND next_date IS NOT NULL""",
)
cte("keyed", "SELECT f.* FROM features f JOIN keys k ON f.date = k.date AND f.symbol = k.symbol")


def _keys(spark, sf):
    at = schedule(calendar(spark, sf), [4])
    on = at.select(F.col("signal_date").alias("date"))
    own = bars(spark, sf).select("date", "symbol").join(F.broadcast(on), "date", "left_semi")
    return own.withColumn("date", F.explode(F.array("date", F.date_add("date", 2))))


@query(
    "features_at",
    sql(
        f"SELECT date, symbol, {r6(*feat.TECH_FEATURES)}, "
        + ", ".join(f"round({rank_sql(c)}, 6) AS {c}{feat.RANK_SUFFIX}" for c in feat.TECH_FEATURES)
        + " FROM keyed"
    ),
)
def _(spark, sf):
    return rounded(feat.features_at(bars(spark, sf), _keys(spark, sf), strict=False, parts=wide_deal(spark, sf)))


cte("enriched", "SELECT k.date, k.symbol, f.* EXCLUDE (date, symbol) FROM keys k JOIN features f ON f.date = k.date AND f.symbol = k.symbol WHERE k.date IN (SELECT date FROM traded)")


@query(
    "enrich",
    sql(
        f"SELECT date, symbol, 1.0::DOUBLE AS label, {r6(*FEATURE_SQL)}, "
        + ", ".join(f"round({rank_sql(c)}, 6) AS {c}_cs_rank" for c in FEATURE_SQL)
        + " FROM enriched"
    ),
)
def _(spark, sf):
    panel = _keys(spark, sf).withColumns({"label": F.lit(1.0), "feat_stale": F.lit(0.0)})
    return rounded(feat.enrich(panel, bars(spark, sf), traded(spark, sf), parts=wide_deal(spark, sf)))


@query("without_bar", sql("SELECT k.date, count(*) AS n_dropped FROM keys k ANTI JOIN bars b ON k.date = b.date AND k.symbol = b.symbol GROUP BY k.date"))
def _(spark, sf):
    return rounded(feat.without_bar(_keys(spark, sf), bars(spark, sf)))


@query(
    "feature_columns",
    sql(
        f"SELECT symbol, date, {r6(*FEATURE_SQL)}, "
        + ", ".join(f"round({rank_sql(c)}, 6) AS {c}_cs_rank" for c in ("feat_vol_10", "feat_ma5_dist"))
        + " FROM features"
    ),
)
def _(spark, sf):
    panel = feat.cs_rank(feat.technical_features(bars(spark, sf)), ["feat_vol_10", "feat_ma5_dist"])
    return rounded(panel.select("symbol", "date", *feat.feature_columns(panel.columns, "raw")))


def _full(expr: str, c: str, n: int) -> str:
    f = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {f} = {n} THEN avg({c}) {f} END"


cte(
    "trend_rows",
    f"""SELECT symbol, date, close, {_full('avg', 'close', 5)} AS ma5, {_full('avg', 'close', 20)} AS ma20, {_full('avg', 'close', 60)} AS ma60,
  {_full('avg', 'volume', 5)} AS vol_ma5, lag(close) OVER ({W}) AS prev, lag(close, 19) OVER ({W}) AS close19,
  avg(volume) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v5, avg(volume) OVER ({W} ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS v10,
  lead(date) OVER ({W}) AS nxt FROM all_bars""",
)
cte("trend_lag", f"SELECT *, lag(ma5, 19) OVER ({W}) AS ma19 FROM trend_rows")
cte(
    "trends",
    """SELECT symbol, date, close, ma5, ma20, ma60, vol_ma5, (close / nullif(prev, 0) - 1) * 100 AS change_pct,
  CASE WHEN close19 IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, ((ma5 / nullif(ma19, 0) - 1) * 0.4::DOUBLE + (close / nullif(close19, 0) - 1) * 0.4::DOUBLE
    + least(v5 / nullif(v10, 0) - 1, 0.2::DOUBLE) * 0.2::DOUBLE) * 10)) END AS strength FROM trend_lag WHERE nxt IS NULL""",
)
cte("trend_flags", "SELECT *, coalesce(ma5 > ma20 AND ma20 > ma60 AND close > ma20 AND strength > 0.6, false) AS uptrend FROM trends")


@query("index_trend", sql(f"SELECT symbol, date, {r6('close', 'ma5', 'ma20', 'ma60', 'vol_ma5', 'change_pct', 'strength')}, uptrend FROM trend_flags"))
def _(spark, sf):
    return rounded(feat.index_trend(bars(spark, sf).unionByName(market(spark, sf))))


@query(
    "market_trend",
    sql(
        """SELECT count(*) AS n_index, count(*) FILTER (uptrend) AS n_uptrend, round(avg(strength), 6) AS strength,
  count(*) FILTER (uptrend) * 2 >= count(*) AS uptrend FROM trend_flags"""
    ),
)
def _(spark, sf):
    return rounded(feat.market_trend(feat.index_trend(bars(spark, sf).unionByName(market(spark, sf)))))


cte(
    "slopes",
    """SELECT symbol, CASE WHEN count(*) < 2 THEN 0 ELSE greatest(-0.1, least(0.1, coalesce(regr_slope(close, -r) * count(*) / nullif(max(close) - min(close), 0), 0))) END AS trend
  FROM (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM bars) WHERE r <= 20 GROUP BY symbol""",
)


@query("slope_trend", sql("SELECT symbol, round(trend, 6) AS trend FROM slopes"))
def _(spark, sf):
    return rounded(feat.slope_trend(bars(spark, sf)))


@query(
    "mean_pool",
    sql(
        """SELECT label, pos, round(avg(x), 6) AS value FROM
  (SELECT label, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, pos"""
    ),
)
def _(spark, sf):
    pooled = feat.mean_pool(table(spark, sf, "embeddings"), ["label"])
    return rounded(pooled.select("label", F.posexplode("pooled").alias("pos", "value")))


@query(
    "concat_pools",
    sql(
        """SELECT label, pos, round(avg(x), 6) AS value FROM
  (SELECT label, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings UNION ALL
   SELECT label, unnest(range(64, 128)) AS pos, CAST(unnest(embedding) AS DOUBLE) * CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, pos"""
    ),
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    squares = e.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * x.cast("double")))
    both = feat.concat_pools([feat.mean_pool(e, ["label"]), feat.mean_pool(squares, ["label"])], ["label"])
    return rounded(both.select("label", F.posexplode("pooled").alias("pos", "value")))


def code_sql(start: int, bits: int) -> str:
    return "(" + " + ".join(f"CASE WHEN embedding[{start + i}] > 0 THEN {2**i} ELSE 0 END" for i in range(bits)) + ")"


cte("sign_codes", f"SELECT vec_id, embedding, CAST({code_sql(1, 10)} AS BIGINT) AS s1, CAST({code_sql(11, 10)} AS BIGINT) AS s2 FROM embeddings")


@query("sign_code", sql("SELECT vec_id, s1, s2 FROM sign_codes"))
def _(spark, sf):
    return feat.sign_code(table(spark, sf, "embeddings"), 10, 10).select("vec_id", "s1", "s2")


# ---- labels ---------------------------------------------------------------------------------


@query("forward_open_return", sql("SELECT symbol, date, round(label, 6) AS label FROM labels5"))
def _(spark, sf):
    return rounded(lab.forward_open_return(bars(spark, sf), 5).select("symbol", "date", "label"))


# reference dates three days after each bar, and one before the first bar of each symbol
cte("refs", "SELECT symbol, date + 3 AS date FROM bars UNION SELECT symbol, min(date) - 30 FROM bars GROUP BY symbol")
cte(
    "first_after",
    """SELECT r.symbol, r.date, min(b.date) AS first_date FROM refs r JOIN bars b ON r.symbol = b.symbol AND b.date > r.date GROUP BY r.symbol, r.date""",
)


def _refs(spark, sf):
    b = bars(spark, sf).select("symbol", "date")
    before = b.groupBy("symbol").agg(F.date_sub(F.min("date"), 30).alias("date"))
    return b.select("symbol", F.date_add("date", 3).alias("date")).unionByName(before)


@query(
    "forward_open_return_at",
    sql(
        f"""SELECT a.symbol, a.date, round(label, 6) AS label FROM first_after a JOIN
  (SELECT symbol, date, lead(open, 3) OVER ({W}) / nullif(open, 0) - 1 AS label FROM bars) l ON a.symbol = l.symbol AND a.first_date = l.date WHERE label IS NOT NULL"""
    ),
)
def _(spark, sf):
    return rounded(lab.forward_open_return_at(bars(spark, sf), _refs(spark, sf), 3))


def _h_label(h: int) -> str:
    return f"lead(open, {h + 1}) OVER ({W}) / nullif(lead(open, 1) OVER ({W}), 0) - 1"


@query(
    "composite_label",
    sql(
        f"""SELECT symbol, date, round(coalesce(0.5 * h1 + 0.3 * h3 + 0.2 * h5, h1), 6) AS label FROM
  (SELECT symbol, date, {_h_label(1)} AS h1, {_h_label(3)} AS h3, {_h_label(5)} AS h5 FROM bars)"""
    ),
)
def _(spark, sf):
    rows = bars(spark, sf)
    for h in (1, 3, 5):
        rows = lab.forward_open_return(rows, h, f"label_h{h}")
    return rounded(lab.composite_label(rows.withColumn("label", F.col("label_h1"))).select("symbol", "date", "label"))


cte("placed", "SELECT b.symbol, b.open, n.idx, n.prev_date FROM bars b JOIN numbered n ON b.date = n.date")
cte(
    "grid_returns",
    """SELECT a.symbol, a.prev_date AS date, a.idx - 1 AS idx, z.open / nullif(a.open, 0) - 1 AS ret FROM placed a JOIN placed z
  ON a.symbol = z.symbol AND z.idx = a.idx + 5 WHERE a.prev_date IS NOT NULL""",
)


@query("calendar_forward_return", sql("SELECT symbol, date, round(ret, 6) AS ret FROM grid_returns WHERE ret IS NOT NULL"))
def _(spark, sf):
    return rounded(lab.calendar_forward_return(bars(spark, sf), calendar(spark, sf), 5).select("symbol", "date", "ret"))


@query(
    "own_path",
    sql(
        f"""SELECT symbol, date, n, round(weighted, 4) AS weighted FROM
  (SELECT symbol, date, count(*) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS n, lead(close, 1) OVER ({W}) + coalesce(2 * lead(close, 2) OVER ({W}), 0)
    + coalesce(3 * lead(close, 3) OVER ({W}), 0) + coalesce(4 * lead(close, 4) OVER ({W}), 0) AS weighted FROM bars) WHERE n > 0"""
    ),
)
def _(spark, sf):
    rows = lab.own_path(bars(spark, sf), 4)
    return rounded(
        rows.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.col("h")).alias("weighted")), 4
    )


@query(
    "actual_path",
    sql(
        f"""SELECT a.symbol, a.date, n, round(weighted, 4) AS weighted FROM first_after a JOIN
  (SELECT symbol, date, count(*) {_ahead(3)} AS n, close + coalesce(2 * lead(close, 1) OVER ({W}), 0) + coalesce(3 * lead(close, 2) OVER ({W}), 0)
    + coalesce(4 * lead(close, 3) OVER ({W}), 0) AS weighted FROM bars) l ON a.symbol = l.symbol AND a.first_date = l.date"""
    ),
)
def _(spark, sf):
    rows = lab.actual_path(bars(spark, sf), _refs(spark, sf), 4)
    return rounded(
        rows.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.col("h")).alias("weighted")), 4
    )
