"""Sources, cleaning and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.operators import calendar as cal_ops
from barline.operators import clean
from barline.operators import features as feat
from barline.operators import labels as lab
from barline.sources import bars as src
from barline.sources import parsing, sinks
from workload.base import (
    BENCHMARK,
    FIELDS,
    SK,
    all_bars,
    bars,
    calendar,
    cte,
    holes,
    hourly,
    market,
    query,
    r6,
    rounded,
    scratch,
    sql,
    table,
)

BAR6 = "symbol, date, " + r6(*FIELDS)
HOLES_BAR = "symbol, date, " + ", ".join(FIELDS)


@query("read_bars", sql(f"SELECT {BAR6} FROM bars WHERE symbol = 'S1' AND date BETWEEN '1996-01-01' AND '1998-12-31'"))
def _(spark, sf):
    return rounded(src.read_bars(spark, bars(spark, sf), "S1", "1996-01-01", "1998-12-31"))


@query(
    "read_window",
    sql(f"SELECT {BAR6} FROM bars WHERE symbol IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_nationkey < 12) AND date >= '1997-06-01'"),
)
def _(spark, sf):
    local = table(spark, sf, "supplier").where("s_nationkey < 12").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"))
    return rounded(src.read_window(bars(spark, sf), local, "1997-06-01"))


@query("symbol_stats", sql("SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS n_bars FROM bars GROUP BY symbol"))
def _(spark, sf):
    return rounded(src.symbol_stats(bars(spark, sf)))


cte("late_bars", "SELECT * FROM bars WHERE date >= '2001-01-01'")
cte(
    "bar_updates",
    """SELECT symbol, date, open, high, low, close * 1.01::DOUBLE AS close, volume, amount, 1 AS seq FROM late_bars
  UNION ALL SELECT symbol, date, open, high, low, close * 1.02::DOUBLE, volume + 1, amount, 2 FROM late_bars
  UNION ALL SELECT symbol, date, open, high, low, close, volume, amount, 1 FROM market""",
)


def _updates(spark, sf):
    late = bars(spark, sf).where("date >= '2001-01-01'")
    return (
        late.withColumns({"close": F.col("close") * F.lit(1.01), "seq": F.lit(1)})
        .unionByName(late.withColumns({"close": F.col("close") * F.lit(1.02), "volume": F.col("volume") + 1, "seq": F.lit(2)}))
        .unionByName(market(spark, sf).withColumn("seq", F.lit(1)))
    )


UPSERTED = sql(
    f"""SELECT {BAR6} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) AS rn
  FROM (SELECT *, 0 AS seq FROM bars UNION ALL SELECT * FROM bar_updates)) WHERE rn = 1"""
)


@query("upsert_bars", UPSERTED)
def _(spark, sf):
    return rounded(src.upsert_bars(bars(spark, sf), _updates(spark, sf)))


@query("merge_panel", UPSERTED)
def _(spark, sf):
    path = scratch(spark)
    sinks.write_panel(bars(spark, sf), f"{path}/panel")
    sinks.merge_panel(_updates(spark, sf), f"{path}/panel", f"{path}/merge")
    return rounded(src.open_panel(spark, f"{path}/panel").drop("year"))


@query(
    "incremental_slice",
    sql(
        f"""SELECT b.{BAR6.replace('symbol, date', 'symbol, b.date')} FROM bars b LEFT JOIN
  (SELECT symbol, max(date) AS last_date FROM bars WHERE date < '2000-06-01' AND {SK} % 3 <> 0 GROUP BY symbol) s ON b.symbol = s.symbol
  WHERE b.date >= coalesce(last_date, DATE '1999-01-01')"""
    ),
)
def _(spark, sf):
    stored = bars(spark, sf).where(f"date < '2000-06-01' and {SK} % 3 <> 0")
    return rounded(src.incremental_slice(bars(spark, sf), src.symbol_stats(stored), "1999-01-01"))


@query(
    "source_fallback",
    sql(f"SELECT {BAR6}, CASE WHEN {SK} % 3 = 0 THEN 1 WHEN {SK} % 2 = 0 THEN 2 ELSE 3 END AS source FROM bars"),
)
def _(spark, sf):
    b = bars(spark, sf)
    return rounded(src.source_fallback([(1, b.where(f"{SK} % 3 = 0")), (2, b.where(f"{SK} % 2 = 0")), (3, b)]))


@query("parse_exchange_rows", sql(f"SELECT {BAR6} FROM bars WHERE {SK} % 10 <> 0"))
def _(spark, sf):
    era = F.concat_ws("/", (F.year("date") - 1911).cast("string"), F.date_format("date", "MM"), F.date_format("date", "dd"))
    text = [F.col(c).cast("string") for c in ("amount", "open", "high", "low", "close")]
    broken = F.expr(f"{SK} % 10 = 0")
    text[1] = F.when(broken, F.lit("--")).otherwise(text[1])
    raw = bars(spark, sf).select("symbol", F.array(era, F.format_number("volume", 0), *text).alias("row"))
    return rounded(parsing.parse_exchange_rows(raw).select("symbol", "date", *FIELDS))


@query(
    "dedupe_bars",
    sql(f"SELECT {BAR6} FROM bars WHERE date BETWEEN '1996-01-01' AND '2000-12-31'"),
)
def _(spark, sf):
    b = bars(spark, sf)
    pages = b.withColumn("page", F.lit(1)).unionByName(b.where("month(date) % 2 = 0").withColumns({"close": F.col("close") + 1, "page": F.lit(2)}))
    return rounded(src.dedupe_bars(pages, "1996-01-01", "2000-12-31"))


@query(
    "parse_packed_bars",
    sql(
        f"""SELECT symbol, date, {r6('open', 'close', 'high', 'low', 'volume')},
  round(CASE WHEN {SK} % 2 = 0 THEN amount ELSE 0 END, 6) AS amount, 0.0::DOUBLE AS turnover FROM bars"""
    ),
)
def _(spark, sf):
    core = F.concat_ws(",", F.col("date").cast("string"), *[F.col(c).cast("string") for c in ("open", "close", "high", "low", "volume")])
    line = F.when(F.expr(f"{SK} % 2 = 0"), F.concat_ws(",", core, F.col("amount").cast("string"))).otherwise(core)
    packed = bars(spark, sf).groupBy("symbol").agg(F.to_json(F.struct(F.struct(F.collect_list(line).alias("klines")).alias("data"))).alias("j"))
    payload = F.when(F.expr(f"{SK} % 3 = 0"), F.concat(F.lit("/**/cb("), F.col("j"), F.lit(");"))).otherwise(F.col("j"))
    out = parsing.parse_packed_bars(packed.select("symbol", payload.alias("payload")))
    return rounded(out.select("symbol", "date", "open", "close", "high", "low", "volume", "amount", "turnover"))


@query("rename_aliases", sql(f"SELECT {BAR6} FROM bars"))
def _(spark, sf):
    named = {"date": "日期", "open": "开盘价", "high": "最高", "low": "min", "close": "收盘", "volume": "成交量", "amount": "Trading_money"}
    return rounded(parsing.rename_aliases(bars(spark, sf).withColumnsRenamed(named)))


@query(
    "load_bar_file",
    sql(f"SELECT symbol, CAST(date AS TIMESTAMP) AS timestamps, {r6(*FIELDS)} FROM bars WHERE {SK} % 10 <> 0"),
)
def _(spark, sf):
    path = scratch(spark) + "/bars"
    text = bars(spark, sf).withColumn("close", F.when(F.expr(f"{SK} % 10 = 0"), F.lit("n/a")).otherwise(F.col("close").cast("string")))
    text.write.mode("overwrite").option("header", True).csv(path)
    return rounded(parsing.load_bar_file(spark, path).select("symbol", "timestamps", *FIELDS))


@query(
    "describe_bars",
    sql(
        """SELECT h.symbol, count(*) AS n_rows, min(date) AS start_time, max(date) AS end_time, round(min(low), 6) AS price_min,
  round(max(high), 6) AS price_max, round(max(g.bar_seconds), 6) AS bar_seconds FROM hourly h JOIN
  (SELECT symbol, avg(gap) AS bar_seconds FROM (SELECT symbol, CAST(epoch(date) - epoch(lag(date) OVER (PARTITION BY symbol ORDER BY date)) AS DOUBLE) AS gap,
     row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM hourly) WHERE rn <= 10 GROUP BY symbol) g
  ON h.symbol = g.symbol GROUP BY h.symbol"""
    ),
)
def _(spark, sf):
    return rounded(src.describe_bars(hourly(spark, sf)))


@query(
    "write_panel",
    sql("SELECT year(date) AS year, count(*) AS n, round(sum(close), 4) AS close, round(sum(volume), 4) AS volume FROM bars GROUP BY year(date)"),
)
def _(spark, sf):
    path = scratch(spark) + "/panel"
    sinks.write_panel(bars(spark, sf), path)
    back = spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("close"), F.sum("volume").alias("volume"))
    return rounded(back, 4)


@query(
    "panel_by_symbol",
    sql(
        f"""SELECT b.symbol, b.date, round(f.feat_ma5_dist, 6) AS feat_ma5_dist, round(f.feat_vol_10, 6) AS feat_vol_10, round(f.feat_volume_trend, 6) AS feat_volume_trend,
  round(l.label, 6) AS label, count(*) OVER (PARTITION BY b.symbol) AS n_bars
  FROM bars b JOIN features f ON b.symbol = f.symbol AND b.date = f.date JOIN labels5 l ON b.symbol = l.symbol AND b.date = l.date"""
    ),
)
def _(spark, sf):
    """Stored once by symbol; features, labels and counts then read it without another exchange."""
    folder = scratch(spark)
    stored = sinks.store_by_symbol(bars(spark, sf), folder + "/by_symbol", "panel_" + folder.rpartition("-")[2])
    return rounded(by_symbol(stored))


def by_symbol(stored):
    from pyspark.sql import Window

    feats = feat.volume_trend(feat.volatility(feat.ma_dist(lab.forward_open_return(stored, 5), 5), 10))
    counted = feats.withColumn("n_bars", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    return counted.select("symbol", "date", "feat_ma5_dist", "feat_vol_10", "feat_volume_trend", "label", "n_bars")


@query("history_cutoff", sql(f"SELECT {BAR6} FROM bars WHERE date >= (SELECT max(date) FROM bars) - 730"))
def _(spark, sf):
    return rounded(src.history_cutoff(bars(spark, sf), 2))


# ---- cleaning -------------------------------------------------------------------------------


@query(
    "fill_amount",
    sql(
        f"""SELECT symbol, date, {r6('open', 'high', 'low', 'close')}, round(coalesce(volume, 0), 6) AS volume,
  round(CASE WHEN amount IS NOT NULL THEN amount WHEN volume IS NULL THEN 0 ELSE volume * (open + high + low + close) / 4 END, 6) AS amount FROM holes"""
    ),
)
def _(spark, sf):
    return rounded(clean.fill_amount(holes(spark, sf)))


@query(
    "repair_open",
    sql(
        """SELECT symbol, date, round(CASE WHEN open IS NULL OR open = 0
  THEN coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), close) ELSE open END, 6) AS open FROM holes"""
    ),
)
def _(spark, sf):
    return rounded(clean.repair_open(holes(spark, sf)).select("symbol", "date", "open"))


@query(
    "repair_amount",
    sql(
        """SELECT symbol, date, round(CASE WHEN count(*) OVER s = count(*) FILTER (amount IS NULL) OVER s
  OR count(*) OVER s = count(*) FILTER (amount = 0) OVER s THEN close * volume ELSE amount END, 6) AS amount
  FROM holes WINDOW s AS (PARTITION BY symbol)"""
    ),
)
def _(spark, sf):
    return rounded(clean.repair_amount(holes(spark, sf)).select("symbol", "date", "amount"))


@query(
    "clean_numeric_text",
    sql(
        f"""SELECT symbol, date, round(CASE WHEN {SK} % 5 IN (0, 1) THEN NULL ELSE volume END, 6) AS volume,
  round(open, 6) AS open FROM bars"""
    ),
)
def _(spark, sf):
    volume = F.when(F.expr(f"{SK} % 5 = 0"), "--").when(F.expr(f"{SK} % 5 = 1"), " ").otherwise(F.format_number("volume", 2))
    raw = bars(spark, sf).select("symbol", "date", volume.alias("volume"), F.concat(F.lit(" "), F.col("open").cast("string")).alias("open"))
    return rounded(clean.clean_numeric_text(raw, ["volume", "open"]))


@query(
    "forward_fill",
    sql(
        """SELECT symbol, date, round(last_value(open IGNORE NULLS) OVER w, 6) AS open, round(last_value(close IGNORE NULLS) OVER w, 6) AS close,
  round(last_value(amount IGNORE NULLS) OVER w, 6) AS amount FROM holes
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    ),
)
def _(spark, sf):
    return rounded(clean.forward_fill(holes(spark, sf), ["open", "close", "amount"]).select("symbol", "date", "open", "close", "amount"))


NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in FIELDS)


@query(
    "drop_short_or_null",
    sql(f"SELECT {BAR6} FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM holes WHERE {NOT_NULL}) WHERE n >= 250"),
)
def _(spark, sf):
    return rounded(clean.drop_short_or_null(holes(spark, sf), 250))


CODE = "lpad(CAST(s_suppkey * 97 % 10000 AS VARCHAR(10)), 4, '0') || CASE WHEN s_suppkey % 6 = 0 THEN 'B' ELSE '' END"
cte("codes", f"SELECT s_suppkey, {CODE} AS symbol FROM supplier")


def _codes(spark, sf):
    return table(spark, sf, "supplier").selectExpr("s_suppkey", f"{CODE.replace('VARCHAR(10)', 'STRING')} AS symbol")


FUNDS = ", ".join(f"'{c}'" for c in clean.CORE_FUNDS)


@query("universe_filter", sql(f"SELECT symbol FROM codes WHERE regexp_full_match(symbol, '[1-9][0-9]{{3}}') OR symbol IN ({FUNDS})"))
def _(spark, sf):
    return clean.universe_filter(_codes(spark, sf)).select("symbol")


@query(
    "classify_exchange",
    sql("SELECT symbol, CASE WHEN left(symbol, 1) IN ('0', '2', '3') THEN '0' ELSE '1' END AS exchange FROM codes"),
)
def _(spark, sf):
    return clean.classify_exchange(_codes(spark, sf)).select("symbol", "exchange")


@query(
    "normalise_date",
    sql(
        """SELECT date, count(*) AS n FROM (SELECT CAST(ts AS DATE) AS date FROM events UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem
  UNION ALL SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END FROM orders) GROUP BY date"""
    ),
)
def _(spark, sf):
    """Zoned stamps, stamps, and days written in four ways, every fifth unreadable."""
    zoned = table(spark, sf, "events").select(F.concat(F.col("ts").cast("string"), F.lit("+08:00")).alias("date"))
    stamps = table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("date"))
    day = F.col("o_orderdate")
    forms = [F.lit("31st of May"), F.date_format(day, "yyyy/M/d"), F.date_format(day, "yyyyMMdd"), F.date_format(day, "yyyy.MM.dd"), F.date_format(day, "yyyy-MM-dd'T'HH:mm")]
    written = table(spark, sf, "orders").select(F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("date"))
    both = clean.normalise_date(zoned).unionByName(clean.normalise_date(stamps)).unionByName(clean.normalise_date(written))
    return rounded(both.groupBy("date").agg(F.count(F.lit(1)).alias("n")))


@query("validate_fields", sql("SELECT symbol, count(close) AS n FROM bars GROUP BY symbol"))
def _(spark, sf):
    b = bars(spark, sf)
    clean.validate_fields(b, ["open", "close"])
    return b.groupBy("symbol").agg(F.count("close").alias("n"))


@query(
    "derived_changes",
    sql(
        """SELECT symbol, date, round(coalesce(close - lag(close) OVER w, 0), 6) AS change,
  round(coalesce((close / nullif(lag(close) OVER w, 0) - 1) * 100, 0), 6) AS change_pct,
  round((high - low) / nullif(open, 0) * 100, 6) AS amplitude FROM holes WINDOW w AS (PARTITION BY symbol ORDER BY date)"""
    ),
)
def _(spark, sf):
    return rounded(clean.derived_changes(holes(spark, sf)).select("symbol", "date", "change", "change_pct", "amplitude"))


@query(
    "reshape_long_wide",
    sql(
        "SELECT date, "
        + ", ".join(f"round(max(CASE WHEN field = '{c}' THEN value END), 6) AS {c}" for c in FIELDS)
        + " FROM (UNPIVOT market ON open, high, low, close, volume, amount INTO NAME field VALUE value) GROUP BY date"
    ),
)
def _(spark, sf):
    long = clean.to_long(market(spark, sf), ["date"], FIELDS)
    return rounded(clean.reshape_long_wide(long, ["date"], "field", "value", FIELDS))


# ---- calendars ------------------------------------------------------------------------------

MIN_SYMBOLS = 80
cte(
    "traded",
    f"SELECT date FROM all_bars GROUP BY date HAVING count(*) >= {MIN_SYMBOLS} AND bool_or(symbol = '^MKT')",
)


def traded(spark, sf):
    return cal_ops.trading_days(all_bars(spark, sf), BENCHMARK, MIN_SYMBOLS)


@query("trading_days", sql("SELECT date FROM traded"))
def _(spark, sf):
    return traded(spark, sf)


@query("benchmark_calendar", sql("SELECT date FROM market WHERE date BETWEEN '1996-01-01' AND '1999-12-31'"))
def _(spark, sf):
    return cal_ops.benchmark_calendar(all_bars(spark, sf), BENCHMARK, "1996-01-01", "1999-12-31")


def sched_sql(*holds: int) -> str:
    parts = [
        f"SELECT CAST({h} AS BIGINT) AS variant, date AS signal_date, next_date AS exec_date FROM numbered WHERE idx % {h} = 0 AND next_date IS NOT NULL"
        for h in holds
    ]
    return " UNION ALL ".join(parts)


@query("schedule", sql(sched_sql(3, 5, 10)))
def _(spark, sf):
    return rounded(cal_ops.schedule(calendar(spark, sf), [3, 5, 10]))


@query(
    "date_filter",
    sql("SELECT symbol, count(*) AS n FROM bars WHERE date BETWEEN '1997-01-01' AND '1999-12-31' AND date IN (SELECT date FROM traded) GROUP BY symbol"),
)
def _(spark, sf):
    kept = cal_ops.date_filter(bars(spark, sf), "1997-01-01", "1999-12-31", traded(spark, sf))
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(
    "multi_range_filter",
    sql(
        """SELECT symbol, count(*) AS n FROM bars WHERE (date BETWEEN '1996-01-01' AND '1997-06-30' OR date BETWEEN '1999-01-01' AND '2000-12-31')
  AND NOT date BETWEEN '1996-06-01' AND '1996-08-31' AND date IN (SELECT date FROM traded) GROUP BY symbol"""
    ),
)
def _(spark, sf):
    kept = cal_ops.multi_range_filter(
        bars(spark, sf),
        [("1996-01-01", "1997-06-30"), ("1999-01-01", "2000-12-31")],
        [("1996-06-01", "1996-08-31")],
        traded(spark, sf),
    )
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def _bounds(spark, sf):
    return src.symbol_stats(bars(spark, sf)).select("symbol", F.col("first_date").alias("start"), F.col("last_date").alias("end"))


cte("bounds", "SELECT symbol, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY symbol")
cte(
    "weekdays",
    """SELECT symbol, d, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS m FROM
  (SELECT symbol, CAST(unnest(generate_series(first_date, last_date, INTERVAL 1 DAY)) AS DATE) AS d FROM bounds) WHERE isodow(d) <= 5""",
)


@query(
    "even_dates",
    sql(
        """SELECT DISTINCT w.symbol, w.d AS date FROM weekdays w, range(0, 40) t(k)
  WHERE w.m <= 40 OR w.i = round_even(k * CAST(w.m - 1 AS DOUBLE) / 39, 0)"""
    ),
)
def _(spark, sf):
    return cal_ops.even_dates(_bounds(spark, sf), 40).select("symbol", "date")


@query("business_dates", sql("SELECT symbol, d AS date FROM weekdays WHERE i % 20 = 0"))
def _(spark, sf):
    return cal_ops.business_dates(_bounds(spark, sf), 20).select("symbol", "date")


@query("sample_universe", sql("SELECT symbol FROM bounds ORDER BY md5(symbol || '#42'), symbol LIMIT 20"))
def _(spark, sf):
    return cal_ops.sample_universe(bars(spark, sf), 20, 42)


cte(
    "holidays",
    "SELECT DISTINCT CAST(o_orderdate AS DATE) + 1095 AS date FROM orders WHERE extract(day FROM o_orderdate) IN (5, 6, 7, 8, 20)",
)


@query(
    "future_dates",
    sql(
        """SELECT symbol, last_date, date, step FROM (SELECT symbol, last_date, d AS date, row_number() OVER (PARTITION BY symbol ORDER BY d) AS step
  FROM (SELECT symbol, last_date, CAST(unnest(generate_series(last_date + 1, last_date + 400, INTERVAL 1 DAY)) AS DATE) AS d FROM bounds)
  WHERE isodow(d) <= 5 AND d NOT IN (SELECT date FROM holidays)) WHERE step <= 30"""
    ),
)
def _(spark, sf):
    day = F.col("o_orderdate").cast("date")
    off = table(spark, sf, "orders").where(F.dayofmonth(day).isin(5, 6, 7, 8, 20)).select(F.date_add(day, 1095).alias("date"))
    last = _bounds(spark, sf).select("symbol", F.col("end").alias("date"))
    return rounded(cal_ops.future_dates(last, 30, off).select("symbol", "last_date", "date", "step"))


@query(
    "phantom_days",
    sql(
        """SELECT year(d.date) AS split, count(*) AS n_dates, count(*) FILTER (t.date IS NULL) AS n_phantom,
  CAST(coalesce(sum(n) FILTER (t.date IS NULL), 0) AS BIGINT) AS n_rows, round(count(*) FILTER (t.date IS NULL) / count(*), 6) AS share
  FROM (SELECT date, count(*) AS n FROM bars GROUP BY date) d LEFT JOIN traded t ON d.date = t.date GROUP BY year(d.date)"""
    ),
)
def _(spark, sf):
    return rounded(cal_ops.phantom_days(bars(spark, sf), traded(spark, sf), F.year("date")))
