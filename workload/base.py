"""The panel behind every query, once in Spark and once as SQL, and the query registry."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.groups import GROUP_LIMIT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}
BENCHMARK = "^MKT"
FIELDS = ["open", "high", "low", "close", "volume", "amount"]


def cte(name: str, text: str) -> None:
    CTES[name] = text.strip()


def sql(select: str) -> str:
    """Prefix ``select`` with the named tables it uses, in dependency order; slog(x) stands for what ``logged`` does."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in re.findall(r"[a-z_][a-z_0-9]*", text):
            if word in CTES and word not in seen:
                seen.add(word)
                visit(CTES[word])
                order.append(word)

    visit(select)
    if not order:
        return select
    return signed_logs("WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + select)


def signed_logs(text: str) -> str:
    """Write out every slog(x)."""
    while (at := text.find("slog(")) >= 0:
        depth, end = 1, at + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        x = text[at + 5 : end - 1]
        text = f"{text[:at]}(sign({x}) * ln(1 + abs({x}))){text[end:]}"
    return text


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to 6 places (and no negative zero), counts to bigint: what both engines compare.

    Rounds as the SQL side does, on the binary value; Spark's own ``round`` works on the decimal text and
    differs on ties such as x / 32.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            scale = F.lit(10.0**places)
            c = c.cast("double")
            c = F.signum(c) * (F.floor(F.abs(c) * scale + F.lit(0.5)) / scale) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def logged(df: DataFrame, *cols: str) -> DataFrame:
    """Replace compounded figures by sign(x) ln(1 + |x|): weekly prices of random orders compound past any fixed precision."""
    return df.withColumns({c: F.signum(F.col(c)) * F.log1p(F.abs(F.col(c))) for c in cols})


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- weekly bars per supplier ---------------------------------------------------------------


def _bar_columns() -> list[Column]:
    order, price = F.struct(*LINE_FIELDS), F.col("l_extendedprice") / F.col("l_quantity")
    return [
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("amount"),
    ]


LINE_FIELDS = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of lineitem that bars are made of, with the symbol and the week of a line."""
    symbol = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol")
    return table(spark, sf, "lineitem").select(*LINE_FIELDS, symbol, F.date_trunc("week", F.col("l_shipdate")).cast("date").alias("date"))


#: Lines that a task of the deal by symbol sorts: there is a partition for each so many, and the session's number at least.
LINES = 1_000_000
_SIZES: dict[str, int] = {}


def _deals(spark: SparkSession, sf: str) -> int:
    """Partitions that lineitem needs, from the row counts in its files. A count that grew old only changes the size of tasks."""
    if sf not in _SIZES:
        _SIZES[sf] = table(spark, sf, "lineitem").count()
    return -(-_SIZES[sf] // LINES)


def wide_deal(spark: SparkSession, sf: str) -> int | None:
    """Partitions for a deal of rows made from lineitem, or None where the session's number is enough."""
    n = _deals(spark, sf)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def by_date(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Rows made from lineitem dealt out by date, into as many partitions as its lines ask for, where the session's number is too small."""
    n = wide_deal(spark, sf)
    return rows.repartition(n, "date") if n else rows


def limit_of_dates(spark: SparkSession, sf: str) -> int | None:
    """``GROUP_LIMIT`` for bars of this lineitem, or None if no week has so many lines that one of its cross-sections could be above it.

    That look reads one column, where a look at the bars would deal out all lines once more.
    """
    most = _lines(spark, sf).groupBy("date").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return GROUP_LIMIT if (most or 0) > GROUP_LIMIT else None


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars by (symbol, date). The lines are dealt out by symbol once; windows along a symbol find them where they are.

    The number of partitions follows the number of lines, so what a task sorts does not grow with the table. Symbol and
    week are made before the deal and nothing stands between it and the aggregate: a semi-join on them goes below both.
    """
    lines, n = _lines(spark, sf), wide_deal(spark, sf)
    dealt = lines.repartition(n, "symbol") if n else lines.repartition("symbol")
    return dealt.groupBy("symbol", "date").agg(*_bar_columns())


def market(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark: the same bars without the supplier key.

    The first and the last line of a week lie on its first and last shipping day. These come from an aggregate without a
    sort; only lines of those days are put in order.
    """
    lines = _lines(spark, sf)
    _, high, low, _, volume, amount = _bar_columns()
    days = lines.groupBy("date").agg(F.min("l_shipdate").alias("_from"), F.max("l_shipdate").alias("_to"), high, low, volume, amount)
    of = F.broadcast(days.select(F.col("date").alias("_week"), "_from", "_to"))  # a row a week
    outer = lines.join(of, F.col("date").eqNullSafe(F.col("_week"))).where("l_shipdate <=> _from OR l_shipdate <=> _to")
    opening, closing = _bar_columns()[0], _bar_columns()[3]
    ends = outer.groupBy("date").agg(opening, closing).withColumnRenamed("date", "_week")
    both = days.join(F.broadcast(ends), F.col("date").eqNullSafe(F.col("_week")))
    return both.select(F.lit(BENCHMARK).alias("symbol"), "date", *FIELDS)


def all_bars(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).unionByName(market(spark, sf))


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("date").distinct()


_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"
_AGG = f"""first(price ORDER BY {_ORDER}) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY {_ORDER}) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount"""
cte(
    "lines",
    "SELECT *, l_extendedprice / l_quantity AS price, CAST(date_trunc('week', l_shipdate) AS DATE) AS date FROM lineitem",
)
cte("bars", f"SELECT 'S' || l_suppkey AS symbol, date, {_AGG} FROM lines GROUP BY l_suppkey, date")
cte("market", f"SELECT '^MKT' AS symbol, date, {_AGG} FROM lines GROUP BY date")
cte("all_bars", "SELECT * FROM bars UNION ALL SELECT * FROM market")
cte("calendar", "SELECT DISTINCT date FROM lines")
cte(
    "numbered",
    """SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, lag(date) OVER (ORDER BY date) AS prev_date,
  lead(date) OVER (ORDER BY date) AS next_date FROM calendar""",
)

# ---- features, scores, labels, paths --------------------------------------------------------

W = "PARTITION BY symbol ORDER BY date"


def _frame(n: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


FEATURE_SQL = {
    **{f"feat_ma{n}_dist": f"coalesce(close / nullif(avg(close) {_frame(n)}, 0) - 1, 0)" for n in (5, 20, 60)},
    **{f"feat_momentum_{n}": f"coalesce(close / nullif(lag(close, {n}) OVER ({W}), 0) - 1, 0)" for n in (3, 5, 10, 20, 60)},
    **{
        f"feat_vol_{n}": f"CASE WHEN count(r) {_frame(n)} = {n} THEN stddev_pop(r) {_frame(n)} ELSE 0 END" for n in (10, 30)
    },
    "feat_volume_ratio": f"coalesce(volume / nullif(avg(volume) {_frame(20)}, 0), 1)",
    "feat_volume_trend": f"CASE WHEN count(*) {_frame(20)} = 20 THEN coalesce(avg(volume) {_frame(5)} / nullif(avg(volume) {_frame(20)}, 0), 1) ELSE 1 END",
    "feat_hl_spread_5": f"avg(coalesce((high - low) / nullif(close, 0), 0)) {_frame(5)}",
}
cte("returns", f"SELECT *, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM bars")
cte("features", "SELECT symbol, date, " + ", ".join(f"{v} AS {k}" for k, v in FEATURE_SQL.items()) + " FROM returns")
cte("score_a", "SELECT date, symbol, -feat_ma5_dist AS score FROM features")
cte("score_b", "SELECT date, symbol, feat_momentum_20 AS score FROM features")
cte("labels5", f"SELECT symbol, date, lead(open, 6) OVER ({W}) / nullif(lead(open, 1) OVER ({W}), 0) - 1 AS label FROM bars")
cte(
    "scored",
    """SELECT f.date, f.symbol, -feat_ma5_dist AS score, feat_momentum_20 AS score_b, label
  FROM features f JOIN labels5 l ON f.symbol = l.symbol AND f.date = l.date WHERE label IS NOT NULL""",
)
cte(
    "paths",
    """SELECT b.date, b.symbol, CAST(h AS INTEGER) AS h, b.close * (1 + h * f.feat_momentum_5 / 10) AS value
  FROM bars b JOIN features f ON b.symbol = f.symbol AND b.date = f.date, range(1, 11) t(h)""",
)
cte(
    "curves",
    """SELECT p.date, p.symbol, p.h - 1 AS h, p.value / nullif(f.value, 0) - 1 AS value
  FROM paths p JOIN paths f ON p.date = f.date AND p.symbol = f.symbol AND f.h = 1 WHERE p.h > 1""",
)


def features(spark: SparkSession, sf: str) -> DataFrame:
    from barline.operators.features import technical_features

    return technical_features(bars(spark, sf))


def score_a(spark: SparkSession, sf: str) -> DataFrame:
    from barline.operators.features import ma_dist

    return ma_dist(bars(spark, sf), 5).select("date", "symbol", (-F.col("feat_ma5_dist")).alias("score"))


def score_b(spark: SparkSession, sf: str) -> DataFrame:
    from barline.operators.features import momentum

    return momentum(bars(spark, sf), 20).select("date", "symbol", F.col("feat_momentum_20").alias("score"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """(date, symbol, score, score_b, label): both stand-in scores with the 5-step label."""
    from barline.operators.features import ma_dist, momentum
    from barline.operators.labels import forward_open_return

    rows = forward_open_return(momentum(ma_dist(bars(spark, sf), 5), 20), 5).where("label is not null")
    return rows.select(
        "date", "symbol", (-F.col("feat_ma5_dist")).alias("score"), F.col("feat_momentum_20").alias("score_b"), "label"
    )


def blended(spark: SparkSession, sf: str) -> DataFrame:
    """The 0.6 / 0.4 blend of both scores."""
    from barline.operators.features import ma_dist, momentum
    from barline.operators.scores import blend_columns

    both = momentum(ma_dist(bars(spark, sf), 5), 20).withColumn("score_a", -F.col("feat_ma5_dist"))
    return blend_columns(both, "score_a", "feat_momentum_20", 0.6)


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """(date, symbol, h, value) for h = 1..10: the close moved along its 5-step momentum."""
    from barline.operators.features import momentum

    value = F.col("close") * (F.lit(1.0) + F.col("h") * F.col("feat_momentum_5") / F.lit(10.0))
    return (
        momentum(bars(spark, sf), 5)
        .withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(10))))
        .select("date", "symbol", "h", value.alias("value"))
    )


def packed(rows: DataFrame) -> DataFrame:
    """Bars with feat_momentum_5, and the ten values of ``paths`` as an array ``path`` beside them."""
    value = lambda h: F.col("close") * (F.lit(1.0) + h * F.col("feat_momentum_5") / F.lit(10.0))
    return rows.withColumn("path", F.transform(F.sequence(F.lit(1), F.lit(10)), value))


def packed_paths(spark: SparkSession, sf: str) -> DataFrame:
    """(date, symbol, close, path): ``paths`` with one row per (date, symbol)."""
    from barline.operators.features import momentum

    return packed(momentum(bars(spark, sf), 5)).select("date", "symbol", "close", "path")


def curves(spark: SparkSession, sf: str) -> DataFrame:
    from barline.operators.scores import predicted_return_curve

    return predicted_return_curve(packed_paths(spark, sf), None, "open", 10)


# ---- bars with holes, for the repairs --------------------------------------------------------

SK = "CAST(substr(symbol, 2) AS INT)"
WK = "weekofyear(date)"
_HOLES = {
    "open": f"CASE WHEN {SK} % 7 = 0 AND {WK} % 5 = 0 THEN 0 WHEN {SK} % 7 = 1 AND {WK} % 5 = 1 THEN NULL ELSE open END",
    "high": "high",
    "low": "low",
    "close": f"CASE WHEN ({SK} + {WK}) % 11 = 0 THEN NULL ELSE close END",
    "volume": f"CASE WHEN {SK} % 9 = 0 AND {WK} % 4 = 0 THEN NULL ELSE volume END",
    "amount": f"CASE WHEN {SK} % 4 = 0 THEN NULL WHEN {SK} % 4 = 1 THEN 0 WHEN {SK} % 4 = 2 AND {WK} % 3 = 0 THEN NULL ELSE amount END",
}
cte("holes", "SELECT symbol, date, " + ", ".join(f"{v} AS {k}" for k, v in _HOLES.items()) + " FROM bars")


def holes(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).selectExpr("symbol", "date", *[f"CAST({v} AS DOUBLE) AS {k}" for k, v in _HOLES.items()])


# ---- hourly bars per event type -------------------------------------------------------------


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("symbol"), F.col("value").alias("price"))


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    from barline.streaming.bars import stream_bars

    out = stream_bars(ticks(spark, sf), "1 hour")
    return out.withColumn("date", F.col("date").cast(T.TimestampNTZType()))


cte(
    "hourly",
    """SELECT event_type AS symbol, date_trunc('hour', ts) AS date, first(value ORDER BY ts, event_id) AS open,
  max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
  CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount FROM events GROUP BY event_type, date_trunc('hour', ts)""",
)


LOCAL_SCRATCH: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A fresh folder for tables written by a query, below the cluster's shared folder.

    Only a session that runs inside one machine may go without that setting; it gets a folder of its own then.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not LOCAL_SCRATCH:
            LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="spark-"))
        shared = LOCAL_SCRATCH[0]
    return f"{shared.rstrip('/')}/panel-{uuid.uuid4().hex}"


def r6(*cols: str) -> str:
    """round(x, 6) AS x, or round(expr, 6) AS name for 'expr AS name'."""
    out = []
    for c in cols:
        expr, _, name = c.rpartition(" AS ")
        out.append(f"round({expr or name}, 6) AS {name}")
    return ", ".join(out)
