"""Turning provider payloads into bars. Malformed values give NULL, malformed rows are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.expr import BAR_FIELDS, PRICE_FIELDS

# Provider column headers and their canonical names.
HEADER_ALIASES = {
    "日期": "date",
    "开盘价": "open",
    "最高价": "high",
    "最低价": "low",
    "收盘价": "close",
    "成交量": "volume",
    "成交额": "amount",
    "开盘": "open",
    "收盘": "close",
    "最高": "high",
    "最低": "low",
    "max": "high",
    "min": "low",
    "Trading_Volume": "volume",
    "Trading_money": "amount",
}
# Fixed value: years between the Republic-of-China era and the common era.
ERA_OFFSET_YEARS = 1911
# Field order of the two row layouts.
EXCHANGE_ROW = ["volume", "amount", "open", "high", "low", "close"]
PACKED_ROW = ["open", "close", "high", "low", "volume"]
PACKED_TAIL = ["amount", "amplitude", "change_pct", "change", "turnover"]


def plain_number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def parse_exchange_rows(raw: DataFrame, col: str = "row") -> DataFrame:
    """``row`` is an array of strings: era date y/m/d, then volume, amount, open, high, low, close."""
    part = F.split(F.get(F.col(col), F.lit(0)), "/")
    y, m, d = (F.get(part, F.lit(i)).try_cast("int") for i in range(3))
    iso = F.format_string("%04d-%02d-%02d", y + ERA_OFFSET_YEARS, m, d).try_cast("date")
    parsed = raw.select(
        *[c for c in raw.columns if c != col],
        F.when(y.isNotNull() & m.isNotNull() & d.isNotNull() & (F.size(part) == 3), iso).alias("date"),
        *[plain_number(F.get(F.col(col), F.lit(i + 1))).alias(f) for i, f in enumerate(EXCHANGE_ROW)],
    )
    return parsed.na.drop(subset=["date", *EXCHANGE_ROW])


def parse_packed_bars(raw: DataFrame, col: str = "payload") -> DataFrame:
    """JSON or JSONP text whose ``data.klines`` lists "date,open,close,high,low,volume[,tail...]" strings."""
    body = F.coalesce(
        F.nullif(F.regexp_extract(F.col(col), r"(?s)^[^{(]*\((.*)\)[^)]*$", 1), F.lit("")), F.col(col)
    )
    lines = F.from_json(body, "data struct<klines: array<string>>")["data"]["klines"]
    rows = raw.select(*[c for c in raw.columns if c != col], F.explode(lines).alias("_line"))
    item = F.split("_line", ",")
    cell = lambda i: F.get(item, F.lit(i)).try_cast("double")
    keep = [c for c in rows.columns if c != "_line"]
    first_tail = 1 + len(PACKED_ROW)
    out = rows.select(
        *keep,
        F.get(item, F.lit(0)).try_cast("date").alias("date"),
        *[cell(i + 1).alias(f) for i, f in enumerate(PACKED_ROW)],
        *[
            F.when(F.size(item) > first_tail + i, cell(first_tail + i)).otherwise(F.lit(0.0)).alias(f)
            for i, f in enumerate(PACKED_TAIL)
        ],
    )
    return out.na.drop(subset=["date", *PACKED_ROW, *PACKED_TAIL])


def rename_aliases(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename the headers that are present and whose canonical name is still free."""
    mapping = HEADER_ALIASES if mapping is None else mapping
    todo, taken = {}, set(df.columns)
    for old, new in mapping.items():
        if old in df.columns and new not in taken:
            todo[old] = new
            taken.add(new)
    return df.withColumnsRenamed(todo)


def load_bar_file(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV or parquet with any of the usual time headers; rows with a NULL are dropped.

    Without a time column an hourly clock from 2024-01-01 is laid over the rows in file order.
    """
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    missing = [c for c in PRICE_FIELDS if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    numeric = [c for c in BAR_FIELDS if c in df.columns]
    df = df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in numeric})
    stamp = next((c for c in ("timestamps", "timestamp", "date") if c in df.columns), None)
    if stamp is not None:
        df = df.withColumn("timestamps", F.col(stamp).cast("string").try_cast(T.TimestampNTZType()))
    else:
        df = _hourly_clock(df)
    return df.na.drop()


def _hourly_clock(df: DataFrame) -> DataFrame:
    # monotonically_increasing_id = partition << 33 | row; counts per partition turn it into a row number
    tagged = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_id", 33))
    sizes = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select(
        "_p",
        F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
    )
    row = F.col("_id") - F.shiftleft("_p", 33) + F.col("_o")
    start = F.lit("2024-01-01 00:00:00").cast(T.TimestampNTZType())
    return (
        tagged.join(F.broadcast(before), "_p")
        .withColumn("timestamps", start + F.make_dt_interval(hours=row.cast("int")))
        .drop("_id", "_p", "_o")
    )
