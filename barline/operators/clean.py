"""Repair and screening of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.expr import BAR_FIELDS, change, count_if, nan_to_null, ratio
from barline.functions.timeline import along, carry


def fill_amount(bars: DataFrame) -> DataFrame:
    """Missing amount = volume x mean of the four prices (NULL if one is), or 0 without volume; known amounts stay.

    Missing volume = 0.
    """
    mean = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / F.lit(4.0)
    amount = F.coalesce("amount", F.when(F.col("volume").isNull(), F.lit(0.0)).otherwise(F.col("volume") * mean))
    return bars.withColumns({"amount": amount, "volume": F.coalesce("volume", F.lit(0.0))})


def repair_open(bars: DataFrame) -> DataFrame:
    """An open that is 0 or missing becomes the previous close, else the own close."""
    bad = F.col("open").isNull() | (F.col("open") == 0)
    return along(
        bars,
        lambda df, w: df.withColumn(
            "open", F.when(bad, F.coalesce(F.lag("close").over(w), F.col("close"))).otherwise(F.col("open"))
        ),
        back=1,
    )


def repair_amount(bars: DataFrame) -> DataFrame:
    """Symbols whose amounts are all missing or all 0 get close x volume."""
    n = F.count(F.lit(1))
    unusable = (
        bars.groupBy("symbol")
        .agg(n.alias("_n"), count_if(F.col("amount").isNull()).alias("_null"), count_if(F.col("amount") == 0).alias("_zero"))
        .where("_null = _n or _zero = _n")
        .select("symbol", F.lit(True).alias("_redo"))
    )
    amount = F.when(F.col("_redo"), F.col("close") * F.col("volume")).otherwise(F.col("amount"))
    return bars.join(unusable, "symbol", "left").withColumn("amount", amount).drop("_redo")


def clean_numeric_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numbers written with thousands separators; ``--``, blanks and other text give NULL."""
    number = lambda c: F.regexp_replace(F.trim(F.col(c).cast("string")), ",", "").try_cast("double")
    return df.withColumns({c: nan_to_null(number(c)) for c in cols})


def forward_fill(bars: DataFrame, cols: list[str]) -> DataFrame:
    return carry(bars, cols)


def drop_short_or_null(bars: DataFrame, min_rows: int) -> DataFrame:
    """Drop rows with a NULL, then symbols left with fewer than ``min_rows`` rows."""
    whole = bars.na.drop()
    enough = whole.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return whole.join(enough, "symbol", "left_semi")


# Ordinary share codes and the core funds kept beside them.
SHARE_CODE = "^[1-9][0-9]{3}$"
CORE_FUNDS = ["0050", "0051", "0052", "0053", "0055", "0056", "0057", "0061"]


def universe_filter(df: DataFrame, pattern: str = SHARE_CODE, extra: list[str] | None = None) -> DataFrame:
    extra = CORE_FUNDS if extra is None else extra
    return df.where(F.col("symbol").rlike(pattern) | F.col("symbol").isin(extra))


# Code prefixes and the market they belong to; anything else counts as market 1.
EXCHANGE_RULES = [(("0", "2", "3"), "0"), (("6", "9"), "1")]


def classify_exchange(df: DataFrame, rules=EXCHANGE_RULES, default: str = "1") -> DataFrame:
    out = F.lit(default)
    for prefixes, market in reversed(rules):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.col("symbol").startswith(p)
        out = F.when(hit, F.lit(market)).otherwise(out)
    return df.withColumn("exchange", out)


#: Written days that are understood, with - / . or nothing between year, month and day; a time may follow.
DAY_TEXT = r"^\s*(\d{4})(?:-(\d{1,2})-|/(\d{1,2})/|\.(\d{1,2})\.|(\d{2}))(\d{1,2})(?:[T\s].*)?$"


def normalise_date(df: DataFrame, col: str = "date", strict: bool = False) -> DataFrame:
    """Timestamp, zoned text or written day to a DATE, keeping the written local day.

    Text that is no day gives NULL; with ``strict`` the first such text fails the job that reads it.
    """
    text = F.col(col).cast("string")
    part = lambda i: F.regexp_extract(text, DAY_TEXT, i)
    month = F.concat(part(2), part(3), part(4), part(5))
    day = F.when(text.rlike(DAY_TEXT), F.concat_ws("-", part(1), F.lpad(month, 2, "0"), F.lpad(part(6), 2, "0")).try_cast("date"))
    if strict:
        bad = F.raise_error(F.concat(F.lit(f"no day in {col}: "), text)).cast("date")
        day = F.when(text.isNull(), None).otherwise(F.coalesce(day, bad))
    return df.withColumn(col, day)


def validate_fields(df: DataFrame, fields: list[str]) -> None:
    """Raise for a field that is no bar field or not in the table."""
    unknown = [f for f in fields if f not in BAR_FIELDS or f not in df.columns]
    if unknown:
        raise ValueError(f"Unsupported price fields: {unknown}; choose from {BAR_FIELDS}")


def derived_changes(bars: DataFrame) -> DataFrame:
    """Change and change % from the previous close (0 on the first bar), amplitude in % of the open."""

    def step(df, w):
        prev = F.lag("close").over(w)
        return df.withColumns(
            {
                "change": F.coalesce(F.col("close") - prev, F.lit(0.0)),
                "change_pct": F.coalesce(change("close", prev) * 100, F.lit(0.0)),
                "amplitude": ratio(F.col("high") - F.col("low"), "open") * 100,
            }
        )

    return along(bars, step, back=1)


def to_long(df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One row per key and field."""
    return df.unpivot(key, fields, "field", "value")


def reshape_long_wide(df: DataFrame, key: list[str], field: str, value: str, names: list[str] | None = None) -> DataFrame:
    """One column per field name. Pass ``names`` to save the pass that finds them."""
    pivot = df.groupBy(*key).pivot(field, names) if names else df.groupBy(*key).pivot(field)
    return pivot.agg(F.first(value, ignorenulls=True))
