"""Technical features along time, percentile ranks across a date, vector features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.expr import change, count_if, ratio
from barline.functions.groups import BATCH, GROUP_LIMIT, UNSEEN, hot_groups, percent_rank, with_ranks
from barline.functions.timeline import along

# Names and order of the base features.
TECH_FEATURES = [
    "feat_ma5_dist",
    "feat_ma20_dist",
    "feat_ma60_dist",
    "feat_momentum_3",
    "feat_momentum_5",
    "feat_momentum_10",
    "feat_momentum_20",
    "feat_momentum_60",
    "feat_vol_10",
    "feat_vol_30",
    "feat_volume_ratio",
    "feat_volume_trend",
    "feat_hl_spread_5",
]
RANK_SUFFIX = "_cs_rank"


def _tail(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def _ma_dist(w: WindowSpec, n: int) -> Column:
    return F.coalesce(change("close", F.avg("close").over(_tail(w, n))), F.lit(0.0))


def _momentum(w: WindowSpec, n: int) -> Column:
    return F.coalesce(change("close", F.lag("close", n).over(w)), F.lit(0.0))


def _volatility(w: WindowSpec, n: int) -> Column:
    full = F.count("_ret").over(_tail(w, n)) == n
    return F.when(full, F.stddev_pop("_ret").over(_tail(w, n))).otherwise(F.lit(0.0))


def _volume_ratio(w: WindowSpec, n: int) -> Column:
    return F.coalesce(ratio("volume", F.avg("volume").over(_tail(w, n))), F.lit(1.0))


def _volume_trend(w: WindowSpec, short: int, long: int) -> Column:
    full = F.count(F.lit(1)).over(_tail(w, long)) == long
    trend = ratio(F.avg("volume").over(_tail(w, short)), F.avg("volume").over(_tail(w, long)))
    return F.when(full, F.coalesce(trend, F.lit(1.0))).otherwise(F.lit(1.0))


def _hl_spread(w: WindowSpec, n: int) -> Column:
    return F.avg(F.coalesce(ratio(F.col("high") - F.col("low"), "close"), F.lit(0.0))).over(_tail(w, n))


def _with_return(df: DataFrame, w: WindowSpec) -> DataFrame:
    return df.withColumn("_ret", change("close", F.lag("close").over(w)))


def ma_dist(bars: DataFrame, n: int) -> DataFrame:
    """Close over the mean of up to n closes, minus 1."""
    return along(bars, lambda df, w: df.withColumn(f"feat_ma{n}_dist", _ma_dist(w, n)), back=n - 1)


def momentum(bars: DataFrame, n: int) -> DataFrame:
    """Close over the close n rows back, minus 1; 0 where there is none."""
    return along(bars, lambda df, w: df.withColumn(f"feat_momentum_{n}", _momentum(w, n)), back=n)


def volatility(bars: DataFrame, n: int) -> DataFrame:
    """Population deviation of the last n one-step returns; 0 until there are n."""
    return along(
        bars, lambda df, w: _with_return(df, w).withColumn(f"feat_vol_{n}", _volatility(w, n)).drop("_ret"), back=n
    )


def volume_ratio(bars: DataFrame, n: int = 20) -> DataFrame:
    return along(bars, lambda df, w: df.withColumn("feat_volume_ratio", _volume_ratio(w, n)), back=n - 1)


def volume_trend(bars: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    return along(bars, lambda df, w: df.withColumn("feat_volume_trend", _volume_trend(w, short, long)), back=long - 1)


def hl_spread(bars: DataFrame, n: int = 5) -> DataFrame:
    return along(bars, lambda df, w: df.withColumn(f"feat_hl_spread_{n}", _hl_spread(w, n)), back=n - 1)


def technical_features(bars: DataFrame, limit: int | None = GROUP_LIMIT, keep: list[str] = ()) -> DataFrame:
    """All 13 base features beside (symbol, date) and the columns to keep: one shuffle by symbol, one sort."""

    def step(df: DataFrame, w: WindowSpec) -> DataFrame:
        columns = {
            "feat_ma5_dist": _ma_dist(w, 5),
            "feat_ma20_dist": _ma_dist(w, 20),
            "feat_ma60_dist": _ma_dist(w, 60),
            "feat_momentum_3": _momentum(w, 3),
            "feat_momentum_5": _momentum(w, 5),
            "feat_momentum_10": _momentum(w, 10),
            "feat_momentum_20": _momentum(w, 20),
            "feat_momentum_60": _momentum(w, 60),
            "feat_vol_10": _volatility(w, 10),
            "feat_vol_30": _volatility(w, 30),
            "feat_volume_ratio": _volume_ratio(w, 20),
            "feat_volume_trend": _volume_trend(w, 5, 20),
            "feat_hl_spread_5": _hl_spread(w, 5),
        }
        return _with_return(df, w).withColumns(columns).drop("_ret")

    return along(bars, step, back=60, limit=limit).select("symbol", "date", *keep, *TECH_FEATURES)


def technical_arrays(bars: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``technical_features`` of bars with a DATE column as arrays over many symbols at once: a frame of 60 rows costs 60 additions a row.

    The row number keeps each symbol in one partition and in order; rows of the last symbol of a batch wait for the next one.
    """
    fields, kept = ("high", "low", "close", "volume"), ["symbol", "date", *keep]
    at = F.row_number().over(Window.partitionBy("symbol").orderBy("date")).alias("_at")
    rows = bars.select(*kept, *[F.col(c).cast("double").alias(f"_{c}") for c in fields], at)
    schema = T.StructType([*[bars.schema[c] for c in kept], *[T.StructField(c, T.DoubleType()) for c in TECH_FEATURES]])

    def whole(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        symbols = pa.Table.from_batches(parts)
        found = _features_of(*[symbols.column(f"_{c}") for c in fields], symbols.column("_at").to_numpy())
        columns = [*[symbols.column(c) for c in kept], *[pa.array(found[c]) for c in TECH_FEATURES]]
        return pa.Table.from_arrays(columns, names=schema.names).to_batches(max_chunksize=BATCH)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            firsts = np.flatnonzero(batch.column("_at").to_numpy() == 1)
            if not len(firsts):
                waiting.append(batch)
                continue
            last = int(firsts[-1])
            if waiting or last:
                yield from whole([*waiting, batch.slice(0, last)])
            waiting = [batch.slice(last)]
        if waiting:
            yield from whole(waiting)

    return rows.mapInArrow(add, schema)


#: Rows that the longest frame looks back.
BACK = 60
Known = tuple[np.ndarray, np.ndarray]


def _change(num: Known, den: Known, less: float = 1.0) -> Known:
    there = num[1] & den[1] & (den[0] != 0)
    with np.errstate(all="ignore"):
        return np.where(there, num[0] / np.where(there, den[0], 1.0) - less, 0.0), there


def _back(x: Known, n: int) -> Known:
    """x of n rows before; the first n rows have none."""
    n = min(n, len(x[0]))
    return np.append(np.zeros(n), x[0][: len(x[0]) - n]), np.append(np.zeros(n, bool), x[1][: len(x[1]) - n])


def _frames(values: np.ndarray, n: int) -> np.ndarray:
    """The last n values of each row, 0 before the first."""
    return np.lib.stride_tricks.sliding_window_view(np.append(np.zeros(n - 1, values.dtype), values), n)


def _mean(x: Known, n: int) -> Known:
    count = _frames(x[1].astype(np.int16), n).sum(axis=1)
    return _frames(x[0], n).sum(axis=1) / np.maximum(count, 1), count > 0


def _features_of(high: pa.ChunkedArray, low: pa.ChunkedArray, close: pa.ChunkedArray, volume: pa.ChunkedArray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of TECH_FEATURES for rows of whole symbols, ``at`` being the places in a symbol from 1."""
    # ``BACK`` empty rows before each symbol, so that no frame reaches into another one
    place = np.arange(len(at)) + BACK * np.cumsum(at == 1)
    size = place[-1] + 1 if len(at) else 0
    real = np.zeros(size, bool)
    real[place] = True

    def spread_out(column: pa.ChunkedArray) -> Known:
        values, there = np.zeros(size), np.zeros(size, bool)
        there[place] = pc.is_valid(column).to_numpy()
        values[place] = np.where(there[place], column.to_numpy(), 0.0)
        return values, there

    high, low, close, volume = map(spread_out, (high, low, close, volume))
    or_else = lambda x, value: np.where(x[1], x[0], value)
    out = {f"feat_ma{n}_dist": or_else(_change(close, _mean(close, n)), 0.0) for n in (5, 20, 60)}
    out |= {f"feat_momentum_{n}": or_else(_change(close, _back(close, n)), 0.0) for n in (3, 5, 10, 20, 60)}
    ret = _change(close, _back(close, 1))
    for n in (10, 30):
        frames, full = _frames(ret[0], n), _frames(ret[1].astype(np.int16), n).sum(axis=1) == n
        off = frames - frames.mean(axis=1, keepdims=True)
        out[f"feat_vol_{n}"] = np.where(full, np.sqrt((off * off).mean(axis=1)), 0.0)
    short, long = _mean(volume, 5), _mean(volume, 20)
    out["feat_volume_ratio"] = or_else(_change(volume, long, 0.0), 1.0)
    trend = or_else(_change(short, long, 0.0), 1.0)
    spread = _change((high[0] - low[0], high[1] & low[1]), close, 0.0)
    out["feat_hl_spread_5"] = _mean((or_else(spread, 0.0), real), 5)[0]
    return {"feat_volume_trend": np.where(at >= 20, trend[place], 1.0), **{c: x[place] for c, x in out.items()}}


def cs_rank(df: DataFrame, cols: list[str], by: str = "date", limit: int | None = GROUP_LIMIT, hot=UNSEEN) -> DataFrame:
    """Average-tie percentile rank per date as ``<col>_cs_rank``; NULL stays NULL. ``hot``: what ``hot_groups`` said about df's groups."""
    ranked = with_ranks(df, [by], cols, limit=limit, hot=hot)
    return ranked.select(*df.columns, *[percent_rank(c).alias(c + RANK_SUFFIX) for c in cols])


def _dealt(df: DataFrame, parts: int | None, *cols: str) -> DataFrame:
    return df if parts is None else df.repartition(parts, *cols)


def features_at(bars: DataFrame, keys: DataFrame, strict: bool = True, limit: int | None = GROUP_LIMIT, parts: int | None = None) -> DataFrame:
    """Features and their ranks for the requested (date, symbol) keys only.

    A key without a same-day bar fails the job (strict) or is dropped. Ranks are taken afterwards, so they
    compare the keys among themselves. ``parts``: partitions for the deals by key and by date, where the session's number would
    make a task's share grow with the table.
    """
    keys = keys.select("date", "symbol").distinct()
    wanted = bars.join(keys.select("symbol").distinct(), "symbol", "left_semi")
    feats = _dealt(technical_features(wanted, limit), parts, "date", "symbol")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no bar for "), F.col("symbol"), F.lit(" on "), F.col("date").cast("string")))
        first = TECH_FEATURES[0]
        found = keys.join(feats, ["date", "symbol"], "left").withColumn(
            first, F.when(F.col(first).isNull(), missing.cast("double")).otherwise(F.col(first))
        )
    else:
        found = keys.join(feats, ["date", "symbol"])
    hot = hot_groups(found, ["date"], limit)
    return cs_rank(_dealt(found, parts, "date"), TECH_FEATURES, limit=limit, hot=hot)


def enrich(panel: DataFrame, bars: DataFrame, cal: DataFrame | None = None, limit: int | None = GROUP_LIMIT, parts: int | None = None) -> DataFrame:
    """Recompute the ``feat_*`` columns of a panel; rows off the calendar or without a bar are dropped.

    A repeated (date, symbol) fails the job. ``parts`` as in ``features_at``.
    """
    base = panel.drop(*[c for c in panel.columns if c.startswith("feat_")])
    if cal is not None:
        base = base.join(F.broadcast(cal.select("date").distinct()), "date", "left_semi")
    repeated = F.raise_error(F.concat(F.lit("repeated key "), F.col("symbol"), F.lit(" "), F.col("date").cast("string")))
    keys = (
        _dealt(base.select("date", "symbol"), parts, "date", "symbol")
        .groupBy("date", "symbol")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.when(F.col("_n") > 1, repeated.cast("boolean")).otherwise(F.lit(True)))
    )
    feats = _dealt(features_at(bars, keys, strict=False, limit=limit, parts=parts), parts, "date", "symbol")
    return base.join(feats, ["date", "symbol"]).select(*base.columns, *technical_columns(feats.columns))


def without_bar(panel: DataFrame, bars: DataFrame) -> DataFrame:
    """Panel keys that ``enrich`` drops, counted per date."""
    lost = panel.select("date", "symbol").join(bars.select("date", "symbol"), ["date", "symbol"], "left_anti")
    return lost.groupBy("date").agg(F.count(F.lit(1)).alias("n_dropped"))


def technical_columns(columns: list[str]) -> list[str]:
    """Canonical order of ``feat_*`` names, each rank next to its base, unknown ones last."""
    paired = [c for base in TECH_FEATURES for c in (base, base + RANK_SUFFIX)]
    known = [c for c in paired if c in columns]
    return known + sorted(c for c in columns if c.startswith("feat_") and c not in known)


def feature_columns(columns: list[str], feature_set: str = "full") -> list[str]:
    """Column names of a feature set: 'emb' in numeric order, 'raw' technicals, 'full' both."""
    emb = sorted((c for c in columns if c.startswith("emb_")), key=lambda c: int(c[4:]))
    sets = {"emb": emb, "raw": technical_columns(columns), "full": emb + technical_columns(columns)}
    if feature_set not in sets:
        raise ValueError(f"unknown feature set: {feature_set}")
    return sets[feature_set]


def index_trend(bars: DataFrame) -> DataFrame:
    """State of each index on its last bar: averages, up-trend flag and trend strength in 0..1."""

    def step(df: DataFrame, w: WindowSpec) -> DataFrame:
        def mean(c: str, n: int) -> Column:
            frame = _tail(w, n)
            return F.when(F.count(c).over(frame) == n, F.avg(c).over(frame))

        volumes = df.withColumns(
            {
                "ma5": mean("close", 5),
                "ma20": mean("close", 20),
                "ma60": mean("close", 60),
                "vol_ma5": mean("volume", 5),
                "_prev": F.lag("close").over(w),
                "_close19": F.lag("close", 19).over(w),
                "_v5": F.avg("volume").over(w.rowsBetween(-4, 0)),
                "_v10": F.avg("volume").over(w.rowsBetween(-9, -5)),
                "_next": F.lead("date").over(w),
            }
        )
        return volumes.withColumn("_ma19", F.lag("ma5", 19).over(w))

    # the longest look back is 60 bars, of ma5 24: older bars go before the frames see them
    newest = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    recent = bars.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= 81).drop("_age")
    last = along(recent, step, back=80, ahead=1).where(F.col("_next").isNull())
    lift = (
        change("ma5", "_ma19") * 0.4
        + change("close", "_close19") * 0.4
        + F.least(change("_v5", "_v10"), F.lit(0.2)) * 0.2
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), lift * 10))
    strength = F.when(F.col("_close19").isNull(), F.lit(0.5)).when(lift.isNotNull(), bounded)
    up = (F.col("ma5") > F.col("ma20")) & (F.col("ma20") > F.col("ma60")) & (F.col("close") > F.col("ma20"))
    return last.select(
        "symbol",
        "date",
        "close",
        "ma5",
        "ma20",
        "ma60",
        "vol_ma5",
        (change("close", "_prev") * 100).alias("change_pct"),
        strength.alias("strength"),
        F.coalesce(up & (strength > 0.6), F.lit(False)).alias("uptrend"),
    )


def market_trend(trends: DataFrame) -> DataFrame:
    """Mean strength and majority vote over the indices."""
    share = ratio(count_if(F.col("uptrend")), F.count(F.lit(1)))
    return trends.agg(
        F.count(F.lit(1)).alias("n_index"),
        count_if(F.col("uptrend")).alias("n_uptrend"),
        F.avg("strength").alias("strength"),
        (share >= 0.5).alias("uptrend"),
    )


def slope_trend(bars: DataFrame, n: int = 20) -> DataFrame:
    """Least-squares slope of the last n closes times their number over their range, clipped to +-0.1."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    last = bars.select("symbol", "date", "close").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    slope = F.regr_slope(F.col("close"), -F.col("_r").cast("double"))
    count = F.count("close")
    raw = ratio(slope * count, F.max("close") - F.min("close"))
    # a flat line has no range; least and greatest would take the bound for it
    clipped = F.greatest(F.lit(-0.1), F.least(F.lit(0.1), F.coalesce(raw, F.lit(0.0))))
    return last.groupBy("symbol").agg(
        F.when(count < 2, F.lit(0.0)).otherwise(clipped).alias("trend")
    )


def mean_pool(vectors: DataFrame, by: list[str], col: str = "embedding") -> DataFrame:
    """Element-wise mean of the vectors of a group."""
    items = vectors.select(*by, F.posexplode(col).alias("pos", "x"))
    means = items.groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_p"))
    return packed.select(*by, F.transform("_p", lambda p: p["x"]).alias("pooled"))


def concat_pools(pools: list[DataFrame], by: list[str]) -> DataFrame:
    """Join pools of the same groups and chain their vectors."""
    out = pools[0]
    for nxt in pools[1:]:
        right = nxt.withColumnRenamed("pooled", "_next")
        out = out.join(right, by).withColumn("pooled", F.concat("pooled", "_next")).drop("_next")
    return out


def sign_code(vectors: DataFrame, s1_bits: int, s2_bits: int, col: str = "embedding") -> DataFrame:
    """Codes from the signs of a vector, lowest bit first: the first s1 bits and the next s2 bits.

    Scaling a vector to unit length keeps its signs, so the codes need no normalisation.
    """

    def code(start: int, bits: int) -> Column:
        positive = F.transform(F.slice(col, start, bits), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i)).otherwise(0.0))
        return F.aggregate(positive, F.lit(0.0), lambda a, b: a + b).cast("long")

    return vectors.withColumns({"s1": code(1, s1_bits), "s2": code(s1_bits + 1, s2_bits)})


def unit_signs(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    """The unit-length vector and its decoded sign vector (+-1/sqrt(dim))."""
    norm = F.sqrt(F.aggregate(col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    side = F.lit(1.0) / F.sqrt(F.size(col).cast("double"))
    return vectors.withColumns(
        {
            "unit": F.transform(col, lambda x: ratio(x, norm)),
            "decoded": F.transform(col, lambda x: F.when(x > 0, side).otherwise(-side)),
        }
    )
