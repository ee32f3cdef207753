"""Ranks inside groups that may be far larger than one task can sort.

A cross-section (all rows of one date) has no natural upper size. Groups up to ``limit``
rows are ranked with ordinary windows, or, where many columns are ranked at once, as arrays in one pass over the group.
Larger groups are cut into value ranges first, more of them the larger the
group: the cut points are approximate quantiles, the counts per range are exact, so the ranks are exact
too. A value that more than ``limit`` rows share needs no sort at all: its rank follows from the counts, and the turns
inside it from ranges of the key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP_LIMIT = 5_000_000
#: Value ranges for each ``limit`` rows of a large group, and sampled cut points of the key.
CUTS = 4
SALTS = 64
GROUP_LIMIT_MAX_K = 1000


def hot_groups(df: DataFrame, by: list[str], limit: int | None = GROUP_LIMIT) -> DataFrame | None:
    """A local table (by.., ``_rows``) of the groups above ``limit`` rows, or None if there are none.

    One aggregate that reads the keys only; at most rows / limit keys come out, hence it is safe to collect and to
    broadcast. Callers that rank one panel several times look once and hand the result on.
    """
    if limit is None:
        return None
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    found = sizes.collect()
    return df.sparkSession.createDataFrame(found, sizes.schema) if found else None


#: Stands for "not looked yet" where None says that no group is large.
UNSEEN = object()


def split_hot(df: DataFrame, by: list[str], limit: int | None, hot=UNSEEN) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary groups, and rows of groups above ``limit`` or None if there are no such groups.

    The sizes are looked at here unless the caller brings them. Without the answer every plan would have to carry both
    ways. ``limit`` None skips the look, for callers who know their groups.
    """
    hot = hot_groups(df, by, limit) if hot is UNSEEN else hot
    if hot is None:
        return df, None
    keys = F.broadcast(hot.select(*by))
    return df.join(keys, by, "left_anti"), df.join(keys, by, "left_semi")


def with_ranks(
    df: DataFrame,
    by: list[str],
    cols: list[str],
    key: str = "symbol",
    limit: int | None = GROUP_LIMIT,
    turns: bool = False,
    hot=UNSEEN,
) -> DataFrame:
    """Add a struct ``<col>_rk`` per column: n (values present), below, equal and, if asked for, turn.

    ``below`` counts smaller values, ``equal`` counts rows with the same value and ``turn`` is
    the position among those by ``key`` (a string), for which each column is sorted once more.
    NULLs take no part and get NULL. (by, key) is unique. ``hot``: what ``hot_groups`` said about df's groups.
    """
    hot = hot_groups(df, by, limit) if hot is UNSEEN else hot
    cold, large = split_hot(df, by, limit, hot)
    as_arrays = len(cols) >= ARRAY_COLUMNS and _has_array_form(df, cols)
    ranked = (_ranks_by_array if as_arrays else _ranks_by_window)(cold, by, cols, key, turns)
    if large is None:
        return ranked
    most = hot.agg(F.max("_rows")).first()[0]
    return ranked.unionByName(_ranks_by_range(large, by, cols, key, turns, max(1, limit), most))


def average_rank(col: str) -> Column:
    rk = F.col(f"{col}_rk")
    return rk["below"] + (rk["equal"] + 1) / 2


def percent_rank(col: str) -> Column:
    """Average-tie rank over the number of values, as a share."""
    return average_rank(col) / F.col(f"{col}_rk")["n"]


def with_shares(df: DataFrame, by: list[str], cols: list[str], key: str = "symbol", limit: int | None = GROUP_LIMIT, sized: list[str] = ()) -> DataFrame:
    """Add ``<col>_share`` per column, what ``percent_rank`` makes of ``with_ranks``, and ``<col>_n``, the number of values, for those in ``sized``.

    One number a value leaves the task of a group instead of three; groups above ``limit`` rows are ranked by ranges.
    """
    hot = hot_groups(df, by, limit)
    cold, large = split_hot(df, by, limit, hot)
    added = [*[T.StructField(f"{c}_share", T.DoubleType()) for c in cols], *[T.StructField(f"{c}_n", T.LongType()) for c in sized]]
    schema = T.StructType([*df.schema.fields, *added])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        out = group
        counts = {}
        for c in cols:
            column = group.column(c)
            values = column.drop_null().to_numpy()
            counts[c] = len(values)
            share = average_ranks(values) / max(len(values), 1)
            if column.null_count:
                there = pc.is_valid(column).to_numpy()
                wide = np.zeros(group.num_rows)
                wide[there] = share
                out = out.append_column(f"{c}_share", pa.array(wide, mask=~there))
            else:
                out = out.append_column(f"{c}_share", pa.array(share))
        for c in sized:
            out = out.append_column(f"{c}_n", pa.array(np.full(group.num_rows, counts[c])))
        yield from out.combine_chunks().to_batches(max_chunksize=BATCH)

    shares = cold.groupBy(*by).applyInArrow(add, schema)
    if large is None:
        return shares
    most = hot.agg(F.max("_rows")).first()[0]
    ranked = _ranks_by_range(large, by, cols, key, False, max(1, limit), most)
    return shares.unionByName(ranked.select(*df.columns, *[percent_rank(c).alias(f"{c}_share") for c in cols], *[F.col(f"{c}_rk")["n"].alias(f"{c}_n") for c in sized]))


def average_ranks(values: np.ndarray) -> np.ndarray:
    """1 for the smallest value, the mean of their places for equal ones; NaN sorts last and equals itself, -0.0 equals 0.0."""
    order = np.argsort(values)
    there = values[order]
    new = np.ones(len(there), bool)
    new[1:] = (there[1:] != there[:-1]) & ~((there[1:] != there[1:]) & (there[:-1] != there[:-1]))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(there)))
    ranks = np.empty(len(there))
    ranks[order] = np.repeat(starts + (sizes + 1) / 2, sizes)
    return ranks


def place_up(col: str) -> Column:
    """1 for the smallest value, ties by key."""
    rk = F.col(f"{col}_rk")
    return rk["below"] + rk["turn"]


def place_down(col: str) -> Column:
    """1 for the largest value, ties by key."""
    rk = F.col(f"{col}_rk")
    return rk["n"] - rk["below"] - rk["equal"] + rk["turn"]


def _ranks_by_window(df: DataFrame, by: list[str], cols: list[str], key: str, turns: bool) -> DataFrame:
    group = Window.partitionBy(*by)
    parts = {}
    for c in cols:
        w = group.orderBy(F.col(c).asc_nulls_last())
        below = F.rank().over(w).cast("long") - 1
        upto = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        fields = [F.count(c).over(group).alias("n"), below.alias("below"), (upto - below).alias("equal")]
        if turns:
            place = F.row_number().over(group.orderBy(F.col(c).asc_nulls_last(), key)).cast("long")
            fields.append((place - below).alias("turn"))
        parts[f"{c}_rk"] = F.when(F.col(c).isNotNull(), F.struct(*fields))
    return df.select("*", *[x.alias(n) for n, x in parts.items()])


def _has_array_form(df: DataFrame, cols: list[str]) -> bool:
    """Numbers in the ranked columns, and no type of Spark ML's beside them."""
    number = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    return all(isinstance(df.schema[c].dataType, number) for c in cols) and not any(isinstance(f.dataType, T.UserDefinedType) for f in df.schema.fields)


#: From so many ranked columns on, one pass over arrays takes the place of a sort per column. Few columns over thousands of small
#: groups are quicker with windows.
ARRAY_COLUMNS = 3
#: Rows of a group that leave its task at a time.
BATCH = 10_000


def _ranks_by_array(df: DataFrame, by: list[str], cols: list[str], key: str, turns: bool) -> DataFrame:
    """One sort of each column of a group, in a task that holds the group's columns and two or three numbers a value."""
    names = ["n", "below", "equal", *(["turn"] if turns else [])]
    rank = T.StructType([T.StructField(n, T.LongType()) for n in names])
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"{c}_rk", rank) for c in cols]])
    kinds = pa.struct([pa.field(n, pa.int64()) for n in names])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        by_key = pc.rank(group.column(key), tiebreaker="first", null_placement="at_start").to_numpy() if turns else None
        ranks = []
        for c in cols:
            there = pc.is_valid(group.column(c)).to_numpy()
            values = group.column(c).drop_null().to_numpy()
            # NaN sorts last and equals itself, -0.0 equals 0.0, as in Spark
            in_order = np.sort(values)
            below = np.searchsorted(in_order, values, side="left")
            found = [below, np.searchsorted(in_order, values, side="right") - below]
            if turns:
                place = np.empty(len(values), dtype=np.int64)
                place[np.lexsort((by_key[there], values))] = np.arange(1, len(values) + 1)
                found.append(place - below)
            wide = [np.zeros(group.num_rows, dtype=np.int32) for _ in found]
            for w, f in zip(wide, found):
                w[there] = f
            ranks.append((there, len(values), wide))
        at = 0
        for batch in group.to_batches(max_chunksize=BATCH):
            part, at = slice(at, at + batch.num_rows), at + batch.num_rows
            out = list(batch.columns)
            for there, n, wide in ranks:
                numbers = [np.full(batch.num_rows, n), *[w[part].astype(np.int64) for w in wide]]
                out.append(pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in numbers], fields=list(kinds), mask=pa.array(~there[part])))
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *[f"{c}_rk" for c in cols]])

    return df.groupBy(*by).applyInArrow(add, schema)


def _ranks_by_range(df: DataFrame, by: list[str], cols: list[str], key: str, turns: bool, limit: int, most: int) -> DataFrame:
    item = [*by, "_col"]
    kinds: dict[str, list[str]] = {}
    for c, kind in df.select(*cols).dtypes:
        kinds.setdefault(kind, []).append(c)
    ranked = []
    for same in kinds.values():  # values keep their type: one table for each
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).alias("_v")) for c in same]))
        long = df.select(*by, F.col(key).alias("_key"), pairs.alias("_p")).select(*by, "_key", "_p._col", "_p._v").where("_v is not null")
        ranked.append(_rank_long(long, item, turns, limit, most))
    wide = union_all(ranked).groupBy(*by, F.col("_key").alias(key)).agg(*[F.max(F.when(F.col("_col") == c, F.col("_rk"))).alias(f"{c}_rk") for c in cols])
    return df.join(wide, [*by, key], "left")


def _rank_long(long: DataFrame, item: list[str], turns: bool, limit: int, most: int) -> DataFrame:
    """(item.., _key, _rk) of (item.., _key, _v). Every table that is broadcast has a few times rows / limit rows."""
    heavy = long.groupBy(*item, "_v").agg(F.count(F.lit(1)).alias("_ties")).where(F.col("_ties") > limit)
    steps = max(2, CUTS * -(-most // limit))
    quantiles = long.groupBy(*item).agg(F.percentile_approx("_v", [i / steps for i in range(1, steps)], 10 * steps).alias("_q"))
    tops = heavy.groupBy(*item).agg(F.collect_list("_v").alias("_h"))
    cuts = quantiles.join(tops, item, "left").select(*item, F.array_sort(F.array_distinct(F.concat("_q", F.coalesce("_h", F.slice("_q", 1, 0))))).alias("_cut"))
    marked = long.join(F.broadcast(cuts), item).join(F.broadcast(heavy), [*item, "_v"], "left")
    # with c cuts below: a heavy value on the next cut is range 2c + 1, other values up to that cut are range 2c
    at = F.size(F.filter("_cut", lambda x: x < F.col("_v"))) * 2 + F.when(F.col("_ties").isNotNull(), 1).otherwise(0)
    placed = marked.withColumn("_range", at).drop("_cut")
    if turns:
        # key cut points inside heavy values: a hash takes about CUTS * ties / limit of the whole keys
        sample = placed.where(F.col("_ties").isNotNull() & (F.pmod(F.xxhash64("_key"), F.lit(max(1, limit // CUTS))) == 0))
        keys = sample.groupBy(*item, "_v").agg(F.array_sort(F.collect_list("_key")).alias("_kcut"))
        placed = placed.join(F.broadcast(keys), [*item, "_v"], "left")
        part = F.when(F.col("_kcut").isNotNull(), F.size(F.filter("_kcut", lambda x: x < F.col("_key")))).otherwise(0)
        placed = placed.withColumn("_part", part).drop("_kcut")
    else:
        placed = placed.withColumn("_part", F.lit(0))
    cell = [*item, "_range", "_part"]
    sizes = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(*item)
    in_order = whole.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *cell,
        F.coalesce(F.sum("_size").over(in_order), F.lit(0)).alias("_before"),
        F.sum("_size").over(whole).alias("_n"),
    ).withColumn("_range_before", F.min("_before").over(Window.partitionBy(*item, "_range")))
    placed = placed.join(F.broadcast(offsets), cell)
    own, tied = placed.where("_ties is null"), placed.where("_ties is not null")
    w = Window.partitionBy(*cell)
    by_value = w.orderBy("_v")
    below_here = F.rank().over(by_value).cast("long") - 1
    upto_here = F.count(F.lit(1)).over(by_value.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own_fields = [F.col("_n").alias("n"), (F.col("_before") + below_here).alias("below"), (upto_here - below_here).alias("equal")]
    tied_fields = [F.col("_n").alias("n"), F.col("_range_before").alias("below"), F.col("_ties").alias("equal")]
    if turns:
        own_fields.append((F.row_number().over(w.orderBy("_v", "_key")).cast("long") - below_here).alias("turn"))
        turn = F.col("_before") - F.col("_range_before") + F.row_number().over(w.orderBy("_key")).cast("long")
        tied_fields.append(turn.alias("turn"))
    return own.select(*item, "_key", F.struct(*own_fields).alias("_rk")).unionByName(tied.select(*item, "_key", F.struct(*tied_fields).alias("_rk")))


def best_k(df: DataFrame, by: list[str], score: str, k: int, key: str = "symbol") -> DataFrame:
    """The k highest scores per group, ties by key, with ``place`` 1..k.

    ``row_number() <= k`` lets Catalyst keep only k rows per group and map task before the shuffle. It does so up
    to k = 1000; above that, salted parts of each group are cut to k first.
    """
    order = [F.col(score).desc(), F.col(key)]
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    if k > GROUP_LIMIT_MAX_K:
        part = Window.partitionBy(*by, "_salt").orderBy(*order)
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
        rows = salted.withColumn("_p", F.row_number().over(part)).where(F.col("_p") <= k).drop("_salt", "_p")
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def range_join(
    left: DataFrame,
    right: DataFrame,
    left_date: str,
    low: str,
    high: str,
    width: int,
    on: list[str] | None = None,
    calendar_sized: bool = False,
) -> DataFrame:
    """Rows of ``left`` whose date lies in [low, high] of a ``right`` row.

    Each interval is listed under every ``width``-day slot it touches, so this is an equi-join with a
    residual filter instead of a nested loop. A ``right`` of at most one row per day is broadcast: slots
    alone would be far too few keys to shuffle by.
    """
    slot = lambda c: F.floor(F.unix_date(F.col(c)) / F.lit(width))
    slotted = right.withColumn("_slot", F.explode(F.sequence(slot(low), slot(high))))
    if calendar_sized:
        slotted = F.broadcast(slotted)
    return (
        left.withColumn("_slot", slot(left_date))
        .join(slotted, [*(on or []), "_slot"])
        .where(F.col(left_date).between(F.col(low), F.col(high)))
        .drop("_slot")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
