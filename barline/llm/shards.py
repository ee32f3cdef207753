"""Sharding along a Hilbert curve: rows close in several metadata dimensions share a file, so files can be skipped.

Method: every dimension is quantised to 2^bits levels at its quantiles, the levels give a place on a Hilbert
curve, rows are ordered by that place and the order is cut into runs of equal row count, one run a shard.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import partitions, places, stored

#: Rows of one curve cell are numbered in so many independent sub-cells.
SPREAD = 64


def hilbert_index(levels: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with `bits` bits a dimension (bits times dimensions up to 62).

    Axes become the transposed index by undoing excess work bit by bit and Gray-coding the result.
    """
    x = [np.asarray(v, dtype=np.int64).copy() for v in levels]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            swap = (x[i] & q) == 0
            t = np.where(swap, (x[0] ^ x[i]) & low, 0)
            x[0] = np.where(swap, x[0] ^ t, x[0] ^ low)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


def text_cuts(rows: DataFrame, columns: list[str], parts: int) -> dict[str, list[str]]:
    """The values at ranks n/parts, 2n/parts, .. of each text column, n its rows that are not null; whole values, counted exactly.

    Rows are counted by value first. Values lie in ranges of their order, so that their counts add up in many tasks; the
    driver sees the sum of each range and the cuts.
    """
    if not columns:
        return {}
    spark = rows.sparkSession
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(c).alias("value")) for i, c in enumerate(columns)])).alias("x")
    counts = rows.select(values).select("x.*").where("value IS NOT NULL").groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))
    ranged = stored(counts, "values").repartitionByRange(partitions(spark), "dim", "value").withColumn("run", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    sums = ranged.groupBy("dim", "run").agg(F.sum("n").alias("n")).orderBy("dim", "run").collect()
    total: dict[int, int] = defaultdict(int)
    starts = []
    for r in sums:
        starts.append((r["dim"], r["run"], total[r["dim"]]))
        total[r["dim"]] += r["n"]
    ranks = [(d, -(-n * j // parts)) for d, n in total.items() for j in range(1, parts)]
    if not ranks:
        return {}
    wanted: dict[tuple[int, int, int], list[int]] = {}
    for d, rank in ranks:
        start = max((s for s in starts if s[0] == d and s[2] < rank), key=lambda s: s[2])
        wanted.setdefault(start, []).append(rank)
    asked = spark.createDataFrame([(*k, sorted(set(v))) for k, v in wanted.items()], "_dim int, _run int, _start long, _ranks array<long>")
    # only ranges with a cut are read again
    mine = ranged.join(F.broadcast(asked), (F.col("dim") == F.col("_dim")) & (F.col("run") == F.col("_run")))
    upto = F.col("_start") + F.sum("n").over(Window.partitionBy("dim", "run").orderBy("value"))
    found = mine.withColumn("_upto", upto).where(F.exists("_ranks", lambda r: (r <= F.col("_upto")) & (r > F.col("_upto") - F.col("n"))))
    out: dict[str, list[str]] = defaultdict(list)
    for r in found.select("dim", "value").collect():
        out[columns[r["dim"]]].append(r["value"])
    return out


def hilbert_shards(
    docs: DataFrame, shards: int = 24, dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, size, text_crc32, curve, position, shard, slot) of every row of docs.

    size: UTF-8 bytes of the text plus 8. Shards take runs of the curve order whose row counts differ by one at
    most. Inside a curve cell rows follow a hash and then the id. Quantiles of numbers come from one pass over all rows,
    those of texts from the exact counts of their whole values; only the 2^bits - 1 cuts of each dimension, and for
    texts the row count of each range of values, reach the driver.

    Null dimensions take the lowest level, null texts have no bytes (crc32 0), a null id is kept as it is, repeated
    rows each get their own slot, an empty table gives no rows. Extra columns are ignored. Dimensions missing from
    docs raise an AnalysisException.
    """
    kinds = dict(docs.dtypes)
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        *[(F.col(d) if kinds.get(d) == "string" else F.col(d).cast("double")).alias(f"_d{i}") for i, d in enumerate(dims)],
    )
    texts = [f"_d{i}" for i, d in enumerate(dims) if kinds.get(d) == "string"]
    numbers = [f"_d{i}" for i in range(len(dims)) if f"_d{i}" not in texts]
    cuts: dict[str, list] = dict(text_cuts(rows, texts, 2**bits))
    if numbers:
        steps = F.array(*[F.lit((j + 1) / 2**bits) for j in range(2**bits - 1)])
        cuts |= rows.agg(*[F.percentile_approx(c, steps, F.lit(10_000)).alias(c) for c in numbers]).first().asDict()

    def level(i: int) -> Column:
        edges = sorted(set(cuts.get(f"_d{i}") or []))
        if not edges:
            return F.lit(0)
        return F.coalesce(F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(f"_d{i}"))), F.lit(0))

    @F.pandas_udf("long")
    def curve(levels: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([levels[c].to_numpy() for c in levels.columns], bits))

    cells = rows.select("doc_id", "size", "text_crc32", curve(F.struct(*[level(i).alias(f"l{i}") for i in range(len(dims))])).alias("curve"))
    placed = places(cells, ["curve"], [F.col("doc_id"), F.col("text_crc32")], "_place", SPREAD, ["doc_id", "text_crc32"])
    # one row for each curve cell, 2^(bits * dims) at most whatever the input: their running sum may sit in one task
    counts = cells.groupBy("curve").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy("curve")
    starts = counts.select(
        F.col("curve").alias("_curve"),
        F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_rows"),
    )
    at = placed.join(starts, F.col("curve") == F.col("_curve")).withColumn("position", F.col("_start") + F.col("_place"))
    # shard s starts at the first position p with p * shards >= s * rows
    shard = F.expr(f"(position * {shards}) div _rows")
    begin = F.expr(f"(shard * _rows + {shards - 1}) div {shards}")
    return (
        at.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("position") - begin).cast("long"))
        .select("doc_id", "size", "text_crc32", "curve", "position", "shard", "slot")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 1_000_000) -> None:
    """docs as Parquet below path/shard=N, in slot order. Large shards are cut into several files.

    Rows are matched by id and crc32 of the text; rows alike in both (repeated rows, null ids) are numbered on both sides, as
    any of them may take any of their slots: each row is written once. An empty table writes no file. A column of
    docs named shard or slot is replaced.
    """
    alike = ["id_", "crc_", "turn_"]
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    key = docs.select(*names)
    for a in range(len(alike)):  # names that docs does not have
        while alike[a] in names:
            alike[a] += "_"
    ident, crc, turn = alike
    number = lambda order: F.row_number().over(Window.partitionBy(ident, crc).orderBy(order))
    where = placed.select(F.col("doc_id").alias(ident), F.col("text_crc32").alias(crc), "shard", "slot").withColumn(turn, number("slot")).withColumn("_run", F.expr(f"slot div {max_rows}"))
    own = key.withColumns({ident: F.col(id_col), crc: F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long")}).withColumn(turn, number(F.lit(0)))
    right = where.select(*[F.col(c).alias(f"{c}r") for c in alike], "shard", "slot", "_run")
    on = F.col(ident).eqNullSafe(F.col(f"{ident}r")) & (F.col(crc) == F.col(f"{crc}r")) & (F.col(turn) == F.col(f"{turn}r"))
    out = own.join(right, on).select(*names, "shard", "slot", "_run")
    out.repartition("shard", "_run").sortWithinPartitions("shard", "slot").drop("_run").write.partitionBy("shard").parquet(path)
