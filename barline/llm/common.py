"""Helpers shared by the operators: tables in the cluster's shared folder, row runs, distributed places."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOCAL_ROOT: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir. Where that is unset, a session inside one machine gets a folder of its own; any other fails."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not LOCAL_ROOT:
            LOCAL_ROOT.append(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
        root = LOCAL_ROOT[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: the lineage ends there, lost executors repeat nothing before it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """crc32 of the id as text, modulo folds, equals fold. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def places(df: DataFrame, group: list[str], order: list[Column], name: str, spread: int = 64, salt: list[str] | None = None) -> DataFrame:
    """df with `name`: places 0, 1, .. without gaps inside each group, in no stated order between salted cells.

    A hot group is split into `spread` cells by a hash of `salt`; cells are numbered on their own (ordered by
    `order`) and moved by the summed counts of the cells before them. Nothing gathers a whole group in a task.
    """
    keys = [*group, "_cell"]
    cut = df.withColumn("_cell", F.pmod(F.xxhash64(*[F.col(c) for c in (salt or [])]), F.lit(spread)).cast("int"))
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = cut.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    out = inside.join(starts, on)
    return out.withColumn(name, (F.col("_at") + F.col("_start")).cast("long")).drop("_cell", "_at", "_start", *[f"_k_{k}" for k in keys])


def slices(batches: Iterable[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a text column holds `size` bytes or a single row: what tasks build from a slice stays small."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
        piece = lengths.cumsum() // size
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(piece.searchsorted(piece[start], side="right")))
            yield batch.slice(start, end - start)
            start = end


def runs(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal key columns, put together across batches. The input is clustered by key."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in key]
        values = list(zip(*cols))
        start = 0
        for i, v in enumerate(values):
            if v != last:
                if i > start:
                    kept.append(batch.slice(start, i - start))
                if kept:
                    yield pa.Table.from_batches(kept)
                kept, start, last = [], i, v
        kept.append(batch.slice(start))
    if kept:
        yield pa.Table.from_batches(kept)
