"""Writing panels and result documents, and reading result documents back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.sources.bars import BAR_SCHEMA, open_panel, upsert_bars

RESULT_SCHEMA = "run string, variant string, dates array<string>, daily_returns array<double>, metrics map<string,double>"


def write_panel(df: DataFrame, path: str, by: str = "year", fmt: str = "parquet") -> None:
    """One directory per year, rows clustered by symbol.

    Ranges of (year, symbol, date) keep files few and of even size, also where one symbol or year dominates.
    """
    part = df.withColumn("year", F.year("date")) if by == "year" else df
    order = [c for c in (by, "symbol", "date") if c in part.columns]
    ranged = part.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = ranged.write.mode("overwrite").partitionBy(by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def _by_year(rows: DataFrame):
    order = ["year", "symbol", "date"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("year")


def merge_panel(updates: DataFrame, path: str, staging: str, seq: str = "seq") -> list[int]:
    """Upsert into the panel that ``write_panel`` stored at path; returns the years it touched.

    Only the years of the updates (one number a year reaches the driver) are read and rewritten, all other files stay as
    they are. The merged years are written to ``staging`` first, a folder of this batch alone, and replace the panel's from
    there: a merge that broke off half-way is called again with the same staging and repeats the second step. The same batch
    twice gives the same table. Among updates of one key the highest ``seq`` wins. Updates without a symbol or date
    name no bar and are left out; without updates nothing is written.
    """
    spark = updates.sparkSession
    mark = spark._jvm.org.apache.hadoop.fs.Path(staging, "_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        new = updates.where("symbol is not null and date is not null")
        years = sorted(r[0] for r in new.select(F.year("date")).distinct().collect())
        if not years:
            return []
        base = open_panel(spark, path).where(F.col("year").isin(years)).drop("year")
        _by_year(upsert_bars(base, new, seq).withColumn("year", F.year("date"))).parquet(staging)
    merged = spark.read.schema(f"{BAR_SCHEMA}, year int").parquet(staging)
    _by_year(merged).option("partitionOverwriteMode", "dynamic").parquet(path)
    return sorted(r[0] for r in merged.select("year").distinct().collect())


def store_by_symbol(df: DataFrame, path: str, name: str, buckets: int | None = None) -> DataFrame:
    """df as a table bucketed by symbol and sorted by (symbol, date), one file a bucket; returns the stored table.

    Windows along a symbol read it without an exchange, joins by symbol with a table of as many buckets too. Rows are dealt
    once, by the hash that the buckets use. buckets: the session's shuffle partitions unless given; a bucket is what
    one task reads, so large panels want more of them. An existing table of that name is replaced. Rows without a symbol share a
    bucket; an empty table gives an empty table.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [c for c in ("symbol", "date") if c in df.columns]
    dealt = df.repartition(n, "symbol").sortWithinPartitions(*order)
    dealt.write.mode("overwrite").format("parquet").bucketBy(n, "symbol").sortBy(*order).option("path", path).saveAsTable(name)
    return spark.table(name)


def open_by_symbol(spark: SparkSession, path: str, name: str, schema: str, buckets: int) -> DataFrame:
    """A table that ``store_by_symbol`` wrote at path in another session, with its layout. schema and buckets must be those it was written with."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY (symbol) SORTED BY (symbol, date) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_result_doc(ret: DataFrame, metrics: DataFrame, path: str, run: str = "run") -> None:
    """JSON lines, one for each variant of a run: its dates, daily returns and metrics.

    A line has one value per trading day; variants are spread over the tasks.
    """
    days = F.array_sort(F.collect_list(F.struct("date", "ret")))
    series = ret.groupBy("variant").agg(days.alias("_s")).select(
        "variant",
        F.transform("_s", lambda x: x["date"].cast("string")).alias("dates"),
        F.transform("_s", lambda x: x["ret"]).alias("daily_returns"),
    )
    names = [c for c in metrics.columns if c != "variant"]
    pairs = F.map_from_entries(
        F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in names])
    )
    doc = series.join(metrics.select("variant", pairs.alias("metrics")), "variant")
    lines = doc.select(F.lit(run).alias("run"), F.col("variant").cast("string").alias("variant"), "dates", "daily_returns", "metrics")
    lines.write.mode("overwrite").json(path)


def read_result_docs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Long table (run, variant, date, ret, metrics) from one or many documents."""
    zipped = F.explode(F.arrays_zip(F.col("dates").alias("date"), F.col("daily_returns").alias("ret")))
    rows = spark.read.schema(RESULT_SCHEMA).json(path).select("run", "variant", "metrics", zipped.alias("d"))
    return rows.select("run", "variant", F.col("d.date").cast("date").alias("date"), F.col("d.ret").alias("ret"), "metrics")


def cached_scores(df: DataFrame, path: str) -> DataFrame:
    """Write scores or paths once and read them back, for any number of sweeps."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compare_runs(docs: DataFrame) -> DataFrame:
    """(run, variant, metric, value) across documents."""
    return docs.groupBy("run", "variant").agg(F.first("metrics").alias("_m")).select(
        "run", "variant", F.explode("_m").alias("metric", "value")
    )
