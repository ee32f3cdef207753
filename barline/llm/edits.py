"""The next document in descending id order beside each document, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import partitions

#: Quantile segments of the ids; each is cut evenly by id into further buckets.
SEGMENTS = 128
#: Buckets a shuffle partition.
PER_PARTITION = 8


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (doc_id, ..) with next_<c> for each of columns, from the row that follows in descending doc_id order.

    The last row is followed by the first. Rows of equal id follow each other in any order; a null id has no place: such
    a row has no next row (nulls) and is nobody's. A single row follows itself.

    Ids are cut into buckets at their quantiles. Each bucket is one window; the first rows of a bucket are also sent to
    the bucket before it, where they close the gap. The only table that is not spread has one row a bucket.
    """
    buckets = max(SEGMENTS, PER_PARTITION * partitions(rows.sparkSession))
    inner = -(-buckets // SEGMENTS)
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / SEGMENTS) for i in range(SEGMENTS + 1)]), F.lit(20_000))).first()[0]
    if not cuts:
        return rows.select("*", *[F.lit(None).cast(dict(rows.dtypes)[c]).alias(f"next_{c}") for c in columns])
    cuts = sorted(set(cuts))
    # segment: the number of cuts at or below the id; inside it the id's share of the way to the next cut
    edges = "array(" + ",".join(f"{c}L" for c in cuts) + ")"
    starts, ends = f"array({cuts[0]}L,{','.join(f'{c}L' for c in cuts)})", f"array({','.join(f'{c}L' for c in cuts)},{cuts[-1]}L)"
    placed = rows.withColumn("_seg", F.expr(f"size(filter({edges}, c -> c <= doc_id))"))
    share = f"least({inner - 1}L, greatest(0L, cast((cast(doc_id as double) - {starts}[_seg]) / ({ends}[_seg] - {starts}[_seg] + 1.0D) * {inner} as bigint)))"
    placed = placed.withColumn("_bucket", F.expr(f"CASE WHEN doc_id IS NOT NULL THEN _seg * {inner}L + {share} END")).drop("_seg")
    heads = placed.where(F.col("doc_id").isNotNull()).groupBy("_bucket").agg(F.max("doc_id").alias("_head"))
    line = Window.orderBy(F.col("_bucket").desc())  # one row a bucket
    heads = heads.select(
        F.col("_head"),
        F.coalesce(
            F.lag("_bucket").over(line), F.min("_bucket").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        ).alias("_before"),
    )
    # at most SEGMENTS * inner rows of two longs
    marked = placed.join(F.broadcast(heads), F.col("doc_id") == F.col("_head"), "left").drop("_head")
    guest = F.struct(F.col("_before").alias("b"), F.lit(True).alias("g"))
    home = F.struct(F.coalesce("_bucket", -F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)) - 1).alias("b"), F.lit(False).alias("g"))
    spread = marked.withColumn("_at", F.explode(F.when(F.col("_before").isNotNull(), F.array(home, guest)).otherwise(F.array(home))))
    spread = spread.select(*rows.columns, F.col("_at.b").alias("_b"), F.col("_at.g").alias("_g"))
    order = Window.partitionBy("_b").orderBy("_g", F.col("doc_id").desc())
    after = [F.when(F.col("doc_id").isNotNull(), F.lead(c).over(order)).alias(f"next_{c}") for c in columns]
    return spread.select("*", *after).where(~F.col("_g")).drop("_b", "_g")
