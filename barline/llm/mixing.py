"""Mixing sources to target weights by Poisson replication.

Method: a source's rate is its target share of the output over its share of the input. Every document draws its number
of copies from the Poisson distribution of its source's rate by inverting the distribution function at a uniform number
hashed from the seed and the document, is exploded by that number, and the copies are shuffled globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import stored

#: Most sources whose rates are broadcast.
BROADCAST_SOURCES = 10_000
DIGITS = 13  # hexadecimal digits of a uniform number: 52 bits fit a double


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from md5 of the seed and the columns as text; null counts as the text 'null'."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def distribution(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), .. for rate, as far as a 52-bit uniform number can tell (mean + 12 deviations + 30).

    Terms are kept as logarithms, so that a rate beyond 745, where exp(-rate) is zero, still works.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    empty = F.expr("cast(array() as array<double>)")
    folded = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct((-rate).alias("term"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("all")),
        lambda acc, k: F.struct(
            (acc["term"] + F.ln(rate) - F.ln(k.cast("double"))).alias("term"),
            (acc["total"] + F.exp(acc["term"] + F.ln(rate) - F.ln(k.cast("double")))).alias("total"),
            F.array_append(acc["all"], acc["total"] + F.exp(acc["term"] + F.ln(rate) - F.ln(k.cast("double")))).alias("all"),
        ),
        lambda acc: acc["all"],
    )
    return F.when(rate > 0, folded).otherwise(empty)


def mixing_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, source_col: str = "source") -> DataFrame:
    """(source, n_docs, weight, rate): one row a source of docs.

    weights: target shares (any positive scale) by source, 0 for sources left out; None: the square root of the source's
    rows. total: expected rows of the mix, as many as docs has by default. A null source is a source like any other.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weight = F.sqrt(F.col("n_docs").cast("double"))
    else:
        weight = F.lit(0.0)
        for name, share in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(weight)
    sums = counts.withColumn("weight", weight)
    # summed in exact decimals, so that the order of the sources does not matter
    both = sums.agg(F.sum(F.col("weight").cast("decimal(28,10)")).cast("double"), F.sum("n_docs")).first()
    all_weight, goal = both[0] or 0.0, float(total if total is not None else both[1] or 0)
    rate = F.col("weight") / F.lit(all_weight) * F.lit(goal) / F.col("n_docs") if all_weight > 0 else F.lit(0.0)
    return sums.select("source", "n_docs", "weight", rate.alias("rate"))


def poisson_mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", shuffle: bool = True
) -> DataFrame:
    """docs with every row repeated by its Poisson draw, plus `copy` (from 1) and `copies`, in a globally shuffled order.

    The draw hangs on the seed and the id alone, so runs and retries agree. A hash of the seed, the id
    and the copy deals the copies out to partitions and orders them there: one shuffle without hot keys. The table of
    rates is broadcast up to BROADCAST_SOURCES sources (a few hundred bytes each, counted first); beyond, it meets the
    documents in a join whose hot sources Spark splits.

    Null ids draw as the text 'null'; null sources are a source; repeated rows draw alike; an empty table gives no rows.
    docs may have columns named copy or copies: they are replaced. Other columns pass through.
    """
    plain = docs.drop("copy", "copies")
    rates = stored(mixing_rates(docs, weights, total, source_col), "rates").select(F.col("source").alias("_source"), distribution(F.col("rate")).alias("_cdf"))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    drawn = plain.withColumn("_u", uniform(seed, F.col(id_col)))
    joined = drawn.join(rates, F.col(source_col).eqNullSafe(F.col("_source")))
    # the number of values of the distribution function at or below u is the smallest k with F(k) > u
    copies = F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))
    counted = joined.withColumn("copies", F.when(F.size("_cdf") == 0, 0).otherwise(copies).cast("int")).drop("_source", "_cdf", "_u")
    out = counted.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    if not shuffle:
        return out
    order = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy").cast("string")))
    return out.withColumn("_order", order).repartition("_order").sortWithinPartitions("_order").drop("_order")
