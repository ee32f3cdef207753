"""Exact top-k inner products by Fagin's threshold algorithm, block by block.

Method: inside a block of vectors every dimension has its list of rows sorted by component. For a query the lists are
read from their best end (largest components for positive weights, smallest for negative ones). A row seen in any list
is scored in full at once; what the lists still hold is worth at most the sum of weight times next component.
Reading stops when that bound is below the kth score. Blocks are independent; their k best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import runs

BLOCK_ROWS = 4096
BLOCK_QUERIES = 512
#: Products are exact in a double while their sum stays below 2^53.
EXACT = float(2**53)


def threshold_top_k(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of the k best rows of each query; ties to the smaller id.

    Rows with the query's own id take no part. Reading deeper doubles the depth each time: 16, 32, 64, ..
    """
    n, d = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable")  # ascending; the best end of a negative weight is the front
    by_value = np.take_along_axis(vectors, order, axis=0)
    small = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * d < EXACT
    exact = vectors.astype(np.float64) if small else vectors
    asked = queries.astype(np.float64) if small else queries
    out_q, out_r, out_s = [], [], []
    dims = np.arange(d)
    for j in range(len(queries)):
        weight, own = queries[j], query_ids[j]
        down = weight > 0
        used = dims[weight != 0]
        seen = np.zeros(n, dtype=bool)
        rows, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        depth, step = 0, 16
        while True:
            upto = min(n, depth + step)
            if len(used):
                places = np.where(down[used], n - 1 - np.arange(depth, upto)[:, None], np.arange(depth, upto)[:, None])
                touched = order[places, used].ravel()
            else:
                touched = np.arange(n)
                upto = n
            mark = np.zeros(n, dtype=bool)
            mark[touched] = True
            fresh = np.flatnonzero(mark & ~seen)
            seen[fresh] = True
            fresh = fresh[ids[fresh] != own]
            rows = np.concatenate([rows, fresh])
            scores = np.concatenate([scores, (exact[fresh] @ asked[j]).astype(np.int64)])
            if len(rows) > k:
                best = np.lexsort((ids[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
            if upto >= n:
                break
            if len(rows) >= k:
                ahead = by_value[np.where(down[used], n - 1 - upto, upto), used]
                # a row still unseen has at most these components; an equal score may win by its id, so go on at equality
                if int((ahead.astype(object) * weight[used].astype(object)).sum() if not small else ahead @ weight[used]) < int(scores.min()):
                    break
            depth, step = upto, upto
        out_q.append(np.full(len(rows), j))
        out_r.append(rows)
        out_s.append(scores)
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * component) as longs. Null ids, null vectors and null, NaN or infinite components go."""
    v = F.col(vector_col)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v")
    )


def top_k_search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of vectors by integer inner product, ties to smaller ids.

    Both sides are cut into blocks by a hash of their id; each pair of a query block and a vector block is one group of
    bounded size. Candidates are all rows but those with the query's id. Vectors and queries that are null, or hold null
    or non-finite components, or have no id take no part; vectors of another length than the query's are no candidates.
    A repeated vector row is a candidate each time; of a repeated query id the smallest vector asks, once. Fewer than k
    candidates give all of them; empty tables give no rows. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    base = integer_vectors(vectors, id_col, vector_col, scale)
    asked = integer_vectors(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_rows, n_queries = vectors.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_queries // BLOCK_QUERIES))
    # rows may repeat an id, so their block comes from the whole row
    left = base.withColumn("vb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(row_blocks))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long")))
    )
    right = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks))).withColumn(
        "vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long")))
    )
    cols = [F.col("vb").cast("long").alias("vb"), F.col("qb").cast("long").alias("qb")]
    both = left.select(*cols, F.lit(False).alias("asks"), "vec_id", "v").unionByName(right.select(*cols, F.lit(True).alias("asks"), "vec_id", "v"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["vb", "qb"]):
            asks = group["asks"].to_numpy()
            ids = group["vec_id"].to_numpy()
            flat = group["v"].combine_chunks()
            flat = flat if isinstance(flat, pa.ListArray) else pa.concat_arrays(flat.chunks)
            lengths = flat.value_lengths().to_numpy()
            values = flat.flatten().to_numpy()
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            out = [[], [], []]
            for size in np.unique(lengths[asks]):
                mine = lengths == size
                q, r = np.flatnonzero(mine & asks), np.flatnonzero(mine & ~asks)
                if not len(r):
                    continue
                take = lambda at: values[begin[at][:, None] + np.arange(size)].reshape(len(at), size)
                qi, ri, s = threshold_top_k(take(r), ids[r], take(q), ids[q], k)
                out[0].append(ids[q][qi])
                out[1].append(ids[r][ri])
                out[2].append(s)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    n_parts = min(row_blocks * query_blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    found = both.repartition(n_parts, "vb", "qb").sortWithinPartitions("vb", "qb").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
