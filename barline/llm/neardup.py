"""Near-duplicate groups from bottom-k sketches of one hash function.

Method: a text's sketch is the k smallest hashes of its shingle set. Inverted lists of the retained values bring
texts together that share some; the sketch of a pair's union estimates their similarity and drops most pairs; the
rest is decided by the exact Jaccard similarity of the full shingle sets.

What is compared. Equal sets are one class from the start, and links are sought between classes. If two sets have a
similarity of at least t, then at least c of the k smallest hashes of their union lie in both sketches: c follows from the
set size where the set is small, else from the binomial law, short of which a pair falls with a probability below
LOSS. So a class with fewer than c values that any other class retains has no partner, and of the others the values
past the rarest q - c + 1 need no list (q: values it shares with anyone). Passages that many texts share fall out
this way. Groups of near copies are not expanded into pairs: in each list the members are compared with three pivots
first, and only members that are still in different components are compared with each other.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import slices, stored
from barline.llm.shingles import WordHashes, exact_set, shingle_set, words

K = 64
#: Bytes of text that a task turns into words at once.
SLICE = 1_000_000
#: Bytes of words whose hashes a task keeps.
KEPT_BYTES = 50_000_000
#: Chance that the sketches of one linked pair share fewer than the counted values.
LOSS = 1e-10
#: Class texts are fetched by a broadcast of their ids (8 bytes each) up to this number, by a shuffled join beyond.
BROADCAST_IDS = 1_000_000


def least_shared(k: int, percent: int, loss: float = LOSS) -> int:
    """The largest c with P(Binomial(k, percent%) < c) <= loss."""
    t, total, c = percent / 100, 0.0, 0
    while True:
        total += comb(k, c) * t**c * (1 - t) ** (k - c)
        if total > loss:
            return c
        c += 1


def sketches(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, n_shingles, sig, sketch): hash of the text, set size, 128-bit hash of the set, the k smallest shingle hashes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(KEPT_BYTES)
        for batch in slices(batches, 1, SLICE):
            sizes, sigs, least = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(words(text), hashes)
                sizes.append(len(s))
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                least.append(s[:k].view(np.int64))
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in least])]).astype(np.int32), np.concatenate([*least, np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), lists], names=["doc_id", "mark", "n_shingles", "sig", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    return rows.mapInArrow(build, "doc_id long, mark long, n_shingles long, sig binary, sketch array<long>")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of links (a, b): comp is the smallest node of its component.

    Alternating large-star and small-star steps on edge tables in the shared folder; minima are partial aggregates and
    neighbours meet them in joins, so no neighbourhood is gathered.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def need(n: Column, k: int, percent: int) -> Column:
    """Values that a set of n shingles must share with a partner's sketch."""
    sure = F.least(F.lit(k).cast("long"), n) - F.floor(n * (100 - percent) / F.lit(percent))
    return F.when(n >= k, F.greatest(sure, F.lit(least_shared(k, percent)).cast("long"))).otherwise(sure)


def close_sizes(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def likely(pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose union sketch does not rule a link out."""
    left = nodes.select(F.col("nid").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = nodes.select(F.col("nid").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    both = pairs.join(left, "a").join(right, "b").where(close_sizes("na", "nb", percent))
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    both = both.withColumn("u", F.size(F.array_union("sa", "sb"))).withColumn("m", F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))))
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    enough = F.when(whole, F.size(F.array_intersect("sa", "sb")) * 100 >= F.col("u") * percent).otherwise(F.col("m") >= least_shared(k, percent))
    return both.where(enough).select("a", "b")


def linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity: 100 * intersection >= percent * union."""
    left = texts.select(F.col("nid").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("nid").alias("b"), F.col("text").alias("tb"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, set] = OrderedDict()

        def of(nid: int, text: str) -> set:
            s = kept.pop(nid, None)
            s = exact_set(words(text)) if s is None else s
            kept[nid] = s
            if len(kept) > 32:
                kept.popitem(last=False)
            return s

        for batch in slices(batches, 2, SLICE):
            out = []
            for a, b, ta, tb in zip(*[c.to_pylist() for c in batch.columns]):
                x, y = of(a, ta), of(b, tb)
                both = len(x & y)
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(out, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def still_apart(open_nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open nodes (nid, comp, n) in different components that can be linked, judged by full sets.

    Each set is ordered from its rarest value among the open nodes to the most frequent. Two sets of n and m values that
    are linked share at least o = ceil(percent (n + m) / (100 + percent)) of them, so their first common value is among
    the first n - o + 1 and m - o + 1. Values that no other open node has come first and make no list: a text that has
    more of its own than a partner may lack meets nobody.
    """

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(KEPT_BYTES)
        for batch in slices(batches, 3, SLICE):
            sets = [shingle_set(words(t), hashes).view(np.int64) for t in batch.column(3).to_pylist()]
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32), np.concatenate([*sets, np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["nid", "comp", "n", "values"])

    sets = open_nodes.join(texts, "nid").select("nid", "comp", "n", "text").mapInArrow(full, "nid long, comp long, n long, values array<long>")
    values = stored(sets.select("nid", "comp", "n", F.explode("values").alias("v")), "values")
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    held = values.join(shared, "v").groupBy("nid").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("freq", "v"))).alias("held"))
    own = F.col("n") - F.size("held")
    first = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - own  # the longest prefix that any partner's size asks for
    prefix = held.where(first > 0).select("nid", "comp", "n", own.alias("own"), F.posexplode(F.slice("held", F.lit(1), first.cast("int"))).alias("i", "x"))
    prefix = stored(prefix.select("nid", "comp", "n", F.col("x.v").alias("v"), (F.col("own") + F.col("i") + 1).alias("pos")), "prefixes")
    left, right = (prefix.select("v", *[F.col(c).alias(f"{c}_{side}") for c in ("nid", "comp", "n", "pos")]) for side in "ab")
    o = F.ceil((F.col("n_a") + F.col("n_b")) * percent / F.lit(100 + percent))
    met = left.join(right, (left["v"] == right["v"]) & F.expr("nid_a < nid_b AND comp_a <> comp_b") & close_sizes("n_a", "n_b", percent) & (F.col("pos_a") <= F.col("n_a") - o + 1) & (F.col("pos_b") <= F.col("n_b") - o + 1))
    return met.select(F.col("nid_a").alias("a"), F.col("nid_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = K, id_col: str = "doc_id", text_col: str = "text", marks: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs, with marks also `mark`: xxhash64 of its text.

    Shingles are five lower-cased words (fewer words: one shingle). Rows are linked if 100 * intersection >= percent *
    union; component_id is the smallest id reachable over links; kept: the row has that id.

    Texts that are null, empty or white have no shingles and no links: each is a component of its own. A null id has a
    null component_id and is kept, and hands links on like any row. Rows that
    repeat an id are judged each by its own text; mark tells them apart.
    An empty table gives no rows; extra columns are ignored.
    """
    rows = stored(sketches(docs, k, id_col, text_col), "sketches")
    grouped = rows.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("min_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    # ids of classes hold once the table is written
    classes = stored(grouped.withColumn("nid", F.monotonically_increasing_id()), "classes")

    values = classes.select("nid", "n", "copies", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    held = values.join(shared, "v").groupBy("nid").agg(
        F.first("n").alias("n"), F.first("copies").alias("copies"), F.sum("freq").alias("central"), F.sort_array(F.collect_list(F.struct("freq", "v"))).alias("held")
    )
    spare = F.size("held") - need(F.col("n"), k, percent) + 1
    lists = held.where(spare > 0).select("nid", "copies", "central", F.explode(F.slice("held", F.lit(1), spare.cast("int"))).alias("x"))
    lists = stored(lists.select("nid", "copies", "central", F.col("x.v").alias("v")), "lists")
    # the member whose values most others retain, the one with most copies, and one by a hash
    ends = lists.groupBy("v").agg(
        F.count(F.lit(1)).alias("members"), F.max(F.struct("central", "nid")).alias("p0"), F.max(F.struct("copies", "nid")).alias("p1"), F.min(F.struct(F.xxhash64("nid"), F.col("nid"))).alias("p2")
    ).where("members > 1")
    ends = stored(ends.select("v", F.array_distinct(F.array("p0.nid", "p1.nid", "p2.nid")).alias("pivots")), "pivots")
    lists = lists.select("nid", "v")

    ids = lists.join(ends.select("v"), "v").select("nid").distinct()
    nodes = classes.join(ids, "nid").select("nid", "sig", "min_id", "n", "sketch")
    nodes = stored(nodes, "nodes")
    texts = stored(class_texts(docs, nodes, id_col, text_col), "texts")

    near = lists.join(ends, "v").select("nid", F.explode("pivots").alias("p")).where("nid <> p")
    near = near.select(F.least("nid", "p").alias("a"), F.greatest("nid", "p").alias("b")).distinct()
    first = stored(linked(likely(near, nodes, k, percent), texts, percent), "links")
    labels = stored(components(first), "labels")

    # lists whose members are not all in one component yet, and their members
    member = lists.join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    open_lists = member.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("v")
    open_nodes = member.join(open_lists, "v", "left_semi").groupBy("nid").agg(F.first("comp").alias("comp"))
    rest = still_apart(open_nodes.join(nodes.select("nid", "n"), "nid"), texts, percent)
    second = linked(likely(rest.join(near, ["a", "b"], "left_anti"), nodes, k, percent), texts, percent)
    links = stored(first.unionByName(second), "links")
    labels = components(links)

    named = classes.select("nid", "sig", "min_id").join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    named = stored(named, "named")
    least = named.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    by_sig = named.join(least, "comp").select("sig", "component_id")
    out = rows.select("doc_id", "mark", "n_shingles", "sig").join(by_sig, "sig", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), *(["mark"] if marks else []))


def class_texts(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(nid, text): one text for each of nodes, found by the smallest id and the set's hash."""
    rows = docs.select(F.col(id_col).cast("long").alias("min_id"), F.col(text_col).alias("text"))
    wanted = nodes.select("nid", "sig", "min_id")
    few = nodes.count() <= BROADCAST_IDS
    ids = wanted.select("min_id").distinct()
    # ids of texts come first: only texts that are asked for are hashed again
    asked = rows.join(F.broadcast(ids) if few else ids, "min_id", "left_semi")
    unnamed = rows.where("min_id IS NULL")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(KEPT_BYTES)
        for batch in slices(batches, 0, SLICE):
            sig = [xxhash.xxh3_128_digest(shingle_set(words(t), hashes).tobytes()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), batch.column(0)], names=["sig", "text"])

    signed = asked.unionByName(unnamed).select("text").mapInArrow(sign, "sig binary, text string")
    found = signed.join(wanted.select("nid", "sig"), "sig")
    return found.groupBy("nid").agg(F.first("text").alias("text"))
