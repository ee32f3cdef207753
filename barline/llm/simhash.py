"""SimHash near-duplicates by a popcount embedding.

Method: a fingerprint of 64 bits is mapped to the bit counts of its 32 segments of two bits. The Manhattan distance of two
such vectors never exceeds the number of differing bits, so links lie within that range of each other. A grid range
join finds them: the segments are dealt to `bands` bands; a pair within range r agrees in all but r bands at most, hence in a
grid cell of bands - r bands. Pairs that meet in a cell are filtered by their Manhattan distance, then
verified on the fingerprints themselves.

Size. Equal fingerprints are one node. The number of bands follows the number of nodes, so that a node meets a few others in a
cell by chance, however many there are. Dense cells are not expanded into pairs: members are compared with
three pivots first; then only cells with several components are opened, and there only members outside the cell's
largest component are compared with members of other components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import partitions, slices, stored
from barline.llm.neardup import components
from barline.llm.shingles import words

SEGMENTS = 32
EVEN = 0x5555555555555555
#: Chance that one segment of two random fingerprints has the same bit count: (1 + 4 + 1) / 16.
SAME = 0.375
#: Bands at least: up to some six million fingerprints a cell is shared by chance by less than one other.
LEAST_BANDS = 8
#: Shingles whose bits are added up at once.
AT_ONCE = 65_536


def simhash(parts: list[bytes], size: int = 4, seed: int = 42) -> int:
    """Fingerprint of a word sequence: bit i is set if more than half of the shingles' XXH64 hashes have it. Zero without words."""
    n = max(1, len(parts) - size + 1)
    if not parts:
        return 0
    data = b" ".join(parts)
    length = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[:n].tolist()
    stops = ends[min(size, len(parts)) - 1 :].tolist()
    counts, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, AT_ONCE):
        h = np.array([digest(data[s:e], seed) for s, e in zip(starts[at : at + AT_ONCE], stops[at : at + AT_ONCE])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row: the fingerprint as a signed long. Null and empty texts have fingerprint zero."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1_000_000):
            found = np.array([simhash(words(t), size, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(build, "doc_id long, fp long")


def embedded(fp: Column) -> Column:
    """The bit count of each two-bit segment, in the segment's two bits."""
    upper = F.shiftrightunsigned(fp, 1)
    one, two = fp.bitwiseXOR(upper).bitwiseAND(F.lit(EVEN)), fp.bitwiseAND(upper).bitwiseAND(F.lit(EVEN))
    return one.bitwiseOR(F.shiftleft(two, 1))


def manhattan(x: Column, y: Column) -> Column:
    """Distance of two embedded vectors. Counts 0, 1, 2 differ as bits by 1 or 3 for a distance of one, by 2 for two."""
    d = x.bitwiseXOR(y)
    low = d.bitwiseAND(F.lit(EVEN))
    high = F.shiftrightunsigned(d, 1).bitwiseAND(F.lit(EVEN)).bitwiseAND(F.bitwise_not(low))
    return F.bit_count(low) + 2 * F.bit_count(high)


def band_count(nodes: int, radius: int) -> int:
    """The least number of bands whose cells are so fine that a node meets about one other by chance."""
    wanted = min(log(max(nodes, 2)) / -log(SAME), SEGMENTS / 2 + radius)
    bands = max(LEAST_BANDS, radius + 1)
    while SEGMENTS * (bands - radius) / bands < wanted:
        bands += 1
    return bands


def cell_masks(bands: int, radius: int) -> list[int]:
    """For each choice of bands - radius bands the bits of their segments, as signed 64-bit numbers."""
    edges = [SEGMENTS * i // bands for i in range(bands + 1)]
    band = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(band, bands - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, radius: int, bands: int | None = None) -> DataFrame:
    """(a, b): links of nodes (fp, copies), fp distinct, that join every pair within `radius` differing bits directly or over others."""
    bands = bands or band_count(nodes.count(), radius)
    vector = embedded(F.col("fp"))
    cells = F.posexplode(F.array(*[vector.bitwiseAND(F.lit(m)) for m in cell_masks(bands, radius)])).alias("grid", "cell")
    # nodes are few bytes, their cells are many: dealt out before they multiply
    placed = nodes.repartition(partitions(nodes.sparkSession)).select("fp", "copies", cells)
    turn = lambda seed: F.min(F.struct(F.xxhash64(F.lit(seed), F.col("fp")), F.col("fp")))["fp"]
    ends = placed.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("copies", "fp"))["fp"].alias("p0"), turn(1).alias("p1"), turn(2).alias("p2"))
    ends = stored(ends.where("members > 1").select("grid", "cell", "members", F.array_distinct(F.array("p0", "p1", "p2")).alias("pivots")), "cells")
    # Spark sizes exploded rows as if they were the nodes: without the hint it may broadcast all cells
    member = stored(placed.select("grid", "cell", "fp").hint("merge").join(ends, ["grid", "cell"]), "members")

    within = lambda a, b: (manhattan(embedded(a), embedded(b)) <= radius) & (F.bit_count(a.bitwiseXOR(b)) <= radius)
    # most members of a cell meet by chance: pivots are filtered and verified where they lie, only links become rows
    linked = F.filter("pivots", lambda p: (p != F.col("fp")) & within(F.col("fp"), p))
    near = member.select(F.col("fp").alias("a"), F.explode(linked).alias("b"))
    first = stored(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    labels = stored(components(first), "labels")
    sized = labels.join(labels.groupBy("comp").agg(F.count(F.lit(1)).alias("size")), "comp").select(F.col("node").alias("fp"), "comp", "size")
    # with one member beside its pivots at most, every pair of a cell has been compared
    crowded = member.where(F.col("members") - F.size("pivots") > 1)
    named = crowded.select("grid", "cell", "fp").join(sized, "fp", "left").select("grid", "cell", "fp", F.coalesce("comp", "fp").alias("comp"), F.coalesce("size", F.lit(1).cast("long")).alias("size"))
    named = stored(named, "named")
    main = named.groupBy("grid", "cell").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max(F.struct("size", "comp"))["comp"].alias("main"))
    main = stored(main.where("x <> y").select("grid", "cell", "main"), "open")
    opened = stored(named.join(main, ["grid", "cell"]).select("grid", "cell", "fp", "comp", "main"), "opened")
    left = opened.where("comp <> main").select("grid", "cell", F.col("fp").alias("a"), F.col("comp").alias("comp_a"))
    right = opened.select("grid", "cell", F.col("fp").alias("b"), F.col("comp").alias("comp_b"), "main")
    # of two members outside the largest component one order is enough
    rest = left.join(right, ["grid", "cell"]).where("comp_a <> comp_b AND (comp_b = main OR a < b)").where(within(F.col("a"), F.col("b")))
    return first.unionByName(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def simhash_duplicates(docs: DataFrame, radius: int = 4, size: int = 4, seed: int = 42, bands: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    Shingles of `size` lower-cased words, repeats included (fewer words: one shingle); fingerprints are linked at radius or fewer
    differing bits; component_id is the smallest id reachable. fingerprint: 16 lowercase hex digits.

    Null, empty and white texts have fingerprint zero and are linked like any other. A null id has a null component_id
    and hands links on; rows that repeat an id stay. An empty table gives no rows; extra columns are ignored.
    """
    if not 0 <= radius < SEGMENTS:
        raise ValueError(f"radius must lie in 0..{SEGMENTS - 1}")
    rows = stored(fingerprints(docs, size, seed, id_col, text_col), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    labels = components(links(nodes.select("fp", "copies"), radius, bands))
    named = stored(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp")), "components")
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    # a fingerprint's name is looked up for many rows, the names themselves are one row a fingerprint
    ids = named.join(least, "comp").select("fp", "component_id")
    out = rows.join(ids, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
