"""Collocations: frequent phrases of one to five words, counted exactly after Misra-Gries summaries, and their scores.

Method: keys (short hashes) of all n-grams are dealt to hash partitions. A block of text gives each partition a summary of
its keys, which is small enough to need no cut; a partition merges its summaries and, whenever it holds more counters than its
capacity, takes the (capacity + 1)-th largest count off all of them. What was taken off is D in all, and D is at most
mass / (capacity + 1): with a capacity beyond mass / threshold it stays below the threshold, so an n-gram seen `threshold` times keeps
a counter, and one whose counter plus D is below the threshold cannot be frequent. Equal keys of different n-grams only
raise counters. What survives goes into a bit table of bounded size; a second pass over the texts counts the n-grams
that are in it, by their words, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import partitions, slices, stored
from barline.llm.ngrams import keys_of, opened_up, shard_of, squeezed
from barline.llm.shingles import mixed

ORDER = 5
#: Capacity of a summary as a multiple of mass / threshold: at 2, D stays below half the threshold.
SLACK = 2
#: Counters of one partition's summary at most, as far as the mass can be told beforehand.
COUNTERS = 1_000_000
#: Keys of a block before its summaries are handed on.
BLOCK_KEYS = 3_000_000
#: Texts are handled so many bytes at a time (a longer text on its own).
SLICE = 2_000_000
#: The table of survivors has 2 ** TABLE_BITS bits (8 MB), whatever the corpus.
TABLE_BITS = 26
#: Bits of a key at least. A width that followed small corpora would make their summaries smaller by key than large ones.
KEY_BITS = 40
#: Words end at space and tab, pieces at these signs and line ends; A-Z in lower case.
SIGNS = b".,;:!?\n\x0b\x0c\r"
SPLIT = bytes.maketrans(ascii_uppercase.encode() + b"\t" + SIGNS, ascii_lowercase.encode() + b" " + b"\n" * len(SIGNS))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts of one language: their numbers, their pieces and the keys of their n-grams."""

    def __init__(self, lang: str, texts: list[bytes]):
        pieces = [p.split() for p in b"\n".join(texts).translate(SPLIT).split(b"\n")]
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        self.words = list(chain.from_iterable(pieces))
        self.piece = np.repeat(np.arange(len(pieces)), sizes)
        numbers: dict[bytes, int] = {}
        self.ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in self.words), dtype=np.int64, count=len(self.words))
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), dtype=np.uint64, count=len(numbers))[self.ids]
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8")))

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, first places, 64-bit keys) of the n-grams inside pieces, for k = 1 .. order."""
        at = np.arange(len(self.words))
        keys = mixed(self.hashes + self.seed)
        for k in range(1, order + 1):
            if k > 1:
                inside = at + k - 1 < len(self.words)
                at, keys = at[inside], keys[inside]
                inside = self.piece[at] == self.piece[at + k - 1]
                at = at[inside]
                keys = mixed(keys[inside] + self.hashes[at + k - 1] * _STEP)
            yield k, at, keys

    def phrase(self, at: int, k: int) -> bytes:
        return b" ".join(self.words[at : at + k])


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """Texts of (lang, text), a bounded slice and a language at a time."""
    for batch in slices(batches, 1, SLICE):
        held: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary()).to_pylist()):
            held.setdefault(lang, []).append(text)
        for lang, texts in held.items():
            yield lang, Words(lang, texts)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts; quick where keys come in sorted runs."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Summary:
    """A Misra-Gries summary: at most `capacity` counters, each too low by `off` at most."""

    def __init__(self, capacity: int):
        self.capacity, self.off, self.waiting, self.size = capacity, 0, [], 0
        self.keys, self.counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size >= self.capacity:
            self.merge()

    def merge(self) -> None:
        keys, counts = (np.concatenate(c) for c in zip((self.keys, self.counts), *self.waiting))
        self.waiting, self.size = [], 0
        keys, counts = summed(keys, counts)
        if len(keys) > self.capacity:
            rank = len(keys) - self.capacity - 1
            cut = int(np.partition(counts, rank)[rank])
            keys, counts = keys[counts > cut], counts[counts > cut] - cut
            self.off += cut
        self.keys, self.counts = keys, counts

    def survivors(self, threshold: int) -> np.ndarray:
        self.merge()
        return self.keys[self.counts + self.off >= threshold]


def summaries(rows: DataFrame, order: int, bits: int, shards: int) -> DataFrame:
    """(shard, mass, keys, counts): the n-gram keys of blocks of text, a slice of the sorted keys for each partition."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        down = np.uint64(64 - bits)
        parts: list[np.ndarray] = []

        def handed() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            edges = np.searchsorted(shard_of(keys << down, shards), np.arange(shards + 1))
            out: list[list] = [[], [], [], []]
            for s in np.flatnonzero(np.diff(edges)):
                k, n = keys[edges[s] : edges[s + 1]], counts[edges[s] : edges[s + 1]]
                for column, value in zip(out, (s, int(n.sum()), squeezed(np.diff(k, prepend=np.uint64(0))), squeezed(n))):
                    column.append(value)
            types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["shard", "mass", "keys", "counts"])

        size = 0
        for _, words in by_language(batches):
            for _, _, keys in words.grams(order):
                parts.append(keys >> down)
                size += len(keys)
            if size >= BLOCK_KEYS:
                yield handed()
                parts, size = [], 0
        if size:
            yield handed()

    return rows.mapInArrow(build, "shard int, mass long, keys binary, counts binary")


def survivors(blocks: DataFrame, threshold: int, slack: int, bits: int, table_bits: int = TABLE_BITS) -> DataFrame:
    """(place, part, n): for each partition the stretch of the bit table that its summary fills."""
    masses = blocks.groupBy("shard").agg(F.sum("mass").alias("whole"))
    # a row a shard, sent to all: were both sides dealt out for the join, Spark would take that deal for the one asked for below
    # and could read it as it was written, so that a shard's rows met in several tasks and each kept only what is frequent in its part
    dealt = blocks.join(F.broadcast(masses), "shard").repartition("shard").sortWithinPartitions("shard")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filled(summary: Summary) -> pa.RecordBatch:
            found = summary.survivors(threshold)
            places = (found >> np.uint64(bits - table_bits)).astype(np.int64)
            first = int(places[0]) // 8 * 8 if len(places) else 0
            table = np.zeros(int(places[-1]) - first + 1 if len(places) else 0, dtype=bool)
            table[places - first] = True
            return pa.RecordBatch.from_arrays([pa.array([first // 8], pa.int64()), pa.array([np.packbits(table).tobytes()], pa.binary()), pa.array([len(found)], pa.int64())], names=["place", "part", "n"])

        shard, summary = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                if row["shard"] != shard:
                    if summary:
                        yield filled(summary)
                    shard, summary = row["shard"], Summary(slack * row["whole"] // threshold + 1)
                summary.add(keys_of(row["keys"]), opened_up(row["counts"]).astype(np.int64))
        if summary:
            yield filled(summary)

    return dealt.mapInArrow(merge, "place long, part binary, n long")


def phrase_counts(docs: DataFrame, threshold: int = 100, order: int = ORDER, slack: int = SLACK, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, k, phrase, n): every phrase of k = 1 .. order words with n >= threshold occurrences in its language; k = 0: all words.

    Null language: `und`. Null and empty texts have no words; repeated rows count each; an empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # two bytes a word at least, `order` n-grams a word at most
    most = order * int(rows.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 1)
    bits = min(62, max(KEY_BITS, most.bit_length() + 3))
    shards = max(partitions(docs.sparkSession), -(-slack * most // (threshold * COUNTERS)))
    blocks = stored(summaries(rows, order, bits, shards), "summaries")
    table = np.zeros((1 << TABLE_BITS) // 8 + 8, dtype=np.uint8)
    # each row is the stretch of one partition: the table's size in all
    for part in survivors(blocks, threshold, slack, bits).select("place", "part").toLocalIterator():
        stretch = np.frombuffer(part["part"], dtype=np.uint8)
        table[part["place"] : part["place"] + len(stretch)] |= stretch
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        down = np.uint64(64 - TABLE_BITS)

        def found(lang: str, k: int, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
            n = len(phrases)
            return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([k] * n, pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "k", "phrase", "n"])

        for lang, words in by_language(batches):
            yield found(lang, 0, [b""], np.array([len(words.words)]))
            before = np.ones(len(words.words) + 1, dtype=bool)
            for k, at, keys in words.grams(order):
                # a frequent phrase holds frequent phrases only
                likely = before[at] & before[at + 1] if k > 1 else before[at]
                at, keys = at[likely], keys[likely]
                place = (keys >> down).astype(np.int64)
                there = (shared.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0
                at, keys = at[there], keys[there]
                before = np.zeros(len(words.words) + 1, dtype=bool)
                before[at] = True
                if not len(at):
                    break
                _, first, number, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
                same = np.ones(len(at), dtype=bool)
                for j in range(k):
                    same &= words.ids[at + j] == words.ids[at[first][number] + j]
                if not same.all():  # two phrases under one key: the second is handed on by itself
                    counts = np.bincount(number[same], minlength=len(first))
                    yield found(lang, k, [words.phrase(p, k) for p in at[~same].tolist()], np.ones(int((~same).sum()), dtype=np.int64))
                yield found(lang, k, [words.phrase(p, k) for p in at[first].tolist()], counts)

    counted = rows.mapInArrow(count, "lang string, k int, phrase string, n long").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return counted.where((F.col("k") == 0) | (F.col("n") >= threshold))


def exact(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, k, phrase, a, l, r, n, score) of the phrases of two words or more: the lowest score of all cuts, ties to the shortest first part.

    score = floor(1000 a n / (l r)), in decimals of 38 digits.
    """
    totals = counts.where("k = 0").select("lang", F.col("n").alias("total"))
    known = counts.where("k > 0").select("lang", "phrase", "n")
    words = F.split("phrase", " ")
    cuts = counts.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "k", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k")), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    cuts = cuts.join(totals, "lang").withColumns({"up": F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * F.col("total").cast("decimal(16,0)"), "down": exact("l") * exact("r")})
    cuts = cuts.withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "k", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "k", "phrase", "a", "best.l", "best.r", "n", "best.score")


def without_parts(found: DataFrame, percent: int = 100) -> DataFrame:
    """found without phrases that lie inside a longer one of it which has `percent` of their occurrences.

    A phrase between the two has at least as many as the longer one, so phrases longer by one word tell.
    """
    words = F.split("phrase", " ")
    inner = F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " ")))
    longer = found.where("k > 2").select("lang", inner.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = found.join(longer, ["lang", "phrase"], "left")
    return kept.where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer")


def ranked(found: DataFrame, top: int, spread: int = 32) -> DataFrame:
    """The first `top` of each language by score, a (both descending) and phrase, with their rank from 1."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    cell = F.pmod(F.xxhash64("phrase"), F.lit(spread))
    # the first of each cell hold the first of all, so no task sees a whole language
    first = found.withColumn("cell", cell).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "cell").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("cell")


def collocations(docs: DataFrame, threshold: int = 100, top: int = 2000, percent: int = 100, order: int = ORDER, slack: int = SLACK, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 .. order words that occur `threshold` times.

    a, l, r: occurrences of the phrase and of the two parts of its weakest cut; n: words of the language. Phrases inside a
    longer one with `percent` of their occurrences are left out. Null texts count as empty, a null language as `und`;
    repeated rows count each; an empty table gives no rows; extra columns are ignored.
    """
    counts = stored(phrase_counts(docs, threshold, order, slack, lang_col, text_col), "phrases")
    found = stored(scored(counts), "scored")
    return ranked(without_parts(found, percent), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
