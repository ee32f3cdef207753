"""Best-two-fit packing of token sequences into as few training sequences as it can.

Method: a bin is filled greedily, the longest piece that fits first. Then its smallest piece is put back if two unpacked
pieces fit the gap it leaves more tightly. Only lengths matter, and there are at most `capacity` of them: the plan is made from
the counts by length, a pattern at a time, each used as often as the counts allow. Pieces then take the places of
their length in the plan by their number among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.common import places, slices, stored
from barline.llm.tokens import GROUP, ChunkEncoder

CAPACITY = 4096
END = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<long>"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): every document's ids and an end id, cut only where beyond capacity.

    tokenizer: a word_bpe_49k file. ids_crc32: unsigned, over little-endian unsigned 32-bit ids. with_ids=False leaves
    ids null, where only lengths and checksums are wanted. Null text counts as empty: its only id is the end.
    Null ids and repeated rows stay; an empty table gives no rows; extra columns are ignored.
    """
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for batch in slices(batches, 1, GROUP):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for n, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    values = (doc_id, n, at, len(part), zlib.crc32(part.tobytes()), part.astype(np.int64) if with_ids else None)
                    for column, value in zip(out, values):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern, bins)]: a pattern is [(length, pieces of it in a bin)], longest first; all counts are used up.

    Every pattern exhausts a length or lowers its count below what a pattern needs, so there are a few times `capacity`
    patterns at most, however many pieces there are.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    out = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return out
        need: dict[int, int] = {}
        gap = capacity
        while gap > 0:
            i = int(np.searchsorted(there, gap, side="right")) - 1
            while i >= 0 and left[there[i]] - need.get(int(there[i]), 0) <= 0:
                i -= 1
            if i < 0:
                break
            length = int(there[i])
            n = min(gap // length, int(left[length]) - need.get(length, 0))
            need[length] = need.get(length, 0) + n
            gap -= n * length
        if gap > 0 and sum(need.values()) > 1:
            small = min(need)
            room = gap + small
            free = left.copy()
            for length, n in need.items():
                free[length] -= n
            sizes = np.flatnonzero(free[: room + 1])
            # for each first length the longest second that still fits; a pair must be longer than what it replaces
            best, pair = small, None
            for a in sizes[::-1]:
                a = int(a)
                if 2 * a <= best:
                    break
                j = int(np.searchsorted(sizes, room - a, side="right")) - 1
                while j >= 0 and int(sizes[j]) == a and free[a] < 2:
                    j -= 1
                if j >= 0 and int(sizes[j]) <= a and a + int(sizes[j]) > best:
                    best, pair = a + int(sizes[j]), (a, int(sizes[j]))
                    if best == room:
                        break
            if pair:
                need[small] -= 1
                if not need[small]:
                    del need[small]
                for length in pair:
                    need[length] = need.get(length, 0) + 1
        times = min(int(left[length]) // n for length, n in need.items())
        for length, n in need.items():
            left[length] -= n * times
        out.append((sorted(need.items(), reverse=True), times))


def pack(cut: DataFrame, capacity: int = CAPACITY, salt: list[str] | None = None) -> DataFrame:
    """cut (length, ..) plus (sequence_id, offset): a place for each piece, gapless inside a sequence.

    The counts by length (at most `capacity` rows) are all that reaches the driver; the plan that goes back to the
    tasks has one row for each length of each pattern. Pieces of one length are numbered in salted cells, so a length that a third of all
    pieces share is spread. Lengths lie in 1..capacity; columns sequence_id and offset of cut are replaced; an empty
    table gives no rows.
    """
    rows = cut.drop("sequence_id", "offset")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int, int, int]]] = {}
    first = 0
    for pattern, bins in plan(counts, capacity):
        at = 0
        for length, n in pattern:
            slots.setdefault(length, []).append((n * bins, first, n, at))
            at += n * length
        first += bins
    table = {}
    for length, items in slots.items():
        a = np.array(items, dtype=np.int64)
        table[length] = (np.cumsum(a[:, 0]) - a[:, 0], a[:, 1], a[:, 2], a[:, 3])
    shared = rows.sparkSession.sparkContext.broadcast(table)
    numbered = places(rows, ["length"], [F.col(c) for c in (salt or ["length"])], "_rank", 128, salt or rows.columns[:1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("length", "_rank"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for value in np.unique(length):
                mine = length == value
                begin, bin_at, per_bin, start = shared.value[int(value)]
                i = np.searchsorted(begin, rank[mine], side="right") - 1
                inside = rank[mine] - begin[i]
                sequence[mine] = bin_at[i] + inside // per_bin[i]
                offset[mine] = start[i] + inside % per_bin[i] * value
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"])

    schema = T.StructType([*numbered.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(place, schema).drop("_rank")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): pieces() packed by pack(), tokenised once."""
    cut = pieces(docs, tokenizer, capacity, id_col, text_col, with_ids=False).drop("ids")
    return pack(stored(cut, "pieces"), capacity, ["doc_id", "piece", "ids_crc32"])


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed ids themselves, from pieces with ids and their places.

    Pieces are matched by (doc_id, piece, ids_crc32); pieces alike in all three (repeated rows, copies of a mix, null ids)
    are numbered on both sides, as any of them may take any of their places. A sequence holds `capacity` ids at most. An empty
    table gives no rows.
    """
    same = ["doc_id", "piece", "ids_crc32"]
    turn = F.row_number().over(Window.partitionBy(*same).orderBy("length"))
    at = placed.withColumn("turn", turn).select(*[F.col(c).alias(f"at_{c}") for c in [*same, "turn"]], "sequence_id", "offset")
    own = cut.select(*same, "length", "ids").withColumn("turn", turn)
    joined = own.join(at, F.col("doc_id").eqNullSafe(F.col("at_doc_id")) & (F.col("piece") == F.col("at_piece")) & (F.col("ids_crc32") == F.col("at_ids_crc32")) & (F.col("turn") == F.col("at_turn")))
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = joined.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
