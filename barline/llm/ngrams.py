"""Scores of a smoothed bigram model held as a weighted backoff automaton.

Method: every history seen in training is a state; a bigram is an arc with its smoothed probability; where a state
has no arc for a word, a failure arc with the state's backoff weight leads to the unigram state, which has an arc for every
word. A text is scored in one traversal from left to right that carries the state and adds up log-probabilities.

Smoothing. p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) and p(w | u) = (c(u, w) + m p(w)) / (c(u) + m) with strength m: the
arc of a seen bigram has this weight; the failure arc of u weighs m / (c(u) + m). Probabilities of a state add up to one,
with one unknown word. All bigrams are kept, those seen once too.

Distribution. Neither the model nor the corpus fits a task. Texts are cut into blocks of bounded token count, stored as
word numbers. Each block asks the shards of the count tables for its own distinct words and bigrams (sorted 64-bit
hashes) and hands in its training counts with the question. A shard adds up what all blocks handed in and answers
each in its order. A block then holds the part of the automaton that its texts can visit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import runs, stored
from barline.llm.shingles import WordHashes, mixed, words

BLOCK_TOKENS = 1_000_000
#: Distinct questions, over all blocks, that a shard answers.
SHARD_KEYS = 400_000
#: Strength of the unigram distribution in a state.
STRENGTH = 100.0
STOP = np.uint64(0x2545F4914F6CDD1D)
BLOCKS = "block long, n_docs int, doc_ids array<long>, held array<boolean>, sizes array<int>, words binary, tokens binary, n_keys long"
ASKED = "shard int, block long, kind int, keys binary, counts binary"
ANSWERS = "block long, kind int, shard int, totals binary, n_words long, n_tokens long"


def blocks(docs: DataFrame, id_col: str, text_col: str, folds: int, fold: int) -> DataFrame:
    """One row a block: its documents, its distinct word hashes (sorted) and the texts as numbers into them."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, hashes = TaskContext.get().partitionId(), 0, WordHashes()
        ids, outs, parts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            stream = np.concatenate(parts)
            distinct, tokens = np.unique(stream, return_inverse=True)
            values = [(task << 32) | number, len(ids), ids, outs, [len(p) for p in parts], squeezed(np.diff(distinct, prepend=np.uint64(0))), squeezed(tokens), len(bigrams(stream, [len(p) for p in parts])[0]) + len(distinct)]
            types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["block", "n_docs", "doc_ids", "held", "sizes", "words", "tokens", "n_keys"])

        for batch in batches:
            for doc_id, out, text in zip(*[c.to_pylist() for c in batch.columns]):
                ids.append(doc_id)
                outs.append(out)
                parts.append(np.append(hashes.of(words(text)), STOP))
                size += len(parts[-1])
                if size >= BLOCK_TOKENS:
                    yield block()
                    ids, outs, parts, size, number = [], [], [], 0, number + 1
        if ids:
            yield block()

    return rows.mapInArrow(cut, BLOCKS)


def histories(stream: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The token before each token; before a text's first one the end token, which is counted once a text."""
    before = np.concatenate([[STOP], stream[:-1]])
    before[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)] = STOP
    return before


def bigrams(stream: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, the number of each token's bigram among them)."""
    keys = mixed(mixed(histories(stream, sizes)) + stream * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(keys, return_inverse=True)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Rising with the key, so that a shard's keys are a slice of the sorted ones."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def squeezed(a: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as the largest needs, all first bytes first, compressed."""
    a = np.ascontiguousarray(a.astype(np.min_scalar_type(int(a.max(initial=0)))))
    return bytes([a.itemsize]) + zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 3)


def opened_up(data: bytes) -> np.ndarray:
    width = data[0]
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data[1:]), dtype=np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, word number of each token, sizes, held of each token) of a block."""
    distinct, tokens = keys_of(row["words"]), opened_up(row["tokens"]).astype(np.int64)
    sizes = np.asarray(row["sizes"], dtype=np.int64)
    return distinct, tokens, sizes, np.repeat(np.asarray(row["held"], dtype=bool), sizes)


def ask(cut: DataFrame, shards: int) -> DataFrame:
    """Every block's distinct keys with their training counts, a slice for each shard; kind 0 words, 1 bigrams."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                distinct, tokens, sizes, held = opened(row)
                pairs, number = bigrams(distinct[tokens], sizes)
                out: list[list] = [[], [], [], [], []]
                for kind, keys, at in ((0, distinct, tokens), (1, pairs, number)):
                    counts = np.bincount(at[~held], minlength=len(keys))
                    edges = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
                    for s in np.flatnonzero(np.diff(edges)):
                        part, n = keys[edges[s] : edges[s + 1]], counts[edges[s] : edges[s + 1]]
                        for column, value in zip(out, (s, row["block"], kind, squeezed(np.diff(part, prepend=np.uint64(0))), squeezed(n))):
                            column.append(value)
                types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["shard", "block", "kind", "keys", "counts"])

    return cut.select("block", "held", "sizes", "words", "tokens").mapInArrow(slices, ASKED)


def keys_of(data: bytes) -> np.ndarray:
    """Sorted keys from their squeezed differences."""
    return np.cumsum(opened_up(data), dtype=np.uint64)


def answer(asked: DataFrame) -> DataFrame:
    """Each shard's totals, for each block in the order of its keys; n_words and n_tokens once a shard."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["shard", "kind"]):
            rows = group.to_pylist()
            keys = [keys_of(r["keys"]) for r in rows]
            counts = [opened_up(r["counts"]) for r in rows]
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
            word = rows[0]["kind"] == 0
            begin = 0
            for i, (r, k) in enumerate(zip(rows, keys)):
                mine = squeezed(total[at[begin : begin + len(k)]])
                begin += len(k)
                first = word and i == 0
                values = [r["block"], r["kind"], r["shard"], mine, int((total > 0).sum()) if first else 0, int(total.sum()) if first else 0]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["block", "kind", "shard", "totals", "n_words", "n_tokens"])

    clustered = asked.repartition("shard", "kind").sortWithinPartitions("shard", "kind")
    return clustered.mapInArrow(totals, ANSWERS)


def traverse(totals: list[dict], row: dict, n_words: int, n_tokens: int, strength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known tokens, base, score) of each text of a block."""
    distinct, tokens, sizes, _ = opened(row)
    joined = [np.concatenate([opened_up(t["totals"]).astype(np.int64) for t in sorted((t for t in totals if t["kind"] == kind), key=lambda t: t["shard"])]) for kind in (0, 1)]
    stream = distinct[tokens]
    _, number = bigrams(stream, sizes)
    count = joined[0][tokens].astype(np.float64)
    stop = int(np.searchsorted(distinct, STOP))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    history = np.concatenate([[stop], tokens[:-1]])
    history[starts] = stop
    state = joined[0][history].astype(np.float64)
    unigram = (count + 0.5) / (n_tokens + 0.5 * (n_words + 1))
    arc = joined[1][number].astype(np.float64)
    # an arc where the bigram was seen, else the failure arc and the unigram state's arc
    weight = np.where(arc > 0, (arc + strength * unigram) / (state + strength), strength / (state + strength) * unigram)
    return np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(np.log10(unigram), starts), np.add.reduceat(np.log10(weight), starts)


def score(docs: DataFrame, folds: int = 5, fold: int = 1, strength: float = STRENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Tokens: ASCII lower-cased words and one end. Trained on rows whose crc32(id) modulo folds is not fold.
    Null text counts as empty (its only token is the end); a null id is never held out; repeated rows count and score
    each; without training rows every token has the probability of an unknown word; an empty table gives no rows.
    Extra columns are ignored.
    """
    cut = stored(blocks(docs, id_col, text_col, folds, fold), "blocks")
    asked_keys = cut.agg(F.sum("n_keys")).first()[0] or 0
    shards = max(1, -(-asked_keys // SHARD_KEYS))
    answers = stored(answer(ask(cut, shards)), "answers")
    n_words, n_tokens = (x or 0 for x in answers.agg(F.sum("n_words"), F.sum("n_tokens")).first())
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "totals")).alias("answers"))
    both = cut.drop("n_keys").join(by_block, "block")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                known, base, total = traverse(row["answers"], row, n_words, n_tokens, strength)
                n = len(known)
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(row["sizes"], pa.int64()), pa.array(known), pa.array(np.full(n, n_tokens, dtype=np.int64)), pa.array(base), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return both.mapInArrow(walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
