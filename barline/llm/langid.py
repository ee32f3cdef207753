"""Language identification with error-correcting output codes.

Method: every language has a codeword; each bit is predicted by a binary classifier over hashed character n-grams.
A text's language is the codeword at the least weighted loss from the predicted bits; if the two least losses are
close, the text is ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import slices

UNKNOWN = "und"
DIMENSIONS = 1 << 16
LENGTHS = (2, 3)
#: The classifiers are fitted on about so many rows a language at most, those with the smallest id hashes.
SAMPLE_PER_LANGUAGE = 2_000
#: Most languages that get all possible bits; beyond, bits are drawn by a seeded generator.
EXHAUSTIVE = 6
#: Characters of a text handled at once.
PIECE = 1 << 20
#: Bytes of text that a task holds as Python strings.
SLICE = 1_000_000
SCHEMA = "doc_id long, lang_pred string, score double, second string, margin double, ambiguous boolean"


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1 and -1, one a language: all splits of the languages in two, or 15 log2(n) seeded ones."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        tails = itertools.product((1, -1), repeat=n - 1)
        return np.array([(1, *t) for t in tails if -1 in t], dtype=np.float64).T
    rng, wanted, out = np.random.default_rng(seed), int(np.ceil(15 * np.log2(n))), []
    while len(out) < wanted:
        bit = rng.permutation(np.where(np.arange(n) < n // 2, 1.0, -1.0))
        out.append(bit * bit[0])
    return np.array(out).T


def hashed(text: str, after: int) -> np.ndarray:
    """Hashed n-grams of text that end past its first `after` code points."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[n - 1 :] * np.uint64(0xD1B54A32D192ED03))
        if n in LENGTHS:
            end = h[max(0, after - n + 1) :]
            out.append(((end ^ (end >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def gram_hashes(text: str, piece: int = PIECE) -> Iterator[np.ndarray]:
    """Hashed n-grams of the lower-cased text, whole words with their borders; runs of white space are one space.

    A long text comes in pieces; each carries the end of the one before it, so that the cuts change nothing.
    """
    low, last = text.lower(), " "
    for at in range(0, len(low), piece):
        part = low[at : at + piece]
        body = " ".join(part.split())
        lead = " " if part[0].isspace() and last[-1] != " " else ""
        tail = " " if body and part[-1].isspace() else ""
        more = lead + body + tail
        yield hashed(last + more, len(last))
        last = (last + more)[-(max(LENGTHS) - 1) :]
    if last[-1] != " ":
        yield hashed(last + " ", len(last))


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams."""
    total = np.zeros(DIMENSIONS)
    for grams in gram_hashes(text):
        total += np.bincount(grams, minlength=DIMENSIONS)
    return total


@dataclass(frozen=True)
class Model:
    """weights: log-odds of each n-gram for each bit; trust: how well each bit told the sample apart (0 to 1)."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def losses(self, counts_sum: np.ndarray, n: int) -> np.ndarray:
        """Weighted logistic loss of each language: mean evidence of the n-grams, weaker for fewer than 24 of them."""
        evidence = counts_sum / max(n, 1) * min(n, 24) / 4
        return (np.logaddexp(0, -self.code * evidence) * self.trust).sum(axis=1) / self.trust.sum()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Classifiers from labelled rows of docs. Nulls in text or lang are left out.

    The sample is bounded: per language about per_language rows, taken by a hash of id and text: null or repeated ids
    bias nothing, repeated rows are taken or left together. Without labelled rows the model knows no language. Tasks send one count
    vector a language; as the sample is bounded, so is what the driver adds up.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()  # one row a language
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((DIMENSIONS, 1)), np.ones(1))
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col(lang_col) == r["lang"], F.lit(min(1.0, per_language / r["n"]))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col)), F.lit(1_000_003)) < share * 1_000_003)
    index = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in slices(batches, 1, SLICE):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = gram_counts(text)
                # a text counts by its shape, not by its length
                i = index[lang]
                sums[i] = sums.get(i, 0) + counts / max(counts.sum(), 1) * min(counts.sum(), 5000)
        for i, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([at.astype(np.int32).tobytes()]), pa.array([total[at].astype(np.float32).tobytes()])], names=["i", "at", "n"])

    counts = np.zeros((len(languages), DIMENSIONS))
    few = sample.select(lang_col, text_col)
    for row in few.mapInArrow(count, "i long, at binary, n binary").toLocalIterator():
        counts[row["i"], np.frombuffer(row["at"], dtype=np.int32)] += np.frombuffer(row["n"], dtype=np.float32)
    code = codewords(len(languages))
    # every language weighs the same, whatever its share of the sample
    p = (counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True)
    weights = np.zeros((DIMENSIONS, code.shape[1]))
    for b in range(code.shape[1]):
        plus, minus = p[code[:, b] > 0], p[code[:, b] < 0]
        if len(plus) and len(minus):
            weights[:, b] = np.log(plus.mean(axis=0)) - np.log(minus.mean(axis=0))
    # a bit's trust: the share of n-grams of each language on the right side of zero, beyond a coin's half
    right = np.array([[(p[i] * ((weights[:, b] > 0) == (code[i, b] > 0))).sum() for b in range(code.shape[1])] for i in range(len(languages))])
    return Model(languages, code, weights, np.clip(2 * right.mean(axis=0) - 1, 0.05, 1.0))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_margin: float = 0.05, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, second, margin, ambiguous) of every row of docs, from its whole text alone.

    keep: further columns of docs to carry along. score: the share of the chosen language in exp(-2 loss), 0 to 1.
    margin: the loss of the second language less that of the first; ambiguous below least_margin. A text that is null
    or has no letter is `und` with score 0, and so is every text if the model knows no language. Null ids and repeated
    rows stay; an empty table gives no rows. The model (65,536 n-grams by bits) goes along with the tasks.
    """
    names, code, trust = model.languages, model.code, model.trust
    weights = model.weights.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((names, code, weights, trust))
    extra = [c for c in keep or [] if c not in ("_id", "_text", "_letter")]
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.rlike(F.col(text_col), F.lit(r"\p{L}")), F.lit(False)).alias("_letter"), *extra
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, code, weights, trust = shared.value
        model = Model(langs, code, weights, trust)
        for batch in slices(batches, 1, SLICE):
            pred, score, second, margin = [], [], [], []
            for text, letter in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not letter or not langs:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    second.append(None)
                    margin.append(0.0)
                    continue
                total, n = np.zeros(weights.shape[1]), 0
                for grams in gram_hashes(text):
                    total += np.take(weights, grams, axis=0).sum(axis=0, dtype=np.float64)
                    n += len(grams)
                losses = model.losses(total, n)
                order = np.argsort(losses, kind="stable")
                share = np.exp(-2 * (losses - losses[order[0]]))
                pred.append(langs[order[0]])
                score.append(float(1 / share.sum()))
                second.append(langs[order[1]] if len(order) > 1 else None)
                margin.append(float(losses[order[1]] - losses[order[0]]) if len(order) > 1 else 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.string()), pa.array(margin, pa.float64()), pa.array([m < least_margin for m in margin]), *batch.columns[3:]],
                names=["doc_id", "lang_pred", "score", "second", "margin", "ambiguous", *extra_names],
            )

    extra_names = [f"_keep_{c}" for c in extra]
    schema = SCHEMA + "".join(f", `_keep_{c}` {t}" for c in extra for n, t in docs.dtypes if n == c)
    out = rows.mapInArrow(predict, schema)
    return out.withColumnsRenamed({f"_keep_{c}": c for c in extra}) if extra else out

