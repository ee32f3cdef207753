"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Method: the 64-bit hash of every shingle names a bin (its top bits) and a value. A bin keeps its smallest value, so
each shingle is hashed once for all bins. Empty bins borrow from a full one by optimal densification: every bin has its
own fixed pseudo-random order of the other bins and takes the first full one, independently of all other bins. A
fingerprint stores the eight low bits of each value (of a mix of value and bin, where it is borrowed), packed into
longs. Two unrelated bins agree in one case of 256; the likeness of two fingerprints takes this out:
(share of equal bins - 1/256) / (1 - 1/256).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import SPACE

BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
WORDS = 5
#: First attempts of a densification order are read straight from the bin list; the rest is decided over all full bins.
PROBES = 4

_PER_LONG = 64 // LOW_BITS
_LONGS = BINS // _PER_LONG
_SHIFT = 64 - BIN_BITS
_ONES = 0x0101010101010101


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: The largest value of each bin, in the order of signed longs; it stands for an empty bin.
_CEILINGS = sorted(_signed((i << _SHIFT) | ((1 << _SHIFT) - 1)) for i in range(BINS))


def _probe(attempt: int) -> list[int]:
    """For each bin the place (from 0) it looks at in this attempt, from a multiplicative hash of bin and attempt."""
    out = []
    for i in range(BINS):
        x = (i * 0x9E3779B97F4A7C15 + (attempt + 1) * 0xD1B54A32D192ED03) & (2**64 - 1)
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        out.append((x ^ (x >> 31)) % BINS)
    return out


def _longs(values: list[int]) -> str:
    return "array(" + ",".join(f"{v}L" if v != -(2**63) else "cast(-9223372036854775808 as bigint)" for v in values) + ")"


def add_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with `name`: the packed bins of text as array<bigint>, or null if text has no word.

    Shingles are five lower-cased words; a text with fewer words is one shingle. Null text counts as empty. Steps are
    columns of their own, so that none is evaluated again inside a lambda.
    """
    w, h, s, m, d = (f"_{name}_{x}" for x in "whsmd")
    out = df.withColumn(w, F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), SPACE))
    out = out.withColumn(
        h,
        F.expr(
            f"CASE WHEN {w}[0] = '' THEN cast(array() AS array<bigint>) WHEN size({w}) < {WORDS} THEN array(xxhash64({w})) "
            f"ELSE transform(sequence(0, size({w}) - {WORDS}), i -> xxhash64({', '.join(f'{w}[i + {j}]' if j else f'{w}[i]' for j in range(WORDS))})) END"
        ),
    )
    # with one ceiling a bin the sorted list has every bin, and its first entry of a bin is the bin's smallest value
    out = out.withColumn(s, F.expr(f"sort_array(concat({h}, {_longs(_CEILINGS)}))"))
    out = out.withColumn(m, F.expr(f"filter({s}, (x, i) -> i = 0 OR shiftright(x, {_SHIFT}) <> shiftright({s}[i - 1], {_SHIFT}))"))
    mask, low = f"{(1 << _SHIFT) - 1}L", f"{(1 << LOW_BITS) - 1}L"
    out = out.withColumn(d, F.expr(f"filter({m}, x -> (x & {mask}) <> {mask})"))
    tries = []
    for attempt in range(PROBES):
        at = f"{m}[array({','.join(map(str, _probe(attempt)))})[i]]"
        tries.append(f"CASE WHEN ({at} & {mask}) <> {mask} THEN {at} END")
    # the full bin that comes first in bin i's order: the smallest hash of (i, full bin)
    rest = f"array_min(transform({d}, y -> struct(xxhash64(i, shiftright(y, {_SHIFT})) AS o, y AS y))).y"
    dense = f"transform({m}, (x, i) -> CASE WHEN (x & {mask}) <> {mask} THEN x & {low} ELSE xxhash64(coalesce({', '.join(tries)}, {rest}), i) & {low} END)"
    f = f"_{name}_f"
    out = out.withColumn(f, F.expr(f"CASE WHEN size({d}) > 0 THEN {dense} END"))
    pack = f"transform(sequence(0, {_LONGS - 1}), j -> aggregate(slice({f}, j * {_PER_LONG} + 1, {_PER_LONG}), 0L, (a, x) -> shiftleft(a, {LOW_BITS}) | x))"
    return out.withColumn(name, F.expr(f"CASE WHEN {f} IS NOT NULL THEN {pack} END")).drop(w, h, s, m, d, f)


def likeness(a: str, b: str) -> Column:
    """0 to 1 of two packed columns: bias-corrected share of equal bins; 1 if both are empty, 0 if one is."""
    folded, step = "(p ^ q)", LOW_BITS // 2
    while step:  # the lowest bit of each bin's field: any bit of it differs
        folded, step = f"({folded} | shiftrightunsigned({folded}, {step}))", step // 2
    folded = f"({folded} & {_ONES}L)"
    unequal = f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count({folded})), 0, (s, n) -> s + n)"
    chance = 2.0**-LOW_BITS
    share = f"greatest(0.0D, (1.0D - {unequal} / {float(BINS)}D - {chance}D) / {1 - chance}D)"
    return F.expr(f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1.0D WHEN {a} IS NULL OR {b} IS NULL THEN 0.0D ELSE {share} END")


def as_text(packed: str) -> Column:
    """The packed bins as hexadecimal text; empty for a text without words."""
    return F.expr(f"coalesce(array_join(transform({packed}, x -> lpad(hex(x), 16, '0')), ''), '')")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): packed bins as hexadecimal text, for every row of docs. No shuffle.

    Null, empty or white texts have the empty fingerprint; equal texts have equal ones; null ids and repeated rows stay;
    an empty table gives no rows; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    return add_fingerprint(rows, F.col("_t"), "_p").select("doc_id", as_text("_p").alias("fingerprint"))
