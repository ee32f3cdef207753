"""Spelling variants: words one edit apart, found by asymmetric chunks, and the frequent form each of them leads to.

Method: one word of a pair, the shorter (of equal ones either), is cut into two disjoint chunks; the other gives its grams of
the chunk's length with their places. One edit spares one of the chunks, so the pair meets at an equal chunk and gram whose
places differ by one at most: a spared first chunk stands where it stood, a spared last chunk is moved by the
difference of the lengths. Grams at other places can meet no chunk and are left out before the shuffle. The words themselves
decide (edit distance one).

Frequent chunks. A chunk that many words share would bring all of them together. Where the pairs of a chunk outnumber
its words SPARE times, the rest of the word (what the chunk does not cover) is cut in two again: the edit lies in the rest,
so it spares one of the two. This goes on while chunks are too frequent and the rest has more than one letter, after
which words that meet are nearly all links. So candidates grow in proportion to the words, and no group is left out.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import stored

#: Pairs for each word of a chunk above which the rest of the words is cut again.
SPARE = 8
#: Code points of the rest above which it is cut again in any case: words are compared by their rests, letter by letter.
LONG = 64
#: Letters of a run after lower-casing A-Z: ASCII and U+00C0 to U+00FF.
RUN = "[a-zÀ-ÿ]+"


def runs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word) for each maximal run of letters of each whole text, A-Z in lower case. Null text has none."""
    lower = F.translate(F.col(text_col), ascii_uppercase, ascii_lowercase)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("word"))


def with_slips(words: DataFrame, every: int = 97) -> DataFrame:
    """words with one code point less where `every` divides the crc32 of `<doc_id>:<word>`: place crc32 % length. A null id counts as empty."""
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("word")))
    at = (h % F.length("word")).cast("int")
    short = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return words.withColumn("word", F.when(h % every == 0, short).otherwise(F.col("word")))


def word_counts(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): distinct words of at least so many code points that occur so often."""
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def halved(rows: DataFrame) -> DataFrame:
    """Each row's open part [s, e) cut in two: one row has the first half open, one the second; `key` stands for what is spared.

    l is the length of the word that gives chunks; a longer partner's open part is longer by the difference.
    """
    mid = F.expr("s + (e - s) div 2")
    cut = rows.select("word", "chunk", "l", F.explode(F.array(F.struct(F.col("s"), mid.alias("e")), F.struct(mid.alias("s"), F.col("e")))).alias("part"))
    cut = cut.select("word", "chunk", "l", "part.s", "part.e")
    head, _, tail = parted("word")
    return cut.withColumn("key", F.xxhash64("l", "s", "e", head, tail))


def parted(word: str) -> tuple[Column, Column, Column]:
    """What stands before, in and after the open part."""
    w, n = F.col(word), F.length(word)
    stop = F.col("e") + n - F.col("l")
    return F.substring(w, F.lit(1), F.col("s")), F.substring(w, F.col("s") + 1, stop - F.col("s")), F.substring(w, stop + 1, n)


def near_words(counts: DataFrame, spare: int = SPARE) -> DataFrame:
    """(a, b): all pairs of words that differ by exactly one inserted, deleted or replaced code point, each once.

    counts holds distinct words (column word). Words of any length; null and empty words meet nobody.
    """
    n, zero = F.length("word"), F.lit(0)
    own = counts.select("word", F.lit(1).alias("chunk"), n.alias("l"), zero.alias("s"), n.alias("e"))
    grams = counts.select("word", F.lit(0).alias("chunk"), F.explode(F.array(n - 1, n)).alias("l")).select("word", "chunk", "l", zero.alias("s"), F.col("l").alias("e"))
    rows, found = own.unionByName(grams).where("l > 0"), []
    while True:
        rows = stored(halved(rows), "chunks")
        sizes = rows.groupBy("key").agg(F.sum("chunk").alias("c"), F.sum(1 - F.col("chunk")).alias("g"), F.max(F.col("e") - F.col("s")).alias("open"))
        # a word's own gram is among g: one gram alone is no pair
        hot = (F.col("open") > 1) & ((F.col("open") > LONG) | (F.col("c") * F.col("g") > spare * (F.col("c") + F.col("g"))))
        sizes = stored(sizes.where("c > 0 AND g > 1").select("key", hot.alias("hot")), "sizes")
        cold = rows.join(sizes.where("NOT hot").select("key"), "key")
        left = cold.where("chunk = 1").select("key", F.col("word").alias("a"), "l", "s", "e")
        right = cold.where("chunk = 0").select("key", F.col("word").alias("b"))
        order = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
        (head, rest, tail), (head_b, rest_b, tail_b) = parted("a"), parted("b")
        # keys are hashes: what they stand for is compared too
        met = left.join(right, "key").where(order).where((F.levenshtein(rest, rest_b, 1) == 1) & (head == head_b) & (tail == tail_b))
        found.append(stored(met.select("a", "b").distinct(), "near"))
        if not sizes.where("hot").limit(1).count():
            break
        rows = rows.join(sizes.where("hot").select("key"), "key").select("word", "chunk", "l", "s", "e")
    return reduce(DataFrame.unionByName, found).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form), which hold no circle: the last word of each chain, by doubling steps."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = stored(at.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return at


def variants(counts: DataFrame, factor: int = 2, spare: int = SPARE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of counts (word, n), words distinct.

    form: the near word of largest n (ties: the first in code-point order) if that n is at least factor times the word's n,
    else null. root: the end of the chain of forms, the word itself without one. An empty table gives no rows; factor
    must exceed 1, so that chains end.
    """
    if factor <= 1:
        raise ValueError("factor must exceed 1")
    counts = stored(counts.select("word", "n"), "words")
    pairs = stored(near_words(counts, spare), "links")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = counts.select(F.col("word").alias("b"), F.col("n").alias("other_n"))
    best = both.join(other, "b").groupBy("a").agg(F.count(F.lit(1)).alias("near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("b").alias("form"))).alias("best"))
    out = counts.join(best.withColumnRenamed("a", "word"), "word", "left")
    enough = -F.col("best.minus") >= factor * F.col("n")
    out = stored(out.select("word", "n", F.coalesce("near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")), "forms")
    ends = roots(out.where("form IS NOT NULL"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, factor: int = 2, slips_every: int | None = None) -> DataFrame:
    """variants() of the words of whole texts. slips_every: damage words by with_slips() first, to see what is found again.

    Null and empty texts have no words; repeated rows count each; a null id only matters for slips; an empty table gives
    no rows; extra columns are ignored.
    """
    words = runs_of(docs, id_col, text_col)
    if slips_every:
        words = with_slips(words, slips_every)
    return variants(word_counts(words, least_length, least_count), factor)
