"""Token counts that follow edits: a segment tree of pre-token runs for each document.

Method: a text's pre-tokens are grouped into leaves; a tree over the leaves holds the sums of code points and tokens
below each node. An edit finds its leaves by descending the tree, re-encodes only the text it touches plus the
pre-tokens before it that it can change, stops where the pre-tokens fall in step with the old ones again, and
renews the sums on the paths of the leaves it replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.common import slices

LEAF = 32
#: Distinct pre-tokens whose counts a task keeps.
KEPT = 300_000
#: Bytes of text whose trees a task holds at once; a longer text is held alone.
SLICE = 1_000_000


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Token counts of pre-tokens of a byte-level BPE given as ranks."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.kept: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.kept.get(piece)
        if n is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            n = self.kept[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class Tree:
    """Leaves of up to 2 LEAF pre-tokens, with sums of code points and tokens in a complete binary tree over them.

    spans[i]: lengths of leaf i's pre-tokens; chars and tokens: one array each, node 1 is the root, leaf i is node
    size + i. When edits change the number of leaves, the leaves' sums move and the inner sums are added up anew,
    without encoding anything.
    """

    def __init__(self, spans: list[list[int]], counts: list[list[int]]):
        self.spans, self.counts = spans, counts
        self.lay()

    @classmethod
    def of(cls, text: str, counter: Counter) -> Tree:
        parts = counter.pattern.findall(text)
        lengths, counts = [len(p) for p in parts], [counter.count(p) for p in parts]
        at = range(0, len(parts), LEAF)
        return cls([lengths[i : i + LEAF] for i in at], [counts[i : i + LEAF] for i in at])

    @classmethod
    def kept(cls, lengths: list[int], counts: list[int], sizes: list[int]) -> Tree:
        """From what leaves() gave."""
        spans, tokens, at = [], [], 0
        for n in sizes:
            spans.append(list(lengths[at : at + n]))
            tokens.append(list(counts[at : at + n]))
            at += n
        return cls(spans, tokens)

    def leaves(self) -> tuple[list[int], list[int], list[int]]:
        return [x for s in self.spans for x in s], [x for c in self.counts for x in c], [len(s) for s in self.spans]

    def lay(self) -> None:
        self.size = 1 << max(0, (max(1, len(self.spans)) - 1).bit_length())
        self.chars, self.tokens = np.zeros(2 * self.size, dtype=np.int64), np.zeros(2 * self.size, dtype=np.int64)
        n = len(self.spans)
        self.chars[self.size : self.size + n] = [sum(s) for s in self.spans]
        self.tokens[self.size : self.size + n] = [sum(c) for c in self.counts]
        width = self.size // 2
        while width:
            for a in (self.chars, self.tokens):
                a[width : 2 * width] = a[2 * width : 4 * width : 2] + a[2 * width + 1 : 4 * width : 2]
            width //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its first code point) of the leaf that holds code point at; the last leaf for the end."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def renew(self, leaf: int) -> None:
        """The sums of one changed leaf and of the nodes above it."""
        node = self.size + leaf
        self.chars[node], self.tokens[node] = sum(self.spans[leaf]), sum(self.counts[leaf])
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, text: str, at: int, drop: int, put: str, counter: Counter) -> tuple[str, int]:
        """Replace drop code points at `at` by put: the new text and the number of pre-tokens encoded again."""
        at = min(max(at, 0), len(text))
        drop = min(max(drop, 0), len(text) - at)
        new = text[:at] + put + text[at + drop :]
        if not self.spans:
            fresh = Tree.of(new, counter)
            self.spans, self.counts = fresh.spans, fresh.counts
            self.lay()
            return new, sum(map(len, fresh.spans))
        # Left context. A pre-token that ended at or before `at` may grow or, if it is a run of white space, end
        # elsewhere, since it looks at the characters behind it. So go back two pre-tokens, and past any white space.
        first, begin = self.find(max(0, at - 1))
        start = begin
        bounds = [begin]
        for n in self.spans[first]:
            start += n
            bounds.append(start)
        i = max(k for k, b in enumerate(bounds) if b <= max(0, at - 1))
        back = 2
        while (i or first) and (back or text[bounds[i] - 1].isspace() or text[bounds[i]].isspace()):
            if i:
                i -= 1
            else:
                first -= 1
                begin -= sum(self.spans[first])
                bounds = [begin]
                for n in self.spans[first]:
                    bounds.append(bounds[-1] + n)
                i = len(self.spans[first]) - 1
            back = max(0, back - 1)
        place = bounds[i]
        lengths, counts = self.spans[first][:i], self.counts[first][:i]
        # Right end. From the first new pre-token border behind the edit that is also an old border, all is as before.
        shift = len(put) - drop
        last, old, j = first, place, i  # old: code point of the j-th border of leaf last
        encoded = 0
        for m in counter.pattern.finditer(new, place):
            if m.start() >= at + len(put):
                while old < m.start() - shift:
                    old += self.spans[last][j]
                    j += 1
                    if j == len(self.spans[last]) and last + 1 < len(self.spans):
                        last, j = last + 1, 0
                if old == m.start() - shift and old >= at + drop:
                    break
            lengths.append(m.end() - m.start())
            counts.append(counter.count(m.group()))
            encoded += 1
        else:
            last, j = len(self.spans) - 1, len(self.spans[-1])
        lengths += self.spans[last][j:]
        counts += self.counts[last][j:]
        if first == last and 0 < len(lengths) <= 2 * LEAF:
            self.spans[first], self.counts[first] = lengths, counts
            self.renew(first)
        else:
            cut = range(0, len(lengths), LEAF)
            self.spans[first : last + 1] = [lengths[k : k + LEAF] for k in cut]
            self.counts[first : last + 1] = [counts[k : k + LEAF] for k in cut]
            self.lay()
        return new, encoded


TREE = T.StructType([T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("lengths", "counts", "leaves")])


def with_trees(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text") -> DataFrame:
    """docs plus `tree` (pre-token lengths, their counts, pre-tokens a leaf) and `n_tokens`. No shuffle.

    Null text counts as empty: an empty tree and 0 tokens. Columns named tree or n_tokens are replaced; null ids and
    repeated rows stay; an empty table gives no rows.
    """
    path = tokenizer or tokenizer_path()
    rows = docs.drop("tree", "n_tokens")
    place = rows.columns.index(text_col)
    tree_type = pa.struct([(n, pa.list_(pa.int32())) for n in ("lengths", "counts", "leaves")])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in slices(batches, place, SLICE):
            trees, totals = [], []
            for text in batch.column(place).to_pylist():
                tree = Tree.of(text or "", counter)
                lengths, counts, leaves = tree.leaves()
                trees.append({"lengths": lengths, "counts": counts, "leaves": leaves})
                totals.append(tree.n_tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees, tree_type), pa.array(totals, pa.int64())], names=[*batch.schema.names, "tree", "n_tokens"])

    schema = T.StructType([*rows.schema.fields, T.StructField("tree", TREE), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(build, schema)


def with_edit_log(docs: DataFrame, log: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs plus `edits`, from a log of (doc_id, seq, at, drop, put): one shuffle of both; edits in seq order."""
    one = F.struct("seq", F.struct("at", "drop", "put").alias("e"))
    grouped = log.groupBy(F.col(id_col).alias("_log_id")).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["e"]).alias("edits"))
    return docs.drop("edits").join(grouped, F.col(id_col) == F.col("_log_id"), "left").drop("_log_id")


def recount(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with text, tree, n_tokens and `edits` renewed: edits are applied in order, each to the text before it.

    An edit replaces `drop` code points at `at` by `put`; places beyond the text are moved to its end, null counts as 0
    or as empty text. Adds `reencoded`: the pre-tokens encoded again. No shuffle.
    """
    path = tokenizer or tokenizer_path()
    rows = docs.drop("reencoded")
    names = rows.columns
    place = {c: names.index(c) for c in (text_col, "tree", "n_tokens", "edits")}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in slices(batches, place[text_col], SLICE):
            texts, trees, totals, work = [], [], [], []
            for text, tree, edits in zip(*[batch.column(place[c]).to_pylist() for c in (text_col, "tree", "edits")]):
                state = Tree.kept(tree["lengths"], tree["counts"], tree["leaves"])
                done, now = 0, text or ""
                for e in edits or []:
                    if e is not None:
                        now, n = state.edit(now, e["at"] or 0, e["drop"] or 0, e["put"] or "", counter)
                        done += n
                lengths, counts, leaves = state.leaves()
                texts.append(now if edits or text is not None else None)
                trees.append({"lengths": lengths, "counts": counts, "leaves": leaves})
                totals.append(state.n_tokens)
                work.append(done)
            columns = list(batch.columns)
            for c, values in ((text_col, texts), ("tree", trees), ("n_tokens", totals)):
                columns[place[c]] = pa.array(values, batch.schema.field(place[c]).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(work, pa.int64())], names=[*batch.schema.names, "reencoded"])

    return rows.mapInArrow(apply, T.StructType([*rows.schema.fields, T.StructField("reencoded", T.LongType())]))
