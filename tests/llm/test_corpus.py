"""Language-model scores, mixing, packing, search, edit counts and the pipeline against plain Python."""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barline.llm import common, mixing, ngrams, packing, queries, recount, topk
from barline.llm.tokens import ChunkEncoder
from tests.llm.data import ODD, held, words

SF = "/root/testdata/sf0.001"


def plain_scores(rows, strength):
    single, pairs = Counter(), Counter()
    for doc_id, text in rows:
        if not held(doc_id, 1):
            w = [*words(text), None]
            single.update(w)
            pairs.update(zip([None, *w[:-1]], w))
    n, v = sum(single.values()), len(single)
    for doc_id, text in rows:
        w = [*words(text), None]
        p = [(single[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        full = [(pairs[h, x] + strength * q) / (single[h] + strength) for h, x, q in zip([None, *w[:-1]], w, p)]
        yield doc_id, held(doc_id, 1), len(w), sum(single[x] > 0 for x in w), n, sum(map(math.log10, p)), sum(map(math.log10, full))


def same(got, want):
    got, want = (sorted(x, key=lambda r: (r[0] is None, r[0] or 0)) for x in (got, want))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert tuple(g)[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)


@pytest.mark.parametrize("tokens, keys", [(1_000_000, 400_000), (2_000, 500)])
def test_scores_equal_a_plain_model(docs, rows, odd, none, monkeypatch, tokens, keys):
    monkeypatch.setattr(ngrams, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(ngrams, "SHARD_KEYS", keys)
    got = ngrams.score(docs).collect()
    same(got, plain_scores([(r.doc_id, r.text) for r in rows], ngrams.STRENGTH))
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    same(ngrams.score(odd).collect(), plain_scores([r[:2] for r in ODD], ngrams.STRENGTH))
    assert ngrams.score(none).count() == 0


def test_a_state_adds_up_to_one():
    """Over all known words and one unknown word, for a seen and an unseen history."""
    counts, pairs, m = Counter("aabbbc"), Counter({("a", "b"): 2}), ngrams.STRENGTH
    n, v = 6, 3
    for h in "az":
        total = sum((pairs[h, w] + m * (counts[w] + 0.5) / (n + 0.5 * (v + 1))) / ((counts[h] if h == "a" else 0) + m) for w in "abc?")
        assert math.isclose(total, 1)


def test_poisson_draws_have_the_wanted_mean(spark):
    df = spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 30 == 0, None).otherwise("small").alias("source"))
    mixed = mixing.poisson_mix(df, {"big": 1.0, "small": 2.0, None: 1.0}, total=40000)
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    for name, want in (("big", 10000), ("small", 20000), (None, 10000)):
        assert abs(got[name] - want) < 5 * math.sqrt(want), (name, got[name])
    per = mixed.where("source = 'small'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copies").alias("c"), F.countDistinct("copy").alias("k"))
    assert per.where("n <> c OR n <> k").count() == 0


def test_poisson_inverts_the_distribution(spark):
    for rate in (0.01, 1.0, 7.5, 900.0):
        cdf = spark.range(1).select(mixing.distribution(F.lit(rate)).alias("c")).first().c
        assert cdf == sorted(cdf) and abs(cdf[-1] - 1) < 1e-9
        mean = sum(1 - c for c in cdf)
        assert abs(mean - rate) < 1e-6 * max(rate, 1)


def test_mix_is_shuffled_and_takes_odd_rows(docs, odd, none):
    ids = [r.doc_id for r in mixing.poisson_mix(docs).select("doc_id").collect()]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.3
    got = mixing.poisson_mix(odd)
    assert got.columns.count("copy") == 1 and got.where("copies < copy").count() == 0
    assert mixing.poisson_mix(odd, {"a": 1.0}).where("source IS NULL OR source <> 'a'").count() == 0
    assert mixing.poisson_mix(none).count() == 0
    one = mixing.poisson_mix(docs, shuffle=False)
    assert one.select("doc_id", "copy").exceptAll(mixing.poisson_mix(docs).select("doc_id", "copy")).count() == 0


def test_mix_without_a_broadcast(docs, monkeypatch):
    want = mixing.poisson_mix(docs).select("doc_id", "copy")
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    got = mixing.poisson_mix(docs).select("doc_id", "copy")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def plain_pieces(doc_id, text, tokenizer, capacity):
    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
    return [(doc_id, i, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for i, at in enumerate(range(0, len(ids), capacity))]


def sound(placed, capacity):
    for _, g in placed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= capacity


def test_packs_all_pieces_tightly(spark, rows):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    placed = queries.op6(spark, SF).toPandas()
    want = sorted(p for r in rows for p in plain_pieces(r.doc_id, r.text, tokenizer, 4096))
    assert sorted(placed[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    sound(placed, 4096)
    assert placed.sequence_id.nunique() <= -(-placed.length.sum() // 4096) + 1


def test_packs_odd_rows(odd, none):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    placed = packing.pack_documents(odd, capacity=100).toPandas()
    key = lambda p: (p[0] is None, p[0] or 0, *p[1:])
    got = [(None if np.isnan(p[0]) else int(p[0]), *p[1:]) for p in placed[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)]
    want = [p for r in ODD for p in plain_pieces(r[0], r[1], tokenizer, 100)]
    assert sorted(got, key=key) == sorted(want, key=key)
    sound(placed, 100)
    assert packing.pack_documents(none).count() == 0


def test_sequences_hold_the_ids(docs):
    some = docs.where("doc_id < 30")
    cut = common.stored(packing.pieces(some, capacity=512), "pieces")
    placed = packing.pack(cut.drop("ids"), 512, ["doc_id", "piece"])
    out = packing.sequences(cut, placed).collect()
    assert sum(len(r.ids) for r in out) == cut.agg(F.sum("length")).first()[0] and max(len(r.ids) for r in out) <= 512
    first = {(r.doc_id, r.piece): r.ids for r in cut.collect()}
    where = {r.sequence_id: r.ids for r in out}
    for r in placed.collect():
        assert where[r.sequence_id][r.offset : r.offset + r.length] == first[r.doc_id, r.piece]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50), max_size=20))
def test_plans_use_every_piece_once(counts):
    used, bins = Counter(), 0
    for pattern, times in packing.plan(counts, 64):
        assert sum(length * n for length, n in pattern) <= 64 and times > 0
        for length, n in pattern:
            used[length] += n * times
        bins += times
    assert used == Counter({k: v for k, v in counts.items() if v})
    total = sum(k * v for k, v in counts.items())
    assert bins <= 2 * (total // 64) + 2


def test_two_pieces_replace_one_that_fits_worse():
    # greedy takes 60 and 30, a gap of 10; 30 goes back for 20 + 19, a gap of 1
    assert packing.plan({60: 1, 30: 1, 20: 1, 19: 1}, 100)[0][0] == [(60, 1), (20, 1), (19, 1)]


CHARS = st.text(st.sampled_from("ab Zé'’sß12\n\t ́\x1c .,!İ𝔘\U0001f600<|>"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(CHARS)
def test_chunks_encode_like_whole_texts(text):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    assert list(next(ChunkEncoder(packing.tokenizer_path()).encode([text]))) == tokenizer.encode(text, add_special_tokens=False).ids


CASES = ["a<|ENDOFTEXT|>b", "A<|endoftext|>B", "<|StartOfText|> X", "T\u0308est", "J\u030c", "H\u0331", "W\u030a Y\u030a", "E\u0301T\u0308T\u0301. End", "\u212a\u0331A <| T\u0308", "CAF\u00c9 \u0130stanbul"]


@pytest.mark.parametrize("text", [*CASES, " ".join(CASES), "Plain Words, ".join(CASES)])
def test_case_is_left_to_the_tokenizer(text):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    encoder = ChunkEncoder(packing.tokenizer_path())
    for t in (text.lower(), text, text.upper()):  # one encoder: chunks kept for one case must not serve another
        assert list(next(encoder.encode([t]))) == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoding():
    with open(recount.tokenizer_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return recount.Counter(recount.tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(CHARS.map(lambda t: t * 6), st.lists(st.tuples(st.integers(0, 400), st.integers(0, 30), CHARS), max_size=5))
def test_edited_trees_count_like_whole_texts(encoding, counter, text, steps):
    tree = recount.Tree.of(text, counter)
    for at, drop, put in steps:
        text, _ = tree.edit(text, at, drop, put, counter)
        assert tree.n_tokens == len(encoding.encode_ordinary(text))
        assert int(tree.chars[1]) == len(text)
        tree = recount.Tree.kept(*tree.leaves())


def test_edits_reencode_little(counter):
    text = "some plain words and more of them, one after another. " * 2000
    tree = recount.Tree.of(text, counter)
    new, done = tree.edit(text, 50_000, 3, "xyz", counter)
    assert done < 20 and new != text


def test_edit_counts_equal_whole_counts(spark, rows, encoding):
    got = {r.doc_id: r for r in queries.op10(spark, SF).collect()}
    for r in rows:
        n, text = len(r.text), r.text
        for at, drop, put in ((n // 3, 25, ""), (n // 2, 0, r.text[:40]), (max(n - 10, 0), 5, " revised")):
            at = min(at, len(text))
            text = text[:at] + put + text[at + drop :]
        x = got[r.doc_id]
        assert (x.n_tokens, x.edited_tokens) == (len(encoding.encode_ordinary(r.text)), len(encoding.encode_ordinary(text)))
        assert x.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edit_log_and_odd_rows(spark, odd, none, encoding):
    log = spark.createDataFrame([(1, 2, 0, 3, "A"), (1, 1, 0, 0, "the "), (3, 1, 5, 5, "new text"), (99, 1, 0, 0, "?"), (5, 1, None, None, None)], "doc_id long, seq int, at long, drop long, put string")
    done = recount.recount(recount.with_edit_log(recount.with_trees(odd), log))
    rows = done.collect()
    assert len(rows) == len(ODD) and all(r.n_tokens == len(encoding.encode_ordinary(r.text or "")) for r in rows)
    text = {r.doc_id: r.text for r in rows}
    assert text[1].startswith("A the quick") and text[3] == "new text" and text[2] is None and text[5] == "two words"
    assert recount.recount(recount.with_edit_log(recount.with_trees(none), log)).count() == 0


def plain_search(rows, k, every):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sound:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q and len(v) == len(w))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 37])
def test_search_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op8(spark, SF).collect())) == plain_search(rows, 5, 50)


def test_search_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [9.0, 9.0]), (7, [-1.5, 0.25]), (8, [1.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    assert sorted(map(tuple, topk.top_k_search(df, df.where("vec_id % 50 = 0"), 3).collect())) == plain_search(rows, 3, 50)
    assert topk.top_k_search(df.where("false"), df.where("false")).count() == 0


def test_search_stops_early():
    """One row far ahead: the lists need not be read to their ends."""
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 10, (5000, 2))
    rows[77] = (1000, 1000)
    q, r, s = topk.threshold_top_k(rows, np.arange(5000), np.array([[3, 5]]), np.array([-1]), 1)
    assert list(r) == [77] and list(s) == [8000]


def test_pipeline_stage_by_stage(spark, tmp_path, docs):
    import corpus_pipeline as p
    from tests.llm.data import groups, shingles

    assert [n for n, _ in p.STAGES] == ["language ID", "MinHash near-dedup", "secret scan", "Poisson mix", "best-two-fit packing"]
    extra = spark.createDataFrame([(9001, "12 34", None, None, 5), (9002, None, "en", "src0", None), (9003, "the password: abcdefgh12 is of the and that here with more", "en", "src0", 58), (None, "the of and that this with these others of it", "en", None, 44)], docs.schema)
    now = docs.unionByName(extra)
    for i, (_, stage) in enumerate(p.STAGES):
        stage(spark, now, SF).write.parquet(str(tmp_path / str(i)))
        before, now = now.collect(), spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert now.columns == p.COLUMNS and now.schema == docs.schema
        ids = {r.doc_id for r in now.select("doc_id").collect()}
        if i == 0:
            assert {r.doc_id for r in before} - ids == {9001, 9002}
        if i == 1:
            want = {k for k, v in groups([(r.doc_id, r.text) for r in before], 80).items() if k == v}
            assert ids == want | {None}
        if i == 2:
            assert len(before) == now.count() and "abcdefgh12" not in now.where("doc_id = 9003").first().text
            assert now.where("n_chars <> length(text)").count() == 0
        if i == 3:
            assert ids <= {r.doc_id for r in before}
        if i == 4:
            tokens = Tokenizer.from_file(packing.tokenizer_path())
            assert now.agg(F.sum("length")).first()[0] == sum(len(tokens.encode(r.text, add_special_tokens=False).ids) + 1 for r in before)
            sound(now.toPandas(), 4096)
    assert shingles("") == set()


def test_groups_of_texts_encode_like_each_text():
    """Texts of one group, with marks, special tokens and the group's own mark inside."""
    texts = ["Plain Words, plain.", None, "", "a\0b \0 c", "T\u0308est <|endoftext|> X,y", "naïve café! 12,5", " \t\n"] * 3
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for group in (texts, [t for t in texts if t and t.isascii() and "\0" not in t and "<" not in t], [t for t in texts if t and "\0" in t]):
        got = [list(x) for x in ChunkEncoder(packing.tokenizer_path()).encode(group)]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in group]


def test_sequences_of_repeated_pieces(spark):
    """Copies, null ids and different texts under one id come out once each, with the ids of their texts."""
    texts = [(1, "some words here"), (1, "some words here"), (1, "other words"), (None, "no id"), (None, "no id"), (2, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    cut = packing.pieces(df)
    got = packing.sequences(cut, packing.pack_documents(df)).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in texts)
    flat = [i for r in got for i in r.ids]
    assert len(flat) == sum(map(len, want)) and sorted(split_ends(flat)) == want
    assert sorted([d for r in got for d in r.doc_ids], key=repr) == sorted([i for i, _ in texts], key=repr)


def split_ends(ids: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[]]
    for i in ids:
        out[-1].append(i)
        if i == 1:
            out.append([])
    return out[:-1]


def test_pipeline_dedup_judges_texts_under_one_id_apart(spark):
    import corpus_pipeline

    texts = [(1, " ".join(f"a{i}" for i in range(30))), (1, " ".join(f"b{i}" for i in range(30))), (1, " ".join(f"b{i}" for i in range(30))), (5, " ".join(f"a{i}" for i in range(30))), (None, "x y"), (None, "x y")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=repr) == sorted([texts[0], texts[1], texts[4], texts[5]], key=repr)
    assert corpus_pipeline.near_duplicates(spark, df.where("false"), "").count() == 0
