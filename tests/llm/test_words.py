"""Spelling variants, collocations and SimHash groups against plain Python."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barline.llm import phrases, queries, simhash, spelling
from tests.llm.data import ODD, words

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_variants(counts: dict[str, int], factor: int = 2) -> set:
    near = defaultdict(set)
    by_rest = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            by_rest[w[:i] + w[i + 1 :]].add(w)
        by_rest[w].add(w)
    for group in by_rest.values():
        for a, b in combinations(group, 2):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    best = {w: min(near[w], key=lambda o: (-counts[o], o)) for w in counts if near[w]}
    form = {w: b for w, b in best.items() if counts[b] >= factor * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def test_variants_of_all_documents(spark, rows):
    seen = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            seen[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    counts = {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}
    got = queries.op11(spark, SF)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute_variants(counts)


@pytest.mark.parametrize("spare", [0, 8, 10**9])
def test_near_words_however_often_the_rest_is_cut(spark, spare):
    """Words of one hot first half, of few letters, of one letter, with letters beyond ASCII, and a very long one."""
    rng = np.random.default_rng(4)
    found = {"incompre" + "".join(rng.choice(list("abé"), rng.integers(1, 6))) for _ in range(300)}
    found |= {"".join(rng.choice(list("aab"), rng.integers(1, 9))) for _ in range(150)} 
    n = 30000 if spare == 8 else 90
    found |= {"x" * n, "x" * (n - 1), "x" * (n // 2) + "y" + "x" * (n - n // 2 - 1)}
    got = spelling.near_words(spark.createDataFrame([(w,) for w in found], "word string").repartition(3), spare).collect()
    want = {frozenset(p) for p in combinations(found, 2) if abs(len(p[0]) - len(p[1])) < 2 and one_edit(*p)}
    assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_hot_chunks_give_candidates_in_proportion(spark):
    words_ = [f"commonprefix{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000]}" for i in range(3000)]
    rows = spelling.halved(spark.createDataFrame([(w,) for w in words_], "word string").select("word", F.lit(1).alias("chunk"), F.length("word").alias("l"), F.lit(0).alias("s"), F.length("word").alias("e")))
    assert rows.groupBy("key").count().agg(F.max("count")).first()[0] == 3000  # one chunk of all
    assert spelling.near_words(spark.createDataFrame([(w,) for w in words_], "word string")).count() == sum(1 for _ in pairs_of(words_))


def pairs_of(found: list[str]):
    by_hole = defaultdict(list)
    for w in found:
        for i in range(len(w)):
            by_hole[i, w[:i] + w[i + 1 :]].append(w)
    for group in by_hole.values():
        yield from combinations(group, 2)


def test_forms_chain_to_a_root_and_ties_go_to_the_first(spark):
    counts = [("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("abbbb", 48), ("ccccc", 5), ("ccccd", 10), ("cccce", 10), ("zzzzz", 4), ("zzzzy", 7)]
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame(counts, "word string, n long")).collect()}
    assert got["aaaaa"] == ("aaaab", "abbbb", 1, 6) and got["aabbb"] == ("abbbb", "abbbb", 2, 48) and got["abbbb"] == (None, "abbbb", 1, None)
    assert got["ccccc"] == ("ccccd", "ccccd", 2, 10) and got["zzzzz"] == (None, "zzzzz", 1, None)
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame(counts, "word string, n long"), factor=1)


def test_variants_of_odd_rows(odd, none):
    got = spelling.spelling_variants(odd, least_count=3).collect()
    seen = Counter(w for r in ODD for w in re.findall("[a-zÀ-ÿ]+", (r[1] or "").translate(LOWER)) if len(w) > 4)
    assert {(r.word, r.n) for r in got} == {(w, n) for w, n in seen.items() if n >= 3}
    assert spelling.spelling_variants(odd, least_length=4, slips_every=1).count() > 0 and spelling.spelling_variants(none).count() == 0


def brute_phrases(rows: list[tuple], threshold: int, top: int, percent: int = 100) -> list[tuple]:
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: c for p, c in counts.items() if len(p) > 1 and c >= threshold}
        inside = Counter()
        for p, c in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        best = []
        for p, a in found.items():
            if inside[p] and 100 * inside[p] >= percent * a:
                continue
            score, cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def test_collocations_equal_plain_counts(docs, rows):
    texts = [(r.lang, r.text) for r in rows]
    for threshold, top, percent, slack in ((20, 2000, 100, 2), (5, 40, 90, 1), (2, 100, 50, 3)):
        got = sorted(tuple(r) for r in phrases.collocations(docs, threshold, top, percent, slack=slack).collect())
        assert got == brute_phrases(texts, threshold, top, percent)


def test_collocations_of_odd_rows(spark, odd, none):
    got = sorted(tuple(r) for r in phrases.collocations(odd, threshold=2).collect())
    assert got == brute_phrases([(r[2], r[1]) for r in ODD], 2, 2000)
    signs = [(None, "Big data. big\tDATA; big  data!big\x0bdata, big data big data\x00 big data"), ("x", "é.é é"), (None, None)] * 3
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(signs, "lang string, text string"), threshold=3).collect())
    assert got == brute_phrases(signs, 3, 2000) and got
    assert phrases.collocations(none).count() == 0


def test_collocations_of_a_shard_meet_in_one_task(spark):
    """Blocks of many files; the masses are small enough for a broadcast once Spark has seen their size, the blocks are not."""
    draw = np.random.default_rng(5)
    rows = [(lang, " ".join(f"w{x}" for x in draw.zipf(1.6, 40) if x < 400)) for lang in ("en", "de", None) for _ in range(500)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(24)
    settings_ = {"spark.sql.autoBroadcastJoinThreshold": "2k", "spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings_}
    try:
        for k, v in settings_.items():
            spark.conf.set(k, v)
        blocks = phrases.stored(phrases.summaries(docs.fillna("und"), 5, 40, 12), "summaries")
        assert phrases.survivors(blocks, 100, 2, 40).count() == blocks.select("shard").distinct().count()
        got = sorted(tuple(r) for r in phrases.collocations(docs, threshold=100).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_phrases(rows, 100, 2000) and got


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), max_size=12), st.integers(2, 8), st.integers(1, 3))
def test_every_frequent_key_survives_the_summary(blocks, threshold, slack):
    """A capacity beyond mass / threshold, summaries merged in any order: what is off stays below the threshold."""
    mass = sum(map(len, blocks))
    summary = phrases.Summary(slack * mass // threshold + 1)
    for block in blocks:
        summary.add(*np.unique(np.array(block, dtype=np.uint64), return_counts=True))
    kept = set(summary.survivors(threshold).tolist())
    whole = Counter(x for b in blocks for x in b)
    assert summary.off < threshold and len(summary.keys) <= summary.capacity
    assert {x for x, c in whole.items() if c >= threshold} <= kept
    assert all(c <= whole[int(k)] <= c + summary.off for k, c in zip(summary.keys, summary.counts))


def brute_simhash(text: str | None) -> int:
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints: list[tuple[int, int]], radius: int) -> dict[int, int]:
    parent = {p: p for _, p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if bin(a ^ b).count("1") <= radius:
            parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for i, p in prints:
        least[root(p)] = min(i, least.get(root(p), i))
    return {i: least[root(p)] for i, p in prints}


def test_simhash_groups_of_all_documents(spark, rows):
    prints = [(r.doc_id, brute_simhash(r.text)) for r in rows]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op13(spark, SF).collect()}
    groups = brute_groups(prints, 4)
    assert got == {i: (f"{p:016x}", groups[i]) for i, p in prints}
    # Spark's own xxhash64 has the seed of the contract
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c d", 42)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("radius, bands", [(4, None), (4, 5), (4, 9), (1, 3), (0, None), (7, 9)])
def test_links_join_what_lies_within_the_radius(spark, radius, bands):
    """Random fingerprints, a dense ball around one, and chains of single flips."""
    rng = np.random.default_rng(radius)
    found = {int(x) for x in rng.integers(0, 2**63, 200)}
    centre = int(rng.integers(0, 2**63))
    for _ in range(300):
        x = centre
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            x ^= 1 << int(b)
        found.add(x)
    x = int(rng.integers(0, 2**63))
    for b in range(0, 64, 2):
        x ^= 3 << b
        found.add(x)
    nodes = spark.createDataFrame([(signed(x), 1) for x in found], "fp long, copies long").repartition(4)
    got = simhash.components(simhash.links(nodes, radius, bands)).collect()
    least: dict[int, set] = defaultdict(set)
    for r in got:
        least[r.comp].add(r.node)
    groups = defaultdict(set)
    for x, root in brute_groups([(x, x) for x in found], radius).items():
        groups[root].add(signed(x))
    assert {frozenset(s) for s in least.values()} == {frozenset(s) for s in groups.values() if len(s) > 1}


def test_embedding_bounds_the_difference_from_below(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(a) ^ int(m) & int(n)) for a, m, n in rng.integers(-(2**63), 2**63 - 1, (400, 3))]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", simhash.manhattan(simhash.embedded(F.col("a")), simhash.embedded(F.col("b"))).alias("d"))
    counts = lambda x: [bin((x >> 2 * s) & 3).count("1") for s in range(32)]
    for a, b, d in df.collect():
        assert d == sum(abs(x - y) for x, y in zip(counts(a), counts(b))) <= bin((a ^ b) & (2**64 - 1)).count("1")
    for bands in (5, 6, 9):
        masks = simhash.cell_masks(bands, 4)
        assert len(set(masks)) == len(masks)
    assert [simhash.band_count(n, 4) for n in (0, 50_000, 14_000_000)] == [8, 8, 9]


def test_cells_of_few_nodes_are_not_broadcast(spark, monkeypatch):
    """Exploded cells are some 70 times the nodes, which Spark does not count: they must not become a broadcast table."""
    plans, stored = {}, simhash.stored

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(simhash, "stored", kept)
    nodes = spark.range(300).select(F.xxhash64("id").alias("fp"), F.lit(1).cast("long").alias("copies"))
    simhash.links(nodes, 4)
    assert "SortMergeJoin" in plans["members"] and "Broadcast" not in plans["members"]


def test_simhash_of_odd_rows(odd, none):
    got = simhash.simhash_duplicates(odd).collect()
    assert len(got) == len(ODD)
    of = lambda i: {(r.fingerprint, r.component_id) for r in got if r.doc_id == i}
    assert of(2) == of(3) == of(4) == {("0" * 16, 2)} and of(5) == {(f"{brute_simhash('two words'):016x}", 5)} and of(6) == {(f"{brute_simhash('two words'):016x}", 5)}
    assert len(of(1)) == 1 and {c for _, c in of(None)} == {None}
    assert simhash.simhash_duplicates(none).count() == 0
