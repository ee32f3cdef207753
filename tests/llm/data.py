"""Small tables and plain Python versions of what the operators compute."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

DOCS = "/root/testdata/sf0.001/documents.parquet"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and white texts, few words, repeated rows, other scripts, a long text.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 59),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 59),
    (2, None, "en", "a", None),
    (3, "", "en", None, 0),
    (4, " \t\n", None, "b", 3),
    (5, "two words", "en", "b", 9),
    (6, "Two WORDS", "en", "b", 9),
    (None, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 59),
    (7, "12345 !!! 67890", "en", "b", 15),
    (8, "naïve 𝔘nicode   text \U0001f600 with password = hunter2hunter2 in it", "en", None, None),
    (9, "lorem ipsum dolor sit amet " * 30000, "la", "c", None),
    (-4, "İstanbul ß ſ K Σας", "tr", "c", 18),
]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None) -> set:
    w = words(text)
    return set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())


def held(doc_id: int | None, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == fold


def groups(rows: list[tuple[int, str | None]], percent: int) -> dict[int, int]:
    """Smallest reachable id of each id, by counting every shared shingle of every pair."""
    sets = [shingles(t) for _, t in rows]
    holders, shared, parent = defaultdict(list), Counter(), {i: i for i in range(len(rows))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for members in holders.values():
        for n, i in enumerate(members):
            for j in members[n + 1 :]:
                shared[i, j] += 1
    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return {doc_id: least[root(i)] for i, (doc_id, _) in enumerate(rows) if doc_id is not None}
