"""Token ids by chunk: a chunk (text between ASCII white space) is encoded once and kept."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

#: Bytes of distinct chunks that a task keeps (with some 100 more for each chunk); beyond, it forgets all and goes on.
KEPT_BYTES = 60_000_000
#: Chunks encoded in one call.
JOINED = 2_000
#: Bytes of text handled at once; a longer text is handled on its own.
GROUP = 2_000_000
#: A border between a letter or digit and such a sign is one for the tokenizer too, so a space may stand there.
SIGNS = b".,!?;:"
KIND = np.array([1 if chr(b).isascii() and chr(b).isalnum() else 2 if b in SIGNS else 0 for b in range(256)], dtype=np.uint8)
#: A capital before a mark from U+0300 to U+037F: NFC composes the two before the tokenizer lowers letters, and some pairs only compose in lower case.
MARKED = re.compile(rb"[A-Z][\xcc\xcd]")
#: Special tokens begin so; they are found in texts as they are, in their own case.
SPECIAL = b"<|"
#: A special token, which ends whatever stands before it, and its id.
BETWEEN, BETWEEN_ID = "<|endoftext|>", 49407
#: Stands after each text of a group whose texts do not hold it.
MARK = b"\0"
#: No chunk is white space.
OTHER_MARK = b"\n"


class Places(dict):
    """A number for each chunk; new ones are noted as fresh."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []
        self.size = 0

    def __missing__(self, chunk: bytes) -> int:
        n = self[chunk] = len(self)
        self.fresh.append(chunk)
        self.size += len(chunk) + 100
        return n


def spaced(data: bytes) -> bytes:
    """A space before each sign that follows an ASCII letter or digit."""
    values = np.frombuffer(data, dtype=np.uint8)
    kind = KIND[values]
    at = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1
    return np.insert(values, at, 32).tobytes()


def case_matters(data: bytes) -> bool:
    """Whether ASCII letters must be left for the tokenizer to lower. Any other ASCII capital neither composes with its neighbours nor is part of a special token."""
    return SPECIAL in data or (not data.isascii() and MARKED.search(data) is not None)


def chunks(data: bytes) -> list[bytes]:
    """The chunks of a text, in lower case where that changes no id, so that more of them are alike."""
    if not case_matters(data):
        return spaced(data.lower()).split()
    return [c if case_matters(c) else c.lower() for c in spaced(data).split()]


def marked_chunks(group: list[bytes]) -> tuple[list[bytes], bytes]:
    """The chunks of all texts with a mark after each text, and the mark. One pass unless a text needs a closer look."""
    whole = (b" " + MARK + b" ").join([*group, b""])
    if whole.count(MARK) == len(group) and not case_matters(whole):
        return spaced(whole.lower()).split(), MARK
    return [c for data in group for c in (*chunks(data), OTHER_MARK)], OTHER_MARK


class ChunkEncoder:
    """Ids of whole texts for a tokenizer that lowers letters, drops white space and never joins across it.

    word_bpe_49k is such a tokenizer. Texts are cut at ASCII white space and before a sign that follows an ASCII letter
    or digit; other white space stays inside a chunk and is dropped by the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.place = Places()
        self.ids = np.empty(0, dtype=np.uint32)
        self.start, self.length = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def learn(self) -> None:
        fresh, self.place.fresh = self.place.fresh, []
        if fresh:
            # chunks that may hold special tokens are encoded by themselves, others many at a time with a special token after each
            alone = [SPECIAL in c for c in fresh]
            joined = [c.decode("utf-8", "replace") for c, a in zip(fresh, alone) if not a]
            calls = [BETWEEN.join([*joined[i : i + JOINED], ""]) for i in range(0, len(joined), JOINED)]
            flat = np.concatenate([np.empty(0, dtype=np.uint32), *[np.array(self.ids_of(c), dtype=np.uint32) for c in calls]])
            ends = np.flatnonzero(flat == BETWEEN_ID)
            parts = iter(np.split(flat, ends + 1))
            found = [np.array(self.ids_of(c.decode("utf-8", "replace")), dtype=np.uint32) if a else next(parts)[:-1] for c, a in zip(fresh, alone)]
            length = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            ids = np.concatenate(found)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
            self.length, self.ids = np.concatenate([self.length, length]), np.concatenate([self.ids, ids])

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text as uint32; a null text has none."""
        group, size = [], 0
        for text in texts:
            data = (text or "").encode("utf-8")
            if group and size + len(data) > GROUP:
                yield from self.encode_group(group)
                group, size = [], 0
            group.append(data)
            size += len(data)
        if group:
            yield from self.encode_group(group)

    def encode_group(self, group: list[bytes]) -> Iterator[np.ndarray]:
        parts, mark = marked_chunks(group)
        if self.place.size > KEPT_BYTES:
            self.forget()
        at = np.fromiter(map(self.place.__getitem__, parts), dtype=np.int64, count=len(parts))
        self.learn()
        last = at == self.place[mark]
        length = np.where(last, 0, self.length[at])
        upto = np.cumsum(length)
        shift = np.repeat(self.start[at] - (upto - length), length)
        ids = self.ids[shift + np.arange(len(shift))]
        ends = upto[last]
        for begin, end in zip([0, *ends[:-1]], ends):
            yield ids[begin:end]
