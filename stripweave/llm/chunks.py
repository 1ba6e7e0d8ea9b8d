"""Whole texts as chunks whose token ids do not depend on their neighbours.

A byte-level pre-tokenizer always starts a new piece before the last white-space character of a
run that is followed by something else, so ` ?non-space+` and the rest of each run can be
encoded alone and kept in a bounded table of this worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as Unicode's White_Space property has it; Python's \s has four control characters more.
SPACE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A chunk's last characters, behind a letter, are a piece of their own if they are these; no apostrophe, as pieces may begin with one.
TAIL = re.compile(r"[!-&(-/:-@\[-`{-~]{1,8}\Z")
ENDS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


#: A character that no text is split at; texts that have it, or white space in runs that form pieces, are split by CHUNK.
MARK = "\x1f"
OTHER_SPACE = [x for x in SPACE if x not in " \n"]
RUN = re.compile(f"[{SPACE}]{{3}}|[{SPACE}]{{2}}\\Z")
#: The same for Arrow, with MARK.
ODD = f"{MARK}|[{SPACE}]{{3}}|[{SPACE}]{{2}}\\z"


def split(text: str) -> list[str]:
    """Chunks of a text: before each space and around each line feed, unless longer runs of white space call for CHUNK."""
    doubtful = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(x in text for x in OTHER_SPACE)
    if MARK in text or (doubtful and RUN.search(text)):
        return CHUNK.findall(text)
    return [x for x in text.replace(" ", MARK + " ").replace("\n", f"{MARK}\n{MARK}").split(MARK) if x]


def printable_bytes() -> dict[str, int]:
    """The rule by which vocabulary files write bytes as printable characters."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkTable:
    """Texts to packed ids (uint16 or uint32, little-endian) by way of chunks kept from earlier texts.

    encode_chunks: distinct chunks to packed ids. added: texts of added tokens and their packed ids,
    cut out first. Chunks are kept in two generations: when the young one has more than half of `most`
    chunks, it becomes the old one, and what is not asked for again before the next change is
    forgotten. So memory is bounded, and frequent chunks stay.
    """

    def __init__(self, encode_chunks: Callable[[list[str]], list[bytes]], added: dict[str, bytes], most: int = 1_400_000):
        self.encode_chunks, self.added, self.most = encode_chunks, added, most
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.odd = f"{ODD}|{self.cut.pattern}" if self.cut else ODD

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Most texts are split by Arrow; those with longer runs of white space, added tokens or MARK one by one."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, self.odd)
        marked = pc.replace_substring(pc.replace_substring(texts.filter(pc.invert(odd)), " ", MARK + " "), "\n", f"{MARK}\n{MARK}")
        parts = pc.split_pattern(marked, MARK)  # empty chunks have no ids
        plain = iter(self.joined(pc.list_flatten(parts), pc.list_value_length(parts).to_numpy(zero_copy_only=False)))
        rows = [self.pieces(x) for x in texts.filter(odd).to_pylist()]
        others = iter(self.joined(pa.array([x for row in rows for x in row], pa.large_string()), np.array([len(row) for row in rows], np.int64)))
        return [next(others if x else plain) for x in odd.to_pylist()]

    def pieces(self, text: str) -> list[str]:
        found: list[str] = []
        for piece in self.cut.split(text) if self.cut else [text]:
            found += [piece] if piece in self.added else split(piece)
        return found

    def joined(self, chunks: pa.Array, counts: np.ndarray) -> list[bytes]:
        """The ids of each text, whose chunks come one after the other; a chunk is looked up once."""
        coded = chunks.dictionary_encode()
        ids = pa.array(self.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        if not len(ids):
            return [b""] * len(counts)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64, len(ids) + 1)[np.concatenate([[0], np.cumsum(counts)])].tolist()
        raw = memoryview(data or b"")
        return [raw[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]

    def look_up(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of distinct chunks."""
        if len(self.young) > self.most // 2:
            self.young, self.old = {"": b""}, self.young
        found = list(map(self.young.get, chunks))
        gaps = [i for i, x in enumerate(found) if x is None]
        if gaps:
            self.learn([chunks[i] for i in gaps])
            for i in gaps:
                found[i] = self.young[chunks[i]]
        return found

    def learn(self, wanted: list[str]) -> None:
        """Takes chunks from the old generation, or encodes them: those with a tail by way of both parts."""
        if self.old:
            kept = list(map(self.old.get, wanted))
            self.young.update((x, ids) for x, ids in zip(wanted, kept, strict=True) if ids is not None)
            wanted = [x for x, ids in zip(wanted, kept, strict=True) if ids is None]
        self.young.update((x, self.added[x]) for x in wanted if x in self.added)
        last = [x for x in wanted if x[-1] in ENDS and x not in self.added]
        cuts = [TAIL.search(x).start() for x in last]
        ended = [(x, x[:k], x[k:]) for x, k in zip(last, cuts, strict=True) if x[k - 1 : k].isalpha()]
        whole = {x for x, _, _ in ended}
        parts = {x for _, *both in ended for x in both}
        parts.update(x for x in wanted if x not in whole and x not in self.added)
        new = [x for x in parts if x not in self.young]
        self.young.update(zip(new, self.encode_chunks(new), strict=True))
        self.young.update((x, self.young[a] + self.young[b]) for x, a, b in ended)
