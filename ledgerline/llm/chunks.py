"""Encode texts piece by piece with a memory of the pieces seen last.

The byte-level pattern of both vocabularies never matches across the start of a space that stands
between two characters which aren't white space, so a text may be cut there and the parts encoded
by themselves: same ids, and parts that come again are looked up.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Everything that some engine counts as white space, but for the space itself.
_OTHERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if (c.isspace() or c == "\x85") and c != " ")
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")
#: Parts at which a generation of a memory is full, and the longest part that is remembered.
MEMORY, LONGEST = 500_000, 48
#: Texts are encoded in groups of about so many characters.
GROUP = 8_000_000
#: Both for workers that hold other operators' models as well: less memory, more work.
SMALL_MEMORY, SMALL_GROUP = 100_000, 2_000_000


def regular(text: str) -> bool:
    """Does every space of a text stand between characters that aren't white space?"""
    if text[:1] == " " or text[-1:] == " " or "  " in text:
        return False
    return all(c not in text or (c + " " not in text and " " + c not in text) for c in _OTHERS)


def cut(text: str) -> list[str]:
    """Parts of a text; each but the first has lost the space it begins with."""
    return text.split(" ") if regular(text) else _CUT.split(text)


class Memory:
    """Values by key in two generations: a full young one becomes the old one, and what is asked for again comes back, so that frequent keys stay however many rare ones pass."""

    def __init__(self, size: int = MEMORY):
        self.size, self.young, self.old = size, {}, {}

    def turn(self) -> None:
        """Close the young generation if it is full. Between calls it grows by what one group of texts has."""
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young


class ChunkEncoder:
    """encode_parts: texts -> ids of each as little-endian unsigned 32-bit integers, in bytes.

    encode_words: the same for parts that have lost the space before them.
    """

    def __init__(self, encode_parts: Callable[[list[str]], Sequence[bytes]], encode_words: Callable[[list[str]], Sequence[bytes]] | None = None, small: bool = False):
        self.encode_parts = encode_parts
        self.group = SMALL_GROUP if small else GROUP
        self.encode_words = encode_words or (lambda words: encode_parts([" " + x for x in words]))
        self.seen = Memory(SMALL_MEMORY if small else MEMORY)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size > self.group:
                out += self._group(group)
                group, size = [], 0
        out += self._group(group) if group else []
        pa.default_memory_pool().release_unused()
        return out

    def _group(self, texts: list[str]) -> list[bytes]:
        """Arrow cuts the texts and numbers their distinct parts; only those are looked up; numpy puts the ids in the texts' order."""
        if all(map(regular, texts)):
            parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
        else:
            parts = pa.array(list(map(cut, texts)), pa.list_(pa.string()))
        coded = parts.flatten().dictionary_encode()
        first = parts.offsets.to_numpy()
        place = coded.indices.to_numpy().copy()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = self.encode_parts([words[i] for i in place[first[:-1]].tolist()])
        place[first[:-1]] = len(words) + np.arange(len(texts))
        table = [*self._words(words), *codes]
        size = np.fromiter(map(len, table), dtype=np.int32, count=len(table)) // 4  # a group has far fewer than 2^31 ids
        start = np.cumsum(size, dtype=np.int32) - size
        ids = np.frombuffer(b"".join(table), dtype="<u4")
        n = size[place]
        end = np.cumsum(n, dtype=np.int32)
        out = ids[np.repeat(start[place] - end + n, n) + np.arange(end[-1] if len(end) else 0, dtype=np.int32)]
        bound = np.r_[0, end][first]
        return [out[i:j].tobytes() for i, j in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]

    def _words(self, words: list[str]) -> list[bytes]:
        self.seen.turn()
        young, old = self.seen.young, self.seen.old
        codes: list = list(map(young.get, words))
        open_ = [i for i, code in enumerate(codes) if code is None]
        names = [words[i] for i in open_]
        found = list(map(old.get, names))
        made = iter(self.encode_words([word for word, code in zip(names, found, strict=True) if code is None]))
        found = [next(made) if code is None else code for code in found]
        young.update(zip(names, found, strict=True))
        for word in [word for word in names if len(word) > LONGEST]:
            del young[word]
        for i, code in zip(open_, found, strict=True):
            codes[i] = code
        return codes
