"""Token ids of whole texts by the tokenizers library, each distinct chunk encoded once.

A byte-level BPE file cuts a text by its pattern and then encodes each part alone. A space between
two characters that aren't white space always begins a part, such a newline is one, and a sign after
a letter begins one, so a text may be cut there first: chunks are hashed in numpy, only those not seen
before go to the library, and the ids of the rest are gathered. A chunk is known by its bytes: they are
compared once its hash has been found. What a worker keeps is bounded by ``MOST_CHUNKS`` and ``MOST_BYTES``. An added token that a text spells out
is one id to the library, which cuts texts there before its pattern does; each is a chunk of its own.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import words

MOST_CHUNKS, MOST_BYTES = 1_500_000, 48 << 20

_before = np.zeros(256, bool)
_before[0x21:0x7F] = True
_after = _before.copy()
_after[0xC3:0xF8] = True
_letter = np.array([chr(i).isalpha() and i < 0x80 for i in range(256)])
_sign = _before & ~np.array([chr(i).isalnum() for i in range(256)])
_after[[0xE1, 0xE2, 0xE3]] = False  # some of these begin a white-space character


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where chunks start: at each text, at each space or newline between characters that surely aren't white space, after such a newline, and at signs after letters."""
    at = np.flatnonzero((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    two = (data[at - 1] >= 0x80) & (data[at - 1] < 0xC0) & (data[np.maximum(at - 2, 0)] >= 0xC3) & (data[np.maximum(at - 2, 0)] < 0xE0)
    at = at[(_before[data[at - 1]] | two) & _after[data[at + 1]]]
    edges = np.zeros(len(data) + 1, bool)
    edges[at] = True
    edges[at[data[at] == 0x0A] + 1] = True
    edges[1:-1] |= _sign[data[1:]] & _letter[data[:-1]]
    inner = off[1:-1]
    edges[inner] = True  # also where a text starts with a space
    edges[off[:-1]] = True
    edges[len(data)] = False
    return np.flatnonzero(edges)


class Encoder:
    """ids(column) yields runs of texts: first row, ids of all, offsets of each text's ids."""

    _kept: dict[tuple[str, bool], "Encoder"] = {}

    @classmethod
    def of(cls, path: str, plain: bool = False) -> "Encoder":
        """The worker's own, with what it has seen."""
        if (path, plain) not in cls._kept:
            cls._kept[path, plain] = cls(path, plain)
        return cls._kept[path, plain]

    def __init__(self, path: str, plain: bool = False):
        """plain: special tokens that texts spell out are ordinary text, so no text can make their ids."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain and t.special)]
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError(f"{path}: added tokens that depend on what is around them aren't supported")
        # the longest first, as the library takes them
        self.added = re.compile(b"|".join(re.escape(t.content.encode()) for t in sorted(added, key=lambda t: -len(t.content)))) if added else None
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.forget()

    def forget(self) -> None:
        self.keys, self.ids, self.texts = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.spans = np.zeros((0, 4), np.int64)  # of each key: where its ids are and how many, where its bytes are and how many
        self.view = words.eights(self.texts)

    def encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of all, and how many each text has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int32, len(got))
        return np.fromiter((i for ids in got for i in ids), np.uint32, int(size.sum())), size

    def learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        flat, size = self.encoded(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = lambda n, first: first + np.cumsum(n, dtype=np.int64) - n
        where, spans = np.searchsorted(self.keys, keys), np.column_stack([begin(size, len(self.ids)), size, begin(lengths, len(self.texts)), lengths])
        self.keys, self.spans = np.insert(self.keys, where, keys), np.insert(self.spans, where, spans, axis=0)
        self.ids, self.texts = np.concatenate([self.ids, flat]), np.concatenate([self.texts, np.frombuffer(b"".join(texts), np.uint8)])
        self.view = words.eights(self.texts)

    def starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where chunks start: at the cuts and around added tokens, but not inside of these."""
        starts, raw = cuts(data, off), data.tobytes()
        if not (self.added and self.added.search(raw)):
            return starts
        found = [(a + m.start(), a + m.end()) for a, b in zip(off[:-1].tolist(), off[1:].tolist()) for m in self.added.finditer(raw[a:b])]
        if not found:
            return starts
        first, last = np.array(found).T
        at = np.searchsorted(first, starts) - 1
        inside = (at >= 0) & (starts < last[at])
        starts = np.union1d(starts[~inside], np.concatenate([first, last]))
        return starts[starts < len(data)]

    def slab(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        starts = self.starts(data, off)
        ends = np.append(starts[1:], len(data))
        size, raw = ends - starts, data.tobytes()
        own, first, back = np.unique(words.hashes(data, starts, ends), return_index=True, return_inverse=True)
        # an occurrence whose bytes aren't its hash's is encoded apart
        one = first[back]
        odd = (size != size[one]) | ~words.equal(data, starts, data, starts[one], np.minimum(size, size[one]))
        texts = lambda k: [raw[a:b] for a, b in zip(starts[k].tolist(), ends[k].tolist())]
        place = np.minimum(np.searchsorted(self.keys, own), max(0, len(self.keys) - 1))
        new = self.keys[place] != own if len(self.keys) else np.ones(len(own), bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > MOST_CHUNKS or len(self.texts) + int(size[first[new]].sum()) > MOST_BYTES:
                self.forget()
                new[:] = True
            self.learn(own[new], texts(first[new]))
            place = np.searchsorted(self.keys, own)
        if not new.all():
            _, _, at, n = self.spans[place].T
            other = (n != size[first]) | ~words.equal(self.texts, at, data, starts[first], np.minimum(n, size[first]), self.view)
            odd |= other[back]
        at, many = np.ascontiguousarray(self.spans[place[back], :2].T)
        ids = self.ids
        if odd.any():
            more, own_size = self.encoded(texts(odd))
            many[odd], at[odd] = own_size, len(ids) + np.cumsum(own_size) - own_size
            ids = np.concatenate([ids, more])
        ends = np.cumsum(many)
        take = np.repeat(at - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
        before = np.concatenate([[0], ends])
        return ids[take], before[np.searchsorted(starts, off)]

    def of_column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for lo, _, data, off in words.slabs(column):
            yield lo, *self.slab(data, off)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
