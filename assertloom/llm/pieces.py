"""Byte-level BPE of many short texts at once: they are split by array operations, and each distinct piece is encoded once."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import tiktoken

from assertloom.llm.common import mix

#: Character classes: letter, number, other, space, other white space, end of text, and what is left to the encoder's own splitter.
LETTER, NUMBER, OTHER, SPACE, WHITE, END, UNSURE = range(1, 8)
_END = "￿"
_WHITE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces of more characters aren't remembered.
SHORT = 64
#: Pieces that are remembered, and characters that are split at once.
MEMORY, CHUNK = 1_000_000, 400_000

_U = np.uint64
_PHI = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point. Those whose category is no older than Unicode 3.2, or has changed since, are UNSURE, and so are rare planes."""
    out = np.full(0x110000, UNSURE, dtype=np.uint8)
    for c in (*range(0x3400), *range(0x4E00, 0x9FA6), *range(0xA000, 0xA4D0), *range(0xAC00, 0xD7A4), *range(0xF900, 0x10000)):
        kind = unicodedata.category(chr(c))
        if kind == unicodedata.ucd_3_2_0.category(chr(c)) and kind not in ("Cn", "Cs"):
            out[c] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
    out[_WHITE] = WHITE
    out[0x20] = SPACE
    out[0x180E] = UNSURE
    out[ord(_END)] = END
    return out


@lru_cache(maxsize=1)
def _noise() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * _PHI)


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, CHUNK + 1000)
            self.up = np.cumprod(np.concatenate([[_U(1)], np.full(size, _PHI)]))
            self.down = np.cumprod(np.concatenate([[_U(1)], np.full(size, _INV)]))


def split(cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pieces begin, as the pattern '(?:[stmd]|re|ve|ll)| ?L+| ?N+| ?other+|white+(?!\\S)|white+ has it; END characters are pieces too."""
    white = (kind == SPACE) | (kind == WHITE)
    k = np.where(white, SPACE, kind)
    begin = np.empty(len(k), dtype=bool)
    begin[0] = True
    np.not_equal(k[1:], k[:-1], out=begin[1:])
    begin |= k == END
    # the last white character before other text stands alone, or joins that text if it is a space
    at = np.flatnonzero(begin & (k <= OTHER))
    at = at[at > 0]
    after = at[white[at - 1]]
    begin[after - 1] = True
    begin[after[kind[after - 1] == SPACE]] = False
    quote = np.flatnonzero((cp == 39) & begin)
    quote = quote[quote + 2 < len(cp)]  # the text's END comes after what can be short for a word
    if len(quote):
        a, b = cp[quote + 1], cp[quote + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        for at, n in ((quote[one], 2), (quote[two & ~one], 3)):
            begin[at + 1] = False
            at = at[at + n < len(cp)]
            begin[at[k[at + n] == LETTER] + n] = True
    return begin


class _Places:
    """A hash table of arrays: the number of each name, a 64-bit hash and a second word that must be equal too."""

    def __init__(self, bits: int):
        self.mask = _U((1 << bits) - 1)
        self.one, self.two = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint64)
        self.at = np.full(1 << bits, -1, dtype=np.int32)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each name, -1 if it has none."""
        out = np.full(len(one), -1, dtype=np.int32)
        todo, slot = np.arange(len(one)), one & self.mask
        while len(todo):
            at = self.at[slot]
            hit = (self.one[slot] == one[todo]) & (self.two[slot] == two[todo]) & (at >= 0)
            out[todo[hit]] = at[hit]
            go = ~hit & (at >= 0)
            todo, slot = todo[go], slot[go] + _U(1) & self.mask
        return out

    def insert(self, one: np.ndarray, two: np.ndarray, first: int) -> None:
        """New names, all different, numbered from `first`."""
        todo, slot = np.arange(len(one)), one & self.mask
        while len(todo):
            free = np.flatnonzero(self.at[slot] < 0)
            _, take = np.unique(slot[free], return_index=True)
            own = free[take]
            self.one[slot[own]], self.two[slot[own]], self.at[slot[own]] = one[todo[own]], two[todo[own]], first + todo[own]
            go = np.ones(len(todo), dtype=bool)
            go[own] = False
            todo, slot = todo[go], slot[go] + _U(1) & self.mask


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), dtype=x.dtype)])


class Encoder:
    """The ids of texts, just as `encode_ordinary` of the encoding gives them, if its pattern is the one of split()."""

    def __init__(self, enc: tiktoken.Encoding):
        self.enc, self.powers = enc, _Powers()
        self.forget()

    def forget(self) -> None:
        self.places = _Places(MEMORY.bit_length() + 1)
        self.ids, self.ends, self.n = np.zeros(1 << 20, dtype=np.int32), np.zeros(1 << 18, dtype=np.int64), 0

    def _learn(self, words: list[str]) -> None:
        one = self.enc._core_bpe.encode_single_piece
        new = [one(w.encode()) for w in words]
        flat = np.fromiter(chain.from_iterable(new), dtype=np.int32)
        ends = self.ends[self.n] + np.cumsum(np.fromiter(map(len, new), dtype=np.int64, count=len(new)))
        self.ids, self.ends = _room(self.ids, int(ends[-1])), _room(self.ends, self.n + len(new) + 1)
        self.ids[ends[-1] - len(flat) : ends[-1]] = flat
        self.ends[self.n + 1 : self.n + 1 + len(new)] = ends
        self.n += len(new)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last one's end)."""
        flat, sizes = [np.zeros(0, dtype=np.int32)], [np.zeros(1, dtype=np.int64)]
        a = 0
        while a < len(texts):
            b, n = a, 0
            while b < len(texts) and n < CHUNK:
                n += len(texts[b])
                b += 1
            ids, size = self._chunk(texts[a:b])
            flat.append(ids)
            sizes.append(size)
            a = b
        return np.concatenate(flat), np.cumsum(np.concatenate(sizes))

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = {i for i, t in enumerate(texts) if _END in t}
        fast = [("" if i in odd else t) for i, t in enumerate(texts)] if odd else texts
        body = _END.join(fast) + _END
        cp = np.frombuffer(body.encode("utf-32-le"), dtype=np.uint32)
        kind = classes()[cp]
        ends = np.flatnonzero(kind == END)
        unsure = np.flatnonzero(kind == UNSURE)
        if len(unsure):
            odd |= set(np.searchsorted(ends, unsure).tolist())
        if odd:
            return self._mixed(texts, odd)
        begin = np.flatnonzero(split(cp, kind))
        stop = np.append(begin[1:], len(cp))
        real = kind[begin] != END
        begin, stop = begin[real], stop[real]
        if not len(begin):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        which = self._index(body, cp, begin, stop)
        size = self.ends[which + 1] - self.ends[which]
        before = np.cumsum(size) - size
        ids = self.ids[np.repeat(self.ends[which] - before, size) + np.arange(int(size.sum()))]
        counts = np.bincount(np.searchsorted(ends, begin), weights=size, minlength=len(texts)).astype(np.int64)
        if self.n > MEMORY:
            self.forget()
        return ids, counts

    def _index(self, body: str, cp: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The number under which each piece's ids are kept, learned if it is new."""
        self.powers.reach(len(cp) + 1)
        noise, up, down = _noise()[cp], self.powers.up[: len(cp)], self.powers.down[begin]
        length = (stop - begin).astype(np.uint64)
        total = np.empty(len(cp) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(noise * up, out=total[1:])
        one = mix((total[stop] - total[begin]) * down ^ length)
        two = length << _U(42) | cp[begin].astype(np.uint64) << _U(21) | cp[stop - 1]
        long = length > SHORT
        at = self.places.find(one, two)
        new = np.flatnonzero((at < 0) & ~long)
        if len(new):
            _, first, back = np.unique(one[new], return_index=True, return_inverse=True)
            first = new[first]
            n = self.n
            at[new] = n + back
            self._learn([body[a:b] for a, b in zip(begin[first].tolist(), stop[first].tolist())])
            self.places.insert(one[first], two[first], n)
        if len(each := np.flatnonzero(long)):
            at[each] = self.n + np.arange(len(each))
            self._learn([body[a:b] for a, b in zip(begin[each].tolist(), stop[each].tolist())])
        return at

    def _mixed(self, texts: list[str], odd: set[int]) -> tuple[np.ndarray, np.ndarray]:
        ids, size = self._chunk(["" if i in odd else t for i, t in enumerate(texts)])
        parts = np.split(ids, np.cumsum(size)[:-1])
        for i in odd:
            parts[i] = np.array(self.enc.encode_ordinary(texts[i]), dtype=np.int32)
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)


class Decoder:
    """The bytes of ids, by table."""

    def __init__(self, enc: tiktoken.Encoding):
        words = [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]
        self.blob = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all arrays, where each one's begin and the last one's end); ids has them one after the other, up to `ends` (from 0)."""
        size = self.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.blob[np.repeat(self.start[ids] - total[:-1], size) + np.arange(int(total[-1]))], total[ends]
