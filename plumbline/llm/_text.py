"""Vectorised word hashing over Arrow string buffers.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``;
A-Z count as a-z when ``lower`` is set.  The hash of a word is a polynomial
over its bytes modulo the prime 2**61 - 1, taken as a difference of running
sums, so a batch of texts is hashed by a few numpy passes and no word becomes
a Python object.  (Modulo a power of two, whatever the base, words made of two
others in the order of Thue and Morse would have one hash with their
complements.)  A very long text is hashed in pieces, cut between words, so
that what is held besides its bytes doesn't grow with it.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: The prime, the base and its inverse.
PRIME = (1 << 61) - 1
BASE = 0x1B4F6D2C8E93A57 % PRIME
_INVERSE = pow(BASE, -1, PRIME)
_LOW29, _LOW32, _P = U64((1 << 29) - 1), U64((1 << 32) - 1), U64(PRIME)
_BYTE = np.arange(1, 257, dtype=U64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POW = {BASE: np.ones(1, U64), _INVERSE: np.ones(1, U64)}
_HALVES: list[np.ndarray] = [np.ones(1, U64), np.zeros(1, U64)]

#: Bytes of text that are hashed in one go; a single text of twice as many is cut into pieces.
SLICE = 1 << 19


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x >> U64(61)) + (x & _P)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, by halves."""
    ah, al, bh, bl = a >> U64(32), a & _LOW32, b >> U64(32), b & _LOW32
    mid, low = ah * bl + al * bh, al * bl
    return _reduced((ah * bh << U64(3)) + (mid >> U64(29)) + ((mid & _LOW29) << U64(32)) + (low >> U64(61)) + (low & _P))


def _powers(n: int, base: int) -> np.ndarray:
    have = _POW[base]
    while len(have) < n:
        have = np.concatenate([have, times(have, np.full(len(have), pow(base, len(have), PRIME), U64))])
        _POW[base] = have
    return have[:n]


def _halves(n: int) -> list[np.ndarray]:
    if len(_HALVES[0]) < n:
        p = _powers(max(n, 2 * SLICE), BASE)
        _HALVES[:] = [p & _LOW32, p >> U64(32)]
    return [x[:n] for x in _HALVES]


def hashes(text: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """The hash of each text[begin:end]; halves of powers times bytes add up to less than 2**64 for 2**23 bytes."""
    value, sums = (_BYTE_LOWER if lower else _BYTE)[text], []
    for half in _halves(len(text)):
        run = np.zeros(len(text) + 1, U64)
        np.cumsum(value * half, out=run[1:])
        sums.append(run[end] - run[begin])
    low, high = sums
    total = _reduced((high >> U64(29)) + ((high & _LOW29) << U64(32)) + (low >> U64(61)) + (low & _P))
    return sealed(times(total, _powers(len(text) + 1, _INVERSE)[begin]), (end - begin).astype(U64))


def sealed(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash from a polynomial's value and the number of its bytes."""
    return mix(total + size * U64(0x9E3779B97F4A7C15))


def joined_hash(parts) -> int:
    """The hash of parts of one run of bytes in a row."""
    total, size = 0, 0
    for part in parts:
        low, high = (int((_BYTE[part] * half).sum(dtype=U64)) for half in _halves(len(part)))
        total = (total + (low + (high << 32)) * pow(BASE, size, PRIME)) % PRIME
        size += len(part)
    return int(sealed(np.array([total], U64), np.array([size % (1 << 64)], U64))[0])


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a well-known 64-bit mixer; a bijection."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def tidy() -> None:
    """Give memory that isn't used back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """A task function that gives memory back before and after it runs: workers are reused, and what one held would add up.

    Token memories are dropped as well; the tokenising functions, which profit from them, aren't wrapped in this.
    """

    def wrapped(batches):
        if tok := sys.modules.get("plumbline.llm._tok"):
            tok.forget()
        tidy()
        yield from run(batches)
        tidy()

    return wrapped


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray):
    """Ranges of rows whose texts together have about SLICE bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def cuts(raw: np.ndarray, low: int, high: int, ends: np.ndarray = _SPACE):
    """Ranges of about SLICE bytes of raw[low:high], each ending behind a byte that ``ends`` marks or at high."""
    a = low
    while a < high:
        b, at = a, None
        while b < high and (at is None or not len(at)):
            begin, b = b, min(b + SLICE, high)
            at = np.flatnonzero(ends[raw[begin:b]])
        c = high if b == high else begin + int(at[-1]) + 1
        yield a, c
        a = c


@dataclass
class Piece:
    """Words of the texts ``low`` .. ``high - 1``, or some of one text's: the first ``lead`` of these were in the piece before."""

    low: int
    high: int
    words: np.ndarray
    first: np.ndarray
    lead: int = 0
    last: bool = True


def pieces(raw: np.ndarray, offsets: np.ndarray, lead: int = 0, lower: bool = True):
    """The words of all texts in slices, those of a very long one in several pieces which repeat the last ``lead`` words of the one before."""
    for i, j in slices(offsets):
        low, high = int(offsets[i]), int(offsets[j])
        if high - low <= 2 * SLICE:
            h, first, _, _ = words(raw, offsets[i : j + 1], lower)
            yield Piece(i, j, h, first)
            continue
        before = np.zeros(0, U64)
        for a, b in cuts(raw, low, high):
            h = np.concatenate([before, words(raw, np.array([a, b], np.int64), lower)[0]])
            yield Piece(i, j, h, np.array([0, len(h)], np.int64), len(before), b == high)
            before = h[max(0, len(h) - lead) :] if lead else before


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """(hash of each word, first word of each text; one more entry at the end, start byte, end byte)."""
    base = int(offsets[0])
    text, off = raw[base : int(offsets[-1])], offsets - base
    n = len(text)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(off), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[text]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = off[1:] > off[:-1]
    at = off[:-1][full]
    first[at] = solid[at]
    at = off[1:][full] - 1
    last[at] = solid[at]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return hashes(text, begin, end, lower), np.searchsorted(begin, off), begin + base, end + base


def word_hash(word: str, lower: bool = True) -> int:
    """The hash of one word, as :func:`words` gives it."""
    h, _, _, _ = words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())], np.int64), lower)
    return int(h[0])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbours; entry i starts at word i (runs may cross texts: the caller drops those)."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return out
