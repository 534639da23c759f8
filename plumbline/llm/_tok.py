"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

Two kinds of tokenizer let a text be cut at single spaces and line breaks
without changing any id: one that drops white space before it looks at words,
and the byte-level kind whose pattern gives a lone space to the word after it
and makes a lone line break a token.  Other tokenizers, and texts with other
white space, are encoded whole.  A very long text is first cut between two
words with one space, where a new pre-token begins in either kind.

Pieces are found and hashed by numpy passes over a batch's bytes and looked up
in an open-addressed table, whose entries say where pools have the piece's
bytes and ids; a text with a piece of another's hash is left to the library.
Only pieces that the table lacks become Python strings.  Table and pool are
bounded: when full, they begin anew.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from plumbline.llm import _text as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces remembered by one Python worker for one tokenizer, and the longest that is.
MEMORY, LONGEST = 800_000, 200
#: Characters that are encoded in one go, about; where a longer text may be cut.
SEGMENT, _GAP = 1 << 20, re.compile(r"(?<=\w) (?=\w)")
#: Without the apostrophe, which contractions have, and the backslash.
_PUNCT = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: Letters below U+0250 but U+0130, whose lower case ends in a combining mark; words of such.
_LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_PLAIN, _END = re.compile(f"[{_LETTER}]+"), re.compile(f"[{_LETTER}]$")
#: How byte-level models write bytes: printable Latin-1 characters as they are, the others from U+0100 on in their order.
_AS_IS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: chr(b) for b in _AS_IS} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _AS_IS)}
_ENCODERS: dict[str, Encoder] = {}
#: What is before a piece: nothing of the text, a space, a line break.
_LEADS = [np.uint64(0), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
#: White space that is one byte, and what ends the UTF-8 of other white space, by its first byte.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_WIDE = {0xC2: [b"\x85", b"\xa0"], 0xE1: [b"\x9a\x80"], 0xE2: [b"\x80" + bytes([k]) for k in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)] + [b"\x81\x9f"], 0xE3: [b"\x80\x80"]}
_MAY_BE_WIDE = np.zeros(256, bool)
_MAY_BE_WIDE[list(_WIDE)] = True


#: The first so many bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _eights(x: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, but the last seven."""
    return np.ndarray(len(x) - 7, "<u8", x, 0, (1,))


class _Table:
    """Where the ids of pieces are, by the pieces' hashes."""

    def __init__(self, most: int = MEMORY):
        self.size = 1 << (2 * most - 1).bit_length()
        self.most = most
        self.clear()

    def clear(self) -> None:
        # keys 0 are free slots; a piece whose hash is 0 is only ever looked up in vain and learnt again
        self.keys, self.at, self.n = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int64), np.zeros(self.size, np.int32)
        self.place = np.zeros(self.size, np.int64)  # where the piece's bytes begin, how many they are (below 256), its lead (below 4), in one number
        self.pool, self.used, self.count = np.zeros(1 << 16, np.uint32), 0, 0
        self.text, self.filled = np.zeros(1 << 18, np.uint8), 0

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or that where it would go."""
        mask = np.uint64(self.size - 1)
        out = h & mask
        todo = np.flatnonzero((self.keys[out] != h) & (self.keys[out] != 0))
        while len(todo):
            out[todo] = (out[todo] + np.uint64(1)) & mask
            k = self.keys[out[todo]]
            todo = todo[(k != h[todo]) & (k != 0)]
        return out.astype(np.int64)

    def same(self, slot: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """Whether the piece in each slot has these bytes and this lead."""
        size, low = end - begin, int(begin[0])
        place = self.place[slot]
        out = (place & 1023) == (size << 2 | lead)
        own = np.concatenate([raw[low : int(end[-1])], np.zeros(8, np.uint8)])
        mine, theirs, at, to, k = _eights(own), _eights(self.text), begin - low, place >> 10, 0
        todo = np.flatnonzero(out)
        while len(todo):
            left = size[todo] - k
            equal = (mine[at[todo] + k] ^ theirs[to[todo] + k]) & _FIRST[np.minimum(left, 8)] == 0
            out[todo[~equal]] = False
            todo, k = todo[equal & (left > 8)], k + 8
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, lead: np.ndarray) -> None:
        """Pieces that it lacks, each once: their hashes, all their ids, how many each has, their bytes and leads."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        mask, todo = np.uint64(self.size - 1), np.arange(len(h))
        slot = h & mask
        while len(todo):
            # of those that meet in a free slot one takes it; the others go on
            free = todo[self.keys[slot[todo]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            self.keys[slot[free[one]]] = h[free[one]]
            todo = todo[self.keys[slot[todo]] != h[todo]]
            slot[todo] = (slot[todo] + np.uint64(1)) & mask
        slot = self.slots(h)
        self.at[slot], self.n[slot] = self.used + np.cumsum(n) - n, n
        self.used, self.count = self.used + len(ids), self.count + len(h)
        size = end - begin
        total = int(size.sum())
        if self.filled + total + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros(max(len(self.text), total + 8), np.uint8)])
        first = np.cumsum(size) - size
        self.text[self.filled : self.filled + total] = raw[np.arange(total) + np.repeat(begin - first, size)]
        self.place[slot] = (self.filled + first) << 10 | size << 2 | lead
        self.filled += total


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.parts: dict[str, list[int]] = {}
        self.table: _Table | None = None
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        steps = pre.get("pretokenizers", [])
        self.kind = "whole"
        if plain and spec["model"]["type"] == "BPE" and not spec.get("truncation"):
            if not norm and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True):
                self.kind = "leading"
            elif (
                [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
                and [s["type"] for s in steps] == ["Split", "ByteLevel"]
                and (steps[0]["behavior"], steps[0]["invert"], steps[1]["use_regex"], steps[1]["add_prefix_space"]) == ("Removed", True, False, False)
                and "\\s" not in steps[0]["pattern"].get("Regex", "\\s").replace("[^\\s", "")
                and " " not in steps[0]["pattern"]["Regex"]
            ):
                self.kind = "dropped"

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def rest(self) -> None:
        """At a task's end: the table stays for the worker's next task, what takes most memory for least use goes."""
        self.parts = {}
        T.tidy()

    def _segments(self, text: str) -> list[str]:
        """Parts of a long text whose ids, in a row, are the text's; all but the first begin with a space."""
        out, at = [], 0
        while self.kind != "whole" and len(text) - at > 2 * SEGMENT and (m := _GAP.search(text, at + SEGMENT)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def _texts(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[str]:
        """The pieces as strings: copied into one text and split again."""
        n = end - begin
        stop = np.cumsum(n + 1)
        out = np.zeros(int(stop[-1]), np.uint8)
        to = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(stop - n - 1, n) + to] = raw[np.repeat(begin, n) + to]
        texts = out.tobytes().decode()[:-1].split("\0")
        return texts if len(texts) == len(n) else [raw[a:b].tobytes().decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]

    def _learn(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces in a row, how many each has).

        A piece is up to three parts with the same ids in a row: a line break,
        what is before the punctuation at its end, that punctuation.  A part
        with a space before it is written without it, others with a carriage
        return, which no piece has.
        """
        if len(self.parts) > MEMORY // 4:
            self.parts = {}
        known, cut, heads = self.parts, [], ["\r", "", "\r"] if self.kind == "leading" else [""] * 3
        for p, k in zip(self._texts(raw, begin, end), lead.tolist(), strict=True):
            core = p.rstrip(_PUNCT)
            parts = [heads[k] + p] if len(core) == len(p) or not _END.search(core) or "<|" in p else [heads[k] + core, "\r" + p[len(core) :]]
            cut.append(["\r\n", *parts] if k == 2 else parts)
        new = list({q for c in cut for q in c}.difference(known))
        got = dict(zip(new, self._encoded(new), strict=True))
        ids = [known[q] if q in known else got[q] for c in cut for q in c]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        run = np.concatenate([[0], np.cumsum(n)])
        known.update((q, b) for q, b in got.items() if len(q) <= LONGEST)
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(run[-1])), np.diff(run[ends], prepend=0)

    def _encoded(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts: by the library's model alone where one is a pre-token of Latin letters, which needs no other step."""
        written = [q[1:] if q[:1] == "\r" else " " + q if self.kind == "leading" else q for q in parts]
        out: list[list[int]] = [[]] * len(parts)
        plain = [i for i, (q, w) in enumerate(zip(parts, written, strict=True)) if _PLAIN.fullmatch(q[1:] if q[:1] == "\r" else q) and (self.kind == "leading" or w == w.lower())]
        spelled = "\n".join([written[i] for i in plain]).encode().decode("latin-1").translate(_VISIBLE).split(_VISIBLE[10]) if plain else []
        tokenize = self.tok.model.tokenize
        for i, w in zip(plain, spelled, strict=True):
            out[i] = [t.id for t in tokenize(w)]
        rest = list(set(range(len(parts))).difference(plain))
        for i, e in zip(rest, self.tok.encode_batch_fast([written[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _usable(self, raw: np.ndarray, off: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each text may be cut into its words."""
        good = np.ones(len(off) - 1, bool)
        if self.kind == "dropped":
            return good
        n = np.diff(first)
        some = n > 0
        good[~some] = off[1:][~some] == off[:-1][~some]
        good[some] = (begin[first[:-1][some]] == off[:-1][some]) & (end[first[1:][some] - 1] == off[1:][some])
        doc = np.repeat(np.arange(len(n)), n)
        if len(doc) > 1:
            between = raw[end[:-1]]
            bad = (doc[1:] == doc[:-1]) & ((begin[1:] - end[:-1] != 1) | ((between != 32) & (between != 10)))
            good[doc[1:][bad]] = False
        low, high = int(off[0]), int(off[-1])
        text = raw[low:high]
        odd = np.flatnonzero(_BLANK[text])
        wide = [k for k in np.flatnonzero(_MAY_BE_WIDE[text]).tolist() if any(text[k + 1 : k + 1 + len(w)].tobytes() == w for w in _WIDE[text[k]])] if _MAY_BE_WIDE[text].any() else []
        at = np.concatenate([odd, np.array(wide, np.int64)]) + low
        good[np.searchsorted(off, at, side="right") - 1] = False
        return good

    def _cut(self, raw: np.ndarray, off: np.ndarray, start: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has, whether they are right); start: where the text begins of which this is a part."""
        table = self.table = self.table or _Table()
        h, first, begin, end = T.words(raw, off, lower=False)
        good = self._usable(raw, off, first, begin, end) if start is None else np.ones(len(off) - 1, bool)
        lead = np.zeros(len(h), np.int64)
        if self.kind == "leading" and len(h):
            lead = np.where(raw[np.maximum(begin - 1, 0)] == 10, 2, 1)
            lead[first[:-1][np.diff(first) > 0]] = 0
            if start is not None and begin[0] > start:
                lead[0] = 2 if raw[begin[0] - 1] == 10 else 1
            h = T.mix(h + np.array(_LEADS)[lead])
        slot = table.slots(h)
        size = end - begin
        lost = np.flatnonzero((table.keys[slot] != h) & np.repeat(good, np.diff(first)))
        extra, extra_at = np.zeros(0, np.uint32), {}
        if len(lost):
            _, one = np.unique(h[lost], return_index=True)
            some = lost[one]
            ids, n = self._learn(raw, begin[some], end[some], lead[some])
            short = size[some] <= LONGEST
            if table.count + int(short.sum()) > table.most:
                table.clear()
                return self._cut(raw, off, start) if int(short.sum()) <= table.most else self._by_text(raw, off, start)
            own = np.repeat(short, n)
            table.add(h[some[short]], ids[own], n[short], raw, begin[some[short]], end[some[short]], lead[some[short]])
            slot = table.slots(h)
            extra = ids[~own]
            for k, m, at in zip(some[~short].tolist(), n[~short].tolist(), (table.used + np.cumsum(n[~short]) - n[~short]).tolist(), strict=True):
                extra_at[int(lead[k]), raw[begin[k] : end[k]].tobytes()] = (at, m)
        hit = table.keys[slot] == h
        if hit.any():
            hit[hit] = table.same(slot[hit], raw, begin[hit], end[hit], lead[hit])
        where, n = np.where(hit, table.at[slot], 0), np.where(hit, table.n[slot], 0).astype(np.int64)
        doc = np.repeat(np.arange(len(good)), np.diff(first))
        for k in np.flatnonzero(~hit & good[doc]).tolist():
            if found := extra_at.get((int(lead[k]), raw[begin[k] : end[k]].tobytes())):
                where[k], n[k] = found
            else:
                good[doc[k]] = False
        n[~np.repeat(good, np.diff(first))] = 0
        pool = np.concatenate([table.pool[: table.used], extra]) if extra_at else table.pool
        run = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(where - run[:-1], n) + np.arange(run[-1])]
        return ids, np.diff(run[first]), good

    def _by_text(self, raw, off, start):
        """As :meth:`_cut`, for a batch with more new pieces than the table holds: by the library."""
        if start is not None:  # a part: its text is left to the library whole
            return np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, bool)
        texts = [raw[a:b].tobytes().decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        got = [np.frombuffer(b, np.uint32) for b in self._whole(texts)]
        return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(x) for x in got], np.int64), np.ones(len(got), bool)

    def _long(self, raw: np.ndarray, low: int, high: int) -> np.ndarray:
        """The ids of one very long text, in parts."""
        if self.kind != "whole":
            parts = list(T.cuts(raw, low, high))
            # only a part that ends as the text does may end without white space: the byte cut off with it is looked at as a gap
            if self.kind == "dropped" or all(self._plain(raw, a, b, low, high) for a, b in parts):
                got = [self._cut(raw, np.array([a, b], np.int64), low) for a, b in parts]
                if all(good.all() for _, _, good in got):
                    return np.concatenate([ids for ids, _, _ in got])
        text = raw[low:high].tobytes().decode()
        return np.concatenate([np.frombuffer(self._whole([t])[0], np.uint32) for t in self._segments(text)])

    def _plain(self, raw: np.ndarray, a: int, b: int, low: int, high: int) -> bool:
        """Whether a part of a text has only single gaps, a gap before it included."""
        begin = a - (a > low)  # the gap is the last byte of the part before
        off = np.array([a, b - (b < high)], np.int64)
        _, first, at, end = T.words(raw, off, lower=False)
        return bool(len(at) and at[0] == a and self._usable(raw, off, first, at, end)[0] and (begin == a or raw[begin] in (32, 10)))

    def encode_texts(self, raw: np.ndarray, off: np.ndarray):
        """(ids of all texts in a row, end of each in them), for slices of the texts."""
        for i, j in T.slices(off):
            part = off[i : j + 1]
            if part[-1] - part[0] > 2 * T.SLICE:
                ids = self._long(raw, int(part[0]), int(part[-1]))
                yield ids, np.array([len(ids)])
                continue
            if self.kind == "whole":
                texts = [raw[a:b].tobytes().decode() for a, b in zip(part[:-1].tolist(), part[1:].tolist(), strict=True)]
                got = [np.frombuffer(b, np.uint32) for b in self._whole(texts)]
                yield np.concatenate(got), np.cumsum([len(x) for x in got])
                continue
            ids, n, good = self._cut(raw, part)
            if not good.all():
                bad = np.flatnonzero(~good)
                got = self._whole([raw[part[k] : part[k + 1]].tobytes().decode() for k in bad.tolist()])
                each = np.split(ids, np.cumsum(n)[:-1])
                for k, b in zip(bad.tolist(), got, strict=True):
                    each[k] = np.frombuffer(b, np.uint32)
                ids, n = np.concatenate(each), np.array([len(x) for x in each])
            yield ids, np.cumsum(n)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out = []
        for ids, ends in self.encode_texts(*T.buffers(pa.array(texts, pa.large_string()))):
            out += [x.tobytes() for x in np.split(ids, ends[:-1])]
        return out


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drop what this process remembers of pieces."""
    for e in _ENCODERS.values():
        e.parts, e.table = {}, None
