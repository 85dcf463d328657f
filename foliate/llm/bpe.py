"""Byte-pair encoding of many strings at once, with the ids that the tokenizers library gives.

White space separates everything in this kind of tokenizer, so texts are cut there and every different string is encoded
once. Common strings are merged side by side as rows of a matrix; whatever isn't plainly Latin goes to the library itself.
Known strings are found by their 64-bit hashes in a table of arrays whose size is bounded in bytes, so a worker can keep it
from task to task.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .words import split

#: Slots of the table of strings whose ids a worker remembers, at most half of them used, and the ids that they take at
#: most: together some 20 megabytes.
SLOTS, MOST_IDS = 1 << 19, 2 << 20
#: Pieces of strings remembered while new strings are learnt.
MOST_CUTS = 20_000
#: Bytes of the longest string that is merged here.
LONGEST = 48
NONE = np.int32(2**31 - 1)

_LATIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_MARKS = b".,;:!?"
#: How the tokenizer's own pattern cuts lower-cased strings of _LATIN.
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next free one."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class WordEncoder:
    """Ids of texts by a tokenizer file, as bytes of little-endian 32-bit numbers."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.cuts: dict[str, bytes] = {}
        self.forget()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.merges_here = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and kinds == ["NFC", "Replace", "Lowercase"]
        if self.merges_here:
            vocab, letters = model["vocab"], _byte_letters()
            self.inner = np.array([vocab[c] for c in letters], np.int32)
            self.final = np.array([vocab[c + "</w>"] for c in letters], np.int32)
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
            self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
            self._table(keys)

    def _table(self, keys: np.ndarray) -> None:
        """An open-addressing table of pair to rank."""
        self.bits = 18
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        self.tries = 1
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            n = 1
            while self.keys[slot] >= 0:
                slot, n = (slot + 1) & ((1 << self.bits) - 1), n + 1
            self.keys[slot], self.ranks[slot] = key, rank
            self.tries = max(self.tries, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NONE where they don't merge or one is missing (negative)."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.keys[slot] >= 0) & (b >= 0))
        for _ in range(self.tries - 1):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slot[open_]] == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (self.keys[slot[open_]] >= 0)]
            if not len(open_):
                break
        return out

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words (UTF-8, at most LONGEST bytes): in every row, the pair of lowest rank merges, the leftmost first."""
        lengths = np.array([len(w) for w in words])
        out: list[bytes] = [b""] * len(words)
        for low, high in ((0, 6), (6, 10), (10, 16), (16, LONGEST)):
            of = np.flatnonzero((lengths > low) & (lengths <= high))
            if not len(of):
                continue
            flat = np.frombuffer(b"".join(words[i].ljust(high, b"\0") for i in of.tolist()), np.uint8).reshape(-1, high)
            size = lengths[of]
            columns = np.arange(high)
            ids = np.where(columns < size[:, None], self.inner[flat], np.int32(-1))
            ids[np.arange(len(of)), size - 1] = self.final[flat[np.arange(len(of)), size - 1]]
            ranks = np.full((len(of), high), NONE, np.int32)
            ranks[:, :-1] = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(of), -1)
            active = np.arange(len(of))
            work, work_ranks = ids, ranks
            while len(active):
                at = work_ranks.argmin(1)
                i = np.arange(len(active))
                rank = work_ranks[i, at]
                going = rank != NONE
                if not going.all():
                    ids[active] = work
                    work, work_ranks, at, rank, active = work[going], work_ranks[going], at[going], rank[going], active[going]
                    i = np.arange(len(active))
                    if not len(active):
                        break
                # The pair's left place takes the merged id, and what follows moves up.
                source = np.minimum(columns + (columns > at[:, None]), high - 1)
                work = np.take_along_axis(work, source, 1)
                work_ranks = np.take_along_axis(work_ranks, source, 1)
                work[:, -1] = -1
                work_ranks[:, -1] = NONE
                work[i, at] = self.made[rank]
                right = np.minimum(at + 1, high - 1)
                work_ranks[i, at] = np.where(at + 1 < high, self._rank(work[i, at], np.where(at + 1 < high, work[i, right], -1)), NONE)
                left = np.maximum(at - 1, 0)
                work_ranks[i, left] = np.where(at > 0, self._rank(work[i, left], work[i, at]), work_ranks[i, left])
            n = (ids >= 0).sum(1)
            packed = ids[columns < n[:, None]].astype("<u4").tobytes()
            ends = 4 * np.cumsum(n)
            for k, s, e in zip(of.tolist(), (ends - 4 * n).tolist(), ends.tolist(), strict=True):
                out[k] = packed[s:e]
        return out

    def _ids(self, strings: list[bytes]) -> list[bytes]:
        """The ids of different strings without white space."""
        out: list[bytes] = [b""] * len(strings)
        by_library, cut, others = [], {}, range(len(strings))
        if self.merges_here:  # ASCII letters, perhaps with marks after them, are most strings, and are cut there
            stems = [w.rstrip(_MARKS) for w in strings]
            plain = [i for i, s in enumerate(stems) if s.isalpha() and len(strings[i]) <= LONGEST]
            lower = [stems[i].lower() for i in plain]
            different = [*{*lower, *(strings[i][len(stems[i]) :] for i in plain)} - {b""}]
            ids = dict(zip(different, self._merge(different), strict=True)) | {b"": b""}
            for i, s in zip(plain, lower, strict=True):
                out[i] = ids[s] + ids[strings[i][len(s) :]]
            others = sorted({*others} - {*plain})
        for i in others:
            w = strings[i]
            text = w.decode()
            if self.merges_here and _LATIN.fullmatch(text) and "<|" not in text:
                cut[i] = _CUT.findall(text.lower())
            else:
                by_library.append(i)
        fresh = list({c for parts in cut.values() for c in parts if c not in self.cuts})
        raw = [c.encode() for c in fresh]
        short = [i for i, r in enumerate(raw) if len(r) <= LONGEST]
        self.cuts.update(zip((fresh[i] for i in short), self._merge([raw[i] for i in short]), strict=True))
        for i, parts in cut.items():
            if all(c in self.cuts for c in parts):
                out[i] = b"".join([self.cuts[c] for c in parts])
            else:
                by_library.append(i)
        for i in by_library:
            out[i] = np.array(self.library.encode(strings[i].decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.cuts) > MOST_CUTS:
            self.cuts = {}
        return out

    def forget(self) -> None:
        """Empties the table of known strings."""
        self.names = np.zeros(SLOTS, np.uint64)
        self.where = np.full(SLOTS, -1, np.int32)
        self.used = 0
        self.store = np.zeros(1 << 16, "<u4")
        self.filled = 0
        self.begin, self.size = np.zeros(SLOTS // 2, np.int32), np.zeros(SLOTS // 2, np.int32)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash its number, or -1; and the slot where the search ended."""
        slot = (hashes >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)
        number = self.where[slot]
        found = np.where(self.names[slot] == hashes, number, -1)
        going = np.flatnonzero((found < 0) & (number >= 0))
        while len(going):
            slot[going] = (slot[going] + 1) & (SLOTS - 1)
            at = slot[going]
            number = self.where[at]
            hit = (number >= 0) & (self.names[at] == hashes[going])
            found[going[hit]] = number[hit]
            going = going[~hit & (number >= 0)]
        return found, slot

    def _add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """Puts different, unknown hashes and their ids into the table."""
        size = np.array([len(x) // 4 for x in ids], np.int64)
        total = int(size.sum())
        if self.filled + total > len(self.store):
            self.store = np.concatenate((self.store[: self.filled], np.zeros(max(total, self.filled), "<u4")))
        self.store[self.filled : self.filled + total] = np.frombuffer(b"".join(ids), "<u4")
        n = self.used
        self.begin[n : n + len(ids)] = self.filled + np.cumsum(size) - size
        self.size[n : n + len(ids)] = size
        self.filled, self.used = self.filled + total, n + len(ids)
        # Those that end at one free slot take it in turn: the last one written has it, the others search again.
        left, number = np.arange(len(ids)), np.arange(n, n + len(ids), dtype=np.int32)
        while len(left):
            _, slot = self._find(hashes[left])
            self.where[slot], self.names[slot] = number[left], hashes[left]
            left = left[self.where[slot] != number[left]]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each text's followed by `end` if given, and the texts' bounds in them."""
        b = split(texts)
        hashes, n = b.hashes(), len(b.bounds) - 1
        found, _ = self._find(hashes)
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            fresh, first = np.unique(hashes[unknown], return_index=True)
            if self.used + len(fresh) > SLOTS // 2 or self.filled > MOST_IDS:
                self.forget()
                fresh, first = np.unique(hashes, return_index=True)
                unknown = np.arange(len(hashes))
            # A batch may hold more strings than the table; then each part of it is encoded by itself.
            if len(fresh) > SLOTS // 2:
                middle = n // 2
                if n < 2:
                    return self._encode_plain(texts, end)
                left, right = self.encode(texts.slice(0, middle), end), self.encode(texts.slice(middle), end)
                return np.concatenate((left[0], right[0])), np.concatenate((left[1], right[1][1:] + left[1][-1]))
            at = unknown[first]
            raw = b.data.tobytes()
            self._add(fresh, self._ids([raw[s:e] for s, e in zip(b.start[at].tolist(), b.end[at].tolist(), strict=True)]))
            found, _ = self._find(hashes)
        size = self.size[found]
        sums = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        shift = np.repeat(self.begin[found] - sums[:-1], size)
        ids = self.store[np.arange(sums[-1]) + shift]
        bounds = sums[b.first]
        if end is not None:
            ids = np.insert(ids, bounds[1:], end)
            bounds = bounds + np.arange(n + 1)
        return ids, bounds

    def _encode_plain(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """encode() of one text that has more different strings than the table holds, by the library."""
        ids = [self.library.encode(t or "", add_special_tokens=False).ids + ([] if end is None else [end]) for t in texts.to_pylist()]
        return np.array([x for own in ids for x in own], "<u4"), np.concatenate(([0], np.cumsum([len(x) for x in ids])))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
