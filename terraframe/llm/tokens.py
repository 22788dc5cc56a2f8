"""Token ids of a tokenizer file over Arrow batches, by distinct word and not by occurrence.

For a file that lower-cases, splits into letter runs, single digits and other runs, and merges bytes
with a word end, the ids of a text are those of its words one after another. Texts of characters whose
class and lower case are plain are split in numpy, each distinct word is merged once, all words of
a length side by side, and ids are gathered by occurrence. All other texts, and any file of another
make, go through the tokenizer library itself, so results equal the library's.
"""

from __future__ import annotations

import functools
import json

import numpy as np
from tokenizers import Tokenizer

from .kernels import SpanHash

#: The make of file that the fast way is right for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")
WORD_END = "</w>"
NONE = np.int32(2**31 - 1)
#: Longer words go through the library.
LONGEST = 64

SPACE, LETTER, DIGIT, OTHER, ODD = range(5)


def _classes() -> np.ndarray:
    kind = np.full(256, ODD, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind[0x21:0x7F] = OTHER
    kind[0x30:0x3A] = DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = LETTER
    return kind


KIND = _classes()


def classify(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes and the class of each; ODD where only the library knows."""
    kind, flat = KIND[data], data.copy()
    upper = (data >= 0x41) & (data <= 0x5A)
    flat[upper] += 32
    if len(data) < 2:
        return flat, kind
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    sign = (tail == 0x97) | (tail == 0xB7)
    kind[lead] = kind[lead + 1] = np.where(sign, OTHER, LETTER)
    flat[lead[(tail <= 0x9E) & ~sign] + 1] += 32
    lead = np.flatnonzero(data[:-1] == 0xC2)
    tail = data[lead + 1]
    plain = (tail > 0xA0) & ~np.isin(tail, [0xAA, 0xAD, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE])
    kind[lead] = kind[lead + 1] = np.where(plain, OTHER, ODD)
    lead = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80)) if len(data) > 2 else lead[:0]
    tail = data[lead + 2]
    plain = ((tail >= 0x90) & (tail <= 0xA7)) | ((tail >= 0xB0) & (tail <= 0xBB))
    kind[lead] = kind[lead + 1] = kind[lead + 2] = np.where(plain, OTHER, ODD)
    return flat, kind


class Words:
    """The fast way for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.specials = [t["content"].encode() for t in spec.get("added_tokens", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        names = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.fits = (
            split[0].get("pattern", {}).get("Regex") == PATTERN and [x["type"] for x in split] == ["Split", "ByteLevel"] and names == ["NFC", "Replace", "Lowercase"]
            and spec["model"].get("end_of_word_suffix") == WORD_END and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges")
        )
        if not self.fits:
            return
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocab = spec["model"]["vocab"]
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[char[b] + WORD_END] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = len(vocab) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # an open-addressed table of the pairs: key, rank, made
        self.bits = 19
        slot = self._slot(keys)
        self.keys, self.ranks, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32), np.zeros(1 << self.bits, np.int32)
        self.probes = 1
        for rank, (key, at) in enumerate(zip(keys.tolist(), slot.tolist(), strict=True)):
            step = 0
            while self.keys[at] not in (-1, key):
                at, step = (at + 1) % (1 << self.bits), step + 1
            self.probes = max(self.probes, step + 1)
            if self.keys[at] == -1:
                self.keys[at], self.ranks[at], self.made[at] = key, rank, made[rank]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, -1 of those that don't merge."""
        keys = left.astype(np.int64) * self.size + right
        at = self._slot(keys)
        hit = self.keys[at]
        out = np.where(hit == keys, at, -1)
        rest = np.flatnonzero((hit != keys) & (hit != -1))
        for _ in range(self.probes - 1):
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) % (1 << self.bits)
            hit = self.keys[at[rest]]
            found = hit == keys[rest]
            out[rest[found]] = at[rest[found]]
            rest = rest[~found & (hit != -1)]
        return out

    def _merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges rows of ids, each as long, until no pair merges: padded rows and their lengths."""
        n, width = ids.shape
        out, size = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        where, count = np.arange(n), np.full(n, width)
        slots = self._find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rank = np.where(slots >= 0, self.ranks[slots], NONE)
        while True:
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            live = rank[np.arange(len(ids)), best] != NONE if rank.shape[1] else np.zeros(len(ids), bool)
            done = ~live
            if done.any():
                out[where[done], : ids.shape[1]] = ids[done]
                size[where[done]] = count[done]
                ids, rank, best, where, count = ids[live], rank[live], best[live], where[live], count[live]
            if not len(ids):
                return out, size
            here = np.arange(len(ids))
            made = self.made[self._find(ids[here, best], ids[here, best + 1])]
            columns = np.arange(ids.shape[1] - 1)
            ids = np.where(columns <= best[:, None], ids[:, :-1], ids[:, 1:])
            ids[here, best] = made
            count = count - 1
            columns = columns[:-1]
            rank = np.where(columns < best[:, None], rank[:, :-1], rank[:, 1:])
            for at in (best - 1, best):
                ok = np.flatnonzero((at >= 0) & (at + 1 < count))
                slot = self._find(ids[ok, at[ok]], ids[ok, at[ok] + 1])
                rank[ok, at[ok]] = np.where(slot >= 0, self.ranks[slot], NONE)

    def _distinct(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        length = end - start
        number = np.zeros(len(start), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for width in np.unique(length):
            group = np.flatnonzero(length == width)
            if width > LONGEST:
                made = [self.library.encode(flat[start[i] : end[i]].tobytes().decode(), add_special_tokens=False).ids for i in group]
                number[group] = [len(x) for x in made]
                ids = np.full((len(group), max(map(len, made))), -1, np.int32)
                for i, x in enumerate(made):
                    ids[i, : len(x)] = x
            else:
                chars = flat[start[group][:, None] + np.arange(width)]
                ids = self.inner[chars]
                ids[:, -1] = self.final[chars[:, -1]]
                if width > 1:
                    ids, number[group] = self._merge(ids)
                else:
                    number[group] = 1
            parts.append((group, ids, number[group]))
        at = np.concatenate([[0], np.cumsum(number)])
        out = np.zeros(at[-1], np.int32)
        for group, ids, n in parts:
            inside = np.arange(ids.shape[1]) < n[:, None]
            out[(at[group][:, None] + np.arange(ids.shape[1]))[inside]] = ids[inside]
        return out, number

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and how many each row has."""
        n = len(offsets) - 1
        if not self.fits:
            return self._library(data, offsets, range(n))
        flat, kind = classify(data)
        odd = np.concatenate([[0], np.cumsum(kind == ODD)])
        odd = odd[offsets[1:]] > odd[offsets[:-1]]
        whole = data.tobytes()
        for special in self.specials:
            at = whole.find(special)
            while at >= 0:
                odd[np.searchsorted(offsets, at, side="right") - 1] = True
                at = whole.find(special, at + 1)
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        begins = kind != SPACE
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | cut[1:-1]
        for at in np.flatnonzero((data == 0x27) & begins).tolist():
            if not begins[at]:
                continue
            row_end = offsets[np.searchsorted(offsets, at, side="right")]
            text = flat[at : min(at + 3, row_end)].tobytes()
            short = next((c for c in CONTRACTIONS if text.startswith(c)), None)
            if short:
                begins[at + 1] = False
                after = at + len(short)
                if after < row_end and kind[after] == LETTER:
                    begins[after] = True
        start = np.flatnonzero(begins)
        stop = np.flatnonzero((kind == SPACE) | cut[:-1])
        following = np.searchsorted(stop, start, side="right")
        end = np.append(stop, len(data))[following]
        end = np.minimum(end, np.append(start[1:], len(data)))
        row = np.searchsorted(offsets, start, side="right") - 1
        use = ~odd[row]
        start, end, row = start[use], end[use], row[use]
        if not len(start):
            return self._library(data, offsets, np.flatnonzero(odd), n)
        hashes = SpanHash(flat).of(start, end) ^ (end - start).astype(np.uint64)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        made, count = self._distinct(flat, start[first], end[first])
        begin = np.cumsum(count) - count
        each = count[which]
        total = np.bincount(row, weights=each, minlength=n).astype(np.int64)
        place = np.cumsum(each) - each
        ids = made[np.repeat(begin[which] - place, each) + np.arange(each.sum())]
        if not odd.any():
            return ids, total
        slow, sizes = self._library(data, offsets, np.flatnonzero(odd), n)
        order = np.argsort(np.concatenate([np.repeat(np.arange(n), total), np.repeat(np.arange(n), sizes)]), kind="stable")
        return np.concatenate([ids, slow])[order], total + sizes

    def _library(self, data: np.ndarray, offsets: np.ndarray, rows, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        rows = list(rows)
        made = [x.ids for x in self.library.encode_batch_fast([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in rows], add_special_tokens=False)]
        total = np.zeros(n if n is not None else len(rows), np.int64)
        total[rows] = [len(x) for x in made]
        return np.array([i for x in made for i in x], np.int32), total


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Words:
    """One per Python worker and file."""
    return Words(path)
