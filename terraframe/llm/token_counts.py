"""Token counts of whole texts without most of the merging: the whole-token shortcut.

A byte-level BPE file splits a text into pre-tokens and merges the bytes of each. Most pre-tokens are
strings of the vocabulary. Before a run it is proved, string by string with the file's own model, which
of these encode alone as one token; the proven ones make a table (bounded by the vocabulary), which is
sent to all executors. Tasks split texts in numpy, count pre-tokens that the table holds directly,
and merge only the rest, each distinct one once. The table compares all bytes of a string and not a
hash of them.

Splitting in numpy needs to know each character's class. Where it doesn't (other scripts, control
characters, rare spaces) the part between two single spaces around the character goes through the library, and
a text with a special string in it goes there as a whole. So does any file of another make. Counts
are the library's own in all cases.

Defined results: a null text is an empty one, of no bytes and no tokens; ids may be null or
repeat, each row has its count; an empty table gives none. Columns named in `keep` go
along; one that is called like a result raises a ValueError.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .kernels import bounded, pieces, text_buffers
from .tables import map_arrow
from .tokens import LETTER, ODD, SPACE, classify

LIMIT = 1024
RESULTS = {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean", "n_whole": "long"}
#: Longer strings aren't in the table.
LONGEST = 16
#: Distinct strings whose counts a worker remembers, and how long they may be.
REMEMBERED, MEMORABLE = 200_000, 64
#: Places that are looked at for a string from its slot on.
PROBES = 16
GOLD = np.uint64(0x9E3779B97F4A7C15)
# Fixed values of the pattern that the file's pre-tokenizer splits by: what may follow an apostrophe.
ONE_LETTER, TWO_LETTERS = b"stmd", (b"re", b"ve", b"ll")


def byte_chars() -> dict[int, str]:
    """The character by which a byte-level file shows each byte: itself where it can be seen, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


def packed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last eight bytes of strings of at most LONGEST bytes; with the length they are the string. `data` has eight bytes more."""
    words = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    size = end - start
    first = words[start] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(size, 8)) * 8).astype(np.uint64))
    last = np.where(size > 8, words[np.maximum(end - 8, 0)], np.uint64(0))
    return first, last


class WholeTokens:
    """The strings that are one token, in an open-addressed table."""

    def __init__(self, strings: list[bytes]):
        strings = [s for s in strings if 0 < len(s) <= LONGEST]
        data = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
        size = np.array([len(s) for s in strings], np.int64)
        end = np.cumsum(size)
        first, last = packed(data, end - size, end)
        self.bits = max(8, (4 * len(strings)).bit_length())
        room = (1 << self.bits) + PROBES
        self.size = np.zeros(room, np.int64)
        self.first, self.last = np.zeros(room, np.uint64), np.zeros(room, np.uint64)
        self.left_out = 0
        for i, at in enumerate(self._slot(first, last, size).tolist()):
            free = next((k for k in range(at, at + PROBES) if not self.size[k]), None)
            if free is None:  # it is merged like other strings
                self.left_out += 1
                continue
            self.size[free], self.first[free], self.last[free] = size[i], first[i], last[i]

    def _slot(self, first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
        mixed = (first ^ (last * np.uint64(0xC2B2AE3D27D4EB4F)) ^ size.astype(np.uint64)) * GOLD
        return ((mixed ^ (mixed >> np.uint64(29))) * GOLD >> np.uint64(64 - self.bits)).astype(np.int64)

    def hold(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the strings are in the table."""
        size = end - start
        out = np.zeros(len(start), bool)
        todo = np.flatnonzero(size <= LONGEST)
        first, last = packed(data, start[todo], end[todo])
        size = size[todo]
        at = self._slot(first, last, size)
        while len(todo):
            same = (self.size[at] == size) & (self.first[at] == first) & (self.last[at] == last)
            out[todo[same]] = True
            on = ~same & (self.size[at] > 0)
            todo, first, last, size, at = todo[on], first[on], last[on], size[on], at[on] + 1
            if len(todo):  # the table ends with PROBES places beyond the last slot
                inside = at < len(self.size)
                todo, first, last, size, at = todo[inside], first[inside], last[inside], size[inside], at[inside]
        return out


def fits(spec: dict) -> bool:
    """Whether the file splits and merges as the fast way does."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    bytes_only = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    no_more = not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
    return bytes_only and plain and no_more and model.get("type") == "BPE" and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))


def prove(path: str) -> WholeTokens | None:
    """The vocabulary's strings that the file's model encodes alone as one token; None for a file of another make."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if not fits(spec):
        return None
    model = Tokenizer.from_file(path).model
    value = {c: b for b, c in byte_chars().items()}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    alone = [v for v in spec["model"]["vocab"] if v not in special and all(c in value for c in v) and [t.value for t in model.tokenize(v)] == [v]]
    return WholeTokens([bytes(value[c] for c in v) for v in alone])


class Merger:
    """The library's counts of what the shortcut leaves."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.specials = [t["content"].encode() for t in json.load(file).get("added_tokens", [])]
        self.shown = {b: ord(c) for b, c in byte_chars().items()}
        self.known: dict[bytes, int] = {}

    def merged(self, strings: list[bytes]) -> Iterator[int]:
        """Tokens of each of these pre-tokens, of which each distinct one is merged once."""
        every = set(strings)
        made = {s: self.known[s] for s in every & self.known.keys()}
        fresh = every.difference(made)
        made |= {s: len(self.library.model.tokenize(s.decode("latin-1").translate(self.shown))) for s in fresh}
        for s in fresh:
            self._remember(s, made[s])
        return map(made.__getitem__, strings)

    def split_and_merged(self, string: bytes) -> int:
        """Tokens of a part of a text that stands between single spaces."""
        key = b"\0" + string  # no pre-token of the fast way begins so
        n = self.known.get(key)
        if n is None:
            n = len(self.library.encode(string.decode(), add_special_tokens=False).ids)
            self._remember(key, n)
        return n

    def _remember(self, key: bytes, n: int) -> None:
        if len(key) <= MEMORABLE:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = n

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    """One per Python worker and file."""
    return Merger(path)


def token_starts(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a pre-token begins, right wherever classes are known; every byte is part of one.

    A run of letters, of digits or of other characters is one, with a blank right before it. White space
    before it is one without its last character, which is one of its own unless it is that blank;
    white space that ends a text is one. An apostrophe that begins a run takes the ending of a contraction with it.
    """
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    starts = change.copy()
    space = kind == SPACE
    run = np.flatnonzero(change & ~space)
    after = run[(run > 0) & ~first[run]]  # runs with a character of their text before them
    after = after[space[after - 1]]
    joined = data[after - 1] == 0x20
    starts[after - 1] = True
    starts[after[joined]] = False
    quote = run[(data[run] == 0x27) & starts[run]]
    if len(quote):
        ends = np.append(offsets[1:], n)[np.searchsorted(offsets[1:], quote, side="right")]
        more = np.concatenate([data, np.zeros(3, np.uint8)])
        one, two = more[quote + 1], more[quote + 2]
        short = np.isin(one, list(ONE_LETTER)) & (quote + 1 < ends)
        long = np.zeros(len(quote), bool)
        for a, b in TWO_LETTERS:
            long |= (one == a) & (two == b) & (quote + 2 < ends)
        for found, size in ((quote[short], 2), (quote[long & ~short], 3)):
            starts[found + 1] = False
            rest = found + size
            rest = rest[rest < n]
            rest = rest[~first[rest] & (kind[rest] == LETTER)]
            starts[rest] = True
    return starts


def count(data: np.ndarray, offsets: np.ndarray, table: WholeTokens, rest: Merger) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and how many of them the table gave."""
    n = len(offsets) - 1
    total, direct = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not len(data):
        return total, direct
    special = np.zeros(n, bool)
    whole = data.tobytes()
    for string in rest.specials:
        at = whole.find(string)
        while at >= 0:
            special[np.searchsorted(offsets, at, side="right") - 1] = True
            at = whole.find(string, at + 1)
    kind = classify(data)[1]
    starts = token_starts(data, kind, offsets)
    # parts between single blanks that stand among known characters of other classes
    known = (kind != SPACE) & (kind != ODD)
    part = np.zeros(len(data), bool)
    part[1:-1] = (data[1:-1] == 0x20) & known[:-2] & known[2:]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    part[1:] &= ~edge[1:-1]  # a text's first character
    part[:-1] &= ~edge[1:-1]  # a text's last character
    part |= edge[:-1]
    odd_at = np.flatnonzero(kind == ODD)
    use = starts.copy()
    if len(odd_at):
        begin = np.flatnonzero(part)
        end = np.append(begin[1:], len(data))
        odd = np.unique(np.searchsorted(begin, odd_at, side="right") - 1)
        row = np.searchsorted(offsets, begin[odd], side="right") - 1
        for a, b, r in zip(begin[odd].tolist(), end[odd].tolist(), row.tolist(), strict=True):
            use[a:b] = False
            if not special[r]:
                total[r] += rest.split_and_merged(whole[a:b])
    for r in np.flatnonzero(special).tolist():
        use[offsets[r] : offsets[r + 1]] = False
    if special.any():
        total[special] = rest.whole([whole[offsets[r] : offsets[r + 1]].decode() for r in np.flatnonzero(special).tolist()])
    every = np.flatnonzero(starts)
    chosen = use[every]
    start, end = every[chosen], np.append(every[1:], len(data))[chosen]
    row = np.searchsorted(offsets, start, side="right") - 1
    held = table.hold(np.concatenate([data, np.zeros(8, np.uint8)]), start, end)
    direct += np.bincount(row[held], minlength=n)
    total += direct
    others = np.flatnonzero(~held)
    strings = [whole[a:b] for a, b in zip(start[others].tolist(), end[others].tolist(), strict=True)]
    made = np.fromiter(rest.merged(strings), np.int64, len(strings))
    np.add.at(total, row[others], made)
    return total, direct


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to keep, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) and n_whole (tokens that the table gave) of every row."""
    columns = [key, *(c for c in keep if c != key)]
    if clash := sorted(RESULTS.keys() & set(columns)):
        raise ValueError(f"columns {clash} are called like results")
    proven = prove(path)
    shared = docs.sparkSession.sparkContext.broadcast(proven)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rest = shared.value, merger(path)
        for batch in bounded(batches):
            data, offsets = text_buffers(batch.column(len(columns)))
            total, direct = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for first, last in pieces(offsets):
                own, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                if table is None:
                    total[first:last] = rest.whole([own[a:b].tobytes().decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                else:
                    total[first:last], direct[first:last] = count(own, at, table, rest)
            made = [np.diff(offsets), total, total > limit, direct]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *map(pa.array, made)], [*columns, *RESULTS])

    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*columns).schema.fields}
    schema = ", ".join(f"`{n}` {t}" for n, t in (kinds | RESULTS).items())
    return map_arrow(docs.select(*columns, text), run, schema)
