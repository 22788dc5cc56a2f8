"""Exact repeated strings over a corpus, by anchors and hashes of growing strings, until unique or long enough.

Every byte is to go that a string of LENGTH bytes covers which also starts anywhere else; beside that,
words are counted that a run of PASSAGE words covers which another document has. Prefix doubling would rank
all positions by short strings, then by ones twice as long, dropping positions as soon as they are
unique. This is not that: strings do grow and drop out when unique, but from anchors instead of from every position, nothing
is sorted by rank pairs, and equality is told by hashes. It works on bytes and on words alike, in the same passes:

* Of the grams of a quarter of the length in a string, the least hash is its anchor, so equal strings have
  equal anchors at equal distances. About 1 byte in 130 is an anchor, and 1 word in 18; each stands for the
  run of strings that it is the anchor of, which start at distances lo to hi before it.
* Level 0 ranks anchors by their gram. Where it is unique, so are all its strings.
* An anchor's strings together are one longer string; where that is repeated, all of them are.
* Else the distances are split into blocks. The strings of a block share a core, longer than the
  gram; unique cores end a block, repeated unions settle it, and what is open goes on to smaller
  blocks, in the end single strings. Ranks grow from a quarter of the length over length - b + 1, with b each
  of BLOCKS, to the length.

What decides are 95 bits: a hash modulo 2**64 and one modulo the prime 2**31 - 1 of other symbols (for words, symbols
made from the first hash, so there it is no independent one). What only saves work (grams, cores, bitmaps) are 64 bits.

Texts equal as a whole are settled by a count of text hashes, and copies of a text are one from then on, combined on
the map side. Counts are aggregated partially and rows meet their counts in joins of two shuffled
sides, so a passage that a third of all texts hold is no hot group; nothing is emitted per pair. What
was counted once is mostly dropped before it is shuffled, by bitmaps of fixed size that never drop a
repeated rank.

Defined results: a null text is an empty one; matches never go over the end of a text; strings are
judged on the input, with overlaps; repeated rows get equal results; texts shorter than LENGTH stay.
Words of a text that occurs more than once count as found in another document if they are PASSAGE or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import discard
from .kernels import SpanHash, bounded, fixed_binary, mix, pieces, row_bounds, text_buffers, words
from .tables import PLACES, bitmap, cut, map_arrow, maybe

#: Bytes of a string that counts as repeated, and words of a passage that does: more than 50.
LENGTH, PASSAGE = 400, 51
#: Distances to a block, by level.
BLOCKS = (16, 4, 1)
#: Bits of a position in the order in which the least gram is looked for.
POSITION = 26

#: Bits of lo and hi in a run, a long with the anchor's position above them, and the bit that marks a run of words.
BITS, WORDS = 12, 1 << 62


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` successive values, in constant time each."""
    n = len(x)
    if n < width:
        return x[:0]
    full = np.concatenate([x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(hashes: SpanHash, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, position, lo and hi of every anchor: it is that of the strings from position - hi to position - lo."""
    gram, size = length // 4, int(offsets[-1])
    none = np.empty(0, np.int64)
    if size < length:
        return none, none, none, none
    low = np.uint64((1 << POSITION) - 1)
    # positions within the piece break ties to the left
    order = hashes.windows(gram)
    order &= ~low
    order |= np.arange(len(order), dtype=np.uint64) & low
    found = _least(order, length - gram + 1)
    found &= low
    # strings that lie within a text
    row = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - (length - 1), 0))
    if not len(row):
        return none, none, none, none
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    start = np.arange(len(row)) + np.repeat(offsets[row[first]] - first, np.diff(np.append(first, len(row))))
    found = found[start].astype(np.int64)
    position = found if size <= int(low) else start + ((found - start) & int(low))
    new = np.flatnonzero(np.r_[True, (position[1:] != position[:-1]) | (row[1:] != row[:-1])])
    last = np.append(new[1:], len(start)) - 1
    position = position[new]
    return row[new], position, position - start[last], position - start[new]


def _tag(hashes: np.ndarray, *marks: np.ndarray) -> np.ndarray:
    """Hashes that also tell where a string lies about its anchor, and of what it is made."""
    for m in marks:
        hashes = mix(hashes ^ ((np.atleast_1d(m).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    return hashes


def _names(hashes: SpanHash, start: np.ndarray, end: np.ndarray, *marks: np.ndarray) -> np.ndarray:
    """(strings, 16): 128 bits of each string and its marks."""
    return np.stack([_tag(hashes.of(start, end), *marks), _tag(hashes.other(start, end), *marks)], axis=1).view(np.uint8)


def _sequences(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, int]) -> Iterator[tuple[int, int, SpanHash, np.ndarray]]:
    """Kind, length, hashes and offsets of the texts as bytes and as words; of lengths that are asked for."""
    here = SpanHash(data)
    if lengths[0]:
        yield 0, lengths[0], here, offsets
    if lengths[1]:
        start, end, row = words(data, offsets)
        yield 1, lengths[1], SpanHash(here.of(start, end)), row_bounds(row, len(offsets) - 1)


def _places(ranks: np.ndarray) -> np.ndarray:
    return ranks & (PLACES - 1)


def _repeated(ranks: DataFrame, column: str) -> bytes:
    """Bitmap of the ranks that occur more than once."""
    twice = ranks.groupBy(column).count().filter(F.col("count") > 1)
    return bitmap(twice, F.col(column).bitwiseAND(F.lit(PLACES - 1)))


def _packed(kind: int, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    return pa.array((WORDS if kind else 0) | pos << 2 * BITS | lo << BITS | hi, pa.int64())


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """k, the hash of the text, and the text."""
    flat = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.unhex(F.md5(flat)).alias("k"), flat.alias("text"))


def _level0(texts: DataFrame, lengths: tuple[int, int], known: bytes | None) -> DataFrame:
    """Ranks of all anchors; with a bitmap of repeated ranks, rows of those anchors."""
    shared = texts.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            data, offsets = text_buffers(batch.column("text"))
            for first, last in pieces(offsets):
                for kind, length, hashes, here in _sequences(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], lengths):
                    row, at, lo, hi = anchors(hashes, here, length)
                    rank = _tag(hashes.of(at, at + length // 4), kind).view(np.int64)
                    if shared is None:
                        yield pa.RecordBatch.from_arrays([pa.array(rank)], ["c"])
                        continue
                    some = maybe(shared.value, _places(rank))
                    row, at, lo, hi, rank = row[some], at[some], lo[some], hi[some], rank[some]
                    whole = fixed_binary(_names(hashes, at - hi, at - lo + length, lo, hi, kind))
                    k = batch.column("k").take(pa.array(first + row))
                    yield pa.RecordBatch.from_arrays([pa.array(rank), whole, k, _packed(kind, at - here[row], lo, hi)], ["c", "u", "k", "run"])

    return map_arrow(texts, run, "c long" if shared is None else "c long, u binary, k binary, run long")


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, kind, pos, lo, hi of the column of runs, one after another."""
    column = batch.column("runs")
    flat = column.flatten().to_numpy()
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    low = (1 << BITS) - 1
    return row, flat >= WORDS, (flat & (WORDS - 1)) >> 2 * BITS, flat >> BITS & low, flat & low


def _blocks(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """Index of the run, block number, and the run's distances within each block."""
    n = hi // block - lo // block + 1
    run = np.repeat(np.arange(len(at)), n)
    number = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + (lo // block)[run]
    return run, number, np.maximum(lo[run], number * block), np.minimum(hi[run], number * block + block - 1)


def _refine(packed: DataFrame, lengths: tuple[int, int], block: int, known: bytes | None) -> DataFrame:
    """Ranks of the cores of all blocks of the runs; with a bitmap, rows of the blocks whose core it has.

    `packed` has k, the compressed text, and runs.
    """
    shared = packed.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor()
        for whole in bounded(batches):
            size = np.array([zstandard.get_frame_parameters(x.as_buffer()).content_size for x in whole.column("packed")], np.int64)
            for first, last in pieces(np.concatenate([[0], np.cumsum(size)])):
                batch = whole.slice(first, last - first)
                data = np.frombuffer(b"".join(inflate.decompress(x.as_buffer()) for x in batch.column("packed")), np.uint8)
                offsets = np.concatenate([[0], np.cumsum(size[first:last])])
                all_rows, kinds, all_pos, all_lo, all_hi = _runs(batch)
                asked = tuple(n if (kinds == bool(i)).any() else 0 for i, n in enumerate(lengths))
                for kind, length, hashes, begin in _sequences(data, offsets, asked):
                    row, pos, lo, hi = (x[kinds == bool(kind)] for x in (all_rows, all_pos, all_lo, all_hi))
                    of, number, near, far = _blocks(pos, lo, hi, block)
                    at = (pos + begin[row])[of]
                    core = _tag(hashes.of(at - number * block, at - number * block - block + 1 + length), number, kind).view(np.int64)
                    if shared is None:
                        yield pa.RecordBatch.from_arrays([pa.array(core)], ["c"])
                        continue
                    some = maybe(shared.value, _places(core))
                    of, near, far, at = of[some], near[some], far[some], at[some]
                    union = fixed_binary(_names(hashes, at - far, at - near + length, near, far, kind))
                    yield pa.RecordBatch.from_arrays([union, batch.column("k").take(pa.array(row[of])), _packed(kind, pos[of], near, far)], ["u", "k", "run"])

    return map_arrow(packed, run, "c long" if shared is None else "u binary, k binary, run long")


def _place(k: str):
    return F.pmod(F.conv(F.hex(F.substring(k, 14, 3)), 16, 10).cast("long"), F.lit(PLACES))


def _some_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts that `wanted` (by k) has, one of each and compressed, with its other columns; hardly any others are shuffled."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(wanted, _place("k")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in bounded(batches):
            low = np.array([int.from_bytes(x.as_py()[13:], "big") for x in batch.column("k")], np.int64) % PLACES
            at = np.flatnonzero(maybe(shared.value, low))
            packed = [squeeze.compress(batch.column("text")[int(i)].as_buffer() or b"") for i in at]
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(at)), pa.array(packed, pa.binary())], ["k", "packed"])

    found = map_arrow(texts, run, "k binary, packed binary").groupBy("k").agg(F.first("packed").alias("packed"))
    return found.join(wanted.withColumnRenamed("k", "w"), F.col("k") == F.col("w")).drop("w")


def _by_text(rows: DataFrame) -> DataFrame:
    """k and its runs; a text has at most as many as bytes."""
    return rows.groupBy("k").agg(F.collect_set("run").alias("runs"))


def _marked(rows: DataFrame) -> DataFrame:
    """The rows with settled, whether their string is one of bytes that stands twice, or one of words in two texts; and one, true of one of its rows.

    All that is aggregated is numbers, so counts are kept in hash tables.
    """
    texts, row = F.xxhash64("k"), F.xxhash64("k", "run")
    seen = rows.groupBy(F.col("u").alias("v")).agg(F.count("*").alias("n"), F.min(texts).alias("low"), F.max(texts).alias("high"), F.min(row).alias("first"), F.max("run").alias("any"))
    settled = F.when(F.col("any") >= WORDS, F.col("low") != F.col("high")).otherwise(F.col("n") > 1)
    # kept first, so that the join has nothing but exchanges below it and adaptive execution can split a common string
    status = cut(seen.select("v", settled.alias("settled"), "first"))
    return cut(rows.join(status, F.col("u") == F.col("v")).withColumn("one", row == F.col("first")).drop("u", "v", "first"), rows, status)


def repeated_strings(docs: DataFrame, text: str = "text", length: int = LENGTH, passage: int = 0, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """k (hash of a text) and run: strings that start from pos - hi to pos - lo start anywhere else, too.

    With `passage`, runs of so many words that stand in another text, too; 0 leaves them out. What only
    copies of a whole text have in common is not told here.
    """
    if length >> BITS or passage >> BITS or blocks[-1] != 1:
        raise ValueError("too long a string, or blocks don't end in single strings")
    lengths = (length, passage)
    texts = _texts(docs, text).filter(F.octet_length("text") >= min(length, 2 * passage - 1 if passage else length))
    # copies of a text give equal rows, which are one from here on
    rows = cut(_level0(texts, lengths, _repeated(_level0(texts, lengths, None), "c")).dropDuplicates(["c", "u", "k", "run"]))
    marked = _marked(rows)
    grams = marked.groupBy(F.col("c").alias("g")).agg(F.count("*").alias("all"), F.count_if(~F.col("settled")).alias("open"))
    grams = cut(grams.filter((F.col("all") > 1) & (F.col("open") > 0)).select("g"))
    found = [cut(marked.filter("settled").select("k", "run"))]
    # what goes on: anchors whose strings aren't settled, and one of each that is, for those to be found by
    more = marked.filter("one OR NOT settled").join(grams, F.col("c") == F.col("g"), "left_semi")
    runs = cut(_by_text(more), marked, grams)
    state = cut(_some_texts(texts, runs), runs)
    for block in blocks:
        marked = _marked(cut(_refine(state, lengths, block, _repeated(_refine(state, lengths, block, None), "c"))))
        found.append(cut(marked.filter("settled").select("k", "run")))
        if block == 1:
            discard(marked, state)
            break
        runs = cut(_by_text(marked.filter("one OR NOT settled")), marked)
        state = cut(state.drop("runs").join(runs.withColumnRenamed("k", "w"), F.col("k") == F.col("w")).drop("w"), state, runs)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]]) if len(start) else np.empty(0, int)
    return list(zip(start[new].tolist(), end[np.append(new[1:], len(start)) - 1].tolist(), strict=True)) if len(new) else []


def _without(packed: DataFrame, lengths: tuple[int, int], with_text: bool) -> DataFrame:
    """k, n_removed, n_spans, words in passages and hash of the rest of each text, or the rest itself; packed: k, packed, runs, copied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor()
        for batch in bounded(batches):
            row, kinds, pos, lo, hi = _runs(batch)
            edge = np.searchsorted(row, np.arange(len(batch) + 1))
            removed, spans, passages, rest = [], [], [], []
            copied = batch.column("copied").to_pylist()
            for i, raw in enumerate(batch.column("packed")):
                text = inflate.decompress(raw.as_buffer())
                own = np.arange(edge[i], edge[i + 1])
                told, bare = own[kinds[own]], own[~kinds[own]]
                gone = _merged(pos[bare] - hi[bare], pos[bare] - lo[bare] + lengths[0])
                heard = _merged(pos[told] - hi[told], pos[told] - lo[told] + lengths[1])
                if copied[i]:  # whole, in bytes if long enough and in words if enough
                    gone = [(0, len(text))] if len(text) >= lengths[0] else gone
                    n = len(words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0])
                    heard = [(0, n)] if n >= lengths[1] else heard
                kept = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(text)], strict=True))
                removed.append(len(text) - len(kept))
                spans.append(len(gone))
                passages.append(sum(e - s for s, e in heard))
                rest.append(kept.decode(errors="ignore") if with_text else hashlib.sha256(kept).hexdigest())
            columns = [batch.column("k"), *(pa.array(x, pa.int64()) for x in (removed, spans, passages)), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "removed", "spans", "passages", "rest"])

    return map_arrow(packed, run, "key binary, removed long, spans long, passages long, rest string")


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = False, passage: int = PASSAGE) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of every row, or with `with_text` kept_text; and n_passage_words.

    Kept text leaves out bytes of a character that a removed run cuts through. n_passage_words are the
    words in runs of `passage` words that another document has; they are told and not removed.
    """
    texts = _texts(docs, text)
    flat = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(key, F.unhex(F.md5(flat)).alias("k"), F.octet_length(flat).cast("long").alias("n_bytes"), flat.alias("kept") if with_text else F.sha2(flat, 256).alias("kept"))
    least = min(length, 2 * passage - 1)
    copies = cut(base.filter(F.col("n_bytes") >= least).groupBy("k").count().filter("count > 1").select(F.col("k").alias("c")))
    spans = cut(_by_text(repeated_strings(docs, text, length, passage)))
    wanted = spans.join(copies, F.col("k") == F.col("c"), "full")
    wanted = wanted.select(F.coalesce("k", "c").alias("k"), F.coalesce("runs", F.array().cast("array<long>")).alias("runs"), F.col("c").isNotNull().alias("copied"))
    wanted = cut(wanted, spans, copies)
    told = cut(_without(_some_texts(texts, wanted), (length, passage), with_text), wanted)
    out = base.join(told, F.col("k") == F.col("key"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    name = "kept_text" if with_text else "kept_sha256"
    return out.select(base[key], "n_bytes", zero("removed").alias("n_removed"), zero("spans").alias("n_spans"), F.coalesce("rest", "kept").alias(name), zero("passages").alias("n_passage_words"))
