"""How far the sources of a language diverge in their terms: an audit of all pairs of sources, exact in integers.

A term is a longest run of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language keeps the
terms that stand in at least LEAST_DOCS of its documents, V of them. A source of it gives each kept
term p = 1 + floor(PARTS * (count + SMOOTH) / (N + SMOOTH * V)), N its occurrences of kept terms; so does the language as
a whole. Pairs of sources differ by the sum of |p - q| over all kept terms, and a source's own terms are those
that it has and that it gives more than its language does.

Texts are read twice. First, tasks count documents by 64-bit hash of language and term; the hashes that enough documents have
set bits of a fixed-size bitmap. Then strings are counted by source, language and term, but for terms that surely aren't kept, so the
long tail of rare strings is never shuffled; of the rest, exact document counts decide. Tasks
count over whole batches, so a term that stands everywhere is one row per source and batch. The kept terms of a language are dealt by hash into chunks of some CHUNK, and the
sources into blocks of BLOCK. For each chunk a source's counts are packed into one row, and every row is copied to the tiles
(chunk, block, block) that need it: at most as many as there are blocks. A task of a tile unpacks two blocks of counts, makes their p
and sums |p - q| for all pairs of the two; chunks' sums are added. So a task holds 2 * BLOCK vectors of a chunk, whatever the
vocabulary, the number of sources and the share that one source or language has.

Defined results: null lang and source are ''; a null text has no terms; a (lang, source) without kept terms still has a
p of each and its place in all pairs; where a language keeps no term all its pairs have value 0; a source alone in
its language has no pairs; repeated rows count each; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import LOWER, SpanHash, bounded, mix, pieces, text_buffers
from .tables import PLACES, bitmap, cut, map_arrow, maybe

LEAST_DOCS, SMOOTH, PARTS, TOP = 30, 5, 1_000_000_000, 50
#: Kept terms in a chunk (some; they are dealt by hash), sources in a block.
CHUNK, BLOCK = 1 << 14, 32
#: Groups of a language and source that are sent to all tasks; more are joined by their keys.
SENT = 100_000
#: Bytes whose terms a task counts together before it sends counts on.
BATCH = 16 << 20

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

#: A hash's first bits are its place in a bitmap.
PLACE_SHIFT = 65 - PLACES.bit_length()
#: Bytes of terms: A-Z, a-z and all of characters beyond ASCII.
SOLID = np.zeros(256, bool)
SOLID[0x41:0x5B] = SOLID[0x61:0x7B] = SOLID[0x80:] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every term."""
    solid = SOLID[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct strings of spans, and which of them each span is; told by their bytes, found by a hash."""
    _, first, which = np.unique(SpanHash(data).of(start, end) ^ (end - start).astype(np.uint64), return_index=True, return_inverse=True)
    whole = data.tobytes()
    strings = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    # every byte of every span against its first one's; where two strings share a hash, by the strings themselves
    size = end - start
    if not np.array_equal(size, size[first][which]):
        same = False
    else:
        total = np.cumsum(size)
        place = np.arange(total[-1]) - np.repeat(total - size, size)
        same = np.array_equal(data[np.repeat(start, size) + place], data[np.repeat(start[first][which], size) + place])
    if not same:
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(whole[a:b], len(number)) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(start))
        strings = list(number)
    return strings, which


def salts(langs: pa.Array) -> np.ndarray:
    """A 64-bit number for each language."""
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.to_pylist()], np.uint64)


def hashed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of pieces of a batch (lang, text): first and last row, lower-cased bytes, terms' start, end and row, and their hash with the language."""
    data, offsets = text_buffers(batch.column("text"))
    langs = pc.dictionary_encode(batch.column("lang"))
    salt = salts(langs.dictionary)[langs.indices.to_numpy()] if len(batch) else np.empty(0, np.uint64)
    for first, last in pieces(offsets):
        own, at = LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first]
        start, end, row = terms(own, at)
        if len(start):
            key = mix(SpanHash(own).of(start, end) ^ (end - start).astype(np.uint64) ^ salt[first:last][row])
            yield first, last, own, start, end, row, key


def common_terms(docs: DataFrame, least_docs: int) -> bytes:
    """A bitmap by the first bits of hashes: not set for (lang, term) that surely stand in fewer documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            docs = np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(docs)], ["h", "docs"])

        for batch in bounded(batches):
            for *_, row, key in hashed(batch):
                keys, which = np.unique(key, return_inverse=True)
                once = np.unique(row * len(keys) + which) % len(keys)
                held.append((keys, np.bincount(once, minlength=len(keys))))
            size += batch.nbytes
            if held and size >= BATCH:
                yield from sent()
                held, size = [], 0
        if held:
            yield from sent()

    made = map_arrow(docs.select("lang", "text"), run, "h long, docs long").groupBy("h").agg(F.sum("docs").alias("docs"))
    return bitmap(made.filter(F.col("docs") >= least_docs), F.shiftrightunsigned("h", PLACE_SHIFT))


def _counts(batch: pa.RecordBatch, bits: bytes) -> pa.Table:
    """How often each group of a batch has a term that may be kept, and in how many rows."""
    out = []
    for first, last, own, start, end, row, key in hashed(batch):
        use = maybe(bits, (key >> np.uint64(PLACE_SHIFT)).astype(np.int64))
        start, end, row = start[use], end[use], row[use]
        if not len(start):
            continue
        strings, which = distinct(own, start, end)
        langs, sources = (pc.dictionary_encode(batch.column(c).slice(first, last - first)) for c in ("lang", "source"))
        of_row = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        # a row's terms, then a group's: how often each, and in how many rows
        pairs, n = np.unique(row * len(strings) + which, return_counts=True)
        of_pair = of_row[pairs // len(strings)] * len(strings) + pairs % len(strings)
        keys, at_key = np.unique(of_pair, return_inverse=True)
        total, docs = np.bincount(at_key, weights=n, minlength=len(keys)).astype(np.int64), np.bincount(at_key, minlength=len(keys))
        group, term = np.divmod(keys, len(strings))
        lang, source = np.divmod(group, len(sources.dictionary))
        names = pa.array([s.decode() for s in strings], pa.string())
        out.append(pa.table([langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), names.take(pa.array(term)), pa.array(total), pa.array(docs)], COUNTS))
    return pa.concat_tables(out) if out else COUNTS.empty_table()


def term_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n and docs: a row per group and term that it has, all of kept terms and some of others."""
    shared = docs.sparkSession.sparkContext.broadcast(common_terms(docs, least_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
            yield from table.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(COUNTS.names).to_batches(1 << 16)

        for batch in bounded(batches):
            held.append(_counts(batch, shared.value))
            size += batch.nbytes
            if size >= BATCH:
                yield from sent()
                held, size = [], 0
        if held:
            yield from sent()

    made = map_arrow(docs, run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(PARTS * (count + SMOOTH) / (total + SMOOTH * kept)), exact: decimals hold the products."""
    over = (count + SMOOTH).cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(10,0)")
    return F.call_function("div", over, (total + F.lit(SMOOTH) * kept).cast("decimal(20,0)")) + 1


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """The same of rows of counts, by long division in three digits of base 1,000 (PARTS): exact in 64 bits below 9e15 occurrences."""
    under = (total + SMOOTH * kept)[:, None]
    out, rest = np.divmod(counts + SMOOTH, under)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, under)
        out = out * 1000 + digit
    return out + 1


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of |p - q| over the columns of every row of a with every row of b."""
    return np.array([np.abs(b - row).sum(axis=1) for row in a], np.int64).reshape(len(a), len(b))


def pair_values(groups: DataFrame, counts: DataFrame, widths: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, source, item, value of every ordered pair of two sources of a language.

    groups: lang, source, number (from 0 within the language), groups (how many), total, v, chunks. counts: lang, source, chunk, place, n of kept terms. widths: lang, chunk, width (its kept terms).
    """
    packed = counts.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("place", "n")).alias("held"))
    cells = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = cells.join(widths, ["lang", "chunk"], "left").join(packed, ["lang", "source", "chunk"], "left")
    own = F.floor(F.col("number") / block).cast("int")
    last = F.floor((F.col("groups") - 1) / block).cast("int")
    # a block meets every block, itself too, in the tile of the two
    tiles = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(F.least(b, own).alias("high"), F.greatest(b, own).alias("low")))
    rows = rows.withColumn("own", own).withColumn("tile", F.explode(tiles))
    rows = rows.select("lang", "chunk", "tile.high", "tile.low", "own", "number", "total", "v", "width", F.col("held.place").alias("place"), F.col("held.n").alias("n"))

    def tile(table: pa.Table) -> pa.Table:
        number, own = table["number"].to_numpy(), table["own"].to_numpy()
        high, low, kept = (table[c][0].as_py() for c in ("high", "low", "v"))
        size = table["width"][0].as_py() or 0  # terms that neither block has count too
        dense = np.zeros((len(number), size), np.int64)
        for i, (at, n) in enumerate(zip(table["place"], table["n"], strict=True)):
            if at.is_valid:
                dense[i, at.values.to_numpy()] = n.values.to_numpy()
        p = shares(dense, table["total"].to_numpy(), kept) if size else dense
        above, beside = np.flatnonzero(own == high), np.flatnonzero(own == low)
        value = apart(p[above], p[beside])
        i, j = np.nonzero(number[above][:, None] < number[beside][None])  # once a pair in a tile of one block
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(i), pa.string()), "a": pa.array(number[above][i]), "b": pa.array(number[beside][j]), "value": pa.array(value[i, j])})

    sums = rows.groupBy("lang", "chunk", "high", "low").applyInArrow(tile, "lang string, a int, b int, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("lang", "value", "p.a", "p.b")
    name = lambda n, out: groups.select("lang", F.col("number").alias(n), F.col("source").alias(out))
    return both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: every other source by its distance, and the `top` terms that the source has more than its language."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    docs = docs.select(*named, F.col(text).alias("text"))
    every = cut(term_counts(docs, least_docs))
    # the language's kept terms, with their occurrences in it
    kept = every.groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("n_lang")).filter(F.col("d") >= least_docs).drop("d")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    counts = cut(every.join(kept, ["lang", "term"]))
    within = Window.partitionBy("lang")
    groups = docs.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.na.fill(0, ["total", "v", "total_lang"])
    groups = groups.withColumns({"number": F.row_number().over(within.orderBy("source")) - 1, "groups": F.count("*").over(within).cast("int"), "chunks": (F.floor(F.col("v") / chunk) + 1).cast("int")})
    groups = cut(groups, every)
    some = groups if groups.count() > SENT else F.broadcast(groups)
    counts = counts.join(some.select("lang", "source", "total", "v", "total_lang", "chunks"), ["lang", "source"])
    part = F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")
    vocabulary = counts.select("lang", "term", part.alias("chunk")).distinct()  # some `chunk` terms a chunk
    placed = vocabulary.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    placed = cut(placed)
    widths = placed.groupBy("lang", "chunk").agg(F.count("*").alias("width"))
    pairs = pair_values(groups, counts.join(placed, ["lang", "term"]).select("lang", "source", "chunk", "place", "n"), widths, block)
    more = share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("n_lang"), F.col("total_lang"), F.col("v"))
    own = counts.select("lang", "source", F.col("term").alias("item"), more.alias("value")).filter(F.col("value") > 0)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", rank)
    return ranked(pairs, "pair").union(ranked(own, "term").filter(F.col("rank") <= top))
