"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes are the signs of the vectors' principal directions after a rotation that is learned, by
iterative quantisation, on a sample of at most SAMPLE vectors; so is the Hamming radius, which holds
the share COVERED of true neighbours within the sample (in all vectors, neighbours are nearer). A
code is split into substrings, each indexed: two codes within the radius agree in at least one
substring up to that substring's part of it, by the pigeonhole principle. Probing the substrings, all keys
within the part's ball or, where these are more than the buckets, the buckets' keys, gives every code within the
radius; those are reranked by inner products in double precision. Queries
that find fewer than TOP + 1 vectors so, over all rows, are searched once more without a radius.

The query set is stated (ids divisible by QUERY_EVERY), so it meets all rows in blocks: cells of at
most some QUERY_BLOCK queries and ROW_BLOCK rows, each with its own index; a cell's best are merged
by rank. Equal vectors are one class, which is searched once and searches once; of its rows only the
TOP + 1 least ids can be in a result, so a vector that a third of all rows have is no hot group.

Defined results: null ids take no part; nor do vectors that are null, zero, hold null or non-finite
components; vectors are compared with those of their own length, of which there are at most MAX_LENGTHS; rows of a query's own id are its own; ties go to
the lesser id; fewer candidates than TOP give as many rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

TOP, QUERY_EVERY = 20, 20
SAMPLE, BITS, SUBSTRINGS = 10_000, 64, 4
COVERED = 0.96
ROUNDS = 30
QUERY_BLOCK, ROW_BLOCK = 2048, 8192
MAX_LENGTHS = 64


class Code:
    """Mean, rotated directions and radius, learned from a matrix of vectors."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        bits = min(BITS, sample.shape[1])
        directions = np.linalg.svd(centred.T @ centred)[0][:, :bits]
        turned = centred @ directions
        rotation = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(turned @ rotation > 0, 1.0, -1.0).T @ turned)
            rotation = (u @ v).T
        self.turn = directions @ rotation
        codes = self.of(sample)
        asked = rng.permutation(len(sample))[: min(500, len(sample))]
        score = sample[asked] @ sample.T
        score[np.arange(len(asked)), asked] = -np.inf
        near = np.argsort(-score, axis=1)[:, : min(TOP, len(sample) - 1)]
        far = np.bitwise_count(codes[asked][:, None] ^ codes[near])
        self.radius = int(np.ceil(np.quantile(far, COVERED))) if far.size else bits

    def of(self, vectors: np.ndarray) -> np.ndarray:
        bits = (vectors - self.mean) @ self.turn > 0
        full = np.zeros((len(bits), BITS), np.uint8)
        full[:, : bits.shape[1]] = bits
        return np.packbits(full, axis=1).view(">u8").ravel().astype(np.uint64)


@functools.lru_cache(maxsize=BITS)
def ball(width: int, radius: int) -> np.ndarray:
    """All differences of at most `radius` bits in `width`."""
    every = np.arange(1 << width, dtype=np.uint64)
    return every[np.bitwise_count(every) <= radius]


class MultiIndex:
    """Buckets of rows by each substring of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables, self.at = codes, [], []
        width = BITS // SUBSTRINGS
        for i in range(SUBSTRINGS):
            part = (codes >> np.uint64(i * width)) & np.uint64((1 << width) - 1)
            order = np.argsort(part, kind="stable")
            keys, first = np.unique(part[order], return_index=True)
            at = np.full(1 << width, -1, np.int64)
            at[keys.astype(np.int64)] = np.arange(len(keys))
            self.at.append(at)
            self.tables.append((np.uint64(i * width), np.uint64((1 << width) - 1), order, keys, np.append(first, len(codes))))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """All rows whose code is within the radius: substring radii add up so that one must hold."""
        seen = np.zeros(len(self.codes), bool)
        for i, (shift, mask, order, keys, edge) in enumerate(self.tables):
            own = (radius + 1) // SUBSTRINGS + (i < (radius + 1) % SUBSTRINGS) - 1
            if own < 0:
                continue
            part = code >> shift & mask
            near = ball(BITS // SUBSTRINGS, own)
            if len(near) < len(keys):  # look every key of the ball up
                at = self.at[i][(part ^ near).astype(np.int64)]
                for k in at[at >= 0].tolist():
                    seen[order[edge[k] : edge[k + 1]]] = True
            else:
                hit = np.bitwise_count(keys ^ part) <= own
                seen[order[np.repeat(hit, np.diff(edge))]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def usable(vector: Column, length: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == length) & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(df: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = TOP, query_every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, key and score of the `top` nearest found of each query, among vectors of its length."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull())
    lengths = [r["n"] for r in rows.filter(F.size("v") > 0).select(F.size("v").alias("n")).distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"more than {MAX_LENGTHS} lengths of vectors")
    found = [_search(rows.filter(usable(F.col("v"), n)), top, query_every) for n in sorted(lengths)]
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if not found else found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _search(rows: DataFrame, top: int, query_every: int) -> DataFrame:
    """search() among vectors of one length, all usable: id, v."""
    df, rows = rows, rows.withColumn("class", F.xxhash64("v"))
    asks = F.col("id") % query_every == 0
    classes = cut(rows.groupBy("class", "v").agg(F.min("id").alias("least"), F.max(asks).alias("asks")))
    schema = "query_id long, rank int, vec_id long, score double"
    sample = classes.select("v", F.xxhash64(F.lit("sample"), "class").alias("o")).orderBy("o").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast(Code(_matrix(sample)))
    count = classes.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()[0]
    row_blocks = -(-count["n"] // ROW_BLOCK)
    block = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "class"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def cell(queries: pa.Table, table: pa.Table, all_rows: bool) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(table):
            code = shared.value
            base, ids, names = _matrix(table.column("v").combine_chunks()), table.column("least").to_numpy(), table.column("class").to_numpy()
            wanted = _matrix(queries.column("v").combine_chunks())
            index = None if all_rows else MultiIndex(code.of(base))
            for name, vector, own in zip(queries.column("class").to_numpy(), wanted, code.of(wanted), strict=True):
                found = np.arange(len(base)) if all_rows else index.within(own, code.radius)
                score = base[found] @ vector
                if len(found) > top + 1:  # all that may be among the best, for the sums in order of components
                    found = found[score >= np.partition(score, -top - 1)[-top - 1] - 1e-9 * (1 + np.abs(score).max())]
                score = (base[found] * vector).sum(axis=1)
                best = np.lexsort((ids[found], -score))[: top + 1]
                out.append((np.full(len(best), name), names[found[best]], ids[found[best]], score[best]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0)]
        return pa.table({n: pa.array(x) for n, x in zip(("query", "class", "least", "score"), columns, strict=True)})

    def nearest(wanted: DataFrame, n: int, all_rows: bool) -> DataFrame:
        """query, class and score of the best of each of n wanted classes: those within the radius, or all."""
        query_blocks = max(1, -(-n // QUERY_BLOCK))
        there = classes.select("class", "v", "least", block("row", row_blocks).alias("r"), every(query_blocks).alias("q"))
        asked = wanted.select("class", "v", block("query", query_blocks).alias("q"), every(row_blocks).alias("r"))
        cells = asked.groupBy("r", "q").cogroup(there.groupBy("r", "q"))
        found = cells.applyInArrow(lambda x, y: cell(x, y, all_rows), "query long, class long, least long, score double")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
        return cut(found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= top + 1).select("query", "class", "score"))

    found = nearest(classes.filter("asks"), count["q"], False)
    enough = found.groupBy("query").count().filter(F.col("count") >= min(top + 1, count["n"]))
    short = cut(classes.filter("asks").join(enough, F.col("class") == F.col("query"), "left_anti").select("class", "v"))
    if n_short := short.count():
        found = found.join(enough, "query", "left_semi").union(nearest(short, n_short, True))
    least = Window.partitionBy("member").orderBy("id")
    members = rows.select(F.col("class").alias("member"), "id").withColumn("n", F.row_number().over(least)).filter(F.col("n") <= top + 1)
    each = found.join(members, F.col("class") == F.col("member")).select("query", (-F.col("score")).alias("s"), "id")
    # a query's class has a list of its nearest, one more than wanted for its own row
    lists = cut(each.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("s", "id"))).alias("list")))
    queries = rows.filter(asks).select(F.col("id").alias("query_id"), F.col("class").alias("c"))
    mine = queries.join(lists, F.col("c") == F.col("query"))
    best = F.slice(F.filter("list", lambda x: x["id"] != F.col("query_id")), 1, top)
    out = mine.select("query_id", F.posexplode(best).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
