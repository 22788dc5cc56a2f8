"""MinHash near-deduplication by an LSH forest.

Every distinct shingle set has a signature of HASHES minhashes. A tree of the forest is an order of
all sets by DEPTH of these hashes, one after another; sets whose hashes have a long common prefix
stand beside each other. Candidates are the sets of one region, those with a common prefix whose depth
adapts to the place: SPARSE hashes where at most REGION sets share them, else DEPTH hashes:

1. Regions of one set are left out before anything is sorted, by a count of region hashes.
2. The others are sorted, in all TREES orders. Where a region has at most REGION sets, pairs in it are
   candidates if their whole signatures and sizes allow the similarity. The sets of a region that still
   has more at full depth are chained, so they end up in one cluster and are compared as a whole; so
   are those of a region that a border of range partitions cuts.
3. Clusters, the components of candidates, are compared on full sets: every pair of a cluster whose
   signatures and sizes allow it is decided, unless links put both in one component before. A cluster of more
   than CELL sets or ITEMS shingles is dealt into blocks: blocks first, then one set for each
   component of a block, until they are few; then all sets outside the cluster's largest component meet all of its
   sets, in cells of two blocks. A cell gives links that join components, not pairs.

So no pair that shares DEPTH hashes in a tree is lost for the size of its region, and links don't depend
on borders of partitions. Two sets of similarity 0.8 share DEPTH hashes in one order with probability 0.41;
orders share hashes, so they aren't independent. Of 2,000,000 simulated pairs, each hash equal with
probability 0.8, 192 (0.0096 %) share them in none of the 32, with 0.85 16 (0.0008 %); in sparse regions, where
SPARSE hashes do, 2 and 0 (`missed_pairs`, seed 1). Signatures that share fewer hashes than SIGMAS standard deviations below what the
similarity lets expect are not compared: 1.2 in a million at similarity 0.8. So links are found with these
probabilities; there is no way here that finds all for certain.

Sorting is by range over complete keys, so no group is hot; full sets travel once to be
reduced to one of a kind, combined on the map side, and once to their cells. What grows fastest is a family of n
sets that share prefixes without links: it takes n * n comparisons of signatures, as each may be a link.

Defined results: A-Z count as a-z; a document of fewer words than a shingle has its sequence as
one; a document without words (or null) has an empty set, is linked with nothing and kept; equal
sets are one node, however many documents have them. `deduplicate` decides by row: one row of each
group stays, that of the least key (null keys last), then of the least set; of rows equal in both, any.
Columns that begin with two underscores raise a ValueError.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, least_reachable
from .kernels import bounded, fixed_binary, mix, pieces, row_bounds, shingles, text_buffers
from .tables import PLACES, bitmap, cut, map_arrow, maybe, refuse_own_names

HASHES, TREES, SPARSE, DEPTH, REGION = 64, 32, 3, 4, 256
#: Sets and shingles that a cell holds of each side; a larger set is a cell of its own.
CELL, ITEMS = 2048, 1 << 20
#: Standard deviations by which a signature may fall short of what the similarity lets expect.
SIGMAS = 5

_random = np.random.default_rng(20240229)
FACTORS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
ORDERS = np.stack([_random.permutation(HASHES)[:DEPTH] for _ in range(TREES)])


def missed_pairs(share: float, pairs: int, seed: int = 1, step: int = 100_000) -> tuple[int, int]:
    """Of simulated pairs of which each hash is equal with a probability, how many share no SPARSE and no DEPTH hashes in any order."""
    rng, out = np.random.default_rng(seed), [0, 0]
    for _ in range(0, pairs, step):
        same = rng.random((step, HASHES), dtype=np.float32) < share
        for k, depth in enumerate((SPARSE, DEPTH)):
            found = np.zeros(step, bool)
            for order in ORDERS:
                found |= same[:, order[:depth]].all(axis=1)
            out[k] += int((~found).sum())
    return out[0], out[1]


def set_keys(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """128 bits that identify each set, as (sets, 16) bytes; sets must not be empty."""
    first = np.add.reduceat(mix(hashes), bounds)
    second = np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)), bounds)
    return np.stack([first, second], axis=1).astype(">u8").view(np.uint8).reshape(-1, 16)


def signatures(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(sets, HASHES) minhashes, 16 bits each."""
    out = np.empty((len(bounds), HASHES), np.uint16)
    work = np.empty_like(hashes)
    for j in range(HASHES):
        np.multiply(hashes, FACTORS[j], out=work)
        work += SHIFTS[j]
        out[:, j] = mix(np.minimum.reduceat(work, bounds)) & np.uint64(0xFFFF)
    return out


def scan(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, __n (set size), __set (its key, null if empty) and __sig of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            data, offsets = text_buffers(batch.column(text))
            for first, last in pieces(offsets):
                n = last - first
                row, hashes = shingles(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width)
                bounds = row_bounds(row, n)
                size = np.diff(bounds)
                full = size > 0
                begin = bounds[:-1][full]
                some = len(begin) > 0
                sets = set_keys(begin, hashes) if some else np.empty((0, 16), np.uint8)
                sigs = signatures(begin, hashes).astype(">u2").view(np.uint8).reshape(len(begin), -1) if some else np.empty((0, 2 * HASHES), np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(first, n), pa.array(size, pa.int64()), fixed_binary(sets, full), fixed_binary(sigs, full)], [key, "__n", "__set", "__sig"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, __n long, __set binary, __sig binary")


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """A binary column of values of one width as a matrix."""
    if not len(column):
        return np.empty((0, width), kind)
    raw = np.frombuffer(column.buffers()[2], np.uint8)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return raw[at[0] : at[-1]].reshape(len(column), -1).view(kind)


def least_equal(percent: int) -> int:
    """Hashes that two signatures share at least if their sets have the similarity."""
    share = percent / 100
    return max(0, math.floor(HASHES * share - SIGMAS * math.sqrt(HASHES * share * (1 - share))))


def _region_hash(sigs: np.ndarray, tree: int) -> np.ndarray:
    """64 bits of a tree and the first SPARSE hashes there."""
    region = np.full(len(sigs), tree + 1, np.uint64)
    for j in ORDERS[tree][:SPARSE]:
        region = mix(region * np.uint64(0x9E3779B97F4A7C15) ^ sigs[:, j].astype(np.uint64))
    return region.view(np.int64)


def _regions(nodes: DataFrame) -> DataFrame:
    """The region hash of every node in every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 4096):
            sigs = _matrix(batch.column("sig"), 2 * HASHES, ">u2")
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_region_hash(sigs, t) for t in range(TREES)]))], ["region"])

    return map_arrow(nodes.select("sig"), run, "region long")


def _orders(nodes: DataFrame, known: bytes) -> DataFrame:
    """tree, place, node, n, sig: every node once for each tree in which its region may have others, unsorted."""
    shared = nodes.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 4096):
            sigs = _matrix(batch.column("sig"), 2 * HASHES, ">u2")
            for tree in range(TREES):
                at = np.flatnonzero(maybe(shared.value, _region_hash(sigs, tree) & (PLACES - 1)))
                if len(at):
                    place = np.ascontiguousarray(sigs[at][:, ORDERS[tree]]).view(np.uint8).reshape(len(at), -1)
                    rest = [batch.column(c).take(pa.array(at)) for c in ("node", "n", "sig")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree), pa.int32()), fixed_binary(place), *rest], ["tree", "place", "node", "n", "sig"])

    return map_arrow(nodes.select("node", "n", "sig"), run, "tree int, place binary, node binary, n long, sig binary")


def neighbours(tree: np.ndarray, place: np.ndarray, size: np.ndarray, sigs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of rows in order: candidates, and chains through regions of more than REGION rows."""
    n = len(tree)
    none = np.empty(0, np.int64)
    if n < 2:
        return none, none
    same = (place[1:] == place[:-1]) & (tree[1:] == tree[:-1])[:, None]
    lcp = np.cumprod(same, axis=1).sum(axis=1)

    def count(depth: int) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(lcp < depth)])
        return np.bincount(run)[run]

    # the depth at which a row's pairs are looked for
    deep = count(DEPTH)
    depth = np.where(count(SPARSE) <= REGION, SPARSE, np.where(deep <= REGION, DEPTH, DEPTH + 1))
    chain = np.flatnonzero((lcp >= DEPTH) & (deep[1:] > REGION))
    left, right, common = [chain], [chain + 1], lcp
    enough = least_equal(percent)
    for step in range(1, REGION):
        if step > 1:
            common = np.minimum(common[:-1], lcp[step - 1 :])
        at = np.flatnonzero(common >= SPARSE)
        if not len(at):
            break
        at = at[common[at] >= depth[at]]
        at = at[100 * np.minimum(size[at], size[at + step]) >= percent * np.maximum(size[at], size[at + step])]
        for some in np.array_split(at, len(at) // 20_000 + 1):
            some = some[(sigs[some] == sigs[some + step]).sum(axis=1) >= enough]
            left.append(some)
            right.append(some + step)
    return np.concatenate(left), np.concatenate(right)


def _region_edges(orders: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between nodes, or a node and a name of its region, that connect all candidates."""

    def hung(tree: np.ndarray, place: np.ndarray, raw: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges from rows to the names of their regions."""
        named = np.zeros((len(tree), 16), np.uint8)
        named[:, 0], named[:, 1] = depth, tree
        named[:, 2 : 2 + 2 * depth] = np.ascontiguousarray(place[:, :depth]).view(np.uint8).reshape(len(tree), -1)
        return raw, named

    def edges(rows: tuple, border: int, whole: bool) -> pa.RecordBatch:
        """Of whole regions; those of the first `border` rows may go on elsewhere, so they hang on their names."""
        tree, place, node, size, sigs = rows
        root = least_reachable(*neighbours(tree, place, size, sigs, percent), len(tree))
        at = np.flatnonzero(root != np.arange(len(root)))
        raw = node.reshape(-1, 1).view(np.uint8).reshape(-1, 16)
        parts = [(raw[at], raw[root[at]])]
        if border:
            parts.append(hung(tree[:border], place[:border], raw[:border], DEPTH))
            if whole:
                parts.append(hung(tree[:border], place[:border], raw[:border], SPARSE))
        return pa.RecordBatch.from_arrays([fixed_binary(np.concatenate(x)) for x in zip(*parts, strict=True)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for batch in batches:
            if not len(batch):
                continue
            own = (batch.column("tree").to_numpy(), _matrix(batch.column("place"), 2 * DEPTH, ">u2"), _matrix(batch.column("node"), 16, "S16"), batch.column("n").to_numpy(), _matrix(batch.column("sig"), 2 * HASHES, ">u2"))
            if held is not None:
                own = tuple(np.concatenate([h, o]) for h, o in zip(held, own, strict=True))
            tree, place = own[:2]
            start = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (place[1:, :SPARSE] != place[:-1, :SPARSE]).any(axis=1)])
            last = int(start[-1])
            if last:
                border = int(start[1]) if first else 0
                yield edges(tuple(x[:last] for x in own), border, border <= REGION)
                held, first = tuple(x[last:] for x in own), False
            elif len(tree) <= 4 * REGION:  # one region so far
                held = own
            else:  # more than is held: its rows hang on their names, here and in what follows
                yield edges(own, len(tree), False)
                held, first = None, True
        if held is not None:
            yield edges(held, len(held[0]), len(held[0]) <= REGION)

    ordered = orders.repartitionByRange("tree", "place", "node").sortWithinPartitions("tree", "place", "node")
    return map_arrow(ordered, run, "a binary, b binary")


def _place(node: str):
    """A node's place in a bitmap: its last three bytes, which are as good as random."""
    return F.pmod(F.conv(F.hex(F.substring(node, 14, 3)), 16, 10).cast("long"), F.lit(PLACES))


def _sets(docs: DataFrame, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """node, items: the full sets of the wanted nodes and some others, once each."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, _place("node")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            data, offsets = text_buffers(batch.column(text))
            for first, last in pieces(offsets):
                row, hashes = shingles(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width)
                bounds = row_bounds(row, last - first)
                full = np.flatnonzero(np.diff(bounds) > 0)
                if not len(full):
                    continue
                keys = set_keys(bounds[full], hashes)
                low = keys[:, 13:].astype(np.int64)
                hit = np.flatnonzero(maybe(shared.value, (low[:, 0] << 16 | low[:, 1] << 8 | low[:, 2]) % PLACES))
                _, once = np.unique(keys[hit], axis=0, return_index=True)
                hit = hit[once]
                values = pa.ListArray.from_arrays(pa.array(np.append(bounds[full], bounds[-1]), pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([fixed_binary(keys[hit]), values.take(pa.array(hit))], ["node", "items"])

    return map_arrow(docs.select(text), run, "node binary, items array<long>").groupBy("node").agg(F.first("items").alias("items"))


def links(sigs: np.ndarray, edge: np.ndarray, items: np.ndarray, label: np.ndarray, few: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links between sets of different labels that join these, and the labels then.

    Set i is items[edge[i]:edge[i + 1]]. Each of `few`, in order, is compared with all sets that aren't
    before it in `few`, where its label, size and signature ask for it.
    """
    size, label, out, enough = np.diff(edge), label.copy(), [], least_equal(percent)
    names, dense = np.unique(items, return_inverse=True)
    mark = np.zeros(len(names), bool)
    todo = np.ones(len(size), bool)
    for i in few.tolist():
        todo[i] = False
        j = np.flatnonzero(todo & (label != label[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
        j = j[(sigs[j] == sigs[i]).sum(axis=1) >= enough] if len(j) else j
        if not len(j):
            continue
        own, n = dense[edge[i] : edge[i + 1]], size[j]
        mark[own] = True
        begin = np.cumsum(n) - n
        both = np.add.reduceat(mark[dense[np.repeat(edge[j] - begin, n) + np.arange(n.sum())]].astype(np.int64), begin)
        mark[own] = False
        j = j[100 * both >= percent * (size[i] + n - both)]
        _, once = np.unique(label[j], return_index=True)
        if len(once):
            out += [(i, k) for k in j[once].tolist()]
            met = np.append(label[j[once]], label[i])
            label[np.isin(label, met)] = met.min()
    return out, label


def _cells(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that the cells of `rows` give: cluster, x, y, few, node, comp, sig, items.

    Within a cell, rows marked `few` are compared with all others; comp is the component known before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compared() -> pa.RecordBatch:
            cell = pa.Table.from_batches(held).combine_chunks()
            nodes = _matrix(cell.column("node").chunk(0), 16, "S16")
            items = cell.column("items").chunk(0)
            _, label = np.unique(_matrix(cell.column("comp").chunk(0), 16, "S16").ravel(), return_inverse=True)
            few = np.flatnonzero(cell.column("few").to_numpy())
            sigs = _matrix(cell.column("sig").chunk(0), 2 * HASHES, ">u2").astype(np.uint16)
            edge = items.offsets.to_numpy().astype(np.int64)
            found, _ = links(sigs, edge - edge[0], items.flatten().to_numpy(), label.ravel(), few, percent)
            raw, pairs = nodes.reshape(-1, 1).view(np.uint8).reshape(-1, 16), np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([fixed_binary(raw[pairs[:, 0]]), fixed_binary(raw[pairs[:, 1]])], ["a", "b"])

        before = None
        for batch in batches:
            if not len(batch):
                continue
            key = np.concatenate([_matrix(batch.column("cluster"), 16, ">u8").astype(np.uint64), *(batch.column(c).to_numpy().astype(np.uint64)[:, None] for c in ("x", "y"))], axis=1)
            start = np.flatnonzero(np.r_[before is None or (key[0] != before).any(), (key[1:] != key[:-1]).any(axis=1)])
            at = 0
            for k in start.tolist():
                if k > at:
                    held.append(batch.slice(at, k - at))
                if held:
                    yield compared()
                    held.clear()
                at = k
            held.append(batch.slice(at))
            before = key[-1]
        if held:
            yield compared()

    rows = rows.select("cluster", "x", "y", "few", "node", "comp", "sig", "items")
    return map_arrow(rows.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", F.desc("few"), "node"), run, "a binary, b binary")


def _blocks(n: Column, items: Column, cell: int, most: int) -> Column:
    return F.greatest(F.ceil(n / F.lit(cell)), F.ceil(items / F.lit(most)), F.lit(1)).cast("int")


def _cluster_links(members: DataFrame, sets: DataFrame, percent: int, cell: int = CELL, most: int = ITEMS) -> DataFrame:
    """Links (a, b) that join what is linked within clusters; members: node, cluster, n, sig; sets: node, items."""
    own = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    full = sets.select(F.col("node").alias("s"), "items")

    def with_blocks(rows: DataFrame) -> DataFrame:
        """The rows with their clusters' numbers of blocks; a row that is alone goes."""
        count = rows.groupBy(F.col("cluster").alias("c")).agg(F.count("*").alias("k"), F.sum("n").alias("t"))
        # kept first, so that the join has nothing but exchanges below it and adaptive execution can split a large cluster
        count = cut(count.filter("k > 1").select("c", _blocks(F.col("k"), F.col("t"), cell, most).alias("blocks")))
        return cut(rows.join(count, F.col("cluster") == F.col("c")).drop("c"), count)

    def within(rows: DataFrame, salt: str) -> DataFrame:
        """Links within the blocks of the rows' clusters."""
        dealt = rows.withColumns({"x": own(salt, "blocks"), "y": F.lit(0), "few": F.lit(True)})
        return _cells(dealt.join(full, F.col("node") == F.col("s")), percent)

    def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
        """The rows with the components that the links give."""
        comps = connected_components(found, "a", "b").select(F.col("node").alias("m"), "root")
        return rows.drop("comp").join(comps, F.col("node") == F.col("m"), "left").withColumn("comp", F.coalesce("root", "node")).drop("m", "root")

    rows = with_blocks(members.withColumn("comp", F.col("node")))
    found = cut(within(rows, "0"))
    large = cut(rows.filter("blocks > 1"), rows)
    many, step = large.count(), 0
    while many:
        large, step = cut(labelled(large, found), large), step + 1
        # one set for each component, as long as there are half as many each time
        some = large.filter(F.col("comp") == F.col("node")).drop("blocks")
        few = some.count()
        if 2 * few > many:
            break
        some, many = with_blocks(some), few
        found = cut(found.union(within(some, str(step))), found, some)
    else:
        return found
    # all sets outside the largest component of a cluster against all of it
    count = large.groupBy("cluster", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("t")).groupBy(F.col("cluster").alias("c"))
    count = count.agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("k"), F.sum("t").alias("t"), F.max(F.struct("k", "comp", "t")).alias("top"))
    count = count.filter("k > top.k").select("c", "main", _blocks(F.col("k") - F.col("top.k"), F.col("t") - F.col("top.t"), cell, most).alias("fews"), _blocks(F.col("k"), F.col("t"), cell, most).alias("manys"))
    count = cut(count)
    there = cut(large.join(count, F.col("cluster") == F.col("c")).drop("c", "blocks"), large, count)
    outside = F.col("comp") != F.col("main")
    asked = there.filter(outside).withColumns({"x": own("few", "fews"), "few": F.lit(True)}).select("*", every("manys").alias("y"))
    others = there.withColumns({"y": own("many", "manys"), "few": F.lit(False)}).select("*", every("fews").alias("x"))
    # where both blocks hold a set, it stands in the cell once as each; equal nodes have equal labels, so they aren't compared
    return cut(found.union(_cells(asked.unionByName(others).join(full, F.col("node") == F.col("s")), percent)), found, there)


def _grouped(docs: DataFrame, key: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The scanned rows; and node, least (key) and root (of its component) of every distinct set."""
    rows = cut(scan(docs, key, text, width))
    nodes = rows.filter(F.col("__set").isNotNull()).groupBy(F.col("__set").alias("node"))
    nodes = cut(nodes.agg(F.min(key).alias("least"), F.first("__n").alias("n"), F.first("__sig").alias("sig")))
    alone = nodes.select("node", "least", F.col("node").alias("root"))
    shared = _regions(nodes).groupBy("region").count().filter("count > 1")
    edges = cut(_region_edges(_orders(nodes, bitmap(shared, F.col("region").bitwiseAND(F.lit(PLACES - 1)))), percent))
    clusters = connected_components(edges, "a", "b").select(F.col("node").alias("m"), F.col("root").alias("cluster"))
    members = cut(nodes.join(clusters, F.col("node") == F.col("m")).select("node", "cluster", "n", "sig"), edges, clusters)
    if members.isEmpty():
        return rows, alone
    sets = cut(_sets(docs, text, width, members).join(members.select(F.col("node").alias("w")), F.col("node") == F.col("w"), "left_semi"))
    found = _cluster_links(members, sets, percent)
    roots = connected_components(found, "a", "b").select(F.col("node").alias("m"), "root")
    of = alone.drop("root").join(roots, F.col("node") == F.col("m"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    return rows, cut(of, nodes, members, sets, found, roots)


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id (the least key reachable) and kept of every row."""
    refuse_own_names(docs)
    rows, of = _grouped(docs, key, text, width, percent)
    out = rows.select(key, F.col("__n").alias("n_shingles"), "__set")
    low = of.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("__least"))
    least = of.join(cut(low), F.col("root") == F.col("r")).select(F.col("node").alias("__node"), "__least")
    out = out.join(cut(least), F.col("__set") == F.col("__node"), "left")
    out = out.withColumn("component_id", F.when(F.col("__set").isNull(), F.col(key)).otherwise(F.col("__least")))
    return out.select(key, "n_shingles", "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))


def _with_sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """The documents with __set, as scan() has it."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "__set binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            data, offsets = text_buffers(batch.column(text))
            for first, last in pieces(offsets):
                row, hashes = shingles(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width)
                bounds = row_bounds(row, last - first)
                full = np.diff(bounds) > 0
                sets = set_keys(bounds[:-1][full], hashes) if full.any() else np.empty((0, 16), np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, fixed_binary(sets, full)], [*batch.schema.names, "__set"])

    return map_arrow(docs, run, schema)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, and all without words: that of the least key, then of the least set."""
    refuse_own_names(docs)
    rows, of = _grouped(docs, key, text, width, percent)
    first = of.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("f"))
    stays = F.col("__set").eqNullSafe(F.col("__node")) & F.col("__key").eqNullSafe(F.col("__least"))
    pairs = rows.filter(F.col("__set").isNotNull()).groupBy("__set", F.col(key).alias("__key")).agg(F.count("*").alias("__rows"))
    pairs = pairs.join(first.select(F.col("f.node").alias("__node"), F.col("f.least").alias("__least")), stays, "left")
    pairs = cut(pairs.select(F.col("__set").alias("__s"), "__key", "__rows", F.col("__node").isNotNull().alias("__stays")))
    same = (F.col("__set") == F.col("__s")) & F.col(key).eqNullSafe(F.col("__key"))
    own = _with_sets(docs, text, width)
    left = own.join(pairs.filter(~F.col("__stays")), same, "left_anti")
    again = pairs.filter(F.col("__stays") & (F.col("__rows") > 1))
    if not again.isEmpty():
        left = left.join(again, same, "left_anti").union(own.join(again, same, "left_semi").dropDuplicates(["__set", key]))
    return left.select(docs.columns)
