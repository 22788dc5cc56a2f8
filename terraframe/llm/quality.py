"""Quality by hierarchical empirical Bayes: a document's own evidence, its path's and its host's.

A document classifier, naive Bayes over which hashed words documents have, calibrated by a logistic fit, is learned from a
bounded sample: of the labelled rows, the MAX_LABELLED whose hashed keys are least; three quarters of
them give word weights, the others the calibration. Every document of the corpus is then scored, sums by
host and by path within host are aggregated, and their posteriors are shrunk: a host's towards the
corpus, a path's towards its host, by as many pseudo-documents as the spread between groups, over
all documents, calls for. A document's posterior is its evidence with the odds of its path in place
of those of the corpus, its own share taken out of the path's sums.

Defined results: a null or empty text has no evidence and gets its path's quality; a null host or
path is one of its own; without labelled rows the evidence is 0.5 for all; of the documents of a labelled key
the last text in order is learnt from, with each of its labels. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, SpanHash, bounded, pieces, text_buffers, words
from .tables import cut, map_arrow

BUCKETS = 1 << 18
MAX_LABELLED = 20_000
SMOOTHING = 0.5
#: Weights of words seen n times are shrunk by n / (n + RARE).
RARE = 4.0
#: Weights above this in size count as marks of a class.
STRONG = 1.5
INPUTS = 5
#: ASCII signs.
SIGN = np.zeros(256, bool)
SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
FLOOR = 1e-4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of three features of each word: itself, its last bytes, whether it repeats the one before."""
    start, end, row = words(data, offsets)
    if not len(start):
        return np.empty(0, np.int64), row
    exact, lower = SpanHash(data), SpanHash(LOWER[data])
    left, right = start.copy(), end.copy()
    for _ in range(3):  # up to three signs about a word are no part of it
        left += SIGN[data[left]] & (left < right - 1)
        right -= SIGN[data[right - 1]] & (left < right - 1)
    word = lower.of(left, right)
    tail = exact.of(np.maximum(start, end - 3), end) ^ np.uint64(0x5851F42D4C957F2D)
    again = np.r_[False, (word[1:] == word[:-1]) & (row[1:] == row[:-1])].astype(np.uint64) + np.uint64(1)
    shift = np.uint64(64 - 18)
    marks = again * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([word >> shift, tail >> shift, marks >> shift], axis=1).ravel().astype(np.int64), np.repeat(row, 3)


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    data, offsets = text_buffers(column)
    for first, last in pieces(offsets):
        bucket, row = features(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        yield first, bucket, row, last - first


class Model:
    """Word weights of one label, and the logistic fit of the inputs they give."""

    def __init__(self, counts: np.ndarray, documents: np.ndarray):
        share = (counts + SMOOTHING) / (documents[:, None] + 2 * SMOOTHING)
        odds = np.log(share[1]) - np.log(share[0])
        seen = counts.sum(axis=0)
        self.weights = (odds * seen / (seen + RARE)).astype(np.float32)
        self.fit = np.zeros(INPUTS + 1)

    def inputs(self, bucket: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """(rows, INPUTS): mean, largest and least weight, share of strong marks either way."""
        out = np.zeros((n, INPUTS))
        if len(row):
            at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            size = np.diff(at, append=len(row))
            w = self.weights[bucket]
            for i, values in enumerate((np.add.reduceat(w, at) / size, np.maximum.reduceat(w, at), np.minimum.reduceat(w, at),
                                        np.sqrt(np.add.reduceat((w > STRONG).astype(np.float32), at) / size), np.sqrt(np.add.reduceat((w < -STRONG).astype(np.float32), at) / size))):
                out[row[at], i] = values
        return out

    def calibrate(self, inputs: np.ndarray, label: np.ndarray) -> None:
        """Ridge logistic regression by Newton steps."""
        x = np.column_stack([inputs, np.ones(len(inputs))])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ self.fit, -30, 30)))
            ridge = np.diag([0.1] * INPUTS + [1e-6])
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (label - p) - ridge @ self.fit)
            self.fit += step
            if np.abs(step).max() < 1e-8:
                break

    def probability(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs @ self.fit[:-1] + self.fit[-1], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str) -> Model | None:
    """The model of a 0/1 label from the bounded sample, or None where it has one class only."""
    order = F.xxhash64(F.lit(label), key)
    sample = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__id"), F.col(label).cast("int").alias("__y"), order.alias("__o")).orderBy("__o").limit(MAX_LABELLED)
    sample = cut(sample.select("__id", "__y", (F.pmod("__o", F.lit(4)) == 0).alias("__fit")))
    # at most MAX_LABELLED rows of three numbers are broadcast, and one text for each is learnt from
    rows = docs.select(key, text).join(F.broadcast(sample), F.col(key) == F.col("__id"))
    rows = cut(rows.groupBy("__id", "__y", "__fit").agg(F.max(text).alias(text)).select(text, "__y", "__fit"), sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS + 1), np.int64)  # documents last
        for batch in bounded(batches):
            y = batch.column("__y").to_numpy()
            for first, bucket, row, n in _pieces(batch.column(text)):
                once = np.unique(row * BUCKETS + bucket)
                of = y[first : first + n].astype(np.int64)
                total[:, :-1] += np.bincount(of[once // BUCKETS] * BUCKETS + once % BUCKETS, minlength=2 * BUCKETS).reshape(2, BUCKETS)
                total[:, -1] += np.bincount(of, minlength=2)
        for c in (0, 1):
            at = np.flatnonzero(total[c])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c), pa.int32()), pa.array(at, pa.int32()), pa.array(total[c][at])], ["y", "bucket", "n"])

    table = map_arrow(rows.filter("NOT __fit"), count, "y int, bucket int, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, BUCKETS + 1))
    counts[table["y"].to_numpy(int), table["bucket"].to_numpy(int)] = table["n"]
    if not counts[:, :-1].sum(axis=1).all():
        return None
    model = Model(counts[:, :-1], counts[:, -1])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            for first, bucket, row, n in _pieces(batch.column(text)):
                x = shared.value.inputs(bucket, row, n)
                yield pa.RecordBatch.from_arrays([batch.column("__y").slice(first, n), *(pa.array(x[:, i]) for i in range(INPUTS))], ["y", *(f"x{i}" for i in range(INPUTS))])

    fit = map_arrow(rows.filter("__fit"), inputs, "y int, " + ", ".join(f"x{i} double" for i in range(INPUTS))).toPandas().sort_values([*(f"x{i}" for i in range(INPUTS)), "y"])
    model.calibrate(fit[[f"x{i}" for i in range(INPUTS)]].to_numpy(), fit["y"].to_numpy(float))
    return model


def evidence(docs: DataFrame, models: dict[str, Model | None], text: str) -> DataFrame:
    """The rows without the text, with __p_<label> of each model from the whole text; null without words."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    keep = [c for c in docs.columns if c != text]
    names = list(models)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"`__p_{n}` double" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            for first, bucket, row, n in _pieces(batch.column(text)):
                empty = np.bincount(row, minlength=n) == 0
                columns = [batch.column(c).slice(first, n) for c in keep]
                for name in names:
                    m = shared.value[name]
                    columns.append(pa.array(m.probability(m.inputs(bucket, row, n)) if m else np.full(n, 0.5), mask=empty))
                yield pa.RecordBatch.from_arrays(columns, [*keep, *(f"__p_{x}" for x in names)])

    return map_arrow(docs, run, schema)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(FLOOR), F.least(F.lit(1 - FLOOR), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, centre: Column, free: int) -> float:
    """Pseudo-documents of a group's prior, from the spread of groups' means about their centres beyond that of chance; `free`: centres."""
    row = groups.filter("n > 0").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - centre, 2)).alias("between"), F.count("*").alias("k"), F.sum("w").alias("within")).collect()[0]
    return strength(row["n"] or 0, row["between"] or 0.0, row["k"], row["within"] or 0.0, free)


def strength(n: int, between: float, k: int, within: float, free: int) -> float:
    """Of k groups of n documents: noise of a document over the variance of groups' true means, by moments."""
    if not n or k <= free:
        return 1e3
    noise = max(within, 1e-12) / n
    spread = max((between - (k - free) * noise) / n, 1e-6)
    return min(max(noise / spread, 0.1), 1e6)


def posteriors(rows: DataFrame, p: str, host: str, path: str, name: str) -> DataFrame:
    """Adds <name>, <name>_host and <name>_path to rows with a probability each."""
    own = F.col(p)
    sums = [F.count(own).alias("n"), F.coalesce(F.sum(own), F.lit(0.0)).alias("s"), F.coalesce(F.sum(own * own), F.lit(0.0)).alias("q")]
    within = (F.col("q") - F.when(F.col("n") > 0, F.col("s") * F.col("s") / F.col("n")).otherwise(0.0)).alias("w")
    paths = cut(rows.groupBy(F.col(host).alias("h"), F.col(path).alias("a")).agg(*sums).select("h", "a", "n", "s", "q", within))
    hosts = cut(paths.groupBy(F.col("h").alias("hh")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).select("hh", "n", "s", within))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()[0]
    mean = whole["s"] / whole["n"] if whole["n"] else 0.5
    by_host = _strength(hosts, F.lit(mean), 1)
    # paths spread about the mean of their own host
    inner = paths.join(hosts.select("hh", F.col("s").alias("hs"), F.col("n").alias("hn")), F.col("h").eqNullSafe(F.col("hh")))
    by_path = _strength(inner, F.col("hs") / F.col("hn"), hosts.filter("n > 0").count())
    hosts = hosts.select("hh", ((F.col("s") + by_host * mean) / (F.col("n") + by_host)).alias(f"{name}_host"))
    groups = cut(paths.join(hosts, F.col("h").eqNullSafe(F.col("hh"))).select("h", "a", "n", "s", f"{name}_host"))
    out = rows.join(groups, F.col(host).eqNullSafe(F.col("h")) & F.col(path).eqNullSafe(F.col("a")))
    shrunk = lambda s, n: (s + by_path * F.col(f"{name}_host")) / (n + by_path)
    others = shrunk(F.col("s") - F.coalesce(own, F.lit(0.0)), F.col("n") - F.when(own.isNull(), 0).otherwise(1))
    odds = F.when(own.isNull(), _logit(others)).otherwise(_logit(own) + _logit(others) - _logit(F.lit(mean)))
    return out.withColumn(f"{name}_path", shrunk(F.col("s"), F.col("n"))).withColumn(name, 1 / (1 + F.exp(-odds))).drop("h", "a", "n", "s")


def assess(docs: DataFrame, labels: DataFrame, names: tuple[str, ...] = ("quality", "toxic"), key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """key and, for each label, the posterior of a document, of its host and of its path."""
    docs = docs.select(key, text, F.col(host).alias("__host"), F.col(path).alias("__path"))
    models = {n: learn(docs, labels, n, key, text) for n in names}
    rows = cut(evidence(docs, models, text))
    for n in names:
        rows = posteriors(rows, f"__p_{n}", "__host", "__path", n)
    return rows.drop("__host", "__path")
