"""Lineage cuts and connected components, for operators that iterate."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark deletes the shuffle files of an execution at its end where this is on as the plan is made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Edges that one task holds.
EDGES = 500_000


def _set_folder(context) -> None:
    """The session's spark.checkpoint.dir; a temporary folder only where there is a single machine."""
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)


def shared_folder(session: SparkSession) -> str:
    """The checkpoint folder as a path of this machine and of executors, where it is one of a file system that they mount."""
    _set_folder(session.sparkContext)
    where = session.sparkContext._jsc.sc().getCheckpointDir().get()
    scheme, _, path = where.rpartition(":") if ":" in where.split("/")[0] else ("", "", where)
    if scheme not in ("", "file"):
        raise RuntimeError(f"{where}: files of other programs need a folder that is mounted")
    return "/" + path.lstrip("/")


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """The same rows without lineage, in the folder that all executors share; files of `done` go.

    `done` are earlier cuts that nothing will read any more once this one stands. Shuffle files of the
    steps that led here are deleted as soon as the rows are kept.

    A checkpointed plan keeps the size that was estimated for the plan behind it. Estimates of joins
    are products, so over rounds they would become numbers of millions of digits; the rows are
    wrapped anew, of unknown size, and adaptive execution goes by what it measures.
    """
    session = df.sparkSession
    _set_folder(session.sparkContext)
    before = session.conf.get(CLEANUP, "false")
    session.conf.set(CLEANUP, "true")
    try:
        kept = df.select("*").checkpoint(eager=True)._jdf
    finally:
        session.conf.set(CLEANUP, before)
    discard(*done)
    out = DataFrame(session._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), session)
    out._kept_in = kept.queryExecution().analyzed().rdd().getCheckpointFile()
    return out


def discard(*done: DataFrame) -> None:
    """Deletes the files of cuts that nothing reads any more."""
    for df in done:
        where = getattr(df, "_kept_in", None)
        if where is not None and where.isDefined():
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(where.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
            df._kept_in = None


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of nodes 0 to n - 1 with edges a[i] - b[i], the least node of each one's component."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) for the nodes of a task's edges: the least node that these edges lead to."""
    held = [x for x in batches if len(x)]
    if not held:
        return
    both = pa.concat_arrays([*(x.column(0) for x in held), *(x.column(1) for x in held)]).dictionary_encode()
    del held
    names = both.dictionary
    order = pc.sort_indices(names)
    rank = np.empty(len(names), np.int64)
    rank[order.to_numpy()] = np.arange(len(names))
    ends = rank[both.indices.to_numpy()]
    names = names.take(order)
    root = least_reachable(ends[: len(ends) // 2], ends[len(ends) // 2 :], len(names))
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], ["node", "root"])


def connected_components(edges: DataFrame, a: str, b: str, per_task: int = EDGES) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    Tasks contract the edges they hold, at most some `per_task` each, to stars. Where there are more tasks than
    one, a node may have a root in each; these roots, linked with the least of them, are the graph that
    is left, and so on until one task holds it. Edges are dealt by range, so what lies together is
    contracted together, and a hub's edges are split; a hub of the graph meets its root in joins
    that adaptive execution splits.
    """
    links = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a") != F.col("b")))
    kind = links.schema["a"].dataType.simpleString()
    levels = []
    while True:
        tasks = -(-links.count() // per_task)
        if tasks <= 1:
            labels = cut(links.coalesce(1).mapInArrow(_stars, f"node {kind}, root {kind}"), links)
            break
        stars = links.repartitionByRange(tasks, "a", "b").mapInArrow(_stars, f"node {kind}, root {kind}")
        # a node has a root in each task at most
        met = cut(stars.groupBy("node").agg(F.min("root").alias("low"), F.collect_set("root").alias("roots")), links)
        links = cut(met.select(F.explode("roots").alias("a"), F.col("low").alias("b")).filter("a != b").distinct())
        levels.append(cut(met.select("node", "low"), met))
    for level in reversed(levels):
        top = labels.select(F.col("node").alias("n"), F.col("root").alias("r"))
        labels = cut(level.join(top, F.col("low") == F.col("n"), "left").select("node", F.coalesce("r", "low").alias("root")), level, labels)
    return labels
