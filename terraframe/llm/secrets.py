"""Secret scans: patterns find candidates, corpus-wide ownership tells live from copied.

Three base patterns always give spans. Besides, every long token of mixed letters and digits
outside of them is a candidate. Candidate values are hashed and counted over the corpus: how many
repositories and how many owners hold the value. Both decide. A value looks live if one owner holds it, in
at most FILLED repositories (beyond that it is the owner's own template), or if two owners hold
it in a repository each, as after a move or a fork; any other value has been copied around. Long tokens
become spans of kind `owned` only if they look live; base spans stay whatever their class, with live ones
and copied ones counted apart.

Only hashes are counted, by partial aggregation, so a value that a third of all rows hold costs a
row per task; the classes come back by a join on the text's hash, whose other side has a row per
distinct text with candidates.

Defined results: a null text is an empty one without spans; a null owner or repository counts as
one of its own; repeated rows are reported each; positions are code points, the end exclusive. Columns that begin with two
underscores raise a ValueError.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import bounded, pieces, text_buffers
from .tables import cut, map_arrow, refuse_own_names

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
#: A text without a match of this has no assign span; it is looked for in one pass over a batch.
HINT = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]"""
#: Order of kinds of one start.
KINDS = ("assign", "access", "hex", "owned")
LEAST = {"assign": 12, "access": 18, "hex": 16, "owned": 20}
#: Bits of entropy per character of a long token that counts as a candidate.
ENTROPY = 3.0
#: Repositories of one owner that may hold a live value.
FILLED = 20

CANDIDATE = "array<struct<kind:string,start:int,stop:int,value:string>>"


def _runs(data: np.ndarray, offsets: np.ndarray, chars: bytes, least: int) -> np.ndarray:
    """Rows with a run of at least `least` bytes of `chars`; a run ends where its row ends."""
    wanted = np.zeros(256, bool)
    wanted[list(chars)] = True
    inside = wanted[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return np.searchsorted(offsets, start[end - start >= least], side="right") - 1


HEX_BYTES = b"0123456789abcdef"
TOKEN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all base spans of a text and of its long tokens, in order."""
    base = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    base += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    base += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    more = []
    for m in TOKEN.finditer(text):
        value = m[0]
        if len(value) < LEAST["owned"] or not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
            continue
        if any(s < m.end() and m.start() < e for _, s, e, _ in base):
            continue
        if -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= ENTROPY:
            more.append(("owned", m.start(), m.end(), value))
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan(batch: pa.RecordBatch, text: str) -> list[list[tuple[str, int, int, str]]]:
    """find() of every row, but only rows that can have a span are looked at one by one."""
    column = batch.column(text)
    data, offsets = text_buffers(column)
    rows: set[int] = set()
    for first, last in pieces(offsets, 8 << 20):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        for chars, least in ((HEX_BYTES, LEAST["hex"]), (TOKEN_BYTES, LEAST["owned"])):
            rows.update((_runs(part, at, chars, least) + first).tolist())
    flat = pc.fill_null(column, "")
    for seen in (pc.match_substring(flat, "AKIA"), pc.match_substring_regex(flat, HINT)):
        rows.update(np.flatnonzero(seen.to_numpy(zero_copy_only=False)).tolist())
    found: list[list] = [[]] * len(column)
    for i in rows:
        found[i] = find(column[i].as_py() or "")
    return found


def _value_hash(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows without the text, with __key (hash of the text) and __found, the candidates."""
    refuse_own_names(docs)
    keep = [c for c in docs.columns if c != text]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "__key string", f"__found {CANDIDATE}"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found = [[(k, s, e, _value_hash(v)) for k, s, e, v in row] for row in _scan(batch, text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keep, "__key"]), pa.array(found, kind)], [*keep, "__key", "__found"])

    return map_arrow(docs.withColumn("__key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), scan, schema)


def ownership(found: DataFrame, owner: str, repository: str) -> DataFrame:
    """Value hash -> owners and repositories that hold it, over the whole corpus."""
    each = found.filter(F.size("__found") > 0).select(F.col(owner).alias("o"), F.col(repository).alias("r"), F.explode("__found.value").alias("value"))
    return each.groupBy("value", "o", "r").count().groupBy("value", "o").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def classified(found: DataFrame, owner: str, repository: str) -> DataFrame:
    """Distinct text hash -> __spans: its candidates with owners and repositories of each."""
    held = ownership(found, owner, repository)
    texts = found.filter(F.size("__found") > 0).groupBy("__key").agg(F.first("__found").alias("f"))
    each = texts.select("__key", F.explode("f").alias("f")).select("__key", "f.*")
    return each.join(held, "value").groupBy("__key").agg(F.collect_list(F.struct("kind", "start", "stop", "owners", "repositories")).alias("__spans"))


def is_live(span: Column) -> Column:
    """One owner's, in few repositories, or two owners' in one each; else the value has been copied around."""
    return ((span["owners"] == 1) & (span["repositories"] <= FILLED)) | ((span["owners"] == 2) & (span["repositories"] == 2))


def is_span(span: Column) -> Column:
    """Base spans always; long tokens if they look live."""
    return (span["kind"] != "owned") | is_live(span)


def _joined(spans: Column) -> Column:
    order = F.transform(spans, lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["stop"], s["kind"]))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """The rows without the text, with __spans (kind, start, stop, owners, repositories) and their digests."""
    found = cut(candidates(docs, text))
    # kept first, so that the join has nothing but exchanges below it and adaptive execution can split a common text
    classes = cut(classified(found, owner, repository))
    rows = found.drop("__found").join(classes, "__key", "left")
    rows = rows.withColumn("__spans", F.filter(F.coalesce("__spans", F.array().cast("array<struct<kind:string,start:int,stop:int,owners:bigint,repositories:bigint>>")), is_span))
    count = lambda test: F.size(F.filter("__spans", test)).cast("long")
    of_kind = lambda kind: lambda s: s["kind"] == kind
    rows = rows.withColumns({f"__n_{k}": count(of_kind(k)) for k in KINDS})
    rows = rows.withColumn("__n_live", count(is_live)).withColumn("__n_copied", count(lambda s: ~is_live(s)))
    return rows.withColumn("__base", _joined(F.filter("__spans", lambda s: s["kind"] != "owned"))).withColumn("__all", _joined(F.col("__spans"))).drop("__key")


def redact(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", mask: str = "<secret>") -> DataFrame:
    """The documents, all of them, with every span of theirs replaced by the mask.

    Only texts that have a long token travel to the classes; base spans are masked where they are read.
    """
    refuse_own_names(docs)
    found = cut(candidates(docs.select(owner, repository, text), text).filter(F.size("__found") > 0))
    owned = F.filter("__spans", lambda s: (s["kind"] == "owned") & is_live(s))
    live = classified(found, owner, repository).select(F.col("__key").alias("__text"), owned.alias("__owned")).filter(F.size("__owned") > 0)
    part = "array<struct<kind:string,start:int,stop:int>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"__found {part}"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found = [[(k, s, e) for k, s, e, _ in row] for row in _scan(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "__found"])

    seen = map_arrow(docs, base, schema)
    may = F.exists("__found", lambda s: s["kind"] == "owned")
    some = seen.filter(may).withColumn("__key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    some = some.join(live, F.col("__key") == F.col("__text"), "left").drop("__key", "__text")
    some = some.withColumn("__found", F.concat(F.filter("__found", lambda s: s["kind"] != "owned"), F.coalesce(F.transform("__owned", lambda s: F.struct(s["kind"], s["start"], s["stop"])), F.array().cast(part)))).drop("__owned")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            at = batch.schema.get_field_index(text)
            spans, texts = batch.column("__found").to_pylist(), batch.column(text)
            if any(spans):
                values = texts.to_pylist()
                for i, own in enumerate(spans):
                    if own:
                        values[i] = masked(values[i], [(s["start"], s["stop"]) for s in own], mask)
                texts = pa.array(values, texts.type)
            columns = [texts if i == at else c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "__found"]
            yield pa.RecordBatch.from_arrays(columns, [n for n in batch.schema.names if n != "__found"])

    return map_arrow(seen.filter(~may).unionByName(some), replace, docs.schema)


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """The text with each stretch that spans cover replaced by one mask."""
    out, at = [], 0
    for start, stop in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, stop)
    return "".join([*out, text[at:]])
