"""URL filters: a trie over reversed host labels and path segments, longest match first.

A rule is a verdict and a pattern "host/path". It fits an url whose host is the rule's host or a
subdomain of it and whose path starts with the rule's path. Among the rules that fit, the one of
most host labels wins, then the one of the longest path; the verdict of a url that no rule fits is
the default. Of two rules with one pattern the first one given counts.

The rule list is a parameter of at most MAX_RULES rules, a fixed bound on what is broadcast. The trie is built
once and sent to the Python workers, which keep it. A url costs a look-up for each of its labels and segments and
for each length that rules' last segments have there, not for each rule. Defined results: a null url, or one without "://", has an
empty host and path; no rule with a path fits an empty path; an empty table gives no rows. Extra
columns are kept as they are, but those that begin with two underscores raise a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import map_arrow, refuse_own_names

MAX_RULES = 200_000
DEFAULT = "allow"


class HostTrie:
    """Rules by reversed host labels; each node holds the path rules of its host."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {"next": {}, "paths": None}
        for verdict, pattern in rules:
            host, slash, path = pattern.partition("/")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"next": {}, "starts": {}}
            *whole, start = (slash + path).split("/")
            at = node["paths"]
            for segment in whole:
                at = at["next"].setdefault(segment, {"next": {}, "starts": {}})
            at["starts"].setdefault(start, (verdict, pattern))
            if len(start) not in at.setdefault("lengths", []):
                at["lengths"] = sorted([*at["lengths"], len(start)], reverse=True)

    @staticmethod
    def _longest(paths: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            # the longest start that a rule has here
            for n in paths.get("lengths", ()):
                if n <= len(segment) and (found := paths["starts"].get(segment[:n])):
                    best = found
                    break
            paths = paths["next"].get(segment)
            if paths is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, pattern) of the rule that wins, or None."""
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            if node["paths"] is not None:
                best = self._longest(node["paths"], segments) or best
        return best


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Adds __host, __path, __rule (null if none fits) and __verdict."""
    refuse_own_names(df)
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are broadcast")
    shared = df.sparkSession.sparkContext.broadcast(HostTrie(rules))
    rows = df.withColumn("__host", host_of(F.col(url))).withColumn("__path", path_of(F.col(url)))
    schema = T.StructType([*rows.schema.fields, T.StructField("__rule", T.StringType()), T.StructField("__verdict", T.StringType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            hosts, paths = batch.column("__host").to_pylist(), batch.column("__path").to_pylist()
            found = [trie.match(h, p) for h, p in zip(hosts, paths, strict=True)]
            rule = pa.array([x and x[1] for x in found], pa.string())
            verdict = pa.array([x[0] if x else default for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [*batch.schema.names, "__rule", "__verdict"])

    return map_arrow(rows, judge, schema)
