"""URL filter: a trie over reversed host labels and path segments, with allow and block entries.

A rule is a host and a path. It fits the host and all its subdomains, and every path that begins with the
rule's. The trie has a level per host label from the right, and below a host a level per path segment; the
last, open segment of a rule may end inside a segment of the URL. The longest fitting rule decides: that
with the most host labels, then that with the longest path; of two equal entries the block wins.

Rules come from the driver in parts of at most ``PART`` entries; each part's trie is one broadcast, and a
task takes the longest match over all parts, so no number of rules is too large for a worker.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PART = 500_000

ALLOW, BLOCK = "allow", "block"


@dataclass
class _Path:
    """Node of a path: the next whole segments, and the rules that end inside the next one."""

    segments: dict[str, "_Path"] = field(default_factory=dict)
    open: dict[str, tuple[str, str]] = field(default_factory=dict)  # open segment: verdict, rule
    longest: int = 0

    def add(self, path: str, entry: tuple[str, str]) -> None:
        *whole, last = path.split("/")
        node = self
        for segment in whole:
            node = node.segments.setdefault(segment, _Path())
        if node.open.get(last, (ALLOW,))[0] != BLOCK:
            node.open[last] = entry
        node.longest = max(node.longest, len(last))

    def find(self, path: str) -> tuple[str, str] | None:
        node, best = self, None
        rest = path.split("/")
        for depth, segment in enumerate(rest):
            # What a rule leaves open may be followed by anything, but the open part has no slash.
            for size in range(min(len(segment), node.longest), -1, -1):
                if (found := node.open.get(segment[:size])) is not None:
                    best = found
                    break
            if depth + 1 == len(rest) or (node := node.segments.get(segment)) is None:
                break
        return best


@dataclass
class _Host:
    labels: dict[str, "_Host"] = field(default_factory=dict)
    paths: _Path | None = None


class Trie:
    def __init__(self, rules: Sequence[tuple[str, str, str]]) -> None:
        """rules: verdict (allow or block), host, path."""
        self.root = _Host()
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.labels.setdefault(label, _Host())
            node.paths = node.paths or _Path()
            node.paths.add(path, (verdict, host + path))

    def find(self, host: str, path: str) -> tuple[int, str, str] | None:
        """Of the longest fitting rule: number of host labels, verdict, rule."""
        node, best = self.root, None
        for depth, label in enumerate(reversed(host.split(".")), 1):
            if (node := node.labels.get(label)) is None:
                break
            if node.paths is not None and (found := node.paths.find(path)) is not None:
                best = (depth, *found)
        return best


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
    path: from there up to ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = ALLOW) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule (null if none fits), verdict.

    Where no rule fits, the verdict is ``default``. Null ids and repeated rows are rows like any other;
    other columns are not read.
    """
    context = pages.sparkSession.sparkContext
    tries = [context.broadcast(Trie(rules[low : low + PART])) for low in range(0, len(rules), PART)]
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    schema = StructType([*rows.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                hits = [hit for trie in tries if (hit := trie.value.find(host, path)) is not None]
                # Most labels, then the longest rule, then block before allow.
                found.append(max(hits, key=lambda h: (h[0], len(h[2]), h[1]), default=(0, default, None)))
            columns = [*batch.columns, pa.array([f[2] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(of, schema)
