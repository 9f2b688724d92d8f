"""URL rules by a sort-merge range join.

A host's key is its labels in reverse order, so a rule's host and all its subdomains are one interval of the keys.  The
urls are range partitioned and sorted by key; beside them runs the sorted list of rules, and a stack holds the rules whose
intervals are open, the innermost on top.  Each url takes the longest of the open rules whose path starts its path.

The rules are an argument, not a table: they are sent to the tasks in blocks of at most `RULES_A_SWEEP` and `RULE_BYTES`, and more
rules take more sweeps over the same sorted partitions, each keeping the longer of its own and the earlier match.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of a sweep, by number and by bytes (a longer one goes alone).
RULES_A_SWEEP, RULE_BYTES = 50_000, 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> tuple[str, ...]:
        return tuple(reversed(self.host.split(".")))

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


class Sweep:
    """Rules in the order of their keys, and the stack of those whose intervals hold the present key."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.at, self.stack, self.key, self.found = 0, [], None, []
        by_key: dict[tuple[str, ...], list[Rule]] = {}
        for rule in rules:
            by_key.setdefault(rule.key, []).append(rule)
        self.keys = sorted(by_key)
        self.rules = [by_key[k] for k in self.keys]

    def start(self, key: tuple[str, ...]) -> None:
        """Opens at the first key of a partition the intervals that began in front of it."""
        self.at = bisect_left(self.keys, key)
        for n in range(1, len(key)):
            i = bisect_left(self.keys, key[:n])
            if i < self.at and self.keys[i] == key[:n]:
                self.stack.append(i)

    def open(self, key: tuple[str, ...]) -> list[Rule]:
        """The open rules at `key`, the longest first; keys must come in order."""
        if key == self.key:
            return self.found
        if self.key is None:
            self.start(key)
        inside = lambda i: key[: len(self.keys[i])] == self.keys[i]
        while self.at < len(self.keys) and self.keys[self.at] <= key:
            while self.stack and self.keys[self.at][: len(self.keys[self.stack[-1]])] != self.keys[self.stack[-1]]:
                self.stack.pop()
            self.stack.append(self.at)
            self.at += 1
        while self.stack and not inside(self.stack[-1]):
            self.stack.pop()
        self.key, self.found = key, sorted((r for i in self.stack for r in self.rules[i]), key=lambda r: (-len(r.name), r.name, r.verdict))
        return self.found

    def match(self, key: tuple[str, ...], path: str) -> Rule | None:
        return next((r for r in self.open(key) if path.startswith(r.path)), None)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], *, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of `pages`.

    rules: (host, path, "allow" or "block").  A rule fits its host and all subdomains where the url's path starts with its
    own; of several the longest wins (host and path together; then the first by name; of one name, allow).  Without a
    fitting rule `rule` is null and the verdict is `default`.  Null urls and those without `://` have empty host and path
    and fit no rule with a host.  Repeated rows come back repeated, null ids stay; other columns are not read.
    """
    blocks: list[list[Rule]] = [[]]
    size = 0
    for rule in (Rule(*r) for r in rules):
        own = len(rule.name.encode())
        if blocks[-1] and (len(blocks[-1]) >= RULES_A_SWEEP or size + own > RULE_BYTES):
            blocks.append([])
            size = 0
        blocks[-1].append(rule)
        size += own
    url = F.col(url_col).cast("string")
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.withColumn("key", F.reverse(F.split("host", r"\."))).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # the path and the id behind the key let a hot host spread over partitions
    urls = urls.repartitionByRange("key", "path", "page_id").sortWithinPartitions("key", "path")
    for block in blocks:

        def run(batches: Iterator[pa.RecordBatch], block: list[Rule] = block) -> Iterator[pa.RecordBatch]:
            sweep = Sweep(block)
            for batch in batches:
                rule, verdict = batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
                for i, (key, path) in enumerate(zip(batch.column("key").to_pylist(), batch.column("path").to_pylist())):
                    r = sweep.match(tuple(key), path)
                    if r and (rule[i] is None or (-len(r.name), r.name, r.verdict) < (-len(rule[i]), rule[i], verdict[i])):
                        rule[i], verdict[i] = r.name, r.verdict
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], schema=batch.schema)

        urls = urls.mapInArrow(run, urls.schema)
    return urls.drop("key")
