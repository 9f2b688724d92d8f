"""What the operators share: the shared folder, written intermediate tables, word splitting and connected components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from sparkloom.operators.graph import lowest
from sparkloom.session import remove, scratch

#: The whitespace of every contract: space and U+0009..U+000D; `bytes.split()` splits at exactly these.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Tables that the open `temporary` blocks hold.
_open: list[list[DataFrame]] = []


def written(df: DataFrame, name: str, *, beyond: bool = False) -> DataFrame:
    """`df` as a table in the shared folder: cuts the lineage, survives the loss of executors, is computed once.  beyond:
    stays when the open `temporary` block ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._llm_path = path
    if _open and not beyond:
        _open[-1].append(out)
    return out


@contextmanager
def temporary() -> Iterator[None]:
    """Tables that are `written` inside go at its end."""
    _open.append([])
    try:
        yield
    finally:
        for df in _open.pop():
            drop(df)


def named(*names: str) -> list[Column]:
    """Columns by their names, whatever stands in these."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop(df: DataFrame) -> None:
    """Removes what `written` wrote; for tables that nothing lazy reads any more."""
    remove(df.sparkSession, df._llm_path)


def with_fields(df: DataFrame, *fields: tuple[str, DataType]) -> StructType:
    """The schema of `df` with further columns."""
    return StructType([*df.schema.fields, *(StructField(n, t) for n, t in fields)])


def words(text: str | bytes | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` in UTF-8; none for null."""
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).split()


def utf8(column: str) -> F.Column:
    """A text column as its UTF-8 bytes, so that Python workers need not decode it."""
    return F.col(column).cast("string").cast("binary").alias(column)


class Forest:
    """Union-find over int64 labels; `join` tells whether the pair merged two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        path = []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for y in path:
            up[y] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs that a union-find needs; the others close cycles."""
    forest = Forest()
    keep = np.fromiter((forest.join(x, y) for x, y in zip(a.tolist(), b.tolist())), dtype=bool, count=len(a))
    return a[keep], b[keep]


#: Edges that a task joins before it hands on their stars.
STAR_EDGES = 1 << 19


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node long, root long): the smallest label reachable, for every node that has an edge.

    Each task first joins what it holds of the edges into stars, which takes long paths out of the graph.  Then it
    alternates large-star and small-star steps: each is a minimum by key (combined before the shuffle) and an equi join, both
    over a hub's edges in parts.  Each round is written to the shared folder and the one before removed; the driver sees two
    numbers a round.  Null ends and loops are left out; no edges give no rows.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def out() -> pa.RecordBatch:
            ends = list(forest.up)
            return pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array(map(forest.root, ends), pa.int64())], ["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(x, y)
            if len(forest.up) >= STAR_EDGES:
                yield out()
                forest = Forest()
        yield out()

    local = edges.select("a", "b").where("a is not null and b is not null and a <> b").mapInArrow(stars, "a long, b long")
    now = written(local.distinct(), "cc")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = lowest(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = lowest(large)
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a > b").distinct()
        new = written(small, "cc")
        was, state = state, new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(now)
        now = new
        if was == state:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
