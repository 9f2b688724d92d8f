"""A quality classifier: gradient-boosted trees grown on feature histograms over statistics of the whole text.

The trees are fitted on the driver on at most `MAX_ROWS` labelled rows (those of the least hash of their id), whose
statistics are first put into `BINS` quantile bins, so that a split is sought in a histogram of gradients.  All trees are
then laid out in flat arrays - feature, threshold, children, value - and a batch of rows walks all of them at once in numpy.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sparkloom.llm.common import fresh, utf8, with_fields, written

#: Labelled rows that the fit uses at most; the fit is on the driver.
MAX_ROWS = 20_000
BINS, DEPTH, TREES, RATE, RIDGE, LEAST = 64, 4, 80, 0.15, 1.0, 8
FEATURES = (
    "words", "word_bytes", "distinct", "top_word", "stutter", "upper", "digits", "symbols", "doubled", "bangs", "bars", "non_ascii", "lines_a_word",
    "repeated_lines", "short_lines", "open_lines", "ends", "commas", "capitals", "spaces", "byte_entropy", "longest_line",
)

_runs = re.compile(rb"[#*$%&]{2,}|!{2,}")
_ends = re.compile(rb"[.!?:;](?:[\"')\]]|\xe2\x80\x9d|\xc2\xbb)*(?:[\x20\x09-\x0d]|$)|\xe2\x80\xa6")


def statistics(text: bytes | None) -> list[float]:
    """FEATURES of a whole text; zeros for null and for texts without words."""
    text = text or b""
    parts = text.split()
    n, size = len(parts), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    by = sum(np.bincount(np.frombuffer(text, np.uint8, min(1 << 20, size - i), i), minlength=256) for i in range(0, size, 1 << 20))
    counted = Counter(parts)
    letters = max(1, int(by[65:91].sum() + by[97:123].sum() + by[128:].sum()))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    sizes = [len(line.split()) for line in lines]
    again, seen = 0, set()
    for line, m in zip(lines, sizes):
        again += m * (line in seen)
        seen.add(line)
    p = by[by > 0] / size
    return [
        float(np.log1p(n)), sum(map(len, parts)) / n, len(counted) / n, max(counted.values()) / n, sum(map(eq, parts, parts[1:])) / n, by[65:91].sum() / letters,
        by[48:58].sum() / size, by[[35, 42, 36, 37, 38, 60, 62]].sum() / n, len(_runs.findall(text)) / n, by[33] / n, by[124] / n, by[128:].sum() / size,
        len(lines) / n, again / n, sum(m for m in sizes if m < 4) / n, sum(m for line, m in zip(lines, sizes) if not _ends.search(line)) / n,
        (by[46] + by[33] + by[63]) / n, by[44] / n, sum(1 for w in parts if 65 <= w[0] <= 90) / n, by[32] / size, float(-(p * np.log2(p)).sum()), float(np.log1p(max(sizes))),
    ]


@dataclass
class Trees:
    """All trees in flat arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    prior: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            some = x[at : at + 4096]
            row = np.arange(len(some))[:, None]
            node = np.tile(self.roots, (len(some), 1))
            for _ in range(DEPTH):
                node = np.where(some[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[at : at + 4096] = self.prior + self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for P(y = 1).  Without rows, or with one class, no tree: the probability is (ones + 1) / (rows + 2)."""
    rate = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(rate / (1 - rate)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])] if len(y) else []
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if len(y) else x
    margin = np.full(len(y), prior)

    def leaf(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> int:
        v = -RATE * g[rows].sum() / (h[rows].sum() + RIDGE)
        margin[rows] += v
        for a, b in ((feature, 0), (threshold, np.inf), (left, len(value)), (right, len(value)), (value, v)):
            a.append(b)
        return len(value) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> int:
        best = (1e-6, -1, -1)
        gs, hs = g[rows].sum(), h[rows].sum()
        if depth < DEPTH and len(rows) >= 2 * LEAST:
            for f, e in enumerate(edges):
                b = binned[rows, f]
                n = len(e) + 1
                gl, hl, cl = (np.cumsum(np.bincount(b, weights=w, minlength=n))[:-1] for w in (g[rows], h[rows], None))
                gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                gain[(cl < LEAST) | (len(rows) - cl < LEAST)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
        _, f, cut = best
        if f < 0:
            return leaf(rows, g, h)
        node = len(value)
        for a, b in ((feature, f), (threshold, edges[f][cut]), (left, 0), (right, 0), (value, 0.0)):
            a.append(b)
        low = binned[rows, f] <= cut
        left[node], right[node] = grow(rows[low], g, h, depth + 1), grow(rows[~low], g, h, depth + 1)
        return node

    if len(y) and 0 < y.sum() < len(y):
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0))
    int_ = lambda a: np.array(a, np.int64)
    return Trees(int_(feature), np.array(threshold, float), int_(left), int_(right), np.array(value, float), int_(roots), prior)


def fold(id_col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo `folds`; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def learn(docs: DataFrame, labels: DataFrame, *, folds: int = 5, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Trees fitted on the labelled rows whose crc32(id as text) mod `folds` is not 0: the `max_rows` labels of the least
    hash of their id, and as many rows with them.  Null ids and labels are left out; several labels of an id all count."""
    taken = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(fold("_id", folds) > 0)
    taken = written(taken.orderBy(F.xxhash64("_id"), "_id", "y").limit(max_rows), "quality-labels")
    rows = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("text")).join(F.broadcast(taken), "_id")  # max_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["id", "y", "x"])

    found = rows.select(F.xxhash64("_id").alias("id"), "y", "text").mapInArrow(run, "id long, y int, x array<double>").orderBy("id", "y", "x").limit(max_rows).select("y", "x").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, found.column("y").to_numpy().astype(float))


def score(docs: DataFrame, trees: Trees, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with the probability of label 1 of each whole text.  Null and empty texts have statistics of zero and are
    scored as such; all rows and columns come back, an old score replaced."""
    held = fresh(docs, "_utf8")
    rest = docs.withColumn(held, F.col(text_col).cast("string").cast("binary")).drop(score_col)
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.columns[-1]], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sent.value.probability(x))], [*batch.schema.names[:-1], score_col])

    return rest.mapInArrow(run, with_fields(rest.drop(held), (score_col, DoubleType())))


def quality_scores(docs: DataFrame, labels: DataFrame, *, folds: int = 5, threshold: float = 0.3, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`: `learn`, then `score`.  held_out: the id's remainder is
    0; a null id is not held out.  Repeated rows come back repeated; other columns are not read."""
    trees = learn(docs, labels, folds=folds, max_rows=max_rows, id_col=id_col, text_col=text_col, label_col=label_col)
    out = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), trees).drop("text")
    return out.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
