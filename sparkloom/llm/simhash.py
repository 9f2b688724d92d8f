"""SimHash near-dedup by anchor-point covering.

Fingerprints (64 bits) are cut into blocks.  If two fingerprints differ in at most `threshold` bits, some block of theirs
differs in at most `threshold // blocks`.  In each block the anchors are the words of a covering code: a Hamming code
beside free bits, whose covering radius is 1.  A fingerprint's home is the anchor nearest to its block; it is replicated
to every anchor within the covering radius plus the block's threshold.  So the home of either of two linked fingerprints
holds the other one too, and comparing each anchor's homes with its replicas finds every link.

Copies have one fingerprint, which is compared once; of the links within an anchor only a spanning forest leaves the
task, so a group of near copies never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import LOWER, Forest, connected_components, fresh, named, spanning, temporary, utf8, words, written
from sparkloom.operators.graph import SALTS

SEED = 42
#: Homes of one anchor that one task compares; beyond it the anchor is dealt over several.
HOMES = 2000


def shingles(parts: list[bytes], k: int) -> list[bytes]:
    """The k-word shingles, repeats included; fewer words: the whole sequence; none: none."""
    if len(parts) <= k:
        return [b" ".join(parts)] if parts else []
    text = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[: len(parts) - k].tolist()]
    return [text[a:b] for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())]


def hashes(parts: list[bytes], k: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the shingles."""
    hash_ = xxhash.xxh64_intdigest
    return np.array([hash_(x, seed) for x in shingles(parts, k)], dtype=np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of `h`; 0 for none.  Signed."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 3, *, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, content binary): the fingerprint of each whole text, A-Z lower-cased, and 128 bits that tell its
    word sequence.  `distinct` counts a repeated shingle once.  Null and empty texts have no words and fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, contents = [], []
            for text in batch.column(1):
                parts = words((text.as_py() or b"").translate(LOWER))
                h = hashes(parts, k)
                fps.append(fingerprint(np.unique(h) if distinct else h))
                contents.append(xxhash.xxh3_128_digest(b" ".join(parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(contents, pa.binary())], ["doc_id", "fp", "content"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col)).mapInArrow(run, "doc_id long, fp long, content binary")


class AnchorCode:
    """Anchors of a block of `width` bits: a Hamming code on the lowest 2^r - 1 bits, the other bits free."""

    def __init__(self, width: int, reach: int) -> None:
        self.width, r = width, max(r for r in range(1, 7) if 2**r - 1 <= width)
        self.n = 2**r - 1
        patterns: list[list[int]] = [[] for _ in range(2**r)]
        for weight in range(reach + 1):
            for bits in combinations(range(width), weight):
                syndrome = 0
                for bit in bits:
                    syndrome ^= bit + 1 if bit < self.n else 0
                patterns[syndrome].append(sum(1 << bit for bit in bits))
        self.patterns = [np.array(x, dtype=np.uint64) for x in patterns]

    def syndrome(self, block: np.ndarray) -> np.ndarray:
        out = np.zeros(len(block), np.uint64)
        for bit in range(self.n):
            out ^= ((block >> np.uint64(bit)) & np.uint64(1)) * np.uint64(bit + 1)
        return out

    def home(self, block: np.ndarray) -> np.ndarray:
        """The nearest anchor: the bit that the syndrome names is turned."""
        s = self.syndrome(block)
        return block ^ np.where(s > 0, np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1)), np.uint64(0))

    def anchors(self, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(row numbers, their anchors within reach as a matrix, the column of the home)."""
        syndrome = self.syndrome(block)
        for s, patterns in enumerate(self.patterns):
            rows = np.flatnonzero(syndrome == s)
            home = np.uint64(1 << (s - 1) if s else 0)
            yield rows, block[rows][:, None] ^ patterns[None, :], int(np.flatnonzero(patterns == home)[0])


@lru_cache(maxsize=4)
def covering(threshold: int, blocks: int) -> list[tuple[int, AnchorCode]]:
    """(lowest bit, code) of each block."""
    width = 64 // blocks
    return [(i * width, AnchorCode(width, 1 + threshold // blocks)) for i in range(blocks)]


def hot_anchors(fps: DataFrame, threshold: int, blocks: int) -> DataFrame:
    """(anchor, parts) of the anchors that are home to over HOMES fingerprints; a row a block goes into the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (low, code) in enumerate(covering(threshold, blocks)):
                key = code.home((fp >> np.uint64(low)) & np.uint64((1 << code.width) - 1)) | np.uint64(i << 40)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64))], ["anchor"])

    homes = fps.select("fp").mapInArrow(run, "anchor long").groupBy("anchor").count().where(F.col("count") > HOMES)
    return homes.select("anchor", F.ceil(F.col("count") / HOMES).cast("int").alias("parts"))


def replicate(fps: DataFrame, threshold: int, blocks: int) -> DataFrame:
    """(fp) -> (anchor long, fp, home boolean), a row for each anchor within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                fp = batch.column(0)[at : at + (1 << 14)].to_numpy(zero_copy_only=False).view(np.uint64)
                for i, (low, code) in enumerate(covering(threshold, blocks)):
                    block = (fp >> np.uint64(low)) & np.uint64((1 << code.width) - 1)
                    for rows, anchors, home in code.anchors(block):
                        if len(rows):
                            key = (anchors | np.uint64(i << 40)).astype(np.int64)
                            is_home = np.zeros(key.shape, bool)
                            is_home[:, home] = True
                            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(fp[rows].view(np.int64), key.shape[1])), pa.array(is_home.ravel())], ["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def compared(key: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of whole anchors, sorted by key; a spanning forest of each large anchor."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    homes = np.add.reduceat(home.astype(np.int64), starts)
    a, b = [], []
    small = (sizes > 1) & (homes > 0) & (sizes * homes <= 4096)
    if small.any():
        group = np.repeat(np.arange(len(starts)), sizes)
        rows = np.flatnonzero(home & small[group])
        for at in range(0, len(rows), 4096):
            some = rows[at : at + 4096]
            n = sizes[group[some]]
            left = np.repeat(some, n)
            right = np.repeat(starts[group[some]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            hit = (left != right) & (np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= threshold)
            a.append(fp[left[hit]])
            b.append(fp[right[hit]])
    for g in np.flatnonzero((sizes > 1) & (homes > 0) & ~small):
        every = fp[starts[g] : starts[g] + sizes[g]]
        for x in every[home[starts[g] : starts[g] + sizes[g]]]:
            near = every[(np.bitwise_count((every ^ x).view(np.uint64)) <= threshold) & (every != x)]
            a.append(np.full(len(near), x))
            b.append(near)
            if sum(map(len, a)) > 1 << 18:
                a, b = ([x] for x in spanning(np.concatenate(a), np.concatenate(b)))
    return spanning(np.concatenate(a), np.concatenate(b)) if a else (key[:0], key[:0])


def links(fps: DataFrame, threshold: int = 3, blocks: int = 2) -> DataFrame:
    """(fp long, distinct) -> (a, b): pairs that differ in at most `threshold` bits, enough of them to connect all that
    such pairs connect."""
    every = replicate(fps, threshold, blocks)
    hot = hot_anchors(fps, threshold, blocks)
    part = F.when(F.col("home"), F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))).otherwise(F.array(F.lit(-1)))
    dealt = every.join(hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", part.getItem(0))
    dealt = dealt.select("anchor", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = dealt.select("anchor", "part", "fp", (F.col("own") == F.col("part")).alias("home"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] = tuple(np.empty(0, x) for x in (np.int64, np.int64, bool))

        def out(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            a, b = compared(*rows, threshold)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            anchor, part, fp, home = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            rows = (anchor | (part.astype(np.int64) << 43), fp, home)
            rest = tuple(np.concatenate(x) for x in zip(rest, rows))
            other = np.flatnonzero(rest[0] != rest[0][-1]) if len(rest[0]) else ()
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield out(tuple(x[:cut] for x in rest))
                rest = tuple(x[cut:] for x in rest)
        if len(rest[0]):
            yield out(rest)

    return dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, k: int = 3, threshold: int = 3, blocks: int = 2, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id): the group of each row under links of at most `threshold` differing bits, named by
    the smallest id in it.

    Repeated rows come back repeated; a null id is no candidate for a name; an empty table gives no rows; other columns
    are not read."""
    fps = written(fingerprints(docs, k, id_col=id_col, text_col=text_col).select("doc_id", "fp"), "simhash")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = connected_components(links(nodes, threshold, blocks))
    rooted = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: What `near_duplicates` takes: BANDS bands of BAND_ROWS least hashes (MinHash) over the very shingles that are compared.  Two
#: texts of Jaccard j share a band with probability 1 - (1 - j^5)^40 wherever they differ: at 0.8 one pair in 7.8 million
#: is missed, at 0.85 one in 1.6 billion.
BANDS, BAND_ROWS = 40, 5
_rng = np.random.default_rng(SEED)
_FLIP, _TIMES = (_rng.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32)[:, None] for _ in range(2))
_TIMES |= np.uint32(1)


def bands(h: np.ndarray) -> np.ndarray | None:
    """The keys of the bands of a set of hashes; null for none."""
    if not len(h):
        return None
    low, least = h.astype(np.uint32), np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(least, ((low[at : at + 512] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    held, width = least.tobytes(), 4 * BAND_ROWS
    keys = [xxhash.xxh64_intdigest(held[i * width : (i + 1) * width], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64)


#: A band that seems to hold over HOT texts, by one text in GLIMPSE, is chained in parts.
HOT, GLIMPSE = 2000, 64


def chained(keyed: DataFrame) -> DataFrame:
    """(key, b) -> (a, b): each text and the one before it in a band, which connects the band without its pairs.  Hot bands
    are chained in SALTS parts, and then the first texts of the parts; a band not known as hot only takes one part more."""
    some = keyed.where(F.pmod(F.xxhash64("b"), F.lit(GLIMPSE)) == 0).groupBy("key").count()
    hot = written(some.where(F.col("count") * GLIMPSE > HOT).select("key", F.lit(True).alias("hot")), "near-hot")
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("b", F.lit(1)), F.lit(SALTS))).otherwise(F.lit(0))
    dealt = keyed.join(hot, "key", "left").withColumn("part", part)
    heads = dealt.where("hot").groupBy("key", "part").agg(F.min("b").alias("b"))
    before = lambda rows, *by: rows.withColumn("a", F.lag("b").over(Window.partitionBy(*by).orderBy("b"))).where("a is not null").select("a", "b")
    return before(dealt, "key", "part").unionByName(before(heads, "key"))


def fingerprint_links(texts: DataFrame, threshold: int = 3, blocks: int = 2) -> DataFrame:
    """(_row, fp) -> (a, b): rows of one fingerprint with the first of them, and the first ones of linked fingerprints."""
    nodes = written(texts.groupBy("fp").agg(F.min("_row").alias("first")), "near-fps")
    same = texts.join(nodes, "fp").where("_row <> first").select(F.col("first").alias("a"), F.col("_row").alias("b"))
    at = lambda c, n: nodes.select(F.col("fp").alias(c), F.col("first").alias(n))
    linked = links(nodes, threshold, blocks).withColumnsRenamed({"a": "x", "b": "y"})
    return same.unionByName(linked.join(at("x", "a"), "x").join(at("y", "b"), "y").select("a", "b"))


#: Texts of one group that a task holds on either side when it compares them.
CELL = 256


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, threshold: int = 3, blocks: int = 2, *, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, _keeper) for each row of `docs` that a row kept instead stands for.  Rows go by `row_col`, distinct longs that
    the table holds: numbers made anew for each reading would change with the number of cores at that moment.

    Two texts are near copies if the Jaccard similarity of their sets of `k`-word shingles (A-Z lower-cased; fewer words:
    the whole sequence) is `similarity` or more; groups are the connected components, and the row of the smallest id stays
    (null ids last, repeated rows by place).  Candidates are the components under the links of SimHash (fingerprints of the
    same shingles, at most `threshold` differing bits); near copies whose fingerprints lie further apart are reached by a
    shared band, the exact way for the rest.  Inside each component all pairs of different texts not yet connected are
    compared exactly, in cells of bounded size where a component is large.
    Null and empty texts are copies of one another.
    """
    numbered = docs.select(F.col(row_col).alias("_row"), F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    kind = numbered.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                parts = [words((text.as_py() or b"").translate(LOWER)) for text in some.column(2)]
                contents = [xxhash.xxh3_128_digest(b" ".join(p)) for p in parts]
                grams = [hashes(p, k) for p in parts]
                fps = pa.array([fingerprint(h) for h in grams], pa.int64())
                keys = pa.array([bands(h) for h in grams], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(contents, pa.binary()), fps, keys], ["_row", "doc_id", "content", "fp", "bands"])

    rows = written(numbered.mapInArrow(read, f"_row long, doc_id {kind}, content binary, fp long, bands array<long>"), "near-rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    texts = written(rows.groupBy("content").agg(F.min(first).alias("first")).withColumn("node", F.col("first._row")), "near-texts")
    own = rows.join(texts.select(F.col("node").alias("_row")), "_row", "left_semi")
    keyed = own.select(F.col("_row").alias("b"), F.explode("bands").alias("key"))
    met = chained(keyed).unionByName(fingerprint_links(own.select("_row", "fp"), threshold, blocks))
    candidates = connected_components(met)
    sizes = candidates.groupBy("root").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    members = written(candidates.join(sizes, "root").select(F.col("node").alias("_row"), "root", "cells"), "near-members")
    verified = _verified(numbered.select("_row", "text").join(members, "_row"), k, similarity)
    groups = connected_components(verified).withColumnRenamed("root", "group")
    kept = texts.join(groups, "node", "left").groupBy(F.coalesce("group", "node").alias("group")).agg(F.min("first").alias("first"))
    keepers = written(kept.select("group", F.col("first._row").alias("_keeper")), "near-kept")
    owner = texts.join(groups, "node", "left").select("content", F.coalesce("group", "node").alias("group")).join(keepers, "group").select("content", "_keeper")
    return rows.select("_row", "content").join(owner, "content").where("_row <> _keeper").select("_row", "_keeper")


def _verified(members: DataFrame, k: int, similarity: float) -> DataFrame:
    """(_row, text, root, cells) -> (a, b): pairs of one root that are near copies, a spanning forest of each cell."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sets = [np.unique(hashes(words((t.as_py() or b"").translate(LOWER)), k)).astype("<u8").tobytes() for t in some.column("text")]
                yield pa.RecordBatch.from_arrays([some.column("_row"), some.column("root"), some.column("cells"), pa.array(sets, pa.binary())], ["_row", "root", "cells", "set"])

    sets = written(members.select("_row", "root", "cells", "text").mapInArrow(shingled, "_row long, root long, cells int, set binary"), "near-sets")
    # a member of cell c goes to the pairs of cells (c, j) and (j, c), so every two members meet once at least
    sets = sets.withColumn("c", F.pmod(F.xxhash64("_row"), F.col("cells")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    sets = sets.select("root", F.least("c", "j").alias("i"), F.greatest("c", "j").alias("j"), "c", "_row", "set")

    def compare(key: tuple, group: list[tuple]) -> tuple[list[int], list[int]]:
        _, i, j = key
        rows = [r for _, r, _ in group]
        held = [frozenset(np.frombuffer(s, "<u8").tolist()) for _, _, s in group]
        size = np.array([len(h) for h in held])
        cell = np.array([c for c, _, _ in group])
        forest, a, b = Forest(), [], []
        for x in range(len(rows)):
            other = (cell[x + 1 :] != cell[x]) if i != j else np.ones(len(rows) - x - 1, bool)
            near = other & (np.minimum(size[x + 1 :], size[x]) >= similarity * np.maximum(size[x + 1 :], size[x]))
            for y in (np.flatnonzero(near) + x + 1).tolist():
                if forest.root(x) != forest.root(y):
                    both = len(held[x] & held[y])
                    if both >= similarity * (len(held[x]) + len(held[y]) - both) - 1e-9:
                        forest.join(x, y)
                        a.append(rows[x])
                        b.append(rows[y])
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        a: list[int] = []
        b: list[int] = []

        def end() -> None:
            if len(group) > 1:
                x, y = compare(key, group)
                a.extend(x)
                b.extend(y)

        for batch in batches:
            for root, i, j, c, row, held in zip(*(batch.column(n).to_pylist() for n in ("root", "i", "j", "c", "_row", "set"))):
                if (root, i, j) != key:
                    end()
                    key, group = (root, i, j), []
                group.append((c, row, held))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
        end()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # dealt by ranges, which a look at the rows evens out: hashes of the few cells of a large group would meet in some tasks
    return sets.repartitionByRange("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "a long, b long")


def deduplicated(docs: DataFrame, k: int = 5, similarity: float = 0.8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of `near_duplicates`; all columns.

    The rows are numbered once, in a stored copy that every later step reads."""
    row = fresh(docs, "_row")
    held = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-docs")
    with temporary():
        gone = written(near_duplicates(held, k, similarity, row_col=row, id_col=id_col, text_col=text_col).select(F.col("_row").alias(row)), "near-gone", beyond=True)
    return held.join(gone, row, "left_anti").select(named(*docs.columns))
