"""Shards of near equal size by histogram sort.

Rows are ordered by the hash of their text and then by id, so copies lie side by side.  Each round counts, over all
partitions, the exact bytes below candidate boundaries: the first round those of `FIRST_BITS` leading bits of the hash,
each further round `MORE_BITS` more bits inside the few buckets in which a splitter still lies, and inside one text's
copies the same on the ids.  A splitter is settled when a boundary meets the tolerance, or where a single key is left.
Then every row is exchanged once, to its shard.

Native: DataFrame functions only.  The driver sees at most 2^FIRST_BITS + shards * 2^MORE_BITS counts a round.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sparkloom.llm.common import fresh, named, written

FIRST_BITS, MORE_BITS = 12, 8
LOW = -(2**63)


@dataclass
class Splitter:
    """The boundary before which `target` bytes should lie, sought between `low` and the end of its bucket."""

    target: int
    below: int = 0  # bytes in front of the bucket
    prefix: int = 0  # of the key, as an unsigned number of `bits` bits: 64 of the hash, then 64 of the id
    bits: int = 0
    cut: tuple[int, int] | None = None  # the settled key: rows at or behind it go on


def signed(x: int) -> int:
    """An unsigned 64-bit place in the order of signed numbers."""
    return x + LOW


def boundary(prefix: int, bits: int) -> tuple[int, int]:
    """The least key whose leading bits are `prefix`; behind the last one, a key above all."""
    if prefix >> bits:
        return (2**63 - 1, 2**63)
    whole = prefix << (128 - bits)
    return signed(whole >> 64), signed(whole & (2**64 - 1))


def top(column: Column, bits: int) -> Column:
    """The leading bits of a signed number's place in the order."""
    return F.shiftrightunsigned(column.bitwiseXOR(F.lit(LOW).cast("long")), 64 - bits)


def counts(keys: DataFrame, where: Column, bucket: Column) -> list[tuple[int, int, int, int]]:
    """(bucket, bytes, least key, greatest key) in order, of the rows in `where`; keys as unsigned 128-bit places."""
    ends = (f(F.struct("h", "i")).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi")))
    rows = keys.where(where).groupBy(bucket.alias("b")).agg(F.sum("size").alias("s"), *ends).collect()
    place = lambda k: (k.h - LOW) << 64 | (k.i - LOW)
    return sorted((r.b & (2**64 - 1), r.s, place(r.lo), place(r.hi)) for r in rows)


def refine(keys: DataFrame, open_: list[Splitter], slack: int) -> None:
    """One round for splitters of equal `bits`: counts inside their buckets, and settles or narrows each."""
    bits, prefixes = open_[0].bits, sorted({s.prefix for s in open_})
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    if bits < 64:
        more = min(MORE_BITS if bits else FIRST_BITS, 64 - bits)
        where = reduce(or_, (top(F.col("h"), bits) == F.lit(p) for p in prefixes)) if bits else F.lit(True)
        for x in counts(keys, where, top(F.col("h"), bits + more)):
            rows.setdefault(x[0] >> more, []).append(x)
    else:
        depth = bits - 64
        more = min(MORE_BITS, 64 - depth)
        for p in prefixes:  # the copies of one text each
            where = F.col("h") == F.lit(signed(p >> depth))
            where = where & (top(F.col("i"), depth) == F.lit(p & ((1 << depth) - 1))) if depth else where
            rows[p] = [((p >> depth) << (depth + more) | b, *x) for b, *x in counts(keys, where, top(F.col("i"), depth + more))]
    for s in open_:
        for prefix, size, lo, hi in rows[s.prefix]:
            if s.below + size < s.target:
                s.below += size
                continue
            # the target lies in this bucket: is either of its edges near enough, or is it one key?
            near, at = min((abs(s.target - s.below), prefix), (abs(s.below + size - s.target), prefix + 1))
            s.prefix, s.bits = prefix, bits + more
            if near <= slack or lo == hi:
                s.cut = boundary(at, s.bits)
            else:  # go on where the bucket's keys begin to differ
                s.bits = max(s.bits, 128 - (lo ^ hi).bit_length())
                s.prefix = lo >> (128 - s.bits)
            break


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The keys at which shards 1, 2, ... begin.  keys: (h long, i long, size long)."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    all_ = [Splitter(total * k // shards) for k in range(1, shards)] if total else []
    while open_ := [s for s in all_ if not s.cut]:
        for bits in sorted({s.bits for s in open_}):
            refine(keys, [s for s in open_ if s.bits == bits], int(tolerance * total / shards))
    return sorted(s.cut for s in all_)


def shard_by_bytes(df: DataFrame, shards: int = 40, *, tolerance: float = 0.002, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of `df` with size (UTF-8 bytes and `overhead`; null text: `overhead`), shard (0 to shards - 1)
    and slot (gapless from 0 in each shard, in the order of 1/1024ths of the hashes).

    Sizes of shards differ from the mean by at most twice `tolerance` of it and the largest row.  Copies of a text are
    neighbours and are parted only where a splitter falls among them and no edge of theirs is within the tolerance.  Rows
    of equal id and text share one key and stay together; a null id sorts first.  An empty table gives no rows; columns
    of `df` called size, shard or slot are replaced.
    """
    dim = F.col(text_col)
    size = F.coalesce(F.octet_length(dim), F.lit(0)).cast("long") + overhead
    h, i = F.xxhash64(dim), F.coalesce(F.col(id_col).cast("long"), F.lit(LOW).cast("long"))
    keys = written(df.select(h.alias("h"), i.alias("i"), size.alias("size")), "shard-keys")
    cuts = splitters(keys, shards, tolerance)
    # the shard is the number of splitters at or before the key
    at = lambda h, i: reduce(lambda a, b: a + b, (F.when((h > c[0]) | ((h == c[0]) & (i >= c[1]) if c[1] < 2**63 else F.lit(False)), 1).otherwise(0) for c in cuts), F.lit(0))
    # within a shard, runs of 1/1024 of the hashes, each in 16 parts by id, are numbered alone and set behind one another,
    # so that a hot text is numbered by many tasks
    run = lambda h, i: top(h, 10) * 16 + F.pmod(F.xxhash64(i), F.lit(16))
    runs = keys.groupBy(at(F.col("h"), F.col("i")).alias("shard"), run(F.col("h"), F.col("i")).alias("run")).count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    hash_, id_, run_, base_, n_, size_, shard_ = (fresh(df, c) for c in ("_h", "_i", "_run", "_base", "_n", "_size", "_shard"))
    base = runs.select(F.col("shard").alias(shard_), F.col("run").alias(run_), F.coalesce(before, F.lit(0)).alias(base_))
    out = df.withColumns({hash_: h, id_: i, size_: size})
    out = out.withColumns({shard_: at(F.col(hash_), F.col(id_)), run_: run(F.col(hash_), F.col(id_))})
    order = Window.partitionBy(shard_, run_).orderBy(hash_, id_)
    out = out.withColumn(n_, F.row_number().over(order).cast("long") - 1)
    out = out.join(F.broadcast(base), [shard_, run_])  # at most 16 * (1024 + shards) rows
    names = [c for c in df.columns if c.lower() not in ("size", "shard", "slot")]
    return out.select(*named(*names), F.col(size_).alias("size"), F.col(shard_).alias("shard"), (F.col(n_) + F.col(base_)).alias("slot"))
