"""Best-fit packing with certified bin counts.

Documents become pieces of at most `capacity` tokens.  Pieces are dealt over partitions at random and packed best-fit
decreasing.  For each partition the largest of the lower bounds that dual feasible functions give certifies its number of
bins; it is taken before rounding up, as a part of a bin that one partition must waste can be filled from another.
Partitions with a gap between the two exchange documents: those of their bins that are not full are pooled over all such
partitions, dealt anew, and packed again, until no gap is left, an exchange wins too little or a single pool has been packed.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm.bpe import byte_symbols
from sparkloom.llm.common import written

CAPACITY, END = 1024, 2
#: Pieces that one partition packs.
PIECES = 40_000
#: Fixed value: the pre-tokenizer's pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBPE:
    """The ids of a tokenizer file as the tokenizers library gives them, by the faster tiktoken where it can."""

    def __init__(self, text: str) -> None:
        self.text = text
        spec = json.loads(text)
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks(spec), special_tokens=special(spec)) if plain(spec) else None
        self.exact: Tokenizer | None = None

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode(text, allowed_special="all", disallowed_special=())
            except BaseException as e:  # the pattern's stack ends at about a million equal white spaces: an error or a panic of the library
                if not isinstance(e, ValueError) and type(e).__name__ != "PanicException":
                    raise
        self.exact = self.exact or Tokenizer.from_str(self.text)
        return self.exact.encode(text, add_special_tokens=False).ids


def special(spec: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in spec["added_tokens"]}


def ranks(spec: dict) -> dict[bytes, int]:
    byte, added = {c: b for b, c in enumerate(byte_symbols())}, special(spec)
    return {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}


def plain(spec: dict) -> bool:
    """Whether a file says what tiktoken does: byte-level BPE with PATTERN, no normalizer, special tokens as they stand, and
    ids in the order of the merges.  Any other file is left to its library."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "unk_token")):
        return False
    if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        return False
    vocab, added = model["vocab"], special(spec)
    symbols = set(byte_symbols())
    if not all(set(token) <= symbols for token in vocab if token not in added):
        return False
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    single = [i for token, i in vocab.items() if len(token) == 1]
    return made == sorted(set(made)) and len(single) == 256 and (not made or made[0] > max(single)) and len(made) + len(single) + sum(t in vocab for t in added) == len(vocab)


@lru_cache(maxsize=2)
def loaded(text: str) -> ByteBPE:
    return ByteBPE(text)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of `n` ids: whole ones, the first shorter where they don't come out even."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, if asked for, ids) of each whole text and its end id.

    A null text is empty: one piece of the end id.  The driver reads the tokenizer file and sends it to the tasks.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    with open(path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(sent.value)
        for batch in batches:
            index, found, ids = [], [], []
            for row, text in enumerate(batch.column(1)):
                data = np.array([*bpe.encode(text.as_py()), end], "<u4")
                for n, (start, size) in enumerate(cuts(len(data), capacity)):
                    part = data[start : start + size]
                    index.append(row)
                    found.append((n, start, size, zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids.append(part.astype(np.int64))
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))] if found else []
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), *columns, *([pa.array(ids, pa.list_(pa.int64()))] if with_ids else [])], names)

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, best-fit decreasing; the open bins are kept by what is free in them."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, count = 0, 0  # a bit for each amount that is free in a bin
    order = np.argsort(-sizes, kind="stable")
    for at, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = some >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
        else:
            room, b = capacity, count
            count += 1
        bins[at], offsets[at] = b, capacity - room
        if left := room - size:
            free[left].append(b)
            some |= 1 << left
    return bins, offsets


def bound(sizes: np.ndarray, capacity: int) -> Fraction:
    """The largest bound of dual feasible functions before rounding up: no packing has fewer bins."""
    if not len(sizes):
        return Fraction(0)
    n = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1)
    best = Fraction(int((n * x).sum()), capacity)
    count, total = np.cumsum(n), np.cumsum(n * x)
    t = np.arange(1, capacity // 2 + 1)  # sizes under t count nothing, sizes over capacity - t a whole bin
    whole = count[-1] - count[capacity - t]
    best = max(best, Fraction(int((whole * capacity + total[capacity - t] - total[t - 1]).max()), capacity))
    for k in range(1, 33):  # rounds to k-ths of a bin, but for sizes that come out even
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, Fraction(int((n * value).sum()), k * capacity))
    return best


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    return math.ceil(bound(sizes, capacity))


def packed(part: DataFrame, round_: int, capacity: int) -> DataFrame:
    """Each group `part` packed: sequence_id, offset, free (in its bin), bins and bound (of its partition)."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema), "sequence_id long, offset long, free long, bins long, bound double"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["length"].to_numpy(np.int64)
        order = np.lexsort([rows["ids_crc32"].to_numpy(), rows["piece"].to_numpy(), rows["doc_id"].to_numpy()])
        rows, sizes = rows.iloc[order], sizes[order]
        bins, offsets = best_fit(sizes, capacity)
        count = int(bins.max()) + 1
        used = np.bincount(bins, weights=sizes).astype(np.int64)
        return rows.assign(sequence_id=(np.int64(round_) << 56) + (rows["part"].to_numpy(np.int64) << 24) + bins, offset=offsets, free=capacity - used[bins], bins=count, bound=float(bound(sizes, capacity)))

    return part.groupBy("part").applyInPandas(run, schema)


def pack(found: DataFrame, *, capacity: int = CAPACITY, per_partition: int = PIECES, least_gain: float = 0.001) -> DataFrame:
    """`found` (doc_id, piece, length, ids_crc32 and more) with sequence_id and offset: sequences of at most `capacity`
    tokens, filled from 0 without gaps.

    Pieces are dealt at random over enough partitions that none gets many more than `per_partition`, in every round.  The
    exchange ends when no partition has a gap or a round wins less than `least_gain` of the open bins.  Every row is placed,
    repeated ones as rows of their own.  No rows give no rows; old columns called sequence_id or
    offset are replaced, and part, free, bins and bound left out.
    """
    names = [c for c in found.columns if c.lower() not in ("part", "sequence_id", "offset", "free", "bins", "bound")]
    rest, done = written(found.select(*names), "pieces"), None
    count, open_, bins = rest.count(), None, 0
    for round_ in range(100):
        parts = max(1, -(-count // per_partition))
        # the row's place in the written table deals repeated rows apart
        seeded = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(round_)), F.lit(parts)).cast("int")
        now = written(packed(rest.select(*names, seeded.alias("part")), round_, capacity), "packed")
        made = now.groupBy("part").agg(F.max("bins").alias("n")).agg(F.sum("n")).first()[0] or 0
        if open_ is not None and made >= bins:  # the exchange has won nothing: the bins stay as they were
            return done.unionByName(open_)
        gap = (F.col("bins") > F.col("bound") + 1e-9) & (F.col("free") > 0) & F.lit(parts > 1 and (open_ is None or bins - made > least_gain * bins))
        final = now.where(~gap).select(*names, "sequence_id", "offset")
        done = final if done is None else done.unionByName(final)
        rest = open_ = now.where(gap).select(*names, "sequence_id", "offset")
        count, bins = open_.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        if not count:
            return done
    return done.unionByName(open_)
