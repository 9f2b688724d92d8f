"""Language-model scores by deleted interpolation.

P(w | v) = l2(v) c(v w) / c(v) + l1(v) c(w) / N + l0(v) / (V + 1): maximum-likelihood bigrams and unigrams and an even
share, mixed by weights that depend on the bucket of the context's frequency c(v).  The weights are learned by
expectation-maximisation on held-out counts: part of the training documents is set apart, the counts of the others predict
its tokens, and those predictions, summed by bucket over the whole part, are what the steps go over.

Counts cover all training documents.  Texts become blocks of at most `BLOCK` tokens, each with its words' 64-bit hashes.
A block sends the sorted hashes of its distinct words and bigrams, with their counts, once to the buckets of the hash
space; a bucket adds up what it gets and answers each block in the same order.  So what is dealt out are sums over a block,
never a frequent word's occurrences, and blocks and buckets have bounded size.  A block asks only the buckets that hold
some of its hashes, so requests are never more rows than the blocks' distinct words and bigrams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import LOWER, utf8, words, written

BLOCK, PER_BUCKET = 1 << 20, 1 << 20
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
LEVELS, STEPS, GRID = 24, 60, 4
#: Training documents with this remainder are set apart for the weights.
FOLDS, HELD_OUT, APART = 7, 2, 3


def mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A bigram's 64-bit hash."""
    x = (context * np.uint64(0x9E3779B97F4A7C15)) ^ (word + np.uint64(0xD6E8FEB86659FD93))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def small(counts: np.ndarray) -> bytes:
    """Counts in a byte each, larger ones behind."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def large(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


class Block:
    """Pieces of documents as one stream of predicted tokens, and the context of each piece's first token."""

    def __init__(self, vocabulary: bytes, tokens: bytes, first: bytes, sizes: bytes) -> None:
        self.vocabulary = np.frombuffer(vocabulary, "<u8")
        self.tokens = np.frombuffer(zstandard.decompress(tokens), "<u4").astype(np.int64)
        self.sizes = np.frombuffer(sizes, "<i8")
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.contexts = np.empty(len(self.tokens), np.int64)
        self.contexts[1:] = self.tokens[:-1]
        has = self.sizes > 0
        self.contexts[self.starts[has]] = np.frombuffer(first, "<u4")[has]

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct hashes, the place of each token's bigram among them)."""
        return np.unique(mixed(self.vocabulary[self.contexts], self.vocabulary[self.tokens]), return_inverse=True)

    def piece(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


BLOCKS = "block long, kind int, n_tokens long, vocabulary binary, tokens binary, first binary, sizes binary, rows array<long>, doc_ids array<long>"


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of one kind of documents each: 0 counted, 1 set apart (counted in the end), 2 held out."""
    fold = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(-1))
    kind = F.when(fold == HELD_OUT, 2).when(fold == APART, 1).otherwise(0)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), kind.alias("kind"), utf8(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, row = TaskContext.get().partitionId(), 0, -1
        open_: dict[int, list] = {}
        held: dict[int, int] = {}

        def close(kind: int) -> pa.RecordBatch:
            nonlocal made
            streams, first, sizes, row_ids, doc_ids = open_.pop(kind)
            stream, first = np.concatenate(streams), np.array(first, np.uint64)
            vocabulary, place = np.unique(np.concatenate([stream, first]), return_inverse=True)
            place = place.astype("<u4")
            made += 1
            packed = zstandard.compress(place[: len(stream)].tobytes(), 1)
            values = [(part << 32) + made, kind, len(stream), vocabulary.astype("<u8").tobytes(), packed, place[len(stream) :].tobytes(), np.array(sizes, "<i8").tobytes(), row_ids, doc_ids]
            types = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4, *[pa.list_(pa.int64())] * 2]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["block", "kind", "n_tokens", "vocabulary", "tokens", "first", "sizes", "rows", "doc_ids"])

        for batch in batches:
            for doc_id, kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                row += 1
                hash_ = xxhash.xxh64_intdigest
                stream = np.array([*map(hash_, words((text.as_py() or b"").translate(LOWER))), int(END)], np.uint64)
                for at in range(0, len(stream), BLOCK):
                    b = open_.setdefault(kind, [[], [], [], [], []])
                    size = len(stream[at : at + BLOCK])
                    for values, value in zip(b, (stream[at : at + BLOCK], stream[at - 1] if at else START, size, (part << 40) + row, doc_id)):
                        values.append(value)
                    held[kind] = held.get(kind, 0) + size
                    if held[kind] >= BLOCK:
                        held[kind] = 0
                        yield close(kind)
        for kind in sorted(open_):
            yield close(kind)

    return rows.mapInArrow(run, BLOCKS)


def slices(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of the buckets that hold some of the sorted hashes."""
    own = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
    return zip(own[starts].astype(np.int64).tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)])


REQUEST = "order int, bucket int, block long, kind int, hashes binary, counts binary"


def requests(made: DataFrame, buckets: int) -> DataFrame:
    """What each block asks of each bucket, and its counts there; order 1: words, 2: bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["order", "bucket", "block", "kind", "hashes", "counts"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time: a batch may hold many
                id_, kind, *held = (c[i].as_py() for c in batch.columns)
                block = Block(*held)
                n = np.bincount(block.tokens, minlength=len(block.vocabulary))
                # a document's start is a context as often as documents begin
                begun = int((block.vocabulary[block.contexts[block.starts]] == START).sum())
                n[block.vocabulary == START] = begun
                pairs, place = block.bigrams()
                for order, hashes, counts in ((1, block.vocabulary, n), (2, pairs, np.bincount(place, minlength=len(pairs)))):
                    out = [(order, own, id_, kind, hashes[x:y].astype("<u8").tobytes(), small(counts[x:y]) if kind < 2 else b"") for own, x, y in slices(hashes, buckets)]
                    for at in range(0, len(out), 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 4096]), types)], names)

    return made.select("block", "kind", "vocabulary", "tokens", "first", "sizes").mapInArrow(run, REQUEST)


ANSWER = "order int, bucket int, block long, kind int, n long, counted binary, counted_apart binary, tokens long, types long, tokens_apart long"


def answers(asked: DataFrame) -> DataFrame:
    """Each request's counts over all training documents and, for blocks set apart, over the others alone; once a bucket
    its numbers of tokens and types."""

    def run(group: pa.Table) -> pa.Table:
        order = group.column("order")[0].as_py()
        kinds = group.column("kind").to_numpy()
        parts = [np.frombuffer(x.as_py(), "<u8") for x in group.column("hashes")]
        counts = [large(x.as_py(), len(h)) if k < 2 else np.zeros(len(h), np.int64) for x, h, k in zip(group.column("counts"), parts, kinds)]
        apart = [c if k == 0 else np.zeros(len(c), np.int64) for c, k in zip(counts, kinds)]
        keys, place = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)
        rest = np.bincount(place, weights=np.concatenate(apart), minlength=len(keys)).astype(np.int64)
        edges = np.cumsum([0, *map(len, parts)])
        every = [small(total[place[x:y]]) for x, y in zip(edges[:-1], edges[1:])]
        some = [small(rest[place[x:y]]) if k == 1 else None for x, y, k in zip(edges[:-1], edges[1:], kinds)]
        token = (keys != START) & (order == 1)
        sums = [[int(x), *[0] * (len(parts) - 1)] for x in (total[token].sum(), (total[token] > 0).sum(), rest[token].sum())]
        columns = [group.column(c) for c in ("order", "bucket", "block", "kind")]
        return pa.table([*columns, pa.array(np.diff(edges)), pa.array(every, pa.binary()), pa.array(some, pa.binary()), *map(pa.array, sums)], names=["order", "bucket", "block", "kind", "n", "counted", "counted_apart", "tokens", "types", "tokens_apart"])

    return asked.groupBy("order", "bucket").applyInArrow(run, ANSWER)


def gathered(right: pa.Table, order: int, column: str) -> np.ndarray:
    """A block's answers of one order, put together in the order of its hashes."""
    rows = sorted((r for r in right.select(["order", "bucket", "n", column]).to_pylist() if r["order"] == order), key=lambda r: r["bucket"])
    return np.concatenate([large(r[column], r["n"]) for r in rows]) if rows else np.empty(0, np.int64)


def parts_of(left: pa.Table, right: pa.Table, column: str) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    """(block, count of each token, of its context, of its bigram)."""
    row = left.to_pylist()[0]
    block = Block(row["vocabulary"], row["tokens"], row["first"], row["sizes"])
    one, two = gathered(right, 1, column), gathered(right, 2, column)
    return block, one[block.tokens], one[block.contexts], two[block.bigrams()[1]]


def level(contexts: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency: 0 for none, then by powers of two."""
    return np.minimum(LEVELS - 1, np.ceil(np.log2(contexts + 1)).astype(np.int64))


def learned(rows: list[tuple[int, int, int, int]], types: int) -> np.ndarray:
    """(LEVELS, 3) weights of even share, unigram and bigram.  rows: (level, unigram's and bigram's step on the grid of
    1 / GRID octaves, tokens); a step of -1 is a probability of 0.  Levels without tokens take the weights of all."""
    data = np.array(rows, np.float64).reshape(-1, 4)

    def fit(some: np.ndarray, bigrams: bool) -> np.ndarray:
        p = np.stack([np.full(len(some), 1 / (types + 1)), *(np.where(some[:, i] < 0, 0, 2.0 ** (-some[:, i] / GRID)) for i in (1, 2))], axis=1)
        w = np.array([0.2, 0.4, 0.4 * bigrams])
        w /= w.sum()
        for _ in range(STEPS):
            mix = p * w
            share = mix / np.maximum(mix.sum(axis=1, keepdims=True), 1e-300)
            n = (share * some[:, 3:]).sum(axis=0) + np.array([1.0, 1.0, 1.0 * bigrams])  # no weight vanishes
            w = n / n.sum()
        return w

    out = np.tile(fit(data, True), (LEVELS, 1))
    for b in range(LEVELS):
        some = data[data[:, 0] == b]
        if len(some) or b == 0:
            out[b] = fit(some, b > 0)
    return out


def scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each whole text.

    Tokens: the words of the text, A-Z lower-cased, and one end.  Documents with crc32(id as text) mod 7 = 2 are held out,
    all others train; a null id trains.  n_known: tokens that occur in training; base_score: the add-one unigram sum of
    log10; score: log10 of the model's probability.  Null and empty texts are the end alone; repeated rows come back
    repeated and count again; an empty table gives no rows.  With nothing to
    train on only the even share is left.
    """
    made = written(blocks(docs, id_col, text_col), "lm-blocks")
    count, tokens = (x or 0 for x in made.agg(F.count("*"), F.sum("n_tokens")).first())
    buckets = max(1, -(-tokens // PER_BUCKET))
    # as many partitions as buckets or blocks, so that what a task reads does not grow with the input
    answered = written(answers(requests(made, buckets).repartition(2 * buckets, "order", "bucket")), "lm-answers")
    by_block = lambda df: df.repartition(max(1, count), "block").groupBy("block")
    n, types, n_apart = (x or 0 for x in answered.agg(F.sum("tokens"), F.sum("types"), F.sum("tokens_apart")).first())

    def predicted(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["level", "one", "two", "n"]
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())], names=names)
        _, c1, cv, c2 = parts_of(left, right, "counted_apart")
        step = lambda p: np.where(p > 0, np.round(-GRID * np.log2(np.maximum(p, 1e-300))), -1).astype(np.int64)
        one, two = step(c1 / max(1, n_apart)), step(c2 / np.maximum(1, cv))
        key, count = np.unique((level(cv) << 40) | ((one + 1) << 20) | (two + 1), return_counts=True)
        return pa.table([pa.array((key >> 40).astype(np.int32)), pa.array((((key >> 20) & 0xFFFFF) - 1).astype(np.int32)), pa.array(((key & 0xFFFFF) - 1).astype(np.int32)), pa.array(count)], names=names)

    apart = by_block(made.where("kind = 1")).cogroup(by_block(answered.where("kind = 1")))
    seen = apart.applyInArrow(predicted, "level int, one int, two int, n long").groupBy("level", "one", "two").agg(F.sum("n").alias("n"))
    weights = learned([tuple(r) for r in seen.orderBy("level", "one", "two").collect()], types)  # at most the cells of the grid

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        block, c1, cv, c2 = parts_of(left, right, "counted")
        w = weights[level(cv)]
        p = w[:, 0] / (types + 1) + w[:, 1] * c1 / max(1, n) + w[:, 2] * c2 / np.maximum(1, cv)
        piece, row = block.piece(), left.to_pylist()[0]
        add = lambda v: pa.array(np.bincount(piece, weights=v, minlength=len(block.sizes)))
        base = np.log10((c1 + 1) / (n + types + 1))
        held = pa.array(np.full(len(block.sizes), row["kind"] == 2))
        known = pa.array(np.bincount(piece, weights=c1 > 0, minlength=len(block.sizes)).astype(np.int64))
        return pa.table([pa.array(row["rows"], pa.int64()), pa.array(row["doc_ids"], pa.int64()), held, pa.array(block.sizes), known, add(base), add(np.log10(p))], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    sums = by_block(made).cogroup(by_block(answered)).applyInArrow(scored, schema)
    sums = sums.groupBy("row", "doc_id", "held_out").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
