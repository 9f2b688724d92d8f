"""Operators against plain versions of themselves, on the driver's tables too; clashing names; numbers that stay."""

import bisect
import math
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, packing, quality_model, quality_rules, sharding, simhash
from sparkloom.llm.common import LOWER, Forest, scratch, temporary, words, written
from sparkloom.session import shared_folder

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def kept_by_brute_force(texts):
    """Of (place, text) the first place of each group of Jaccard 0.8 and more, all pairs that share a shingle compared."""
    sets = {i: frozenset(simhash.hashes(words((t or "").encode().translate(LOWER)), 5).tolist()) for i, t in texts}
    of, forest = defaultdict(list), Forest()
    for i, s in sets.items():
        for x in s or {None}:
            of[x].append(i)
    for same in of.values():
        for n, x in enumerate(same):
            for y in same[:n]:
                if forest.root(x) != forest.root(y) and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                    forest.join(x, y)
    return sorted(i for i in sets if forest.root(i) == i)


@tables
def test_near_duplicates_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert len(dict(texts)) == len(texts)
    found = sorted(r.doc_id for r in simhash.deduplicated(docs).select("doc_id").collect())
    assert found == kept_by_brute_force(texts) and len(found) < len(texts)


def test_rows_keep_their_numbers_when_files_are_cut_anew(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 9000, 30)) for _ in range(150)]
    rows = [(i, base[i % 150], i % 7) for i in range(600)]
    path = scratch(spark, "cut")
    spark.createDataFrame(rows, "doc_id long, text string, _row int").repartition(5).write.parquet(path)
    docs, real, calls = spark.read.parquet(path), simhash.near_duplicates, []

    def recut(*args, **kwargs):
        spark.conf.set("spark.sql.files.minPartitionNum", 11)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
        calls.append(1)
        return real(*args, **kwargs)

    try:
        simhash.near_duplicates = recut
        found = simhash.deduplicated(docs)
        assert found.columns == docs.columns
        spark.conf.set("spark.sql.files.minPartitionNum", 2)
        got = sorted(tuple(r) for r in found.collect())
    finally:
        simhash.near_duplicates = real
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert calls and got == sorted(r for r in rows if r[0] < 150)


def test_hot_bands_are_chained_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 100)
    rows = spark.range(3000).select(F.floor(F.col("id") % 3 / 2).alias("key"), F.col("id").alias("b")).unionByName(spark.range(2).select(F.lit(7).cast("long").alias("key"), (F.col("id") * 2).alias("b")))
    forest = Forest()
    found = simhash.chained(rows.withColumn("key", F.col("key").cast("long"))).collect()
    for r in found:
        forest.join(r.a, r.b)
    assert len(found) < 3300 and len({forest.root(x) for x in range(3000)}) == 1


def test_names_that_the_operators_use(spark):
    text = "These are the words of a text that is long enough and that the rules of quality let pass at once. It ends here."
    taken = ["_utf8", "_text", "_row", "_h", "_i", "_run", "_n", "_base", "_size", "_shard", "_SCORE", "a b-c", "ids_"]
    quoted = ", ".join(f"`{c}` string" for c in taken)
    docs = written(spark.createDataFrame([(i, text, *taken) for i in range(3)], f"doc_id long, text string, {quoted}"), "names")
    for made, new in (
        (quality_rules.clean_lines(docs), list(quality_rules.FIELDS)), (quality_model.score(docs, quality_model.fit(np.zeros((0, 22)), np.zeros(0))), ["score"]),
        (bpe.encode_texts(docs, P.path("word_bpe_49k.json")), ["ids", "decoded"]), (sharding.shard_by_bytes(docs, 4), ["size", "shard", "slot"]), (simhash.deduplicated(docs), []),
    ):
        assert made.columns == [*docs.columns, *new]
        rows = made.collect()
        assert rows and all([r[c] for c in taken] == taken and r.text == text for r in rows)


def plain_statistics(text):
    """The features by their names, one at a time."""
    parts = text.split()
    n, size = len(parts), len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    count = lambda chars: sum(text.count(bytes([c])) for c in chars)
    share = [text.count(bytes([b])) / size for b in range(256)]
    letters = max(1, count(range(65, 91)) + count(range(97, 123)) + count(range(128, 256)))
    runs = len(quality_model._runs.findall(text))
    return {
        "words": math.log1p(n), "word_bytes": sum(map(len, parts)) / n, "distinct": len({*parts}) / n, "top_word": max(parts.count(w) for w in {*parts}) / n,
        "stutter": sum(parts[i] == parts[i + 1] for i in range(n - 1)) / n, "upper": count(range(65, 91)) / letters, "digits": count(range(48, 58)) / size,
        "symbols": count(b"#*$%&<>") / n, "doubled": runs / n, "bangs": count(b"!") / n, "bars": count(b"|") / n, "non_ascii": count(range(128, 256)) / size,
        "lines_a_word": len(lines) / n, "repeated_lines": sum(len(x.split()) for i, x in enumerate(lines) if x in lines[:i]) / n,
        "short_lines": sum(len(x.split()) for x in lines if len(x.split()) < 4) / n, "open_lines": sum(len(x.split()) for x in lines if not quality_model._ends.search(x)) / n,
        "ends": count(b".!?") / n, "commas": count(b",") / n, "capitals": sum(w[:1].isupper() and w[0] < 128 for w in parts) / n, "spaces": count(b" ") / size,
        "byte_entropy": -sum(p * math.log2(p) for p in share if p), "longest_line": math.log1p(max(len(x.split()) for x in lines)),
    }


def test_statistics_one_by_one():
    for text in ("The cat, the cat sat. ÉA 12!! ##\n\nno end | here\nno end | here\n\tEnd.", "a", "x " * 50 + "Ünd … %$ 3", "One line.\nOne line.\nOne line."):
        found = quality_model.statistics(text.encode())
        assert dict(zip(quality_model.FEATURES, found)) == pytest.approx(plain_statistics(text.encode()))
    assert quality_model.statistics(None) == quality_model.statistics(b" \n") == [0.0] * len(quality_model.FEATURES)


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(12)
    x = np.round(rng.random((200, 4)), 2)
    y = (x[:, 2] + 0.3 * rng.random(200) > 0.6).astype(float)
    trees = quality_model.fit(x, y)
    p = (y.sum() + 1) / 202
    g, h = p - y, np.full(200, p * (1 - p))
    best = {}
    for f in range(4):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality_model.BINS + 1)[1:-1])):
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) >= quality_model.LEAST:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + quality_model.RIDGE) for s in (low, ~low))
                best[f, float(cut)] = gain
    f, cut = trees.feature[trees.roots[0]], trees.threshold[trees.roots[0]]
    assert best[int(f), float(cut)] == pytest.approx(max(best.values()))


@tables
def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality_model.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    assert len(rows) > 30 and sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert not bad or sum((a > b) + 0.5 * (a == b) for a in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_splitters_against_a_sorted_list(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "hot" if i % 3 == 0 else f"t{rng.integers(10**9)}" * int(rng.integers(1, 20))) for i in range(2000)]
    found = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 7, tolerance=0.002)
    keyed = found.select(F.xxhash64("text").alias("h"), "doc_id", "size", "shard").collect()
    ordered = sorted((r.h, r.doc_id, r["size"], r.shard) for r in keyed)
    ends = np.cumsum([r[2] for r in ordered])
    total, shards = int(ends[-1]), [r[3] for r in ordered]
    assert shards == sorted(shards) and set(shards) == set(range(7))
    for k in range(1, 7):
        first = bisect.bisect_left(shards, k)
        before, nearest = int(ends[first - 1]), min(ends, key=lambda e: abs(int(e) - total * k // 7))
        assert abs(before - total * k / 7) <= abs(int(nearest) - total * k / 7) + 0.002 * total / 7 + 1


def test_packing_of_hard_sizes_stays_in_its_groups(spark, monkeypatch):
    """Sizes of a quarter to a half of a bin leave gaps that no exchange closes."""
    rng = np.random.default_rng(6)
    sizes = rng.integers(257, 512, 6000)
    found = spark.createDataFrame([(i, 0, 0, int(n), zlib.crc32(str(i).encode())) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    groups, real = [], packing.packed

    def counted(part, round_, capacity):
        groups.append(max(r["count"] for r in part.groupBy("part").count().collect()))
        return real(part, round_, capacity)

    monkeypatch.setattr(packing, "packed", counted)
    rows = packing.pack(found, per_partition=500).collect()
    assert len(rows) == 6000 and max(groups) <= 650 and len(groups) < 12
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 1024 and sorted(o for o, _ in b) == [0, *np.cumsum([n for _, n in sorted(b)])[:-1].tolist()] for b in bins.values())
    assert len(bins) <= 1.02 * (packing.best_fit(sizes, 1024)[0].max() + 1)


def test_other_tokenizer_files_go_to_their_library(tmp_path):
    from tokenizers import Tokenizer

    text = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    assert packing.ByteBPE(text).fast is not None
    other = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    own = packing.ByteBPE(other)
    assert own.fast is None and own.encode("Some words, 12.") == Tokenizer.from_str(other).encode("Some words, 12.", add_special_tokens=False).ids


def test_temporary_tables_go(spark):
    with temporary():
        a, b = written(spark.range(3), "goes"), written(spark.range(4), "stays", beyond=True)
    at = lambda df: df._llm_path.removeprefix("file://")
    assert not os.path.exists(at(a)) and os.path.exists(at(b)) and b.count() == 4


def test_no_private_folder_on_a_cluster(spark):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_phrases_of_four_languages():
    for line in ("Tous droits réservés par la maison.", "Alle Rechte vorbehalten, alle hier.", "Todos los derechos reservados aquí.", "All rights reserved by the house."):
        assert quality_rules.line_fails(line.encode(), len(line.split()))
    assert not quality_rules.line_fails("Un texte tout à fait normal, sans plus.".encode(), 8)
