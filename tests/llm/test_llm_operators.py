"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, and against
brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from sparkloom.llm import ann, bpe, lm, packing, quality_model, quality_rules, sharding, simhash, urlfilter, warc
from sparkloom.llm.common import LOWER, Forest, connected_components, scratch, words

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer

LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(30_000)) + "."
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."), (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (3, "the QUICK brown fox jumps over the lazy dog near the river bank today."), (4, None), (5, ""), (6, " \t\n "), (7, "Über-straße <|endoftext|> naïve ΣΑΣ don't 3.14\x1c!"),
    (8, "a"), (9, LONG), (9, LONG), (None, "An identifier is missing here."), (11, "x\ny\nx\n\ny | z | w | v"), (12, "!!!! ####"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i}", 0.5, 3, 9, True) for i, t in TEXTS]
    # names that the operators use themselves, besides those of documents
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, size int, piece int, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def fp_of(text, k=3):
    parts = (text or "").encode().translate(LOWER).split()
    grams = [b" ".join(parts[i : i + k]) for i in range(len(parts) - k + 1)] if len(parts) >= k else [b" ".join(parts)] if parts else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_groups(docs, empty):
    found = simhash.simhash_groups(docs).collect()
    assert len(found) == len(TEXTS)
    fps = [(i, fp_of(t)) for i, t in TEXTS]
    assert Counter((r.doc_id, r.fp & (2**64 - 1)) for r in found) == Counter(fps)
    forest = Forest()
    for n, (_, x) in enumerate(fps):
        for m, (_, y) in enumerate(fps[:n]):
            if (x ^ y).bit_count() <= 3:
                forest.join(n, m)
    least = defaultdict(lambda: 10**9)
    for n, (i, _) in enumerate(fps):
        least[forest.root(n)] = min(least[forest.root(n)], 10**9 if i is None else i)
    expected = Counter((i, least[forest.root(n)]) for n, (i, _) in enumerate(fps))
    assert Counter((r.doc_id, 10**9 if r.component_id is None else r.component_id) for r in found) == expected
    assert simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("threshold, blocks", [(3, 2), (7, 4)])
def test_every_link_meets_at_an_anchor(threshold, blocks):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 500, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, threshold + 1), replace=False):
            y[i] ^= np.uint64(1 << int(b))
    met = np.zeros(len(x), bool)
    for low, code in simhash.covering(threshold, blocks):
        mask = np.uint64((1 << code.width) - 1)
        home = {}
        for rows, anchors, at in code.anchors((x >> np.uint64(low)) & mask):
            home |= {r: a[at] for r, a in zip(rows.tolist(), anchors)}
        for rows, anchors, _ in code.anchors((y >> np.uint64(low)) & mask):
            for r, a in zip(rows.tolist(), anchors):
                met[r] |= home[r] in a
    assert met.all()


def test_hot_anchor_is_dealt_out_and_connected(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOMES", 8)
    base = 0x123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)})[:300]
    rows = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = simhash.links(rows).collect()
    assert all((e.a ^ e.b).bit_count() <= 3 for e in edges)
    forest, brute = Forest(), Forest()
    for e in edges:
        forest.join(e.a, e.b)
    for n, x in enumerate(fps):
        for y in fps[:n]:
            if (x ^ y).bit_count() <= 3:
                brute.join(x, y)
    assert [forest.root(x) for x in fps] == [brute.root(x) for x in fps]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)] + [(200, x) for x in range(201, 260)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, **{i: 200 for i in range(200, 260)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for _ in range(30):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(int(rng.integers(1, 6))):
            some = list(base)
            for at in rng.choice(len(some), int(rng.integers(0, 5)), replace=False):
                some[at] = f"e{rng.integers(10**6)}"
            rows.append((n, " ".join(some)))
            n += 1
    rows += [(n, rows[0][1]), (n, rows[0][1]), (n + 1, ""), (n + 2, None)]
    path = scratch(spark, "near-test")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    kept = sorted(r.doc_id for r in simhash.deduplicated(spark.read.parquet(path)).select("doc_id").collect())
    sets = [frozenset(simhash.hashes(words((t or "").encode()), 5).tolist()) for _, t in rows]
    forest = Forest()
    for x in range(len(rows)):
        for y in range(x):
            union = len(sets[x] | sets[y])
            if not union or len(sets[x] & sets[y]) >= 0.8 * union:
                forest.join(x, y)
    groups = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        groups[forest.root(x)].append(i)
    assert kept == sorted(min(g) for g in groups.values())


def test_near_duplicates_reach_contiguous_edits(spark):
    rng = np.random.default_rng(7)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts = []
    for size in (200, 400, 600):
        for _ in range(40):
            base, part = fresh(size), size // 12
            at = int(rng.integers(0, size - part))
            texts += [base, base + fresh(size // 5), base[:at] + fresh(part) + base[at + part :]]
            base = fresh(size)
            texts += [base, base[: at // 2] + base[at // 2 + size // 7 :]]
    texts = [" ".join(t) for t in texts]
    path = scratch(spark, "near-passages")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    kept = sorted(r.doc_id for r in simhash.deduplicated(spark.read.parquet(path)).select("doc_id").collect())
    sets = [frozenset(simhash.hashes(words(t.encode()), 5).tolist()) for t in texts]
    forest = Forest()
    for x in range(len(texts)):
        for y in range(max(0, x - 5), x):
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                forest.join(x, y)
    expected = [x for x in range(len(texts)) if forest.root(x) == x]
    assert len(expected) == 0.4 * len(texts) and kept == expected


def test_packing(docs, empty, spark):
    path = P.path("byte_bpe_50k.json")
    exact = Tokenizer.from_file(path)
    found = packing.pieces(docs, path, capacity=64)
    expected = Counter()
    for i, t in TEXTS:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for n, (at, size) in enumerate(packing.cuts(len(ids), 64)):
            expected[i, n, at, size, zlib.crc32(ids[at : at + size].tobytes())] += 1
    assert Counter(map(tuple, found.collect())) == expected
    rows = packing.pack(found, capacity=64, per_partition=200).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for some in bins.values():
        at = 0
        for offset, size in sorted(some):
            assert offset == at
            at += size
        assert at <= 64
    bound = packing.lower_bound(np.array([r.length for r in rows]), 64)
    assert bound <= len(bins) <= bound + 2
    assert packing.pack(packing.pieces(empty, path)).count() == 0
    ids = packing.pieces(docs.where("doc_id = 8"), path, with_ids=True).first().ids
    assert ids == [*exact.encode("a").ids, 2]


def test_bounds_hold_for_small_cases():
    rng = np.random.default_rng(1)
    for _ in range(300):
        sizes = rng.integers(1, 13, int(rng.integers(1, 8)))
        best = min_bins(sorted(sizes.tolist(), reverse=True), 12)
        assert packing.lower_bound(sizes, 12) <= best <= packing.best_fit(sizes, 12)[0].max() + 1
    assert packing.lower_bound(np.full(5, 7), 12) == 5


def min_bins(sizes, capacity, bins=()):
    if not sizes:
        return len(bins)
    out = min_bins(sizes[1:], capacity, (*bins, sizes[0]))
    for i, used in enumerate(bins):
        if used + sizes[0] <= capacity and used not in bins[:i]:
            out = min(out, min_bins(sizes[1:], capacity, (*bins[:i], used + sizes[0], *bins[i + 1 :])))
    return out


def test_white_space_beyond_the_fast_tokenizer():
    path = P.path("byte_bpe_50k.json")
    text = " " * 1_200_000 + "x"
    assert packing.ByteBPE(open(path, encoding="utf-8").read()).encode(text) == Tokenizer.from_file(path).encode(text).ids


def test_quality_model(docs, empty, spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 900, 60)) + "." if i % 3 else "junk### " * 50) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    many = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in quality_model.quality_scores(many, labels).collect()}
    assert len(found) == 400
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(i % 3 > 0) and 0 <= r.score <= 1
    edge = quality_model.quality_scores(docs, labels).collect()
    assert len(edge) == len(TEXTS) and all(r.score is not None for r in edge) and not [r for r in edge if r.doc_id is None and r.held_out]
    assert quality_model.quality_scores(empty, labels).count() == 0
    none = quality_model.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    scored = quality_model.score(docs, quality_model.fit(np.zeros((0, len(quality_model.FEATURES))), np.zeros(0)))
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]


def test_flat_trees_give_what_the_recursion_gives():
    rng = np.random.default_rng(4)
    x = rng.random((600, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality_model.fit(x, y)

    def walk(row, node):
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        return trees.value[node]

    margin = np.array([trees.prior + sum(walk(row, r) for r in trees.roots) for row in x])
    assert np.allclose(trees.probability(x), 1 / (1 + np.exp(-margin)))
    assert ((trees.probability(x) > 0.5) == (y > 0)).mean() > 0.97


def test_quality_rules(docs, empty):
    rows = quality_rules.clean_lines(docs)
    assert rows.columns == [c for c in docs.columns if c != "kept"] + list(quality_rules.FIELDS)
    found = {r.doc_id: r for r in rows.collect()}
    assert rows.count() == len(TEXTS)
    assert (found[4].n_words, found[4].base_failed, found[4].kept) == (0, True, False)
    assert found[11].n_dup_lines == 1 and found[11].n_symbols == 3
    assert found[7].word_chars == len("".join(dict(TEXTS[:8])[7].split(" ")))
    assert found[9].n_words == 60_000
    for i, t in TEXTS:
        parts = (t or "").encode().split()
        grams = Counter(tuple(parts[k : k + 8]) for k in range(len(parts) - 7))
        covered = {k + d for k in range(len(parts) - 7) if grams[tuple(parts[k : k + 8])] > 1 for d in range(8)}
        assert quality_rules.judge((t or "").encode()).n_repeat_words == len(covered)
    clean = "This sentence stands for a document that is fine and long enough to be kept by all of the rules. It has an end.\n"
    dirty = quality_rules.judge((clean + "All rights reserved.\nhome | about | news | contact\nno end here\n" + "buy### now### all### here###\n").encode())
    assert dirty.kept and dirty.text.decode() == clean
    assert not quality_rules.judge((clean + ("home | about | news | contact | more of it\n" * 2 + "no end of words is in this line at all\n" * 9)).encode()).kept
    assert quality_rules.clean_lines(empty).count() == 0


def test_bpe(docs, empty):
    path = P.path("word_bpe_49k.json")
    exact, own = Tokenizer.from_file(path), bpe.WordBPE(open(path, encoding="utf-8").read())
    rng = np.random.default_rng(6)
    letters = list("aeiounthrst'dlmv0123 !?.-éÜßñ\n\t日Σ")
    texts = [t or "" for _, t in TEXTS] + ["".join(rng.choice(letters, 80)) for _ in range(300)] + ["".join(rng.choice(list("abt"), 40)) for _ in range(300)]
    for t in texts:
        ids = exact.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids
        assert own.decode(np.array(ids)).decode() == exact.decode(ids, skip_special_tokens=False)
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    rows = Counter(map(tuple, bpe.encode_texts(docs, path, outputs=outputs).select("doc_id", *outputs).collect()))
    expected = Counter()
    for i, t in TEXTS:
        ids = exact.encode(t or "", add_special_tokens=False).ids
        text = exact.decode(ids, skip_special_tokens=False)
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert rows == expected
    assert bpe.encode_texts(empty, path, outputs=outputs).count() == 0
    assert bpe.encode_texts(docs, path).columns == [*docs.columns, "ids", "decoded"]
    for r in bpe.encode_texts(docs.where("doc_id is not null"), path).collect():
        text = next(t for i, t in TEXTS if i == r.doc_id) or ""
        assert r.ids == exact.encode(text, add_special_tokens=False).ids and r.decoded == exact.decode(r.ids, skip_special_tokens=False)
    own.pieces.held = own.words.held = bpe.REMEMBERED
    assert own.encode("unmet wordlets").tolist() == exact.encode("unmet wordlets", add_special_tokens=False).ids and own.words.held < 10_000


def test_url_rules(spark):
    urls = ["http://a.example.net/en/x", "http://example.net", "http://net/", "https://EXAMPLE.com/de/?q", "http://badexample.com/de/", "http://w.org/fr/a#b", None, "no host", "x://y://z/", "http://a.b.c.net/"]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("c.net", "/", "allow"), ("a.b.c.net", "/q", "block")]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)] + [(0, urls[0], "k")], "page_id long, url string, key string")

    def brute(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
            host, rest = rest[:end].translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER)), rest[end:]
            path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
        fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(min(fits, key=lambda r: (-len(r[0]), r[0])) if fits else (None, "allow")))

    expected = Counter((i, *brute(u)) for i, u in [*enumerate(urls), (0, urls[0])])
    assert Counter(map(tuple, urlfilter.judge_urls(pages, rules).collect())) == expected
    urlfilter.RULES_A_SWEEP, before = 2, urlfilter.RULES_A_SWEEP
    try:
        assert Counter(map(tuple, urlfilter.judge_urls(pages, rules).collect())) == expected
    finally:
        urlfilter.RULES_A_SWEEP = before
    urlfilter.RULE_BYTES, before = 12, urlfilter.RULE_BYTES
    try:
        assert Counter(map(tuple, urlfilter.judge_urls(pages, rules).collect())) == expected
    finally:
        urlfilter.RULE_BYTES = before
    # a hot host over several partitions, and very long paths and hosts
    hot = [(i, f"http://h{'.sub' * (i % 3)}.example.net/{'en' if i % 2 else 'fr'}/{i}") for i in range(3000)] + [(9000, "http://" + "a." * 5000 + "example.com/de/" + "p" * 100_000)]
    many = spark.createDataFrame(hot, "page_id long, url string").repartition(7)
    assert Counter(map(tuple, urlfilter.judge_urls(many, rules).collect())) == Counter((i, *brute(u)) for i, u in hot)
    assert urlfilter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge_urls(pages, []).collect()} == {"allow"}


def test_sharding(docs, empty, spark):
    rows = [(i, f"text {i % 400} " + "x" * (i % 97), "v") for i in range(3000)] + [(10_000 + i, "hot copy", "v") for i in range(1500)] + [(None, None, "v"), (5, "same", "v"), (5, "same", "v")]
    found = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, shard string"), 8).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((i, t) for i, t, _ in rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in found:
        assert r["size"] == len((r.text or "").encode()) + 16
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert sorted(sizes) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 8 + 300
    small = sharding.shard_by_bytes(docs, 40)
    assert small.count() == len(TEXTS) and small.columns == [c for c in docs.columns if c != "size"] + ["size", "shard", "slot"]
    assert sharding.shard_by_bytes(empty, 40).count() == 0


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 32)).astype(np.float32)
    x[700:760] = x[50]  # ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2050, [0.0] * 32, 1), (2100, [float("nan")] * 32, 1), (2150, [1.0, None] * 16, 1), (None, [1.0] * 32, 1), (2200, [1.0, 2.0], 1), (2201, [2.0, 1.0], 1), (2250, [], 1)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    d = x.astype(np.float64)
    scores = (d @ d.T) / np.outer(np.linalg.norm(d, axis=1), np.linalg.norm(d, axis=1))
    hits = 0
    for q in range(0, 1500, 50):
        order = [i for i in np.lexsort((np.arange(1500), -np.round(scores[q], 12))) if i != q][:5]
        hits += len({v for v, _ in got.pop(q)} & set(order))
    assert hits >= 0.99 * 30 * 5
    assert got == {2200: [(2201, pytest.approx(0.8))]}
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language_model(docs, empty, spark):
    found = lm.scores(docs).collect()
    tokens = [(i, [*(t or "").encode().translate(LOWER).split(), None]) for i, t in TEXTS]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    expected = Counter((i, held(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    assert lm.scores(empty).count() == 0


def test_language_model_mixes_to_one(spark):
    """The probabilities of all words after one context add up to one, and the weights come from the held-out counts."""
    rows = lm.learned([(3, 8, 4, 50), (3, 20, -1, 10), (5, 10, 2, 900)], types=1000)
    assert np.allclose(rows.sum(axis=1), 1) and (rows[1:] > 0).all() and rows[0, 2] == 0
    assert rows[5, 2] > rows[3, 2]
    assert lm.learned([], 0).shape == (lm.LEVELS, 3)


def test_language_model_blocks(spark, docs, monkeypatch):
    rows = lambda: sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.scores(docs).collect())
    whole = rows()
    monkeypatch.setattr(lm, "BLOCK", 1000)
    monkeypatch.setattr(lm, "PER_BUCKET", 500)
    assert [pytest.approx(x, rel=1e-9) for x in whole] == rows()


def test_counts_in_bytes():
    n = np.array([0, 1, 254, 255, 256, 10**12, 3])
    assert lm.large(lm.small(n), len(n)).tolist() == n.tolist()


def test_warc_round_trip(spark):
    big = "".join(np.random.default_rng(1).choice(list("abé<>\r\n WARC/1.1"), 200_000))
    rows = [(1, "http://a", "x" * 2000), (2, "http://b", "x" * 2000), (3, None, None), (4, "u", ""), (5, "u", "y" * 999), (6, "u", "y" * 999), (7, "u", big), (8, "u\r\nX: y", big), (9, "u", "WARC/1.1\r\n\r\n" * 50), (None, "n", big), (10, "d", "z" * 50_000), (10, "d", "z" * 50_000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    path = scratch(spark, "warc-test")
    warc.write_archives(pages, path, segment_bytes=4096, archive_records=5)
    found = warc.read_pages(spark, path).collect()
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    assert Counter((r.page_id, r.payload_digest) for r in found) == Counter((i, hashlib.sha1(p).hexdigest()) for i, p in payloads)
    assert {r.page_id: r.refers_to for r in found if r.record_type == "revisit"} == {1: 2, 7: 8}
    assert Counter((r.page_id, bytes(r.payload)) for r in found if r.record_type == "response") == Counter((i, p) for i, p in payloads if i not in (1, 7))
    none = scratch(spark, "warc-none")
    warc.write_archives(pages.limit(0), none)
    assert warc.read_pages(spark, none).count() == 0


def test_broken_archives_are_told():
    with pytest.raises(ValueError):
        list(warc.records(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"))
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.dechunked(warc.chunked(b"q" * 100_000)) == b"q" * 100_000


def test_language_model_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.6, 60) % 50)) for i in range(120)]
    found = {r.doc_id: r.score for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i, _ in rows}
    streams = {i: ["<s>", *t.split(), "</s>"] for i, t in rows}

    def counts(keep):
        one, two = Counter(), Counter()
        for i, t in streams.items():
            if keep(fold[i]):
                one.update(t)
                two.update(zip(t, t[1:]))
        return one, two, sum(one.values()) - one["<s>"]

    one, two, n = counts(lambda f: f != lm.HELD_OUT)
    types = len(one) - 1
    rest1, rest2, rest_n = counts(lambda f: f not in (lm.HELD_OUT, lm.APART))
    level = lambda c: int(lm.level(np.array([c]))[0])
    step = lambda p: round(-lm.GRID * math.log2(p)) if p > 0 else -1
    cells = Counter()
    for i, t in streams.items():
        if fold[i] == lm.APART:
            for v, w in zip(t, t[1:]):
                cells[level(rest1[v]), step(rest1[w] / rest_n), step(rest2[v, w] / max(1, rest1[v]))] += 1
    weights = lm.learned(sorted((*k, c) for k, c in cells.items()), types)
    for i, t in streams.items():
        p = [(weights[level(one[v])] * [1 / (types + 1), one[w] / n, two[v, w] / max(1, one[v])]).sum() for v, w in zip(t, t[1:])]
        assert abs(found[i] - sum(map(math.log10, p))) < 1e-4
