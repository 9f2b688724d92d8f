"""The operators on hand rows and by property."""

import json
import zipfile
from io import BytesIO

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions.names import PREFIX, WINKLER, jaro_winkler
from sparkloom.operators import checks, corpus, duplicates, graph, links, scan, search, terms, turns
from sparkloom.sources import contracts, files, markdown, office, sinks, transcripts
from sparkloom.streaming import events


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_text_functions(spark):
    assert column(spark, ["  Éa’b\t c ", None, ""], T.normalize) == ["ea'b c", None, ""]
    assert column(spark, ["policies", "glasses", "address", "bus", "boxes", "as"], T.singularize) == ["policy", "glass", "address", "bus", "box", "as"]
    assert column(spark, ["l'écran Key-words 3.14", ""], T.tokens) == [["l", "ecran", "key", "word", "3", "14"], []]
    assert column(spark, ["Grün & Söhne!", "--", None], T.slugify) == ["grun-sohne", f"u{fnv('--')}", None]
    assert column(spark, ["item 9", "item 10", "item 0010", "item 99999999999999999999", "item 100000000000000000000"], T.numeric_key) == sorted(column(spark, ["item 9", "item 10", "item 0010", "item 99999999999999999999", "item 100000000000000000000"], T.numeric_key))
    assert T.question_words(" «Déjà» (vu), vu a 12 l’eau! ") == ["deja", "vu", "12", "l'eau"]
    assert column(spark, ["00:01:02.500", "01:02,5", "x"], T.cue_seconds)[:2] == [62.5, 62.5]
    assert column(spark, [3723.25], T.timecode, "double") == ["01:02:03.250"]
    assert column(spark, ["one two three", "short"], lambda c: T.excerpt(c, 9)) == ["one two…", "short"]
    assert column(spark, ["<p>a&lt;b</p> <b>c</b>"], T.plain_text) == ["a<b c"]
    assert column(spark, ["item 9", "item 10"], T.numeric_key) == sorted(column(spark, ["item 9", "item 10"], T.numeric_key))
    assert column(spark, [0.00005, 0.12345, 1.0], T.round4, "double") == [0.0001, 0.1235, 1.0]


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro-Winkler by loops."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not (m := len(left)):
        return 0.0
    crossed = sum(x != y for x, y in zip(left, (c for c, t in zip(b, taken) if t))) / 2
    jaro = (m / len(a) + m / len(b) + (m - crossed) / m) / 3
    common = next((i for i, (x, y) in enumerate(zip(a[:PREFIX], b[:PREFIX])) if x != y), min(PREFIX, len(a), len(b)))
    return jaro + common * WINKLER * (1 - jaro)


def fnv(text):
    h = 2166136261
    for c in text:
        h = (h ^ ord(c)) * 16777619 % 2**32
    return f"{h:08x}"


def test_jaro_winkler():
    # b and c cross a: one and a half transpositions of seven
    assert abs(jaro_winkler_of("abcxxxx", "bcaxxxx") - (1 + 1 + (7 - 1.5) / 7) / 3) < 1e-12
    assert jaro_winkler_of("martha", "marhta") == (17 / 18) + 3 * 0.1 * (1 / 18)
    assert (jaro_winkler_of("", "a"), jaro_winkler_of("a", "a"), jaro_winkler_of("ab", "cd")) == (0.0, 1.0, 0.0)


def test_names_of_other_first_letters_meet(spark, tmp_path):
    from sparkloom import plans

    held = sorted({f"{x}{y}" for x in ("cold ", "old ", "gold ", "c.ld ", "", "a") for y in ("bolt", "bolts", "gear", "gaer", "wheel + axle", "é", "a")} | {""})
    spark.createDataFrame([(x,) for x in [*held, held[3]]], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = {(r.a, r.b) for r in plans.QUERIES["f12_jaro_winkler"](spark, str(tmp_path)).collect()}
    want = {(a, b) for a in held for b in held if a < b and jaro_winkler_of(a, b) >= 0.9}
    assert found == want and ("cold bolt", "old bolt") in found


def test_jaro_winkler_against_loops(spark):
    import random

    rng = random.Random(4)
    words = ["", "a", "abcxxxx", "bcaxxxx", "martha", "marhta", *("".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 14))) for _ in range(60))]
    rows = spark.createDataFrame([(x, y) for x in words for y in words] + [(None, "a"), ("a", None)], "x string, y string")
    for r in rows.select("x", "y", jaro_winkler("x", "y").alias("s")).collect():
        assert r.s is None if r.x is None or r.y is None else abs(r.s - jaro_winkler_of(r.x, r.y)) < 1e-12


@settings(max_examples=60, deadline=None)
@given(st.text("abcdé", max_size=12), st.text("abcdé", max_size=12))
def test_jaro_winkler_is_symmetric_and_bounded(a, b):
    s = jaro_winkler_of(a, b)
    assert 0 <= s <= 1 and abs(s - jaro_winkler_of(b, a)) < 0.12


EVIDENCE = "from string, to string, relation string, method string, path string, line int, section string, position int, confidence double, occurrences int"


def test_combine_links_folds_and_is_idempotent(spark):
    rows = [("a", "b", "related", "glossary_occurrence", "p", 1, "", 0, 0.6, 1), ("a", "b", "related", "glossary_occurrence", "p", 1, "", 7, 0.5, 2), ("a", "b", "related", "explicit_link", "p", 1, "", 0, 0.5, 1)]
    found = spark.createDataFrame(rows, EVIDENCE)
    want = [("a", "b", "related", 0.85, "explicit_link,glossary_occurrence", 3)]
    assert [tuple(r) for r in links.combine_links(found).collect()] == want
    assert [tuple(r) for r in links.combine_links(found.union(found).repartition(3)).collect()] == want
    assert links.combine_links(found.limit(0)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1), min_size=1, max_size=6))
def test_noisy_or_is_bounded_and_free_of_order(spark, values):
    of = lambda v: spark.createDataFrame([(x,) for x in v], "c double").agg(links.noisy_or(F.col("c"))).first()[0]
    assert max(values) - 1e-4 <= of(values) <= 1 and abs(of(values) - of(values[::-1])) <= 1e-4


def test_longest_matches(spark):
    rows = [("p", 1, 0, 3, "a b c"), ("p", 1, 0, 1, "a"), ("p", 1, 2, 4, "c d"), ("p", 1, 1, 2, "b"), ("p", 1, 5, 6, "x"), ("p", 1, 5, 6, "y"), ("p", 2, 0, 1, "a")]
    kept = scan.longest_matches(spark.createDataFrame(rows, "path string, line int, start int, end int, key string"))
    assert sorted(r.key for r in kept.collect()) == ["a", "a b c", "c d", "x", "y"]


def test_terms_penalise_nested_runs(spark):
    docs = spark.createDataFrame([(i, "data mesh platform\n\nthe data mesh platform") for i in range(3)], "doc_id long, text string")
    found = {r.key: r for r in terms.score_terms(terms.units(docs)).collect()}
    assert found["data mesh"].score == 0 and found["data mesh platform"].score > 0 and found["data mesh platform"].occurrences == 6
    known = terms.score_terms(terms.units(docs), terms.TermOptions(defined=("mesh",)))
    again = {r.key: r for r in known.collect()}
    assert "mesh" not in again and again["data"].neighbour
    assert terms.score_terms(terms.units(docs.limit(0))).count() == 0


def test_graph(spark):
    rows = [("a", "b", 0.5), ("b", "c", 0.9), ("a", "d", 0.8), ("d", "c", 0.9), ("c", "e", 0.1), ("x", "x", 1.0), ("y", "z", 0.3)]
    found = spark.createDataFrame(rows, "from string, to string, confidence double")
    near = {(r.id, r.depth, r.score) for r in graph.near(found, spark.createDataFrame([("a",)], "id string"), 2).collect()}
    assert near == {("b", 1, 0.5), ("d", 1, 0.8), ("c", 2, 1.7)}
    assert [r.id for r in graph.path(found, "a", "e").orderBy("step").collect()] == ["a", "d", "c", "e"]
    assert graph.path(found, "a", "z").count() == 0 and [r.id for r in graph.path(found, "a", "a").collect()] == ["a"]
    assert {r.id: r.root for r in graph.components(found).collect()} == {**dict.fromkeys("abcde", "a"), "y": "y", "z": "y"}


def test_relations(spark):
    found = spark.createDataFrame([("1", "2", "related", 0.9), ("2", "1", "related", 0.9), ("2", "3", "related", 0.9), ("1", "3", "uses", 0.9)], "from string, to string, relation string, confidence double")
    types = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C")], "id string, type string")
    allowed = spark.createDataFrame([("uses", "A", "B")], "relation string, from_type string, to_type string")
    out = {(r["from"], r.to, r.relation, r.confidence, r.finding) for r in links.type_relations(found, types, allowed).collect()}
    assert out == {("1", "2", "uses", 0.9, None), ("2", "3", "related", 0.6, None), ("1", "3", "uses", 0.9, "E-META-REL")}


def test_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " end"), (4, "too short"), (5, None), (6, " ".join(f"v{i}" for i in range(60)))], "doc_id long, text string")
    pairs = duplicates.banded_pairs(duplicates.signatures(duplicates.shingles(docs)))
    sets = duplicates.shingle_sets(docs)
    assert {(r.a, r.b): r.jaccard for r in duplicates.similar_pairs(sets, 0.98).collect()} == {(1, 2): 1.0, (1, 3): 0.9825, (2, 3): 0.9825}
    assert duplicates.similar_pairs(sets.limit(0), 0.6).count() == 0
    assert {(r.a, r.b): r.jaccard for r in duplicates.jaccard(pairs, sets).collect()} == {(1, 2): 1.0, (1, 3): 0.9825}
    scored = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.95), (1, 3, 0.6), (4, 5, 0.5), (6, 7, 0.4)], "a long, b long, score double")
    assert {(r.a, r.b): (r.root, r.verdict) for r in duplicates.resolved(scored).collect()} == {(1, 2): (1, "merged"), (2, 3): (1, "merged"), (1, 3): (1, "folded"), (4, 5): (None, "reported")}


def test_terms_of_every_language(spark, tmp_path):
    from sparkloom import plans

    texts = {"en": "the Grand Robot of iron", "fr": "le Grand Robot de fer et l'Écran", "de": "der Grand Robot und Öl", None: "Grand Robot"}
    rows = [(10 * n + i, text, lang) for n, (lang, text) in enumerate(texts.items()) for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: plans.QUERIES[name](spark, str(tmp_path)).collect()
    keys = {(r.lang, r.key): (r.occurrences, r.documents) for r in run("a06_term_discovery")}
    assert {lang for lang, _ in keys} == {"en", "fr", "de", None} and set(keys.values()) == {(6, 6)}
    assert ("fr", "robot de fer") in keys and ("fr", "le grand") not in keys and ("de", "der grand") not in keys and ("en", "the grand") not in keys
    slugs = [r.slug for r in run("l12_publish_terms") if r.slug]
    assert len(slugs) == len(set(slugs))
    assert {(r.lang, r.key, r.documents) for r in run("o03_undefined_terms")} == {(*k, 6) for k in keys}
    assert {(r.lang, r.key): (r.surface, r.n) for r in run("a09_display_form")}["fr", "écran"] == ("Écran", 6)
    assert {r.w: r.n for r in run("f02_singularize")}["robot"] == 24
    assert {r.lang: r.n for r in run("l11_ngrams") if r.words == 1}["de"] == 6 * 2  # ol is too short


def test_noisy_or_folds_all_evidence(spark, tmp_path):
    from sparkloom import plans

    rows = [(o, 1 + o % 2, 5, 0.1) for o in range(1, 8)]  # of the orders only number 7 is a multiple of 7
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {(r.l_partkey, r.l_suppkey): (r.confidence, r.n) for r in plans.QUERIES["a01_noisy_or"](spark, str(tmp_path)).collect()}
    assert found == {(1, 5): (round(1 - 0.9**3, 4), 3), (2, 5): (round(1 - 0.9**4, 4), 4)}


def test_graph_queries_read_all_links(spark, tmp_path):
    from sparkloom import plans

    # a chain of parts and suppliers, two islands and a hub; of the orders only number 50 is a multiple of 10
    ends = [(1, 1), (2, 1), (2, 2), (3, 2), (4, 3), (5, 4), *((6, s) for s in range(5, 14)), (7, 5)]
    rows = [(41 + n, p, s, 0.01 * (n % 9)) for n, (p, s) in enumerate(ends)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: plans.QUERIES[name](spark, str(tmp_path)).collect()
    links_ = {(p, 100000 + s): round(0.2 + 7 * d, 4) for _, p, s, d in rows}
    beside = {}
    for a, b in links_:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)

    def walk(start):
        depth, front = {start: 0}, [start]
        while front:
            front = [y for x in front for y in beside[x] if y not in depth and depth.setdefault(y, depth[x] + 1)]
        return depth

    assert {r.id: r.root for r in run("a21_components")} == {x: min(walk(x)) for x in beside}
    assert {r.id: r.degree for r in run("a23_pivots")} == {x: len(v) for x, v in beside.items() if 3 <= len(v) <= 20}
    assert {r.id: r.depth for r in run("q05_near")} == {x: d for x, d in walk(1).items() if 0 < d <= 3}
    assert {r.id: (r.pivot, r.distance) for r in run("l18_emergent_domains")} == {x: (6, d) for x, d in walk(6).items() if d <= 3}
    assert run("q06_path") == []  # the greatest end is on another island
    spark.createDataFrame([*rows, (99, 3, 13, 0.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_discount double").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.id for r in sorted(run("q06_path"))] == []  # five links, one more than the most
    spark.createDataFrame([*rows, (99, 2, 13, 0.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_discount double").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.id for r in sorted(run("q06_path"))] == [1, 100001, 2, 100013]


def test_all_near_copies_of_odd_ids_too(spark, tmp_path):
    from sparkloom import plans

    words = lambda n, *gone: " ".join(f"x{n}y{i}" if i not in gone else f"z{n}y{i}" for i in range(60))
    texts = [w for n in range(12) for w in (words(n), words(n, 0), words(n, 59, 58), words(n, 30), words(n, 10, 40))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.a, r.b): r.jaccard for r in plans.QUERIES["l16_content_similarity"](spark, str(tmp_path)).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    exact = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(len(texts)) for a in range(b)}
    assert found == {k: round(j, 4) for k, j in exact.items() if j >= 0.8} and any(a % 2 for a, _ in found)


def test_similar_pairs_with_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "COMMON", 30)
    monkeypatch.setattr(duplicates, "GLIMPSE", 2)
    import random

    rng = random.Random(8)
    sets = []
    for i in range(120):
        base = [rng.randrange(10**6) for _ in range(30)] if i % 3 == 0 else [x if rng.random() > 0.08 else rng.randrange(10**6) for x in base]
        sets.append(sorted({*base, *range(12)}))
    rows = spark.createDataFrame([(i, len(s), s) for i, s in enumerate([*sets, sets[5], sets[5]])], "id long, n int, g array<long>")
    every = [set(s) for s in [*sets, sets[5], sets[5]]]
    for least in (0.6, 0.8):
        want = {(a, b) for b in range(len(every)) for a in range(b) if len(every[a] & every[b]) / len(every[a] | every[b]) >= least - 0.00005}
        found = duplicates.similar_pairs(rows, least).collect()
        assert len(found) == len(want) and {(r.a, r.b) for r in found} == want and (120, 121) in want


def test_bands_reach_pairs_of_middling_similarity(spark):
    # shingles drawn at random, 60 shared by the 80 of either: Jaccard 0.6
    rows = [(2 * p + side, 80, (p << 20) + (i if i < 60 else 1000 * (side + 1) + i)) for p in range(300) for side in (0, 1) for i in range(80)]
    grams = spark.createDataFrame(rows, "id long, n int, shingle long")
    pairs = {(r.a, r.b) for r in duplicates.banded_pairs(duplicates.signatures(grams)).collect()}
    assert len(pairs & {(2 * p, 2 * p + 1) for p in range(300)}) >= 288


def test_search(spark):
    fields = spark.createDataFrame([("1", "title", "Red gears"), ("1", "summary", "red"), ("2", "alias", "gear"), ("3", "other", "blue")], "entity string, field string, text string")
    index = search.postings(fields)
    assert [(r.entity, r.score, r["rank"]) for r in search.ranked(index, ["ge"]).orderBy("rank").collect()] == [("1", 5.0, 1), ("2", 4.0, 2)]
    assert search.ranked(index, ["ge", "bl"]).count() == 0
    assert search.closest(index, "gears2").first().token == "gears"
    assert {r.id: r.tier for r in search.resolve(spark.createDataFrame([("x", "Gears"), ("Gears", "y")], "id string, title string"), "Gears").collect()} == {"Gears": 1}


def test_turns(spark):
    cues = spark.createDataFrame([("c", 1, "A", "x"), ("c", 2, "A", "y"), ("c", 3, None, "z"), ("c", 4, None, "w"), ("c", 5, "A", "v")], "conv string, turn int, role string, text string")
    assert [(r.turn, r.speaker, r.text) for r in turns.merged_turns(cues, "conv", "turn", "role", "text").orderBy("turn").collect()] == [(1, "A", "x y"), (2, None, "z w"), (3, "A", "v")]
    assert column(spark, ["Ann Lee met Ann; Anna did not"], lambda c: turns.replace_names(c, ["Ann", "Ann Lee"], "_")) == ["_ met _; Anna did not"]


def test_corpus(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, kind string")
    assert {(r.dimension, r.value, r.n) for r in corpus.count_by(rows, ["kind"]).collect()} == {("kind", "a", 1), ("kind", "(none)", 1), ("all", "all", 2)}
    tree = corpus.folder_tree(spark.createDataFrame([("a/b/c.md",), ("a/d.md",), ("e.md",)], "p string"), F.col("p"))
    assert {(r.folder, r.depth, r.n) for r in tree.collect()} == {("a", 1, 2), ("a/b", 2, 1)}


def test_markdown():
    note = markdown.parse("---\nid: x\ntags: [a, 2]\nlist:\n  - p\n  - true\n---\n# Title\n\nSee [it](to.md \"t\") and `code x` <b>bold</b> https://h/x\n\n## Use\n- one\n| a | b |\n|---|---|\n> said\n```\n# no\n```\n![i](p.png)\n")
    assert note["title"] == "Title" and json.loads(note["frontmatter"]) == {"id": "x", "tags": ["a", 2], "list": ["p", True]}
    assert [s["heading"] for s in note["sections"]] == ["Use"] and [(x["target"], x["image"]) for x in note["links"]] == [("to.md", False), ("p.png", True)]
    assert [(u["kind"], u["text"]) for u in note["units"]] == [("heading", "Title"), ("paragraph", "See it and  bold"), ("heading", "Use"), ("list", "one"), ("table", "a"), ("table", "b"), ("quote", "said")]
    assert markdown.parse("---\n- a\n---\nx")["finding"] == "E-FM-INVALID" and markdown.parse("")["units"] == []
    soft = markdown.parse("# A\n\n## S\n\na soft\nbreak\n\n---\n\n- one\n  two\n\n# B\n\nplain\n\nSet\n---\n")
    assert [(u["line"], u["kind"], u["text"], u["section"]) for u in soft["units"]] == [(1, "heading", "A", None), (3, "heading", "S", "S"), (5, "paragraph", "a soft break", "S"), (10, "list", "one two", "S"), (13, "heading", "B", None), (15, "paragraph", "plain", None), (17, "heading", "Set", "Set")]
    deep = "id: a\nmap:\n  x: 1\n  l:\n    - p\n    - q\ntext: |\n  one\n  two"
    want = {"id": "a", "map": {"x": 1, "l": ["p", "q"]}, "text": "one\ntwo"}
    assert markdown.block(deep.split("\n")) == want and json.loads(markdown.parse(f"---\n{deep}\n---\n")["frontmatter"]) == want


def test_ignore_rules(spark):
    paths = ["a.md", "b/a.md", "b/c.txt", "tmp/x.md", "deep/tmp/y.md", "keep/tmp.md"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in files.filtered(rows, include=["**/*.md"], ignore="tmp/\n/b\n!b/a.md\n# note").orderBy("path").collect()] == ["a.md", "b/a.md", "keep/tmp.md"]


def test_read_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.md").write_text("# é")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    found = {r.path: (r.text, r.finding) for r in files.read_files(spark, str(tmp_path), source="s").collect()}
    assert found == {"d/x.md": ("# é", None), "bad.md": (None, "E-ENCODING")}


def test_transcripts(spark):
    text = "WEBVTT\n\n1\n00:01.000 --> 00:02.500\n<v Ann>Hi &amp; welcome</v>\n\nNOTE x\n\n00:00:03,000 --> 00:00:04,000\nBob: so\nit is"
    found = transcripts.cues(spark.createDataFrame([("f", text)], "path string, text string"))
    assert [(r.start, r.end, r.speaker, r.text) for r in found.orderBy("index").collect()] == [(1.0, 2.5, "Ann", "Hi & welcome"), (3.0, 4.0, "Bob", "so it is")]
    again = transcripts.cues(transcripts.vtt(found))
    assert [(r.start, r.speaker, r.text) for r in again.orderBy("index").collect()] == [(1.0, "Ann", "Hi & welcome"), (3.0, "Bob", "so it is")]


def test_contracts(spark):
    wsdl = '<definitions xmlns="http://schemas.xmlsoap.org/wsdl/" xmlns:s="http://schemas.xmlsoap.org/wsdl/soap/"><portType name="P"><operation name="Get"><input message="t:In"/></operation></portType><binding name="B" type="t:P"><operation name="Get"><s:operation soapAction="urn:get"/></operation></binding></definitions>'
    rows = spark.createDataFrame([("w", wsdl), ("bad", "{"), ("none", None)], "path string, text string")
    circle = {"openapi": "3.0.0", "paths": {"/": {"get": {"responses": {"200": {"$ref": "#/components/responses/R"}}}}}, "components": {"responses": {"R": {"x": {"$ref": "#/components/responses/R"}, "s": {"$ref": "#/components/schemas/S"}}}, "schemas": {"S": {"p": {"$ref": "#/components/schemas/S"}}}}}
    assert contracts.openapi(json.dumps(circle))[0]["schemas"] == ["S"]
    two = '<description xmlns="http://www.w3.org/ns/wsdl" xmlns:s="http://www.w3.org/ns/wsdl/soap" xmlns:x="http://www.w3.org/2001/XMLSchema"><types><x:schema><x:element name="In" type="t:T"/><x:complexType name="T"><x:sequence><x:element name="u" type="t:U"/></x:sequence></x:complexType><x:simpleType name="U"/><x:simpleType name="V"/></x:schema></types><interface name="I"><operation name="Put"><input element="t:In"/></operation></interface><binding name="B" interface="t:I"><operation ref="t:Put" s:action="urn:put"/></binding></description>'
    assert contracts.wsdl(two) == [{"operation": "Put", "method": "soap", "path": "I", "title": "urn:put", "schemas": ["In", "T", "U"]}]
    found = {r.path: (r.operation, r.method, r.route, r.title, r.finding) for r in contracts.operations(rows).collect()}
    assert found == {"w": ("Get", "soap", "P", "urn:get", None), "bad": (None, None, None, None, "W-CONTRACT-UNREACHABLE"), "none": (None, None, None, None, "W-CONTRACT-UNREACHABLE")}


def test_office(spark):
    made = BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("docProps/core.xml", '<c xmlns:d="urn:d"><d:title>T</d:title><d:creator>A</d:creator></c>')
        z.writestr("docProps/app.xml", '<p xmlns="urn:p"><Slides>2</Slides></p>')
        for n in (10, 2):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<s xmlns:a="urn:a"><a:t>slide {n}</a:t></s>')
    pdf = b"%PDF-1.4\n1 0 obj << /Type /Page >> << /Type /Pages >> /Title (A \\(b\\)) /ModDate (D:20200102)"
    rows = spark.createDataFrame([("p", bytearray(made.getvalue())), ("q", bytearray(pdf)), ("r", bytearray(b"no"))], "path string, content binary")
    found = {r.path: (r.title, r.author, r.modified, r.pages, r.slides, r.finding) for r in office.document_properties(rows).collect()}
    assert found["p"] == ("T", "A", None, 2, ["slide 2", "slide 10"], None) and found["q"][:4] == ("A (b)", None, "2020-01-02", 1) and found["r"][5] == "W-CONV-FAILED"


def test_reports(spark):
    rows = [{"check": "E-ENCODING", "severity": "error", "message": "no <UTF-8>", "path": "a.md", "line": 3}, {"check": "W-DOC-NOMD", "severity": "info", "message": "m", "path": None, "line": None}]
    sarif = json.loads(checks.report(rows, "sarif"))["runs"][0]
    assert "locations" not in sarif["results"][1] and sarif["results"][0]["ruleIndex"] == 0 and sarif["tool"]["driver"]["rules"][0]["shortDescription"]["text"]
    assert checks.report(rows).startswith("a.md:3: error E-ENCODING") and json.loads(checks.report(rows, "json"))["counts"]["error"] == 1
    assert json.loads(checks.report(rows, "sarif"))["runs"][0]["results"][0]["level"] == "error" and 'failures="1"' in checks.report(rows, "junit")
    found = checks.enriched(spark.createDataFrame([("E-ENCODING", "a"), ("W-DOC-NOMD", "b"), ("I-PII-DETECTED", "c")], "check string, path string"), disabled=("I-PII-DETECTED",))
    assert {(r.check, r.severity) for r in found.collect()} == {("E-ENCODING", "error"), ("W-DOC-NOMD", "info")} and checks.failed(found)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, None), ("a", 2, "x")], "id string, n int, c string")
    sinks.write_model({"e": rows}, str(tmp_path), {"e": ("id",)})
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/e").collect()] == ["a", "b"]
    assert [r.value for r in sinks.canonical_json(rows).collect()] == ['{"id":"b","n":1}', '{"c":"x","id":"a","n":2}']
    index = search.postings(spark.createDataFrame([("1", "title", "red")], "entity string, field string, text string"))
    sinks.write_index(index, f"{tmp_path}/i")
    assert spark.read.parquet(f"{tmp_path}/i").where("shard = 're'").count() == 1


def test_streaming(spark, tmp_path):
    spark.sql("select timestamp'2020-01-01 00:10:00' as ts, 'a' as k, 1 as id union all select timestamp'2020-01-01 00:50:00', 'a', 1 union all select timestamp'2020-01-01 01:10:00', 'b', 2").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k string, id int").parquet(f"{tmp_path}/in")
    run = events.windowed(events.once(stream, ["id"], "ts"), "ts", ["k"], late=None).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("windows").count() >= 0 and run.exception() is None
    batch = events.windowed(spark.read.parquet(f"{tmp_path}/in"), "ts", ["k"])
    assert sorted((r.k, r.n) for r in batch.collect()) == [("a", 2), ("b", 1)]
