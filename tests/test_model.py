"""Typing, linting, mentions, views, sources, extensions and answers on hand rows."""

import json
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom import answers, plugins
from sparkloom.operators import corpus, duplicates, filing, lint, links, references, scan, search, terms, turns, views
from sparkloom.sources import contracts, ingest, markdown, office, sinks

NOTE = "path string, title string, summary string, front map<string,string>, aliases array<string>, modified timestamp"


def test_filing(spark):
    rows = [("a/x.rule.md", None, "s", {"type": "term", "owner": "me"}, None, None), ("a/sub/y.md", "Y", None, {"id": "Bad", "domain": "inner"}, ["Why"], None), ("b/z.md", "Z", None, None, None, None), ("b/Z.md", "Z2", None, {"application": "  "}, None, None)]
    source = filing.Source("src", rules=(filing.Rule({"type": "rule", "state": "new"}, suffix=".rule.md"), filing.Rule({"type": "none"}, path="b/*")))
    profile = filing.Profile({"document": (), "term": (), "rule": ()})
    domains = (filing.Domain("outer", folder="a", subdomains=(filing.Domain("inner", folder="sub"),)),)
    made, found = filing.typed_sources({"src": spark.createDataFrame(rows, NOTE)}, (source,), profile, domains=domains)
    got = {r.path: (r.id, r.type, r.type_origin, r.domain, r.title, r.attributes) for r in made.collect()}
    assert got["a/x.rule.md"] == ("src/a/x", "term", "frontmatter", "outer", "x.rule", {"owner": "me", "state": "new"})
    assert got["a/sub/y.md"] == ("src/a/sub/y", "document", "source", "outer/inner", "Y", {})
    assert got["b/Z.md"][:4] == ("src/b/z", "document", "rule#2", "unclassified") and "b/z.md" not in got
    checks = sorted((r.check, r.path) for r in found.collect() if not r.check.startswith("W-APP"))
    assert checks == [("E-ID-DUP", "b/z.md"), ("E-ID-INVALID", "a/sub/y.md"), ("E-TYPE-CONFLICT", "a/x.rule.md"), ("W-ATTRIBUTE-UNKNOWN", "a/x.rule.md"), ("W-DOMAIN-UNCLASSIFIED", "b/Z.md"), ("W-DOMAIN-UNCLASSIFIED", "b/z.md"), ("W-TYPE-UNKNOWN", "b/Z.md"), ("W-TYPE-UNKNOWN", "b/z.md")]


def test_mentions(spark):
    units = spark.createDataFrame([("p", 1, "The data object Order, of type: Order. screen Order")], "path string, line int, text string")
    known = scan.dictionary(spark.createDataFrame([("order", 1, "o1"), ("orders", 2, "o2")], "form string, priority int, id string"))
    found = scan.announced(units, scan.occurrences(units, known), {"object": ["data object"], "thing": ["object"], "screen": ["screen"], "type": ["type"], "a": ["twice"], "b": ["twice"]})
    rows = {(r.start, r.target): (r.expected_type, r.confidence) for r in scan.mentions(found, known).collect()}
    assert rows == {(3, "o1"): ("object", 0.35), (3, "o2"): ("object", 0.35), (6, "o1"): (None, 0.3), (6, "o2"): (None, 0.3), (8, "o1"): ("screen", 0.35), (8, "o2"): ("screen", 0.35)}
    assert [r.target for r in scan.recognised(scan.mentions(found, known)).orderBy("start").collect()] == ["o1"] * 3
    assert scan.announced(units, scan.occurrences(units, known), {}).where("expected_type is not null").count() == 0


def test_mention_links(spark):
    entities = spark.createDataFrame([("b", "term", "b.md"), ("a", "screen", "a.md")], "id string, type string, path string")
    found = spark.createDataFrame([("b.md", 1, "Uses", "a", 0.6), ("b.md", 2, None, "a", 0.6), ("b.md", 3, "Uses", "b", 0.6), ("a.md", 1, "Uses", "b", 0.5), ("none.md", 1, None, "a", 0.6)], "path string, line int, section string, target string, confidence double")
    sections = spark.createDataFrame([("term", "uses", "Uses", "uses", False), ("screen", "uses", "Uses", "uses", False)], "type string, heading string, name string, relation string, inverse boolean")
    allowed = spark.createDataFrame([("uses", "term", "screen")], "relation string, from_type string, to_type string")
    made = {tuple(r) for r in links.mention_links(found, entities, sections, allowed).collect()}
    assert made == {("b", "a", "uses", "section_mention", 0.7, "b.md", 1, "Uses"), ("a", "b", "related", "glossary_occurrence", 0.6, "b.md", 2, None), ("a", "b", "related", "glossary_occurrence", 0.5, "a.md", 1, None)}


def test_lint(spark):
    texts = {"a.md": "# A\n[x](b.md) [y](gone/c.md) [z](../other/n.md) [w](other:n.md) [v](other:none.md)\n", "b.md": "---\nid: Bad\n---\n# B", "deep/c.md": "---\n- no\n---\n# C\n[u](two.md)", "x/two.md": "# T", "y/two.md": "# T"}
    notes = markdown.parse_notes(spark.createDataFrame(list(texts.items()), "path string, text string"))
    files = spark.createDataFrame([(p, None) for p in texts] + [("bad.md", "E-ENCODING")], "path string, finding string")
    ids = spark.createDataFrame([(p, "same" if "two" in p else p, "Bad" if p == "b.md" else None) for p in texts], "path string, id string, invalid string")
    found = sorted((r.check, r.path) for r in lint.local(files, notes, ids, "repo").collect())
    assert found == [("E-ENCODING", "bad.md"), ("E-FM-INVALID", "deep/c.md"), ("E-ID-DUP", "y/two.md"), ("E-ID-INVALID", "b.md"), ("E-LINK-BROKEN", "a.md"), ("E-LINK-BROKEN", "deep/c.md")]
    fixes = {r.target: (r.proposed, r.refused) for r in lint.renamed_links(notes, files).collect()}
    assert fixes == {"gone/c.md": ("deep/c.md", None), "two.md": (None, "x/two.md, y/two.md")}
    own = spark.createDataFrame([("a.md", "a", "term", "Red gears", [], "en", {"about": '["o"]'})], "path string, id string, type string, title string, aliases array<string>, locale string, front map<string,string>")
    model = spark.createDataFrame([("o", "screen", "red gear", [], "en", "other", "n.md")], "id string, type string, title string, aliases array<string>, locale string, source string, path string")
    allowed = spark.createDataFrame([], "relation string, from_type string, to_type string")
    refs = spark.createDataFrame([("term", "about", "uses", False)], "type string, attribute string, relation string, inverse boolean")
    remote = lint.published(notes, files, own, model, allowed, refs, "repo", cross_source=False)
    assert sorted((r.check, r.line) for r in remote.na.fill(0).collect()) == [("E-LINK-BROKEN", 2), ("E-META-REL", 0), ("I-TERM-HOMONYM", 0), ("W-LINK-CROSS-SOURCE", 2), ("W-LINK-CROSS-SOURCE", 2)]
    assert lint.both(remote, remote).count() == remote.count()


def test_twins(spark):
    kind = "id string, locale string, source string, folder string, path string, base_name string, title string, heading string, declared string, commit string, text string"
    body = " ".join(f"w{i}" for i in range(80))
    rows = [("a", "en", "s", "f", "f/a.md", "plan", None, None, "../f/b.md", "c1", ""), ("b", "en", "s", "f", "f/b.md", "other", None, None, None, "c1", ""), ("c", "en", "s", "g", "g/c.md", "x", None, None, None, None, body), ("d", "en", "s", "g", "g/d.md", "y", None, None, None, None, body + " z"), ("e", "fr", "s", "g", "g/e.md", "q", None, None, None, None, body)]
    found = {(r.a, r.b): (r.score, r.verdict) for r in duplicates.reconciled(spark.createDataFrame(rows, kind)).collect()}
    assert found == {("a", "b"): (1.0, "merged"), ("c", "d"): (0.9, "reported")}
    lock = spark.createDataFrame([("b", "a")], "a string, b string")
    assert ("a", "b") not in {(r.a, r.b) for r in duplicates.reconciled(spark.createDataFrame(rows, kind), separated=lock).collect()}
    merged = duplicates.reconciled(spark.createDataFrame(rows, kind), merged=spark.createDataFrame([("d", "c")], "a string, b string"))
    into = {r.id: (r.into, r.representations) for r in duplicates.folded(spark.createDataFrame(rows, kind).select("id", "path"), merged).collect()}
    assert into["d"] == ("c", None) and into["c"] == ("c", ["g/c.md", "g/d.md"]) and into["e"] == ("e", None)


def test_pairs_of_names(spark):
    rows = spark.createDataFrame([(1, "Release plan"), (2, "release-plan"), (3, "Release plans"), (4, "else"), (5, None)], "id int, base_name string")
    assert {(r.a, r.b): r.name == 1 for r in duplicates.name_pairs(rows).collect()} == {(1, 2): True, (1, 3): False, (2, 3): False}


def test_numbered_and_bounded(spark):
    rows = spark.createDataFrame([("a" if i % 3 else None, i) for i in range(200)], "g string, i int")
    got = {(r.g, r.i): r.n for r in corpus.numbered(rows, ["g"], ["-i"]).collect()}
    for g in ("a", None):
        own = sorted((i for h, i in got if h == g), reverse=True)
        assert [got[g, i] for i in own] == list(range(1, len(own) + 1))
    assert corpus.numbered(rows.limit(0), ["g"], ["i"]).count() == 0 and corpus.numbered(rows, [], ["i"]).agg(F.max("n")).first()[0] == 200
    first = corpus.bounded(rows, ["g"], ["i"], 2).collect()
    assert sorted((r.g or "", r.i, r.place, r.more) for r in first) == [("", 0, 1, 65), ("", 3, 2, 65), ("a", 1, 1, 131), ("a", 2, 2, 131)]


def test_page_ids_pass_over_taken_numbers(spark):
    rows = spark.createDataFrame([("en", "a"), ("fr", "a"), ("en", "a 2"), ("fr", "à"), ("en", "b")], "lang string, key string")
    assert {(r.lang, r.key): r.id for r in terms.page_ids(rows).collect()} == {("en", "a"): "keywords/a", ("fr", "a"): "keywords/a-3", ("en", "a 2"): "keywords/a-2", ("fr", "à"): "keywords/a-4", ("en", "b"): "keywords/b"}


def test_similar_expressions_against_all_pairs(spark):
    words = ["red", "gear", "small", "box", "of", "iron"]
    keys = sorted({" ".join(words[(i * j) % 6] for j in range(1, 2 + i % 4)) for i in range(1, 60)} | {"red gear", "small red gear box", "iron"})
    want = {}
    for a in keys:
        near = []
        for b in keys:
            x, y = set(a.split()), set(b.split())
            if a != b and (f" {a} " in f" {b} " or f" {b} " in f" {a} " or 2 * len(x & y) >= max(len(x), len(y))):
                near.append((-len(x & y) / len(x | y), b))
        want[a] = [b for _, b in sorted(near)[:5]]
    found = {}
    for r in terms.similar(spark.createDataFrame([(k,) for k in keys], "key string")).orderBy("rank").collect():
        found.setdefault(r.key, []).append(r.other)
    assert found == {k: v for k, v in want.items() if v}


def test_privacy(spark):
    rows = spark.createDataFrame([("Émile Zola met Ann Lee, NASA Staff and Bob", ["Ann Lee"], "m"), (None, None, "n")], "t string, a array<string>, k string")
    assert [r[0] for r in rows.select(turns.personal_mentions("t", ["Ann Lee"])).collect()] == [["Émile Zola"], None]
    done = [tuple(r) for r in turns.pseudonymized(rows, ["t", "a"], ["Ann Lee"], F.col("k") == "m").collect()]
    assert done == [("Émile Zola met [person], NASA Staff and Bob", ["[person]"], "m", True), (None, None, "n", False)]
    docs = spark.createDataFrame([("cue", "vtt"), ("cue", "sbv"), ("page", "pdf")], "unit string, format string")
    shown = lambda **k: [r.published for r in turns.withheld(docs, **k).collect()]
    assert shown(publish=False, enabled=False, dictionary=False) == [False, False, True] and shown(publish=True, enabled=True, dictionary=False) == [False, False, True]
    assert shown(publish=True, enabled=True, dictionary=True) == [True, False, True] and shown(publish=True, enabled=False, dictionary=False) == [True, True, True]


def test_transcripts_are_pseudonymized(spark):
    cues = spark.createDataFrame([("c", 1, "Bob (PM)", "hi Ann, I am Bob (PM)"), ("c", 2, "Ann", "Annabel and Ann and Zed"), ("c", 3, None, "Bob (PM) left"), ("d", 1, "Ann", None)], "conv string, turn int, who string, text string")
    made = [tuple(r) for r in turns.pseudonymized_transcript(cues, "conv", "turn", "who", "text", ["Zed", "Ann"]).orderBy("conv", "turn").collect()]
    assert made == [("c", 1, "Speaker 1", "hi Speaker 2, I am Speaker 1"), ("c", 2, "Speaker 2", "Annabel and Speaker 2 and [person]"), ("c", 3, None, "Speaker 1 left"), ("d", 1, "Speaker 1", None)]


def test_operations(spark):
    kind = "id string, attributes map<string,string>, a string"
    notes = spark.createDataFrame([("n1", {"x": "own"}, "1", True), ("n2", {}, "2", True), ("n3", {}, "2", True), ("n4", {}, "9", True), ("n5", {}, None, False)], kind + ", declared boolean")
    ops = spark.createDataFrame([("o1", {"x": "api", "y": "get"}, "1", "c", "one"), ("o2", {}, "2", "c", "two")], kind + ", location string, name string")
    made = references.attached_operations(notes, ops, spark.createDataFrame([("api", "o1"), ("api", "o2")], "from string, to string"), ["a"])
    assert {r.id: (r.attributes, r.grouped_by) for r in made["entities"].collect()}["n1"] == ({"x": "own", "y": "get"}, "a")
    assert sorted(r.to for r in made["links"].collect()) == ["n1", "o2"]
    assert sorted((r.check, r.entity) for r in made["findings"].collect()) == [("W-OPERATION-AMBIGUOUS", "n2"), ("W-OPERATION-AMBIGUOUS", "n3"), ("W-OPERATION-UNMATCHED", "n4")]


def test_private_hosts(spark):
    urls = ["http://localhost:80/c", "https://10.1.2.3/c", "https://[::1]/c", "http://172.16.0.1", "http://172.32.0.1", "https://example.org/c", "http://user@192.168.0.1/c", "http://x.local/"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in rows.select(contracts.private(F.col("u"))).collect()] == [True, True, True, True, False, False, True, True]


def test_ingest(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    (repo / "a.md").write_text("# A")
    (repo / "b.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nhi")
    run("init", "-q")
    run("add", ".")
    run("commit", "-q", "-m", "one", "--date", "2020-01-02T00:00:00Z")
    (repo / "new.md").write_text("# New")
    (repo / "out").mkdir()
    (repo / "out" / "made.md").write_text("# Made")
    files, bad = ingest.ingested(spark, [ingest.Origin("r", str(repo), outputs=("out",)), ingest.Origin("gone", str(tmp_path / "none")), ingest.Origin("clone", str(tmp_path / "c"), git=str(repo))])
    rows = {(r.source, r.path): r for r in files.collect()}
    assert set(rows) == {("r", "a.md"), ("r", "b.vtt"), ("r", "new.md"), ("clone", "a.md"), ("clone", "b.vtt")}
    assert rows["r", "a.md"].commit == rows["clone", "a.md"].commit and rows["r", "new.md"].commit is None and rows["r", "new.md"].last_modified
    assert [(r.check, r.source) for r in bad.collect()] == [("W-SOURCE-UNREACHABLE", "gone")]
    read, rest = ingest.dispatched(files.withColumn("path", F.concat("path", F.lit(""))))
    assert {r.title for r in read["markdown"].collect()} == {"A", "New"} and read["transcripts"].count() == 2 and rest.count() == 0


def test_plugins(spark):
    registry = plugins.Registry()
    check = lambda model: model["entities"].select(F.lit("X-OWN").alias("check"), F.col("id").alias("entity"), F.lit("m").alias("message"))
    source = lambda s: (s.createDataFrame([("e1",)], "id string"), s.createDataFrame([("e1", "e2", "uses")], "from string, to string, relation string"))
    assert registry.register(plugins.Plugin("one", checks={"X-OWN": ("warning", check)}, sources=(source,), types={"gadget": ("size",)}, converters={"odt": lambda df: df}))
    assert not registry.register(plugins.Plugin("two", programs=("no-such-program",))) and not registry.register(plugins.Plugin("three", checks={"E-ENCODING": ("error", check)}))
    entities, made = registry.contributed(spark)
    found = [(r.check, r.entity, r.severity) for r in registry.checked(spark, {"entities": entities}).collect()]
    assert sorted(found) == [("W-PLUGIN-DISABLED", "three", "warning"), ("W-PLUGIN-DISABLED", "two", "warning"), ("X-OWN", "e1", "warning")]
    assert made.count() == 1 and registry.types({"term": ()}) == {"gadget": ("size",), "term": ()} and registry.converted(entities, "pdf") is None and registry.converted(entities, "odt") is entities
    base = {"types": {"a": {"x": 1}}, "relations": {"uses": {"allowed": [["a", "b"]], "directed": True}}}
    over = {"types": {"a": {"y": 2}}, "relations": {"uses": {"allowed": [["a", "b"], ["b", "c"]]}}, "list": [1]}
    assert plugins.merged_profiles(base, over) == {"list": [1], "types": {"a": {"x": 1, "y": 2}}, "relations": {"uses": {"allowed": [["a", "b"], ["b", "c"]], "directed": True}}}


def test_answers(spark, tmp_path):
    entity = "id string, type string, title string, aliases array<string>, domain string, application string, source string, path string, status string, modified string"
    rows = [("t/red", "term", "Red gear", [], "stock", None, "s", "red.md", "valid", "2020-01-02"), ("d/one", "decision", "Use red", [], None, None, "s", "one.md", "draft", "2020-02-02"), ("x/box", "object", "Box", [], "stock", None, "s", "box.md", "valid", None)]
    blocks = {
        "entities": spark.createDataFrame(rows, entity),
        "links": spark.createDataFrame([("t/red", "x/box", "uses", 0.9, "explicit_link", 1), ("d/one", "t/red", "related", 0.6, "glossary_occurrence", 2)], "from string, to string, relation string, confidence double, methods string, provenances long"),
        "occurrences": spark.createDataFrame([("t/red", "one.md", 3, "a red gear"), ("t/red", "one.md", 3, "the whole red gear")], "target string, path string, line int, context string"),
        "findings": spark.createDataFrame([("E-LINK-BROKEN", "one.md", 1)], "check string, path string, line int"),
        "terms": spark.createDataFrame([("en", "iron box", 5, 3)], "lang string, key string, occurrences long, documents long"),
    }
    path = str(tmp_path / "model")
    sinks.write_model(blocks, path)
    sinks.write_index(search.postings(spark.createDataFrame([(r[0], "title", r[2]) for r in rows], "entity string, field string, text string")), f"{path}/postings")
    spark.createDataFrame([("t/red", "the red gear turns")], "id string, text string").write.parquet(f"{path}/fragments")
    model = answers.Model(spark, path)
    ask = lambda tool, **a: json.loads(answers.call(model, tool, a))
    found = ask("lookup", expression="red gears")
    assert found["entity"]["id"] == "t/red" and [(e["id"], e["direction"]) for e in found["links"]["entries"]] == [("x/box", "out"), ("d/one", "in")]
    assert [e["context"] for e in found["occurrences"]["entries"]] == ["the whole red gear"] and [e["id"] for e in found["related"]] == ["d/one"]
    assert ask("relations", expression="t/red", other="x/box")["path"] == ["t/red", "x/box"] and ask("relations", expression="x/box", radius=2)["near"]["entries"][1]["id"] == "d/one"
    assert [e["entity"] for e in ask("search", query="red")["hits"]["entries"]] == ["t/red", "d/one"] and ask("search", query="gearing")["closest"] == {"gearing": "gear"}
    assert ask("list", domain="stock")["list"]["entries"][0]["id"] == "t/red" and ask("corpus", question="undefined")["undefined"]["entries"][0]["key"] == "iron box"
    assert ask("corpus", question="recent", since="2020-02-01")["recent"]["entries"][0]["id"] == "d/one" and ask("corpus", question="findings", check="E-LINK-BROKEN")["findings"]["more"] == 0
    assert ask("passages", phrase="Red  Gear")["passages"]["entries"][0]["position"] == 5 and any(r["dimension"] == "type" for r in ask("corpus")["stats"])
    text = answers.call(model, "lookup", {"expression": "Use red"}, "text")
    assert text.startswith("d/one — Use red [decision · draft]\n") and "→ t/red" in text and text == answers.call(model, "lookup", {"expression": "Use red"}, "text")
    assert ask("lookup", expression="nothing")["candidates"] == []
    with pytest.raises(ValueError):
        answers.call(model, "lookup", {"expression": "x", "wrong": 1})
    assert answers.age(datetime(2020, 1, 1), datetime(2020, 1, 1, 0, 30)) == "30 min ago" and answers.age(datetime(2020, 1, 1), datetime(2020, 1, 4)) == "3 days ago"


def test_views(spark):
    links_ = spark.createDataFrame([("d2", "d1", "supersedes", None, None), ("m1", "d1", "related", "t.vtt", 4), ("d1", "m1", "related", "t.vtt", 9), ("d1", "m1", "related", "x", 99)], "from string, to string, relation string, path string, line int")
    decisions = spark.createDataFrame([("d1", "s", None), ("d2", "s", "d3"), ("d3", "s", "gone"), ("s/d4", "s", None), ("d5", "s", "d4")], "id string, source string, superseded_by string")
    assert {r.id: (r.supersedes, r.superseded_by) for r in views.supersession(decisions, links_).collect()} == {"d1": (None, "d2"), "d2": ("d1", "d3"), "d3": (None, None), "s/d4": (None, None), "d5": (None, "s/d4")}
    meetings = spark.createDataFrame([("m1", "2020-01-01", "t.vtt", ["a"], " "), ("m2", None, None, None, "2 h")], "id string, date string, transcript string, participants array<string>, duration string")
    assert [tuple(r) for r in views.sessions(decisions, meetings, links_).collect()] == [("d1", "m1", "2020-01-01", 9)]
    cues = spark.createDataFrame([("t.vtt", 61.5)], "path string, start double")
    assert {tuple(r) for r in views.meeting_figures(meetings, decisions, links_, cues).collect()} == {("m1", 1, 9, 1, "00:01:01.500"), ("m2", 0, None, None, "2 h")}
    values = views.category_values(spark.createDataFrame([("c", ["A b", "a-b", "z"]), ("c", ["z"])], "category string, tags array<string>"), "tags")
    assert {(r.value, r.n) for r in values.collect()} == {("A b", 2), ("z", 2)}


def test_pdf_text_and_conversion(spark, tmp_path):
    import sys
    import zlib

    packed = zlib.compress(b"BT /F1 12 Tf (Second \\(page\\)) Tj T* [(k) -20 (ern)] TJ ET")
    info = zlib.compress(b"<< /Title (Packed) /ModDate (D:20210304) >> << /Type /Page >>")
    pdf = b"%PDF-1.5\n<< /Length 1 /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\n<< /Type /ObjStm /Filter /FlateDecode >> stream\n" + info + b"\nendstream"
    plain = b"%PDF-1.4 << /Length 9 >> stream\nBT (One) Tj ET\nendstream << >> stream\nBT (T\\167o) Tj ET\nendstream"
    rows = spark.createDataFrame([("a", bytearray(pdf)), ("b", bytearray(plain)), ("c", bytearray(b"no")), ("d", None), ("e", bytearray(b"%PDF-1.4" + b"x" * 70_000))], "path string, content binary")
    found = sorted((r.path, r.page or 0, r.text or "", r.finding or "") for r in office.page_texts(rows).collect())
    assert found == [("a", 1, "Second (page)\nkern", ""), ("b", 1, "One", ""), ("b", 2, "Two", ""), ("c", 0, "", "W-CONV-FAILED"), ("d", 0, "", "W-CONV-FAILED"), ("e", 0, "", "W-CONV-SUSPECT")]
    assert {r.path: (r.title, r.modified, r.pages) for r in office.document_properties(rows.where("path = 'a'")).collect()}["a"] == ("Packed", "2021-03-04", 1)
    script = "import sys, pathlib; b = pathlib.Path(sys.argv[1]).read_bytes(); b == b'bad' and sys.exit(1); pathlib.Path(sys.argv[2], 'x.pdf').write_bytes(b'%PDF-' + b)"
    files = spark.createDataFrame([("x.docx", bytearray(b"one")), ("y.docx", bytearray(b"one")), ("z.docx", bytearray(b"bad"))], "path string, content binary")
    made = {tuple(r.paths): (bytes(r.pdf) if r.pdf else None, r.finding) for r in office.converted(files, [sys.executable, "-c", script, "{in}", "{out}"]).collect()}
    assert made == {("x.docx", "y.docx"): (b"%PDF-one", None), ("z.docx",): (None, "W-CONV-FAILED")}
