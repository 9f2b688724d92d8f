"""Questions on a stored model, and their answers as text or JSON; the tools of an assistant are the same questions.

A model is a folder as `sinks.write_model` leaves it: entities (id, type, title, aliases, domain, application, source, path,
status, modified), links (from, to, relation, confidence, methods, provenances), occurrences (target, path, line, context),
findings, terms, and the search index's postings.  Answers are bounded lists; what is beyond them is counted."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import corpus, graph, links, search
from sparkloom.sources.sinks import read_model


class Model:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self.blocks = path, read_model(spark, path)
        self.entities, self.links = self.blocks["entities"], self.blocks["links"]

    def resolve(self, expression: str) -> list[dict]:
        """The entities that an expression names; a single term wins among several."""
        found = search.resolve(self.entities, expression).join(self.entities, "id")
        rows = [r.asDict(recursive=True) for r in found.orderBy("id").limit(51).collect()]
        terms = [r for r in rows if r["type"] == "term"]
        return terms if len(rows) > 1 and len(terms) == 1 else rows


def bounded(rows: DataFrame, order: list[Any], most: int) -> dict:
    """{entries, more}: the first rows and how many there are beyond."""
    entries = [r.asDict(recursive=True) for r in rows.orderBy(*order).limit(most).collect()]
    return {"entries": entries, "more": max(0, rows.count() - most) if len(entries) == most else 0}


def lookup(model: Model, expression: str, *, direction: str | None = None, relation: str | None = None, limit: int = 10) -> dict:
    found = model.resolve(expression)
    if len(found) != 1:
        return {"expression": expression, "candidates": [{k: r[k] for k in ("id", "title", "type")} for r in found]}
    id_ = found[0]["id"]
    types = model.entities.select("id", "title", "type")
    out: dict = {"entity": found[0]}
    if "occurrences" in model.blocks:
        own = model.blocks["occurrences"].where(F.col("target") == id_).groupBy("path", "line").agg(F.max_by("context", F.length("context")).alias("context"))
        out["occurrences"] = bounded(own, ["path", "line"], limit)
    linked = links.linked_to(model.links, id_, direction, relation).join(types, "id")
    out["links"] = bounded(linked, [F.desc("confidence"), "id", "relation"], limit)
    out["related"] = [r.asDict() for r in links.related_to(model.links, types.select("id", "type"), id_).orderBy(F.desc("confidence"), "id").collect()]
    return out


def relations(model: Model, expression: str, *, other: str | None = None, radius: int = 2, limit: int = 50) -> dict:
    """What lies about an entity; with another one, the links and the shortest way between the two."""
    ends = [model.resolve(e) for e in (expression, other) if e is not None]
    if any(len(e) != 1 for e in ends):
        return {"candidates": [[r["id"] for r in e] for e in ends]}
    if other is None:
        start = model.entities.where(F.col("id") == ends[0][0]["id"]).select("id")
        return {"near": bounded(graph.near(model.links, start, radius).select("id", "depth", "score"), ["depth", F.desc("score"), "id"], limit)}
    a, b = ends[0][0]["id"], ends[1][0]["id"]
    found = links.explained(model.links, a, b).orderBy(F.desc("confidence"), "relation").collect()
    return {"explained": [r.asDict(recursive=True) for r in found], "path": [r.id for r in graph.path(model.links, a, b).orderBy("step").collect()]}


def searched(model: Model, query: str, *, limit: int = 10) -> dict:
    words = T.question_words(query)
    if not words:
        return {"words": [], "hits": {"entries": [], "more": 0}}
    cited = model.links.groupBy(F.col("to").alias("entity")).agg(F.count_distinct("from").alias("cited"))
    hits = search.ranked(model.blocks["postings"], words, cited).join(model.entities.select(F.col("id").alias("entity"), "title", "type"), "entity")
    out = {"words": words, "hits": bounded(hits, ["rank"], limit)}
    if not out["hits"]["entries"]:
        out["closest"] = {w: r.token for w in words for r in search.closest(model.blocks["postings"], w).collect() if r.token}
    return out


def listed(model: Model, *, limit: int = 500, all_: bool = False, **wanted: str) -> dict:
    rows = corpus.listed(model.entities, **wanted)
    if not wanted and not all_ and len(rows.select("id").limit(501).collect()) > 500:
        return {"refused": "over 500 entities: narrow the list, or ask for all"}
    return {"list": bounded(rows.select("id", "title", "type"), ["id"], limit)}


def about(model: Model, *, question: str = "stats", check: str | None = None, since: str | None = None, min_documents: int = 2, limit: int = 50) -> dict:
    """The corpus as a whole: stats, sources, domains, findings, recent, undefined."""
    e = model.entities
    if question == "stats":
        return {"stats": [r.asDict() for r in corpus.count_by(e, [c for c in ("type", "domain", "application", "source", "status") if c in e.columns]).orderBy("dimension", F.desc("n"), "value").collect()]}
    if question in ("sources", "domains"):
        key = question[:-1]
        return {question: bounded(e.groupBy(F.coalesce(F.col(key), F.lit("(none)")).alias(key)).agg(F.count("*").alias("n"), F.max("modified").alias("newest")), [key], limit)}
    if question == "findings":
        found = model.blocks["findings"]
        return {"findings": bounded(found.where(F.col("check") == check) if check else found, ["check", "path", "line"], limit)}
    if question == "recent":
        rows = e.where("modified is not null")
        return {"recent": bounded((rows.where(F.col("modified") >= since) if since else rows).select("id", "title", "modified"), [F.desc("modified"), "id"], limit)}
    if question == "undefined":
        return {"undefined": bounded(model.blocks["terms"].where(F.col("documents") >= min_documents).select("key", "documents", "occurrences"), [F.desc("documents"), F.desc("occurrences"), "key"], limit)}
    raise ValueError(f"no question of the corpus: {question}")


def passages(model: Model, phrase: str, *, limit: int = 20) -> dict:
    rows = model.blocks["fragments"].select("id", "text")
    return {"passages": bounded(search.passages(rows, T.normal_question(phrase)), ["id", "position"], limit)}


#: The tools of an assistant: each question by its name, with what it takes.
TOOLS: dict[str, tuple[Callable[..., dict], tuple[str, ...]]] = {
    "lookup": (lookup, ("expression", "direction", "relation", "limit")), "relations": (relations, ("expression", "other", "radius", "limit")), "search": (searched, ("query", "limit")),
    "list": (listed, ("type", "domain", "application", "source", "status", "limit", "all_")), "corpus": (about, ("question", "check", "since", "min_documents", "limit")), "passages": (passages, ("phrase", "limit")),
}


def call(model: Model, tool: str, arguments: dict[str, Any], format_: str = "json") -> str:
    """A tool's answer as JSON or text; an argument that it does not take is an error."""
    f, takes = TOOLS[tool]
    if strange := sorted(set(arguments) - set(takes)):
        raise ValueError(f"{tool} does not take {', '.join(strange)}")
    answer = f(model, **arguments)
    return json.dumps(answer, ensure_ascii=False, sort_keys=True, default=str) if format_ == "json" else rendered(answer)


def age(at: datetime, now: datetime) -> str:
    """Minutes under an hour, hours under two days, else days."""
    minutes = max(0, round((now - at).total_seconds() / 60))
    return f"{minutes} min ago" if minutes < 60 else f"{round(minutes / 60)} h ago" if round(minutes / 60) < 48 else f"{round(minutes / 1440)} days ago"


def short(text: str, most: int) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= most else flat[: most - 1] + "…"


def headline(e: dict) -> str:
    domain, status = (f" · domain {e['domain']}" if e.get("domain") else ""), (f" · {e['status']}" if e.get("status", "valid") != "valid" else "")
    return f"{e['id']} — {e['title']} [{e['type']}{domain}{status}]"


def rendered(answer: dict, most: int = 160) -> str:
    """An answer as lines of text, the same for the same answer."""
    lines = []
    for name, value in answer.items():
        if name == "entity":
            lines.append(headline(value))
            continue
        entries = value["entries"] if isinstance(value, dict) and "entries" in value else value if isinstance(value, list) else [value]
        lines.append(f"{name}:")
        for e in entries:
            if isinstance(e, dict) and "direction" in e and "id" in e:
                lines.append(f"  {'→' if e['direction'] == 'out' else '←'} {e['id']} — {e.get('title', '')} [{e.get('type', '')}] {e['relation']} {e['confidence']:.2f} ({e['methods']})")
            elif isinstance(e, dict):
                lines.append("  " + short(", ".join(f"{k} {v}" for k, v in sorted(e.items()) if v is not None), most))
            else:
                lines.append(f"  {e}")
        if isinstance(value, dict) and value.get("more"):
            lines.append(f"  … {value['more']} more")
    return "\n".join(lines) + "\n"
