"""Markdown notes: frontmatter, title, sections, links, code, and the units that term recognition reads.

A small parser: headings of both kinds, fences, list items, table cells, quotes, paragraphs; a unit is a whole paragraph,
item, cell or quote, soft line breaks included, and carries its first line.  Links and code are taken out of the units, the
places of inline code are kept."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

try:
    import yaml
except ImportError:  # the own reader does
    yaml = None

HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
FENCE = re.compile(r"^\s*(```+|~~~+)")
ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
UNDERLINE, RULE = re.compile(r"^ {0,3}(=+|-+)\s*$"), re.compile(r"^ {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")
LINK = re.compile(r"(!?)\[([^\]]*)\]\(\s*(?:<([^<>]*)>|([^)\s>]*))(?:\s+[\"'][^)]*)?\s*\)")
URL = re.compile(r"<?https?://[^\s>)]+>?")
CODE = re.compile(r"(`+)(.+?)\1")
TAG = re.compile(r"</?[A-Za-z][^>]*>")


def frontmatter(text: str) -> tuple[dict | None, int, str | None]:
    """(mapping, lines that it takes, finding).  Scalars, lists, nested mappings and block texts by PyYAML where it is there;
    else by a reader of scalars, flow lists, dashed lists and mappings one below another.  Anything else is E-FM-INVALID."""
    lines = text.split("\n")
    if not lines or lines[0].rstrip() != "---":
        return {}, 0, None
    end = next((i for i, line in enumerate(lines[1:], 1) if line.rstrip() in ("---", "...")), None)
    if end is None:
        return {}, 0, None
    body = [line.rstrip("\r") for line in lines[1:end]]
    try:
        out = yaml_mapping("\n".join(body)) if yaml is not None else block(body)
    except ValueError:
        return None, end + 1, "E-FM-INVALID"
    return out, end + 1, None


def yaml_mapping(text: str) -> dict:
    try:
        found = yaml.load(text, Loader=yaml.BaseLoader)  # every scalar as it is written
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from None
    if found in (None, ""):
        return {}
    if not isinstance(found, dict):
        raise ValueError("no mapping")

    def typed(x: object, node: object = None) -> object:
        if isinstance(x, dict):
            return {str(k): typed(v) for k, v in x.items()}
        if isinstance(x, list):
            return [typed(v) for v in x]
        return scalar(x) if isinstance(x, str) else x

    return typed(found)


def block(lines: list[str]) -> dict:
    """A mapping of scalars, flow lists, dashed lists and mappings below one another by their indent, and block texts."""
    rows = [(len(line) - len(line.lstrip()), line.strip()) for line in lines if line.strip() and not line.lstrip().startswith("#")]
    at = 0

    def value(indent: int, written: str) -> object:
        nonlocal at
        if written in ("|", ">", "|-", ">-"):
            some = []
            while at < len(rows) and rows[at][0] > indent:
                some.append(rows[at][1])
                at += 1
            return ("\n" if written[0] == "|" else " ").join(some)
        if written.startswith("[") and written.endswith("]"):
            return [scalar(x) for x in written[1:-1].split(",") if x.strip()]
        if written:
            return scalar(written)
        if at < len(rows) and (rows[at][0] > indent or (rows[at][0] == indent and rows[at][1].startswith("- "))):
            return listed(rows[at][0]) if rows[at][1].startswith("-") else mapping(rows[at][0])
        return None

    def listed(indent: int) -> list:
        nonlocal at
        out = []
        while at < len(rows) and rows[at][0] == indent and rows[at][1].startswith("-"):
            written = rows[at][1][1:].strip()
            at += 1
            out.append(value(indent, written))
        return out

    def mapping(indent: int) -> dict:
        nonlocal at
        out: dict = {}
        while at < len(rows) and rows[at][0] == indent and (m := re.match(r"^([^\s:][^:]*?)\s*:(?:\s+(.*))?$", rows[at][1])):
            at += 1
            out[m[1].strip("\"'")] = value(indent, (m[2] or "").strip())
        return out

    out = mapping(rows[0][0]) if rows else {}
    if at < len(rows):
        raise ValueError("no mapping")
    return out


def scalar(text: str) -> str | int | float | bool | None:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    if text in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def unit(line: int, kind: str, text: str, section: str | None) -> dict | None:
    """A text unit without code, addresses, tags and link targets; code: (place, text) of inline code taken out."""
    text = LINK.sub(lambda m: "" if m[1] else m[2], text)
    code, out, at = [], [], 0
    for m in CODE.finditer(text):
        out.append(text[at : m.start()])
        code.append({"at": sum(map(len, out)), "text": m[2]})
        at = m.end()
    text = TAG.sub("", URL.sub("", "".join([*out, text[at:]])))
    lead = len(text) - len(text.lstrip())
    code = [{"at": max(0, c["at"] - lead), "text": c["text"]} for c in code]
    return {"line": line, "kind": kind, "text": text.strip(), "section": section, "code": json.dumps(code)} if text.strip() else None


def parse(text: str) -> dict:
    """title, sections, links, units, frontmatter and finding of one note."""
    front, skip, finding = frontmatter(text)
    out: dict = {"title": None, "sections": [], "links": [], "units": [], "frontmatter": json.dumps(front or {}, sort_keys=True, ensure_ascii=False), "finding": finding}
    section, fence, held = None, None, []  # held: (kind, first line, texts) of the paragraph, item or quote that goes on

    def close() -> None:
        if held:
            kind, first, texts = held.pop()
            whole = " ".join(t.strip() for t in texts)
            out["links"] += [{"line": first, "text": m[2], "target": m[4] if m[3] is None else m[3], "image": bool(m[1])} for m in LINK.finditer(CODE.sub("", whole))]
            out["units"].append(unit(first, kind, whole, section))

    lines = text.split("\n")
    for n, line in enumerate(lines[skip:], skip + 1):
        line = line.rstrip("\r")
        if fence:
            fence = None if line.strip().startswith(fence) else fence
            continue
        if m := FENCE.match(line):
            close()
            fence = m[1]
            continue
        below = UNDERLINE.match(line) if held and held[0][0] == "paragraph" else None
        if below or (m := HEADING.match(line)):
            if below:  # a paragraph with a line of = or - below it is a heading
                _, n, texts = held.pop()
                level, title = 1 if line.strip()[0] == "=" else 2, " ".join(t.strip() for t in texts)
            else:
                close()
                level, title = len(m[1]), m[2]
            if level == 1:
                out["title"] = title if out["title"] is None else out["title"]
                section = None
            if level == 2:
                section = title
                out["sections"].append({"line": n, "heading": title})
            held.append(("heading", n, [title]))
            close()
        elif not line.strip() or RULE.match(line):
            close()
        elif line.lstrip().startswith("|"):
            close()
            if not re.fullmatch(r"[|:\s-]+", line.strip()):
                for cell in line.strip().strip("|").split("|"):
                    held.append(("table", n, [cell]))
                    close()
        elif ITEM.match(line):
            close()
            held.append(("list", n, [ITEM.sub("", line, count=1)]))
        elif line.lstrip().startswith(">"):
            if held and held[0][0] != "quote":
                close()
            if not (inner := line.lstrip().lstrip("> ")).strip():
                close()
            elif held:
                held[0][2].append(inner)
            else:
                held.append(("quote", n, [inner]))
        elif held:
            held[0][2].append(line)
        else:
            held.append(("paragraph", n, [line]))
    close()
    out["units"] = [u for u in out["units"] if u]
    return out


SCHEMA = (
    "path string, title string, frontmatter string, finding string, sections array<struct<line:int,heading:string>>, "
    "links array<struct<line:int,text:string,target:string,image:boolean>>, units array<struct<line:int,kind:string,text:string,section:string,code:string>>"
)


def parse_notes(files: DataFrame) -> DataFrame:
    """One row a file (path, text); see SCHEMA."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "title", "frontmatter", "finding", "sections", "links", "units"]
        for frame in frames:
            yield pd.DataFrame([{"path": p, **parse(t or "")} for p, t in zip(frame["path"], frame["text"])], columns=names)

    return files.select("path", "text").mapInPandas(run, SCHEMA)
