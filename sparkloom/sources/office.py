"""Office documents and PDF: their own metadata, the text of PDF pages, and conversion by a program of the project's."""

from __future__ import annotations

import io
import re
import subprocess
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART, TAIL, WHOLE = 8 << 20, 16 << 20, 64 << 20
#: A file of more bytes that shows no text is suspect.
SUSPECT = 64 << 10


def ooxml(content: bytes) -> dict:
    """title, author, modified, pages and slides of a docx, pptx or xlsx; parts over 8 MB are skipped."""
    out: dict = {"title": None, "author": None, "modified": None, "pages": None, "slides": []}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {i.filename: i for i in z.infolist() if i.file_size <= PART}
        xml = lambda name: ElementTree.fromstring(z.read(parts[name])) if name in parts else ElementTree.Element("none")
        for x in xml("docProps/core.xml"):
            name = {"title": "title", "creator": "author", "modified": "modified"}.get(x.tag.rpartition("}")[2])
            if name:
                out[name] = x.text
        for x in xml("docProps/app.xml"):
            if x.tag.rpartition("}")[2] in ("Pages", "Slides") and (x.text or "").isdigit():
                out["pages"] = int(x.text)
        slides = sorted((int(m[1]), n) for n in parts if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for _, name in slides:
            texts = [t.text or "" for t in xml(name).iter() if t.tag.endswith("}t")]
            out["slides"].append(texts[0] if texts else "")
    return out


def inflated(content: bytes, kinds: tuple[bytes, ...] = (b"/ObjStm",)) -> Iterator[bytes]:
    """What the compressed streams of some kinds hold (of all without kinds), PART bytes of each at most; broken ones are
    left out."""
    for m in re.finditer(rb"<<((?:[^<>]|<(?!<)|>(?!>)|<<[^<>]*>>)*)>>\s*stream\r?\n", content):
        head = m[1]
        if b"/FlateDecode" not in head or (kinds and not any(k in head for k in kinds)):
            continue
        end = content.find(b"endstream", m.end())
        try:
            yield zlib.decompressobj().decompress(content[m.end() : end if end >= 0 else None], PART)
        except zlib.error:
            continue


SHOWN = re.compile(rb"\[((?:[^\[\]\\]|\\.)*)\]\s*TJ|(\((?:[^()\\]|\\.)*\))\s*(?:Tj|'|\")|(T\*|Td|TD|ET)")


def shown(stream: bytes) -> str:
    """The text that a content stream shows by its simple operators; fonts with own encodings are not followed."""
    out: list[str] = []
    for m in SHOWN.finditer(stream):
        if m[3]:
            out.append("\n")
            continue
        for part in re.findall(rb"\(((?:[^()\\]|\\.)*)\)", m[1] if m[1] is not None else m[2]):
            raw = re.sub(rb"\\([0-7]{1,3})", lambda o: bytes([int(o[1], 8) & 255]), part)
            out.append(re.sub(rb"\\(.)", rb"\1", raw).decode("cp1252", "replace"))
    return re.sub(r"\s*\n\s*", "\n", "".join(out)).strip()


def pdf_pages(content: bytes) -> list[str]:
    """The text of each page, in the order of the file's content streams; compressed or not."""
    plain = [m[1] for m in re.finditer(rb"stream\r?\n(.*?)endstream", content, re.S) if b" Tf" in m[1] or b"BT" in m[1]]
    found = [s for s in inflated(content, ()) if b"BT" in s] or [s for s in plain if b"BT" in s]
    return [t for s in found if (t := shown(s))]


def page_texts(files: DataFrame) -> DataFrame:
    """(path, page, text, finding) from (path, content) of PDF files: a row a page with text; one that has none, though it is
    large, is W-CONV-SUSPECT, one that is no PDF W-CONV-FAILED."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for path, content in zip(frame["path"], frame["content"]):
                content = bytes(content or b"")
                if not content.startswith(b"%PDF-"):
                    rows.append((path, None, None, "W-CONV-FAILED"))
                    continue
                texts = pdf_pages(content)
                rows += [(path, n, t, None) for n, t in enumerate(texts, 1)] or [(path, None, None, "W-CONV-SUSPECT" if len(content) > SUSPECT else None)]
            yield pd.DataFrame(rows, columns=["path", "page", "text", "finding"]).astype(object).where(lambda d: d.notna(), None)

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, finding string")


def converted(files: DataFrame, command: list[str], *, seconds: int = 120, most: int = 64 << 20) -> DataFrame:
    """(fingerprint, paths, pdf binary, finding) of office files (path, content) by a program that executors have: `command`
    with {in} and {out} (a folder) in its words.  Equal contents are converted once; one that is too large, fails, takes
    longer or gives no PDF is W-CONV-FAILED."""
    once = files.groupBy(F.sha2("content", 256).alias("fingerprint")).agg(F.min("content").alias("content"), F.array_sort(F.collect_set("path")).alias("paths"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, content, paths in zip(frame["fingerprint"], frame["content"], frame["paths"]):
                pdf_ = None
                with tempfile.TemporaryDirectory() as folder:  # one conversion's own files
                    at = Path(folder, "in" + Path(paths[0]).suffix)
                    at.write_bytes(bytes(content))
                    try:
                        if len(content) <= most:
                            subprocess.run([w.format_map({"in": at, "out": folder}) for w in command], check=True, capture_output=True, timeout=seconds)
                            pdf_ = next((p.read_bytes() for p in sorted(Path(folder).glob("*.pdf"))), None)
                    except (subprocess.SubprocessError, OSError):
                        pdf_ = None
                rows.append((key, list(paths), pdf_, None if pdf_ else "W-CONV-FAILED"))
            yield pd.DataFrame(rows, columns=["fingerprint", "paths", "pdf", "finding"])

    return once.mapInPandas(run, "fingerprint string, paths array<string>, pdf binary, finding string")


def pdf(content: bytes) -> dict:
    """title, author, modified and pages from the last Info dictionary and the page objects; of a file over 64 MB the last
    16 MB are read and pages are not counted."""
    some = content if len(content) <= WHOLE else content[-TAIL:]
    some += b"\n".join(inflated(some))  # object streams hold dictionaries and pages too
    texts = lambda key: re.findall(rb"/" + key + rb"\s*\(((?:[^()\\]|\\.)*)\)", some)

    def last(key: bytes) -> str | None:
        found = texts(key)
        if not found:
            return None
        raw = re.sub(rb"\\(.)", rb"\1", found[-1])
        return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")

    date = re.match(r"D:(\d{4})(\d\d)?(\d\d)?", last(b"ModDate") or last(b"CreationDate") or "")
    iso = "-".join(p for p in date.groups() if p) if date else None
    pages = len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", some)) if len(content) <= WHOLE else None
    return {"title": last(b"Title"), "author": last(b"Author"), "modified": iso, "pages": pages, "slides": []}


def document_properties(files: DataFrame) -> DataFrame:
    """(path, title, author, modified, pages, slides, finding) from (path, content); unreadable ones give W-CONV-FAILED."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "title", "author", "modified", "pages", "slides", "finding"]
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows.append({"path": path, **(pdf if bytes(content[:5]) == b"%PDF-" else ooxml)(bytes(content)), "finding": None})
                except (zipfile.BadZipFile, ElementTree.ParseError, TypeError):
                    rows.append({"path": path, "finding": "W-CONV-FAILED"})
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    return files.select("path", "content").mapInPandas(run, "path string, title string, author string, modified string, pages int, slides array<string>, finding string")
