"""Interface contracts: OpenAPI 3 and WSDL 1.1 and 2.0 documents as operations and schemas, and what they add to a model."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T

try:
    import yaml
except ImportError:  # JSON alone
    yaml = None

VERBS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
#: The namespaces of WSDL 1.1 and 2.0, their SOAP bindings, and XML Schema.
WSDL, SOAP = "{http://schemas.xmlsoap.org/wsdl/}", "{http://schemas.xmlsoap.org/wsdl/soap/}"
WSDL2, SOAP2, XSD = "{http://www.w3.org/ns/wsdl}", "{http://www.w3.org/ns/wsdl/soap}", "{http://www.w3.org/2001/XMLSchema}"


def referenced(document: dict, node: object) -> set[str]:
    """Schemas that `node` reaches through local references; each reference is followed once, so all circles end."""
    seen: set[str] = set()
    open_ = [node]
    while open_:
        x = open_.pop()
        if isinstance(x, dict):
            ref = x.get("$ref")
            if isinstance(ref, str) and ref.startswith("#/") and ref not in seen:
                seen.add(ref)
                target: object = document
                for part in ref[2:].split("/"):
                    target = target.get(part.replace("~1", "/").replace("~0", "~"), {}) if isinstance(target, dict) else {}
                open_.append(target)
            open_ += [v for k, v in x.items() if k != "$ref"]
        elif isinstance(x, list):
            open_ += x
    return {r.rsplit("/", 1)[1] for r in seen if re.fullmatch("#/components/schemas/[^/]+", r)}


def openapi(text: str) -> list[dict]:
    """The operations of an OpenAPI 3 document, JSON, or YAML where PyYAML is there."""
    try:
        document = json.loads(text)
    except ValueError:
        if yaml is None:
            raise
        try:
            document = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(str(e)) from None
    if not isinstance(document, dict) or not str(document.get("openapi", "")).startswith("3."):
        raise ValueError("no OpenAPI 3 document")
    return [
        {"operation": o.get("operationId") or f"{verb} {path}", "method": verb, "path": path, "title": o.get("summary"), "schemas": sorted(referenced(document, o))}
        for path, item in sorted((document.get("paths") or {}).items()) for verb, o in sorted(item.items()) if verb in VERBS
    ]


def local(name: str | None) -> str:
    """A qualified name without its prefix."""
    return (name or "").split(":")[-1]


def schema_names(root: ElementTree.Element) -> dict[str, set[str]]:
    """The XSD names (elements, types) that a document declares, each with the names that it refers to."""
    out: dict[str, set[str]] = {}
    for schema in root.iter(f"{XSD}schema"):
        for x in schema:
            if name := x.get("name"):
                found = {local(y.get(k)) for y in x.iter() for k in ("type", "ref", "base", "itemType") if y.get(k)}
                out.setdefault(name, set()).update(found)
    return out


def reached(names: dict[str, set[str]], start: set[str]) -> list[str]:
    """The declared names that some lead to, each once."""
    seen, open_ = set(), [n for n in start if n in names]
    while open_:
        n = open_.pop()
        if n not in seen:
            seen.add(n)
            open_ += [m for m in names[n] if m in names]
    return sorted(seen)


def wsdl(text: str) -> list[dict]:
    """The operations of a WSDL 1.1 (definitions) or 2.0 (description) document: a row for each of a port type or interface,
    with its SOAP action or documentation and the XSD names that its messages reach."""
    root = ElementTree.fromstring(text)
    names = schema_names(root)
    if root.tag == f"{WSDL}definitions":
        parts = {m.get("name"): {local(p.get(k)) for p in m.findall(f"{WSDL}part") for k in ("element", "type") if p.get(k)} for m in root.findall(f"{WSDL}message")}
        actions = {(local(b.get("type")), o.get("name")): s.get("soapAction") for b in root.iter(f"{WSDL}binding") for o in b.findall(f"{WSDL}operation") for s in o.findall(f"{SOAP}operation")}
        found = [
            {"operation": o.get("name"), "method": "soap", "path": port.get("name"), "title": actions.get((port.get("name"), o.get("name"))) or o.findtext(f"{WSDL}documentation"), "schemas": reached(names, {n for m in o if m.get("message") for n in parts.get(local(m.get("message")), ())}) or sorted({local(m.get("message")) for m in o if m.get("message")})}
            for port in sorted(root.findall(f"{WSDL}portType"), key=lambda p: p.get("name") or "") for o in port.findall(f"{WSDL}operation")
        ]
    elif root.tag == f"{WSDL2}description":
        actions = {(local(b.get("interface")), local(o.get("ref"))): o.get(f"{SOAP2}action") for b in root.findall(f"{WSDL2}binding") for o in b.findall(f"{WSDL2}operation")}
        found = [
            {"operation": o.get("name"), "method": "soap", "path": port.get("name"), "title": actions.get((port.get("name"), o.get("name"))) or o.findtext(f"{WSDL2}documentation"), "schemas": reached(names, {local(m.get("element")) for m in o if m.get("element")})}
            for port in sorted(root.findall(f"{WSDL2}interface"), key=lambda p: p.get("name") or "") for o in port.findall(f"{WSDL2}operation")
        ]
    else:
        raise ValueError("no WSDL document")
    if not found and any(x.tag.endswith("}import") for x in root):
        raise ValueError("a document of imports alone")
    return found


def operations(files: DataFrame) -> DataFrame:
    """(path, fingerprint, operation, method, route, title, schemas, finding) from (path, text): by the first character, XML
    as WSDL and the rest as OpenAPI; a document that cannot be read gives one row with W-CONTRACT-UNREACHABLE."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"]):
                base = {"at": path, "fingerprint": hashlib.sha256((text or "").encode()).hexdigest()}
                try:
                    rows += [base | o | {"finding": None} for o in (wsdl if (text or "").lstrip().startswith("<") else openapi)(text or "")]
                except (ValueError, ElementTree.ParseError, AttributeError):
                    rows.append(base | {"finding": "W-CONTRACT-UNREACHABLE"})
            made = pd.DataFrame(rows, columns=["at", "fingerprint", "operation", "method", "path", "title", "schemas", "finding"])
            yield made.rename(columns={"path": "route"}).rename(columns={"at": "path"}).astype(object).where(lambda d: d.notna(), None)

    return files.select("path", "text").mapInPandas(run, "path string, fingerprint string, operation string, method string, route string, title string, schemas array<string>, finding string")


def private(url: Column) -> Column:
    """Whether an address names this machine or a private network, which no contract is fetched from."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    return host.rlike(r"^(localhost|.*\.local|.*\.internal|0\.0\.0\.0|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2\d|3[01])\..*|\[(::1|f[cd].*|fe80.*)\])$")


def loaded(apis: DataFrame, files: DataFrame, confidence: float = 0.95) -> dict[str, DataFrame]:
    """What the contracts of interfaces add: endpoints (entities), links (`exposes`), objects (candidates), contracts (one
    record each) and findings.

    apis: (id, source, folder, contract, application, domain, status), `contract` a path from the note's folder or an
    address; files: (source, path, text), the contract files at hand; an address is a file of that path.  Paths must stay
    inside the source, and private hosts are refused.  Operations of one name take `-n`."""
    from sparkloom.operators.references import normal_path

    url = F.col("contract").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://")
    at = apis.where(F.trim("contract") != "").withColumn("at", F.when(url, F.col("contract")).otherwise(normal_path(F.concat_ws("/", "folder", "contract"))))
    reason = F.when(url & private(F.col("contract")), "a private host").when(F.col("at").isNull(), "outside of its source")
    at = at.withColumn("reason", reason)
    texts = files.select("source", F.col("path").alias("at"), "text").dropDuplicates(["source", "at"])
    met = at.where("reason is null").join(texts, ["source", "at"], "left").withColumn("reason", F.when(F.col("text").isNull(), "no such file"))
    once = met.where("text is not null").groupBy(F.sha2("text", 256).alias("path")).agg(F.min("text").alias("text"))  # equal contracts are read once
    read = operations(once).withColumnRenamed("path", "key")
    rows = met.where("text is not null").withColumn("key", F.sha2("text", 256)).join(read, "key")
    found = rows.where("finding is null")
    slug = T.slugify("operation")
    nth = F.row_number().over(Window.partitionBy("id", slug).orderBy("route", "method", "operation"))
    ends = found.withColumn("endpoint", F.concat(F.col("id"), F.lit("/"), slug, F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise("")))
    endpoints = ends.select(F.col("endpoint").alias("id"), F.lit("endpoint").alias("type"), F.coalesce("title", "operation").alias("title"), "application", "domain", "status", F.lit("contract").alias("type_origin"), "source", F.col("contract").alias("path"), F.create_map(F.lit("method"), "method", F.lit("path"), "route").alias("attributes"))
    links = ends.select(F.col("id").alias("from"), F.col("endpoint").alias("to"), F.lit("exposes").alias("relation"), F.lit(confidence).alias("confidence"), F.lit("contract_import").alias("method"), F.col("contract").alias("path"), "operation")
    objects = found.select(F.col("id").alias("from"), F.explode("schemas").alias("name"), "contract").distinct()
    contracts = found.groupBy("id", "contract", "fingerprint").agg(F.count("*").alias("operations"), F.array_sort(F.collect_set("operation")).alias("names"))  # one contract's
    bad = lambda some, why: some.select(F.lit("W-CONTRACT-UNREACHABLE").alias("check"), F.col("id").alias("entity"), "contract", why.alias("message"))
    findings = bad(at.where("reason is not null"), F.col("reason")).unionByName(bad(met.where("text is null"), F.col("reason"))).unionByName(bad(rows.where("finding is not null"), F.lit("not read as a contract")))
    return {"endpoints": endpoints, "links": links, "objects": objects, "contracts": contracts, "findings": findings}
