"""Readers over texts made from the driver's tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.registry import Tables, query
from sparkloom.session import spread
from sparkloom.sources import contracts, files, markdown, office, transcripts


@query("""select page_id, not (contains(url, '/de/')) or contains(url, '?page=') as kept from pages where not regexp_matches(url, '^[^/]*//[^/]*\\.net/')""")
def s04_file_filter(t: Tables) -> DataFrame:
    """Paths under globs and ignore rules: .net hosts excluded; de/ ignored, but lists re-included."""
    rows = t.pages.select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    rows = files.filtered(rows, exclude=["*.net/**"])
    kept = files.filtered(rows, ignore="de/\n!*page=*").select("page_id", F.lit(True).alias("kept"))
    return rows.join(kept, "page_id", "left").select("page_id", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("""select p_partkey, case when p_size % 5 = 0 then null when p_size % 5 = 1 then p_brand else p_name end as title, p_size % 3 + case when p_size % 5 = 4 then 1 else 0 end as sections, 1 + p_size % 2 as links, case when p_size % 7 = 0 then 'E-FM-INVALID' end as finding, case when p_size % 7 > 0 then p_brand end as brand, case when p_size % 7 > 0 then cast(p_size as varchar) end as deep,
case when p_size % 5 = 0 then 0 else 1 end + p_size % 3 * 2 + case when p_size % 5 = 4 then 1 else 0 end + 2 + p_size % 2 as units, p_name || ' is soft ' || p_brand as first_paragraph from part""")
def s06_markdown(t: Tables) -> DataFrame:
    """Notes of many shapes made from parts, parsed: titles of both kinds or none, sections, links in and beside code, soft line
    breaks, lists, nested and broken frontmatter."""
    size, name = F.col("p_size"), F.col("p_name")
    front = F.when(size % 7 == 0, "---\n- no\n- mapping\n---\n").otherwise(F.concat(F.lit("---\nbrand: "), "p_brand", F.lit("\nmap:\n  size: "), size.cast("string"), F.lit("\n  list: [1, 2]\n---\n")))
    title = F.when(size % 5 == 0, "").when(size % 5 == 1, F.concat("p_brand", F.lit("\n===\n"))).otherwise(F.concat(F.lit("# "), name, F.lit(" #\n")))
    under = F.when(size % 5 == 4, "\nUnder\n---\n").otherwise("")
    body = F.concat(F.lit("\n"), name, F.lit(" is\nsoft "), "p_brand", F.lit("\n\n- see [it](a.md) `[no](b.md)`\n"), F.when(size % 2 == 1, "\n> quoted [too](<c d.md>)\n> on\n").otherwise(""))
    sections = F.repeat(F.lit("\n## Part\n\n```\n# no [x](y)\n```\n\n---\n\n1. one\n   more\n"), (size % 3).cast("int"))
    parsed = markdown.parse_notes(spread(t.part).select(F.col("p_partkey").cast("string").alias("path"), F.concat(front, title, body, under, sections).alias("text")))
    paragraph = F.element_at(F.filter("units", lambda u: u["kind"] == "paragraph"), 1)["text"]
    return parsed.select(
        F.col("path").cast("long").alias("p_partkey"), "title", F.size("sections").alias("sections"), F.size("links").alias("links"), "finding", F.get_json_object("frontmatter", "$.brand").alias("brand"),
        F.get_json_object("frontmatter", "$.map.size").alias("deep"), F.size("units").alias("units"), paragraph.alias("first_paragraph"),
    )


@query("""select conv_id, turn, role as speaker, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text, cast(turn * 4 as double) as start, turn * 4 + 2.5 as "end" from conversations""")
def s10_transcripts(t: Tables) -> DataFrame:
    """Conversations written as WebVTT and read again."""
    rows = t.conversations.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("index"), (F.col("turn") * 4.0).alias("start"), (F.col("turn") * 4 + 2.5).alias("end"), F.col("role").alias("speaker"), F.regexp_replace("text", r"\n\s*\n", "\n").alias("text"))
    read = transcripts.cues(transcripts.vtt(rows))
    return read.select(F.col("path").cast("long").alias("conv_id"), (F.col("start") / 4).cast("long").alias("turn"), "speaker", "text", "start", "end")


@query("""with o as (select p_partkey, p_name, 'get' as method, '/' || p_partkey as route, case p_size % 3 when 0 then 'Part,Size' when 1 then 'Size' else '' end as schemas, p_name as operation from part
union all select p_partkey, p_name, 'post', '/' || p_partkey, case when p_size % 3 = 2 then 'Other' else '' end, 'post /' || p_partkey from part where p_size % 2 = 0)
select p_partkey, operation, method, route, schemas, cast(null as varchar) as finding from o where p_partkey % 11 > 0 union all select p_partkey, null, null, null, null, 'W-CONTRACT-UNREACHABLE' from part where p_partkey % 11 = 0""")
def s17_openapi(t: Tables) -> DataFrame:
    """Contracts of parts: one operation or two, schemas by way of responses, in circles or not at all; some are none."""
    p, size = F.col("p_partkey").cast("string"), F.col("p_size")
    used = F.when(size % 3 == 0, '{"$ref": "#/components/responses/R"}').when(size % 3 == 1, '{"a/b": [{"$ref": "#/components/schemas/Size"}]}').otherwise("{}")
    post = F.when(size % 2 == 0, F.concat(F.lit(', "post": {"x": '), F.when(size % 3 == 2, '{"$ref": "#/components/schemas/Other"}').otherwise("{}"), F.lit("}"))).otherwise("")
    doc = F.concat(
        F.lit('{"openapi": "'), F.when(F.col("p_partkey") % 11 == 0, "2.0").otherwise("3.1.0"), F.lit('", "paths": {"/'), p, F.lit('": {"summary": "no verb", "get": {"operationId": "'), "p_name", F.lit('", "responses": {"200": '), used, F.lit("}}"), post,
        F.lit('}}, "components": {"responses": {"R": {"self": {"$ref": "#/components/responses/R"}, "schema": {"$ref": "#/components/schemas/Part"}}}, "schemas": {"Part": {"p": {"$ref": "#/components/schemas/Size"}, "q": {"$ref": "#/components/schemas/Part"}}, "Size": {}, "Other": {}}}}'),
    )
    found = contracts.operations(spread(t.part).select(p.alias("path"), doc.alias("text")))
    return found.select(F.col("path").cast("long").alias("p_partkey"), "operation", "method", "route", F.array_join("schemas", ",").alias("schemas"), "finding")


@query("""select p_partkey, p_name as operation, case when p_size % 2 = 0 then 'urn:' || p_partkey else 'says ' || p_brand end as title, case when p_size % 3 = 0 then 'In,Kind' else 'In' end as schemas from part""")
def s18_wsdl(t: Tables) -> DataFrame:
    """WSDL 2.0 and 1.1 documents of parts, the XSD names that their messages reach."""
    p, size = F.col("p_partkey").cast("string"), F.col("p_size")
    inner = F.when(size % 3 == 0, '<x:complexType><x:sequence><x:element name="k" type="t:Kind"/></x:sequence></x:complexType>').otherwise("")
    types = F.concat(F.lit('<types><x:schema><x:element name="In">'), inner, F.lit('</x:element><x:simpleType name="Kind"/><x:simpleType name="Unused"/></x:schema></types>'))
    said = F.concat(F.lit("<documentation>says "), "p_brand", F.lit("</documentation>"))
    two = F.concat(F.lit('<description xmlns="http://www.w3.org/ns/wsdl" xmlns:s="http://www.w3.org/ns/wsdl/soap" xmlns:x="http://www.w3.org/2001/XMLSchema">'), types, F.lit('<interface name="I"><operation name="'), "p_name", F.lit('"><input element="t:In"/></operation></interface><binding name="B" interface="t:I"><operation ref="t:'), "p_name", F.lit('" s:action="urn:'), p, F.lit('"/></binding></description>'))
    one = F.concat(F.lit('<definitions xmlns="http://schemas.xmlsoap.org/wsdl/" xmlns:x="http://www.w3.org/2001/XMLSchema">'), types, F.lit('<message name="M"><part name="p" element="t:In"/></message><portType name="P"><operation name="'), "p_name", F.lit('">'), said, F.lit('<input message="t:M"/></operation></portType></definitions>'))
    found = contracts.operations(spread(t.part).select(p.alias("path"), F.when(size % 2 == 0, two).otherwise(one).alias("text")))
    return found.select(F.col("path").cast("long").alias("p_partkey"), "operation", "title", F.array_join("schemas", ",").alias("schemas"))


@query("""select p_partkey, p_name || ' (x)' as title, '2001-0' || (1 + p_size % 9) as modified, 1 + p_size % 3 as pages from part""")
def s14_pdf_properties(t: Tables) -> DataFrame:
    """The last information dictionary of PDF files made from parts, and their pages."""
    size = F.col("p_size")
    body = F.concat(F.lit("%PDF-1.4\n<< /Title (old) >>\n<< /Type /Pages >>"), F.repeat(F.lit("<< /Type /Page >>\n"), (1 + size % 3).cast("int")), F.lit("<< /Title ("), "p_name", F.lit(" \\(x\\)) /ModDate (D:20010"), (1 + size % 9).cast("string"), F.lit(") >>"))
    files = spread(t.part).select(F.col("p_partkey").cast("string").alias("path"), body.cast("binary").alias("content"))
    return office.document_properties(files).select(F.col("path").cast("long").alias("p_partkey"), "title", "modified", F.col("pages").alias("pages"))


@query("""select p_partkey, cast(unnest(range(1, 2 + p_size % 3)) as integer) as page, p_name || chr(10) || 'page ' || unnest(range(1, 2 + p_size % 3)) as text, cast(null as varchar) as finding from part where p_size % 10 > 0
union all select p_partkey, null, null, 'W-CONV-FAILED' from part where p_size % 10 = 0""")
def s16_pdf_pages(t: Tables) -> DataFrame:
    """The text of each page of PDF files made from parts."""
    page = lambda n: F.concat(F.lit("<< /Length 1 >>\nstream\nBT /F 1 Tf ("), "p_name", F.lit(f") Tj T* [(pa) -5 (ge )] TJ ({n}) Tj ET\nendstream\n"))
    size = F.col("p_size")
    body = F.concat(F.when(size % 10 == 0, "no file").otherwise("%PDF-1.4\n"), *(F.when(size % 3 >= n - 1, page(n)).otherwise("") for n in (1, 2, 3)))
    found = office.page_texts(spread(t.part).select(F.col("p_partkey").cast("string").alias("path"), body.cast("binary").alias("content")))
    return found.select(F.col("path").cast("long").alias("p_partkey"), "page", "text", "finding")


@query("""select p_partkey, p_name as title, case when p_size % 2 = 0 then p_brand end as author, p_size as pages, p_name || '|' || p_brand as slides from part where p_size % 9 > 0 union all select p_partkey, null, null, null, null from part where p_size % 9 = 0""")
def s13_office_properties(t: Tables) -> DataFrame:
    """Presentations made from parts, read again: title, author, pages and slide titles in order; some are broken."""

    def made(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            rows = []
            for key, name, brand, size in frame.itertuples(index=False):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    author = f"<d:creator>{brand}</d:creator>" if size % 2 == 0 else ""
                    z.writestr("docProps/core.xml", f'<c xmlns:d="urn:d"><d:title>{name}</d:title>{author}</c>')
                    z.writestr("docProps/app.xml", f'<p xmlns="urn:p"><Slides>{size}</Slides></p>')
                    z.writestr("ppt/slides/slide10.xml", f'<s xmlns:a="urn:a"><a:t>{brand}</a:t><a:t>more</a:t></s>')
                    z.writestr("ppt/slides/slide9.xml", f'<s xmlns:a="urn:a"><a:t>{name}</a:t></s>')
                rows.append((str(key), out.getvalue() if size % 9 else b"no archive"))
            yield pd.DataFrame(rows, columns=["path", "content"])

    files = spread(t.part).select("p_partkey", "p_name", "p_brand", "p_size").mapInPandas(made, "path string, content binary")
    found = office.document_properties(files)
    return found.select(F.col("path").cast("long").alias("p_partkey"), "title", "author", "pages", F.array_join("slides", "|").alias("slides"))
