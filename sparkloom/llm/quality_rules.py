"""Line-first cleaning.

Each line of a text is judged alone; lines that fail go, and a document that loses more than half of its words so is
rejected.  The lines' rules:
- punctuation: no sentence ends in the line, or over a fifth of its words carry doubled symbols or `!!`;
- navigation: at least three separators, one or more for every ten words;
- boilerplate: a licence, consent or site phrase, or a line that repeats an earlier one of the text.
Beside them stand document rules: at least `MIN_WORDS` words, and at most `MAX_REPEATED` % of the words in 8-word windows
that the text repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType

from sparkloom.llm.common import LOWER, fresh, with_fields

MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
LOST = 2  # a document is rejected when it keeps less than one word of so many
SYMBOLS = "#*$%&|<>"
ENDS = "…|[.!?:;][\"”»')\\]]*([\\x20\\x09-\\x0D]|$)"
RUNS = "[#*$%&]{2,}|!{2,}"
SEPARATORS = "[|»·•]"
#: Phrases of licences, consent and sites in the corpus' languages, A-Z in lower case; a project passes its own.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "this work is licensed", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "uses cookies", "accept cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "sign up for our newsletter",
    "subscribe to our", "click here to", "skip to content", "powered by wordpress",
    "alle rechte vorbehalten", "lizenziert unter", "nutzungsbedingungen", "datenschutzerkl", "verwendet cookies", "cookies akzeptieren", "newsletter abonnieren", "zum inhalt springen",
    "tous droits réservés", "sous licence", "conditions d'utilisation", "politique de confidentialit", "utilise des cookies", "accepter les cookies", "aller au contenu",
    "todos los derechos reservados", "con licencia", "términos de uso", "política de privacidad", "utiliza cookies", "aceptar cookies", "saltar al contenido",
)

_runs = re.compile(RUNS.encode())
_ends = re.compile(ENDS.replace("[\"”»')\\]]", "(?:[\"')\\]]|”|»)").encode())
_phrases = tuple(p.encode() for p in BOILERPLATE)
_symbols = [s.encode() for s in SYMBOLS]
_space = [bytes([c]) for c in b" \t\n\v\f\r"]


class Verdict(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept_words: int
    kept: bool
    text: bytes


def repeated_words(parts: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of `width` words that occur at least twice, the first occurrence included."""
    n = len(parts) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, parts), np.int64, len(parts)).view(np.uint64)
    window = np.zeros(n, np.uint64)
    for k in range(width):
        window = window * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(len(parts) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def line_fails(line: bytes, n: int, boilerplate: tuple[bytes, ...] = _phrases, runs: bool = True) -> bool:
    """Whether a line of `n` words fails on its own; one that repeats an earlier line fails besides.  boilerplate and runs:
    the phrases that the text holds at all, and whether it holds doubled symbols."""
    separators = line.count(b"|") + line.count(b"\xc2\xb7") + line.count(b"\xc2\xbb") + line.count(b"\xe2\x80\xa2")
    if separators >= 3 and 10 * separators >= n:
        return True
    if (runs and 5 * len(_runs.findall(line)) > n) or not _ends.search(line):
        return True
    low = line.translate(LOWER) if boilerplate else b""
    return any(p in low for p in boilerplate)


def judge(text: bytes | None, boilerplate: tuple[bytes, ...] = _phrases) -> Verdict:
    """Null is a text without words: it fails the document rules."""
    text = text or b""
    parts = text.split()
    n = len(parts)
    code_points = len(text) - sum(text.count(c) for c in _space) - continuation(text)
    seen: set[bytes] = set()
    kept, kept_words, dups = [], 0, 0
    low = text.translate(LOWER)
    held, runs = tuple(p for p in boilerplate if p in low), _runs.search(text) is not None
    for line in text.split(b"\n"):
        m = len(line.split())
        if not m:
            kept.append(line)
            continue
        if line in seen:
            dups += 1
            continue
        seen.add(line)
        if not line_fails(line, m, held, runs):
            kept.append(line)
            kept_words += m
    repeats = repeated_words(parts)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEATED * n
    return Verdict(n, code_points, sum(text.count(s) for s in _symbols), dups, repeats, failed, kept_words, not failed and LOST * kept_words >= n, b"\n".join(kept))


def continuation(text: bytes) -> int:
    """Bytes of UTF-8 that begin no code point."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))


FIELDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept_words": "long", "kept": "boolean", "clean_text": "string"}


def clean_lines(docs: DataFrame, *, boilerplate: tuple[str, ...] = BOILERPLATE, text_col: str = "text") -> DataFrame:
    """`docs` with the counts, base_failed (document rules), kept_words, kept and clean_text (the lines that pass, and
    those without words) of each whole text.

    All rows come back, repeated and null ones too; null and empty texts have no words and are not kept; columns of `docs`
    with the new names are replaced.
    """
    held = fresh(docs, "_utf8")
    rest = docs.withColumn(held, F.col(text_col).cast("string").cast("binary")).drop(*FIELDS)

    listed = tuple(p.encode() for p in boilerplate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(judge(t.as_py(), listed) for t in batch.columns[-1]))) or [()] * len(FIELDS)
            types = {"long": pa.int64(), "boolean": pa.bool_()}
            new = [pa.array(c, types[t]) if t in types else pa.array(c, pa.binary()) for c, t in zip(found, FIELDS.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], *FIELDS])

    types = {"long": LongType(), "boolean": BooleanType(), "string": BinaryType()}
    schema = with_fields(rest.drop(held), *((n, types[t]) for n, t in FIELDS.items()))
    return rest.mapInArrow(run, schema).withColumn("clean_text", F.col("clean_text").cast("string"))


_PHRASES = "|".join(BOILERPLATE).replace("'", "''")
_WORDS = "'[^\\x20\\x09-\\x0D]+'"
ORACLE_SQL = f"""
with docs as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {_WORDS}) as w from documents
), windows as (
  select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from docs)
), hits as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from windows) where c > 1
), repeats as (
  select doc_id, count(distinct i + k) as n from hits, (select unnest(range(0, {WINDOW})) as k) group by doc_id
), cut as (
  select doc_id, string_split(t, chr(10)) as ls from docs
), lines as (
  select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from cut
), judged as (
  select doc_id, line, len(regexp_extract_all(line, {_WORDS})) as n, row_number() over (partition by doc_id, line order by pos) as nth,
    len(regexp_extract_all(line, '{SEPARATORS}')) as seps, len(regexp_extract_all(line, '{RUNS}')) as runs,
    regexp_matches(line, '{ENDS.replace("'", "''")}') as ends,
    regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PHRASES}') as boiler
  from lines
), summed as (
  select doc_id, count_if(n > 0 and nth > 1) as dups,
    sum(case when n > 0 and nth = 1 and not (seps >= 3 and 10 * seps >= n) and 5 * runs <= n and ends and not boiler then n else 0 end) as kept_words
  from judged group by doc_id
), base as (
  select d.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, s.dups as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, kept_words
  from docs d join summed s using (doc_id) left join repeats r using (doc_id)
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words) and {LOST} * kept_words >= n_words as kept
from base
"""
