"""Text functions as Columns: folding, tokens, keys, excerpts, times.  Offsets and lengths count code points."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plural endings: (ending, singular, least length of the word); the first that fits wins.
PLURALS = (("ies", "y", 5), ("sses", "ss", 6), ("shes", "sh", 6), ("ches", "ch", 6), ("xes", "x", 5), ("ss", "ss", 0), ("s", "", 4))
APOSTROPHES = "’ʼ"
WORD = r"[\p{L}\p{M}\p{N}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=1)
def accents() -> tuple[str, str]:
    """Precomposed letters and what is left of them without marks, for `translate`: from the Unicode data of Python."""
    pairs = []
    for code in range(0xC0, 0x2000):
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M"))
        if len(bare) == 1 and bare != c:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(text: Column | str) -> Column:
    return F.regexp_replace(F.translate(col(text), *accents()), r"\p{M}+", "")


def fold(text: Column | str) -> Column:
    """Without marks, in lower case."""
    return F.lower(strip_accents(text))


def normalize(text: Column | str, apostrophes: str = APOSTROPHES) -> Column:
    """Folded, apostrophes unified, white space collapsed and trimmed."""
    plain = F.translate(fold(text), apostrophes, "'" * len(apostrophes))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def on_boundaries(text: Column | str, start: Column, end: Column) -> Column:
    """Whether the span from `start` to before `end` (from 0) cuts no word at either end."""
    t, word = col(text), "^[\\p{L}\\p{M}\\p{N}]$"
    inside = lambda at: (at > 0) & (at < F.length(t)) & F.substring(t, at, F.lit(1)).rlike(word) & F.substring(t, at + 1, F.lit(1)).rlike(word)
    return ~inside(start) & ~inside(end)


def pointed(document: Column | str, pointer: str) -> Column:
    """What a JSON pointer (`/a/0/b~1c`) names in a JSON text, as text; null where there is nothing."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    if any("'" in p for p in parts):
        raise ValueError(f"a quote in {pointer}")
    return F.get_json_object(col(document), "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts))


def singularize(word: Column | str, rules: tuple[tuple[str, str, int], ...] = PLURALS) -> Column:
    w = col(word)
    fits = [(w.endswith(e) & (F.length(w) >= n), F.concat(F.substring(w, F.lit(1), F.length(w) - len(e)), F.lit(s))) for e, s, n in rules]
    return F.coalesce(*(F.when(f, v) for f, v in fits), w)


def singular_sql(word: str, rules: tuple[tuple[str, str, int], ...] = PLURALS) -> str:
    """`singularize` as a CASE, for SQL engines."""
    return "case " + " ".join(f"when {word} like '%{e}' and length({word}) >= {n} then substr({word}, 1, length({word}) - {len(e)}) || '{s}'" for e, s, n in rules) + f" else {word} end"


def tokens(text: Column | str) -> Column:
    """The words of a text, folded and in the singular."""
    return F.transform(F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0)), lambda w: singularize(w))


def comparison_form(text: Column | str) -> Column:
    """Normalised, each part of a word that - or ' divides in the singular."""
    word = lambda w: F.array_join(F.transform(F.split(w, "-"), lambda p: F.array_join(F.transform(F.split(p, "'"), lambda x: singularize(x)), "'")), "-")
    return F.array_join(F.transform(F.split(normalize(text), " "), word), " ")


def search_tokens(text: Column | str, least: int = 2) -> Column:
    """Every word, its comparison form, its inner parts and theirs, of at least `least` characters, each once."""
    words = F.filter(F.split(normalize(text), " "), lambda w: w != "")
    inner = F.flatten(F.transform(words, lambda w: F.split(w, "[-']")))
    every = F.concat(words, F.transform(words, lambda w: singularize(w)), inner, F.transform(inner, lambda w: singularize(w)))
    return F.array_sort(F.array_distinct(F.filter(every, lambda w: F.length(w) >= least)))


def fnv1a(text: Column | str) -> Column:
    """The 32-bit FNV-1a hash of a text's code points, as eight hex digits."""
    codes = F.transform(F.filter(F.split(col(text), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(1 << 32))
    return F.lpad(F.lower(F.hex(F.aggregate(codes, F.lit(2166136261).cast("long"), step))), 8, "0")


def bare_slug(text: Column | str) -> Column:
    """Letters and digits of ASCII, any other run one `-`; empty where nothing is left of a text."""
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slugify(text: Column | str) -> Column:
    """`bare_slug`, or `u` and a hash where nothing is left of a text."""
    slug = bare_slug(text)
    return F.when(slug == "", F.concat(F.lit("u"), fnv1a(text))).otherwise(slug)


def comparison_key(text: Column | str) -> Column:
    """Folded, all that is no letter or number a space, trimmed."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def context_around(text: Column | str, start: Column, end: Column, width: int = 160) -> Column:
    """`width` characters about the span from `start` to before `end` (from 0), an ellipsis at each cut."""
    t = col(text)
    spare = F.greatest(F.lit(0), F.lit(width) - (end - start))
    low = F.greatest(F.lit(0), start - F.floor(spare / 2).cast("int"))
    high = F.least(F.length(t), F.greatest(end, low + width))
    return F.concat(F.when(low > 0, "…").otherwise(""), F.substring(t, low + 1, high - low), F.when(high < F.length(t), "…").otherwise(""))


def with_code(text: Column | str, code: Column | str) -> Column:
    """A unit's text with its inline code put back: `code` (array<struct<at:int,text:string>>) in order of its places, which
    count the characters of the text without it."""
    step = lambda s, c: F.struct(F.concat(s["out"], F.substring(col(text), s["at"] + 1, c["at"] - s["at"]), F.lit("`"), c["text"], F.lit("`")).alias("out"), c["at"].alias("at"))
    end = lambda s: F.concat(s["out"], F.substring(col(text), s["at"] + 1, F.length(col(text)) - s["at"]))
    return F.aggregate(col(code), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, end)


def occurrence_context(text: Column | str, code: Column | str, start: Column, end: Column, width: int = 80) -> Column:
    """`context_around` a span of a unit's text as it was written, inline code included: the span moves by the code before
    its ends."""
    shift = lambda at: F.aggregate(col(code), F.lit(0), lambda n, c: n + F.when(c["at"] < at, F.length(c["text"]) + 2).otherwise(0))
    inner = F.aggregate(col(code), F.lit(0), lambda n, c: n + F.when(c["at"] <= start, F.length(c["text"]) + 2).otherwise(0))
    return context_around(with_code(text, code), start + inner, end + shift(end), width)


def excerpt(text: Column | str, most: int) -> Column:
    """Cut at the last word that ends within `most` characters."""
    t = col(text)
    cut = F.regexp_replace(F.substring(t, 1, most), r"\s+\S*\z", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(cut, F.lit("…")))


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain_text(html: Column | str) -> Column:
    """Without tags, five entities decoded, white space collapsed."""
    bare = F.regexp_replace(col(html), "<[^>]*>", " ")
    decoded = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, bare)
    return F.trim(F.regexp_replace(decoded, r"\s+", " "))


def letter_of(title: Column | str) -> Column:
    first = F.upper(F.substring(fold(title), 1, 1))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise("#")


def numeric_key(text: Column | str) -> Column:
    """A sort key under which runs of digits compare as numbers, of whatever length: each is led by the number of its digits."""
    runs = F.regexp_extract_all(fold(text), F.lit(r"\d+|\D+"), F.lit(0))
    bare = lambda r: F.regexp_replace(r, r"^0+(?=\d)", "")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.concat(F.lpad(F.length(bare(r)).cast("string"), 5, "0"), bare(r))).otherwise(r)), "")


def directory_proximity(a: Column | str, b: Column | str) -> Column:
    """The depth of the common folder over that of the deeper path; 0 for two roots."""
    x, y = (F.filter(F.split(col(c), "/"), lambda p: p != "") for c in (a, b))
    same = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: F.coalesce(p["x"] == p["y"], F.lit(False)))
    common = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")))["n"]
    deep = F.greatest(F.size(x), F.size(y))
    return F.when(deep > 0, common / deep).otherwise(F.lit(0.0))


def cue_seconds(time: Column | str) -> Column:
    """`hh:mm:ss.mmm`, hours optional, as seconds; null for anything else."""
    t = F.replace(col(time), F.lit(","), F.lit("."))
    part = lambda i: F.regexp_extract(t, r"^(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)$", i)
    return F.coalesce(part(1).try_cast("double"), F.lit(0.0)) * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double")


def date_of(written: Column | str, path: Column | str) -> Column:
    """The ISO day of a date attribute, else of the file's name where it begins or ends with one; null for neither."""
    iso = r"(\d{4}-\d{2}-\d{2})"
    name = F.regexp_extract(col(path), r"([^/]*)$", 1)
    found = F.coalesce(F.nullif(F.regexp_extract(col(written), "^" + iso, 1), F.lit("")), F.nullif(F.regexp_extract(name, iso, 1), F.lit("")))
    return F.when(found.try_cast("date").isNotNull(), found)


def timecode(seconds: Column | str) -> Column:
    s = col(seconds)
    return F.when(s.isNotNull(), F.format_string("%02d:%02d:%06.3f", F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600.0)) / 60).cast("int"), F.pmod(s, F.lit(60.0))))


def round4(x: Column) -> Column:
    """Half up to four decimals, as floor(x * 10000 + 0.5) / 10000."""
    return F.floor(x * 10000 + 0.5) / F.lit(10000.0)


def normal_question(text: str) -> str:
    """A question's words as the index holds them: folded, white space collapsed, trimmed."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M"))
    for c in APOSTROPHES:
        bare = bare.replace(c, "'")
    return " ".join(bare.lower().split())


def question_words(text: str, least: int = 2) -> list[str]:
    """The words of a question without what stands about them, of at least `least` characters, each once, in order."""
    words = (re.sub(r"^[^\w]+|[^\w]+$", "", w) for w in normal_question(text).split(" "))
    return list(dict.fromkeys(w for w in words if len(w) >= least))
