"""Terms: n-grams of the units of a corpus, scored by C-value and inverse document frequency."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.session import stored, spread

#: Function words that end or begin no term; a project passes its own list.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
#: Those of each language, folded, as written and as the tokens' singular; a language without a list has none.
STOPWORDS_OF = {
    "en": STOPWORDS,
    "fr": ("a", "au", "aux", "avec", "ce", "ces", "d", "dan", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "l", "la", "le", "les", "ou", "par", "pour", "qu", "que", "qui", "sur", "un", "une"),
    "de": ("als", "am", "an", "auf", "aus", "bei", "da", "das", "dem", "den", "der", "des", "die", "ein", "eine", "es", "fur", "im", "in", "ist", "mit", "nicht", "oder", "und", "von", "war", "zu", "zum", "zur"),
    "es": ("a", "al", "como", "con", "de", "del", "e", "el", "en", "es", "esta", "la", "las", "lo", "los", "o", "para", "por", "que", "se", "su", "sus", "un", "una", "y"),
}
SUFFIXES = ("ly", "ing", "ed")


@dataclass(frozen=True)
class TermOptions:
    max_words: int = 4
    min_length: int = 3
    min_occurrences: int = 3
    min_documents: int = 2
    max_spread: float = 0.5
    min_confidence: float = 0.5
    stopwords: tuple[str, ...] = STOPWORDS
    #: Those of each value of the column `lang`, in the place of `stopwords` where there is such a column.
    stopwords_of: tuple[tuple[str, tuple[str, ...]], ...] = tuple(STOPWORDS_OF.items())
    suffixes: tuple[str, ...] = SUFFIXES
    defined: tuple[str, ...] = field(default=())


def units(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, line from 1, text) and what to keep: a unit a line that is not blank."""
    lines = spread(docs).select(F.col(id_col).cast("string").alias("path"), *keep, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "text"))
    return lines.where(F.trim("text") != "").select("path", (F.col("pos") + 1).alias("line"), "text", *keep)


def usage_units(found: DataFrame, labels: tuple[str, ...] = (), most: int = 60) -> DataFrame:
    """Units (text, kind, ...) that use words: headings go, and list items lose a label of a mapped section (folded) that
    opens them, with the blanks behind its colon; what is blank then goes too."""
    colon = F.instr("text", ":")
    opens = (F.col("kind") == "list") & (colon > 1) & (colon <= most + 1) & T.normalize(F.substring("text", F.lit(1), colon - 1)).isin(*labels) if labels else F.lit(False)
    rest = F.ltrim(F.substring("text", colon + 1, F.length("text")))
    return found.where("kind <> 'heading'").withColumn("text", F.when(opens, rest).otherwise(F.col("text"))).where(F.trim("text") != "")


def prominent_units(notes: DataFrame) -> DataFrame:
    """(path, line, text) of what a note (a row of the Markdown reader) puts forward: headings, link texts, and the strings
    of its frontmatter, alone or in lists."""
    headings = notes.select("path", F.explode("units").alias("u")).where("u.kind = 'heading'").select("path", "u.line", "u.text")
    links = notes.select("path", F.explode("links").alias("l")).select("path", "l.line", "l.text")
    values = F.map_values(F.from_json("frontmatter", "map<string,string>"))
    listed = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v"))
    front = notes.select("path", F.explode(values).alias("v")).select("path", F.explode(listed).alias("text"))
    front = front.where(F.col("text").try_cast("double").isNull() & ~F.col("text").isin("true", "false") & ~F.col("text").startswith("{"))
    return headings.unionByName(links).unionByName(front.select("path", F.lit(1).alias("line"), "text")).where(F.trim("text") != "")


def carried(found: DataFrame) -> list[str]:
    return ["lang"] if "lang" in found.columns else []


def runs(found: DataFrame, most: int) -> DataFrame:
    """(path, line, position, w, and lang if there is one): for each word of each unit the run of up to `most` words that
    begins with it.  A row holds its run alone, never the unit's words; the generator in front keeps them from being
    computed anew for each."""
    rows = found.select("path", "line", *carried(found), F.explode(F.array(T.tokens("text"))).alias("t")).where(F.size("t") > 0)
    slices = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("t"))), lambda i: F.slice("t", i, most))
    return rows.select("path", "line", *carried(found), F.posexplode(slices).alias("position", "w")).where(F.size("w") > 0)


def is_stopword(word: Column, options: TermOptions, by_language: bool) -> Column:
    """Whether a word is one of its language's, or of the options' where rows have no language."""
    if not by_language:
        return word.isin(*options.stopwords) if options.stopwords else F.lit(False)
    return F.coalesce(*(F.when(F.col("lang") == lang, word.isin(*words)) for lang, words in options.stopwords_of if words), F.lit(False))


def is_term(key: Column, options: TermOptions) -> Column:
    return (F.length(key) >= options.min_length) & ~key.rlike(r"^[\p{N} ]+$")


def ngrams(found: DataFrame, options: TermOptions = TermOptions()) -> DataFrame:
    """(path, line, position (of the first word), words, key, and lang if there is one): n-grams that neither begin nor end
    with a stopword, are not digits alone and long enough.  Those with a stopword at an edge go before anything is shuffled."""
    lang = carried(found)
    rows = runs(found, options.max_words).where(~is_stopword(F.element_at("w", 1), options, bool(lang)))
    rows = rows.select("path", "line", *lang, "position", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("words"))
    rows = rows.where(~is_stopword(F.element_at("w", F.col("words")), options, bool(lang)))
    rows = rows.select("path", "line", *lang, "position", "words", F.array_join(F.slice("w", F.lit(1), F.col("words")), " ").alias("key"))
    return rows.where(is_term(F.col("key"), options))


def grouped(found: DataFrame) -> DataFrame:
    """(lang if there is one, key, words, occurrences, documents), counted by key and document first so that frequent keys
    meet small."""
    lang = carried(found)
    by_doc = found.groupBy(*lang, "key", "words", "path").agg(F.count("*").alias("n"))
    return by_doc.groupBy(*lang, "key", "words").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))


def corpus_size(found: DataFrame, options: TermOptions) -> DataFrame:
    """(lang if there is one, corpus): the documents that hold an n-gram, told by looking for the first one: no n-gram is
    made into a row."""
    lang = carried(found)
    rows = found.select("path", *lang, F.explode(F.array(T.tokens("text"))).alias("t")).where(F.size("t") > 0)
    edge = lambda w: ~is_stopword(w, options, bool(lang))
    key = lambda i, n: F.array_join(F.slice("t", i, n), " ")
    fits = lambda i, n: (i + n - 1 <= F.size("t")) & edge(F.get("t", i - 1)) & edge(F.get("t", i + n - 2)) & is_term(key(i, n), options)
    any_ = lambda n: F.exists(F.sequence(F.lit(1), F.size("t")), lambda i: F.coalesce(fits(i, n), F.lit(False)))
    has = reduce(or_, (any_(n) for n in range(1, options.max_words + 1)))
    return rows.where(has).select("path", *lang).distinct().groupBy(*lang).agg(F.count("*").alias("corpus"))


def nested(key: Column, words: Column) -> Column:
    """The keys inside a longer one, each once."""
    w = F.split(key, " ")
    sizes = F.sequence(F.lit(1), words - 1)
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), words - n + 1), lambda s: F.array_join(F.slice(w, s, n), " ")))))


def confidence(options: TermOptions) -> Column:
    """The product of five factors of the signals."""
    excess = F.when(F.col("corpus") < 10, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("spread") - options.max_spread) / (1 - options.max_spread))
    burst = F.when(F.col("documents") < 5, 1.0).otherwise(F.least(F.lit(1.0), 0.5 + 0.5 * (F.col("burst") - 1) / 0.5))
    position = 0.8 + 0.2 * F.col("prominence")
    return T.round4((1 - excess) * burst * position * F.when(F.col("neighbour"), 1.0).otherwise(0.9) * F.when(F.col("inflected"), 0.8).otherwise(1.0))


def score_terms(found: DataFrame, options: TermOptions = TermOptions(), prominent: DataFrame | None = None) -> DataFrame:
    """(lang if there is one, key, words, occurrences, documents, score, spread, burst, prominence, neighbour, inflected,
    confidence) of units (path, line, text): their n-grams at the thresholds, defined ones left out; each language by itself.

    The penalty of a key is the mean frequency of the frequent longer n-grams that hold it, each once, defined ones too; a
    longer one with a defined part vouches for its parts.  prominent: n-grams of the texts that authors put forward."""
    lang = carried(found)
    groups, corpus = grouped(ngrams(found, options)), corpus_size(found, options)
    defined = F.array(*(F.lit(w) for w in options.defined)) if options.defined else F.array().cast("array<string>")
    # stored, as three branches read it: else each would count all n-grams again
    frequent = stored(groups.where((F.col("occurrences") >= options.min_occurrences) & (F.col("documents") >= options.min_documents)))
    longer = frequent.where("words > 1").select(*lang, "occurrences", F.col("key").alias("whole"), nested(F.col("key"), F.col("words")).alias("parts"))
    longer = longer.withColumn("vouches", F.arrays_overlap("parts", defined))
    inside = longer.select(*lang, F.explode("parts").alias("key"), "occurrences", "vouches")
    penalty = inside.groupBy(*lang, "key").agg((F.sum("occurrences") / F.count("*")).alias("mean"), F.bool_or("vouches").alias("vouched"))
    own = longer.select(*lang, F.col("whole").alias("key"), F.col("vouches").alias("own"))
    held = lambda b, names: b.select(*(F.col(c).alias(f"_{c}") for c in names), *(c for c in b.columns if c not in names))
    left = lambda a, b, names: a.join(held(b, names), reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names)), "left").drop(*(f"_{c}" for c in names))
    rows = left(left(frequent, penalty, [*lang, "key"]), own, [*lang, "key"])
    rows = left(rows, corpus, lang) if lang else rows.crossJoin(F.broadcast(corpus))  # one row a language
    if prominent is not None:
        rows = left(rows, prominent.groupBy(*lang, "key").agg(F.count("*").alias("prominent")), [*lang, "key"])
    else:
        rows = rows.withColumn("prominent", F.lit(None).cast("long"))
    inflected = lambda w: reduce(or_, ((F.length(w) > len(s)) & w.endswith(s) for s in options.suffixes), F.lit(False))
    ends = F.exists(F.split("key", " "), inflected)
    rows = rows.where(~F.array_contains(defined, F.col("key")))
    cvalue = F.log2(F.col("words") + 1) * (F.col("occurrences") - F.coalesce("mean", F.lit(0.0)))
    rows = rows.withColumns({
        "score": T.round4(cvalue * F.log(1 + F.col("corpus") / F.col("documents"))),
        "spread": T.round4(F.col("documents") / F.col("corpus")),
        "burst": T.round4(F.col("occurrences") / F.col("documents")),
        "prominence": T.round4(F.least(F.lit(1.0), F.coalesce(F.col("prominent"), F.lit(0)) / F.col("occurrences"))),
        "neighbour": F.coalesce("vouched", F.lit(False)) | F.coalesce("own", F.lit(False)),
        "inflected": ends,
    })
    rows = rows.withColumn("confidence", confidence(options))
    return rows.select(*lang, "key", "words", "occurrences", "documents", "score", "spread", "burst", "prominence", "neighbour", "inflected", "confidence")


def defined_expressions(found: DataFrame, keys: DataFrame, options: TermOptions = TermOptions()) -> DataFrame:
    """(lang if there is one, key, occurrences, documents): the n-grams that the dictionary (key) defines and that reach the
    thresholds of a page."""
    lang = carried(found)
    rows = grouped(found.join(keys.select("key").distinct(), "key", "left_semi"))
    return rows.where((F.col("occurrences") >= options.min_occurrences) & (F.col("documents") >= options.min_documents)).select(*lang, "key", "occurrences", "documents")


def page_ids(terms: DataFrame, order: tuple[str, ...] = ("lang", "key"), slug: Callable[[str], Column] = T.slugify, *, pass_over: bool = True) -> DataFrame:
    """Terms with their page's id `keywords/<slug>`; of the pages of one slug, in any language, the later ones take `-n`, the
    next number that no other page's slug is; without pass_over the n-th one's number is n."""
    rows = terms.withColumn("_slug", slug("key")).withColumn("_n", F.row_number().over(Window.partitionBy("_slug").orderBy(*order)))
    page = F.concat(F.lit("keywords/"), "_slug", F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(""))
    if not pass_over:
        return rows.withColumn("id", page).drop("_slug", "_n")
    wanted = rows.withColumn("_id", F.when(F.col("_n") == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", "_n")))
    # a number that is another page's own slug is passed over, as are those behind it of the same slug
    own = rows.select(F.col("_slug").alias("_id")).distinct().withColumn("_held", F.lit(True))
    held = wanted.where("_n > 1").select("_slug", "_id", "_n").join(own, "_id").select("_slug", F.col("_n").alias("_at"))
    passed = held.groupBy("_slug").agg(F.array_sort(F.collect_set("_at")).alias("_taken"))  # few: slugs that end in another's number
    step = lambda n, t: F.when(t <= n, n + 1).otherwise(n)
    rows = wanted.join(passed, "_slug", "left").withColumn("_n", F.when(F.col("_n") > 1, F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_n"), step)).otherwise(F.col("_n")))
    return rows.withColumn("id", page).drop("_slug", "_n", "_id", "_taken")


def leads(pages: DataFrame, known: DataFrame, most: int = 5) -> DataFrame:
    """(id, lead, overlap, rank): the pages (id, key) and dictionary entries (key, targets; the first target leads) whose
    expressions are similar to a page's."""
    every = pages.select("key", F.col("id").alias("lead")).unionByName(known.select("key", F.element_at("targets", 1).alias("lead")))
    near = similar(pages.select("key"), most=None, others=every.select("key").distinct())
    rows = pages.select("id", "key").join(near, "key").join(every.withColumnRenamed("key", "other"), "other").where("lead <> id")
    best = rows.groupBy("id", "lead").agg(F.max("overlap").alias("overlap"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("overlap"), "lead"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most)


def taken_over(defined: DataFrame, known: DataFrame, pages: DataFrame) -> DataFrame:
    """(target, id): the page id that a defined expression at the thresholds would have, kept by the first target of its
    dictionary entry; an id that a page (id) holds is no redirect."""
    rows = known.select("key", F.element_at("targets", 1).alias("target")).join(defined.select("key").distinct(), "key", "left_semi")
    return rows.select("target", F.concat(F.lit("keywords/"), T.slugify("key")).alias("id")).distinct().join(pages.select("id"), "id", "left_anti").select("target", "id")


def discover(notes: DataFrame, known: DataFrame, options: TermOptions = TermOptions(), labels: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The expressions that no note defines: terms (scored, with prominence), pages (with id), leads and redirects.

    notes: rows of the Markdown reader with lang; known: the dictionary (key, targets).  Usage is what `usage_units` reads;
    headings, link texts and frontmatter count for prominence alone."""
    lang = notes.select("path", "lang")
    rows = notes.select("path", "lang", F.explode("units").alias("u")).select("path", "lang", "u.line", "u.kind", "u.text")
    used = stored(usage_units(rows, labels).select("path", "line", "text", "lang"))
    front = ngrams(prominent_units(notes).join(lang, "path"), options)
    keys = tuple(r.key for r in known.select("key").distinct().orderBy("key").limit(10_001).collect())
    if len(keys) > 10_000:
        raise ValueError("a dictionary of over 10,000 keys does not go into the plan: leave its keys out by a join")
    scored = stored(score_terms(used, replace(options, defined=keys), front))
    pages = page_ids(scored.where(F.col("confidence") >= options.min_confidence))
    defined = defined_expressions(ngrams(used, options), known, options)
    return {"terms": scored, "pages": pages, "leads": leads(pages, known), "redirects": taken_over(defined, known, pages)}


def published(terms: DataFrame, options: TermOptions = TermOptions(), order: tuple[str, ...] = ("key",), slug: Callable[[str], Column] = T.slugify) -> DataFrame:
    """Terms with fate: page at the confidence, withheld below it, and the slug of the page, `-n` on the n-th key of a slug."""
    page = F.col("confidence") >= options.min_confidence
    base = slug("key")
    nth = F.row_number().over(Window.partitionBy(base, page).orderBy(*order))
    rows = terms.withColumns({"slug": F.when(nth == 1, base).otherwise(F.concat_ws("-", base, nth)), "fate": F.when(page, "page").otherwise("withheld")})
    return rows.withColumn("slug", F.when(page, F.col("slug")))


def display_forms(found: DataFrame) -> DataFrame:
    """(key, surface) from (key, surface, rank): the most frequent surface; of equals the one that reached the count first."""
    counted = found.groupBy("key", "surface").agg(F.count("*").alias("n"), F.max("rank").alias("reached"))
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "reached"))
    return counted.withColumn("r", first).where("r = 1").select("key", "surface", "n")


def similar(keys: DataFrame, most: int | None = 5, others: DataFrame | None = None) -> DataFrame:
    """(key, other, overlap, rank): expressions (of `others`, else of `keys`) of which one is a run of the other's words or
    that share at least half of the larger one's distinct words; the closest `most` of each.

    Two expressions that share so much share one of the few rarest words of each (the prefix of a set by rarity), and a run
    holds or is held with the rarest word of the shorter one; pairs meet through these alone, so a common word brings
    together only what has no rarer one."""
    own = keys.select("key").distinct().withColumn("w", F.array_distinct(F.split("key", " ")))
    rest = own if others is None else others.select("key").distinct().withColumn("w", F.array_distinct(F.split("key", " ")))
    every = own.unionByName(rest).distinct()
    words = every.select("key", F.explode("w").alias("word"), F.size("w").alias("size"))
    ranked = words.join(words.groupBy("word").agg(F.count("*").alias("of")), "word")
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("of", "word")))
    # half of its words: all but half of them less one are the prefix; the rarest word is among them
    few = stored(ranked.where(F.col("r") <= F.col("size") - F.ceil(F.col("size") / 2) + 1).select("key", "word", "r"))
    side = lambda rows, n: few.join(rows.select("key"), "key", "left_semi").select(F.col("key").alias(n), "word")
    met = side(own, "key").join(side(rest, "other"), "word").where(F.col("key") != F.col("other")).select("key", "other")
    # one inside the other: the rarest word of the shorter is somewhere in the longer
    rare = few.where("r = 1").select(F.col("key").alias("short"), "word")
    inside = words.select(F.col("key").alias("long"), "word").join(rare, "word").where("short <> long").where(F.contains(F.concat(F.lit(" "), "long", F.lit(" ")), F.concat(F.lit(" "), "short", F.lit(" "))))
    both = inside.select(F.col("short").alias("key"), F.col("long").alias("other")).unionByName(inside.select(F.col("long").alias("key"), F.col("short").alias("other")))
    both = both.join(own.select("key"), "key", "left_semi").join(rest.select(F.col("key").alias("other")), "other", "left_semi").select("key", "other")
    at = lambda c: F.array_distinct(F.split(c, " "))
    pairs = met.unionByName(both).distinct().withColumns({"x": F.size(at("key")), "y": F.size(at("other")), "shared": F.size(F.array_intersect(at("key"), at("other")))})
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    holds = F.contains(padded("key"), padded("other")) | F.contains(padded("other"), padded("key"))
    pairs = pairs.where(holds | (2 * F.col("shared") >= F.greatest("x", "y")))
    pairs = pairs.withColumn("overlap", F.col("shared") / (F.col("x") + F.col("y") - F.col("shared")))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("overlap"), "other"))
    pairs = pairs.withColumn("rank", rank)
    pairs = pairs.where(F.col("rank") <= most) if most else pairs
    return pairs.select("key", "other", T.round4(F.col("overlap")).alias("overlap"), "rank")
