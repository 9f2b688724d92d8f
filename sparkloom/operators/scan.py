"""Recognition of known phrases in text: a containment join of the units' word runs with a dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators.terms import runs


def dictionary(forms: DataFrame, least: int = 3, stopwords: tuple[str, ...] = (), short: tuple[str, ...] = ()) -> DataFrame:
    """(key, words, targets, homonym) from (form, priority, id): forms in comparison form; too short ones, unless named in
    `short`, and those all of stopwords stay out; targets by priority, then id."""
    key = F.array_join(T.tokens("form"), " ")
    rows = forms.select(key.alias("key"), "priority", "id").where((F.length("key") >= least) | F.col("key").isin(*short))
    if stopwords:
        rows = rows.where(~F.forall(F.split("key", " "), lambda w: w.isin(*stopwords)))
    made = rows.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("priority", "id"))).alias("t"))  # a form's targets
    return made.select("key", F.size(F.split("key", " ")).alias("words"), F.col("t.id").alias("targets"), (F.size("t") > 1).alias("homonym"))


def occurrences(units: DataFrame, known: DataFrame) -> DataFrame:
    """(path, line, start, end, key): every run of words that is a key.  A word is met with the lengths of the keys that it
    begins before any run is made, and no run is made for words that begin none; the planner broadcasts the dictionary while
    it is small."""
    longest = known.agg(F.max("words")).first()[0] or 1
    heads = known.groupBy(F.element_at(F.split("key", " "), 1).alias("head")).agg(F.sort_array(F.collect_set("words")).alias("lengths"))  # at most the longest key's
    rows = runs(units, longest).select("path", "line", F.col("position").alias("start"), "w", F.element_at("w", 1).alias("head"))
    rows = rows.join(heads, "head").select("path", "line", "start", "w", F.explode(F.filter("lengths", lambda n: n <= F.size("w"))).alias("n"))
    rows = rows.select("path", "line", "start", (F.col("start") + F.col("n")).alias("end"), F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("key"))
    return rows.join(known.select("key"), "key", "left_semi").select("path", "line", "start", "end", "key")


def longest_matches(found: DataFrame) -> DataFrame:
    """Spans that lie inside no other one of their line; equal spans and partial overlaps stay.  Two windows, no range
    join: a span stays if it ends last of those that start with it and behind all that start before it."""
    together = F.max("end").over(Window.partitionBy("path", "line", "start"))
    before = F.max("end").over(Window.partitionBy("path", "line").orderBy("start").rangeBetween(Window.unboundedPreceding, -1))
    rows = found.withColumns({"_t": together, "_b": before})
    return rows.where((F.col("end") == F.col("_t")) & (F.col("_b").isNull() | (F.col("end") > F.col("_b")))).drop("_t", "_b")


def placed_words(units: DataFrame) -> DataFrame:
    """(path, line, position, word, gap): the words of each unit in the order of their places, folded and in the singular,
    and what stands between a word and the next."""
    pieces = F.regexp_extract_all("text", F.lit(rf"({T.WORD})([^\p{{L}}\p{{M}}\p{{N}}]*)"), F.lit(0))
    rows = units.select("path", "line", F.posexplode(pieces).alias("position", "piece"))
    word = T.singularize(T.fold(F.regexp_extract("piece", f"^{T.WORD}", 0)))
    return rows.select("path", "line", "position", word.alias("word"), F.regexp_extract("piece", r"[^\p{L}\p{M}\p{N}]*$", 0).alias("gap"))


def announced(units: DataFrame, found: DataFrame, prefixes: dict[str, list[str]]) -> DataFrame:
    """`found` with expected_type: the type whose prefix stands right before the span, blanks between alone; the longest
    prefix first, and one that two types list announces none."""
    listed: dict[str, set[str]] = {}
    for type_, phrases in prefixes.items():
        for phrase in phrases:
            listed.setdefault(phrase, set()).add(type_)
    spark = found.sparkSession
    known = spark.createDataFrame([(p, next(iter(t)) if len(t) == 1 else None) for p, t in listed.items()], "phrase string, type string")
    known = known.select(F.array_join(T.tokens("phrase"), " ").alias("phrase"), "type").groupBy("phrase").agg(F.when(F.count_distinct("type") == F.lit(1), F.when(F.count("type") == F.count("*"), F.min("type"))).alias("type")).where("type is not null")
    longest = known.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 0
    out = found.withColumn("expected_type", F.lit(None).cast("string"))
    if not longest:
        return out
    words = placed_words(units.join(found.select("path", "line").distinct(), ["path", "line"], "left_semi"))
    w = Window.partitionBy("path", "line").orderBy("position")
    best = F.lit(None).cast("string")
    rows = words
    for n in range(1, longest + 1):
        blank = F.lag(F.col("gap").rlike(r"^\s*$"), n).over(w)
        rows = rows.withColumns({f"p{n}": F.lag("word", n).over(w), f"b{n}": F.coalesce(blank, F.lit(False))})
    for n in range(longest, 0, -1):
        phrase = F.concat_ws(" ", *(F.col(f"p{i}") for i in range(n, 0, -1)))
        whole = F.forall(F.array(*(F.col(f"b{i}") for i in range(1, n + 1))), lambda b: b)
        rows = rows.withColumn(f"k{n}", F.when(whole, phrase))
        rows = rows.join(known.select(F.col("phrase").alias(f"k{n}"), F.col("type").alias(f"t{n}")), f"k{n}", "left")
    best = F.coalesce(*(F.col(f"t{n}") for n in range(longest, 0, -1)), best)
    types = rows.select("path", "line", F.col("position").alias("start"), best.alias("expected_type")).where("expected_type is not null")
    return found.join(types, ["path", "line", "start"], "left")


def mentions(found: DataFrame, known: DataFrame, base: float = 0.6, bonus: float = 0.1, homonym: float = 0.5) -> DataFrame:
    """(path, line, start, key, target, confidence) and expected_type where `found` has it: each span's targets, of homonyms
    at a lower confidence, of spans that a type's prefix announces at a higher one."""
    extra = [c for c in ("end", "expected_type") if c in found.columns]
    rows = found.join(known.select("key", "targets", "homonym"), "key")
    more = F.when(F.col("expected_type").isNotNull(), bonus).otherwise(0.0) if "expected_type" in extra else F.lit(0.0)
    value = T.round4((F.lit(base) + more) * F.when(F.col("homonym"), homonym).otherwise(1.0))
    return rows.select("path", "line", "start", "key", F.explode("targets").alias("target"), value.alias("confidence"), *extra)


def recognised(found: DataFrame) -> DataFrame:
    """(path, line, start, end, target) of mentions: the first target of each span by id, the longer one of spans that begin
    together."""
    first = F.row_number().over(Window.partitionBy("path", "line", "start").orderBy("target", F.desc("end"), "key"))
    return found.withColumn("_r", first).where("_r = 1").select("path", "line", "start", "end", "target")


def panel(passages: DataFrame, lead_type: str | None = None, inline: int = 5) -> DataFrame:
    """(target, path, line, passages, place) from (target, source, path, line, type): the pages of a target by their number of
    passages, those of the lead type first; the first passage of each of the first `inline` pages leads, then their others,
    then page by page."""
    once = passages.select("target", "source", "path", "line", "type").distinct()
    pages = once.groupBy("target", "source", "path").agg(F.count("*").alias("passages"), F.min("line").alias("first"), F.max(F.col("type") == F.lit(lead_type)).alias("lead") if lead_type else F.lit(False).alias("lead"))
    order = Window.partitionBy("target").orderBy(F.desc("lead"), F.desc("passages"), "source", "path")
    pages = pages.withColumn("page", F.row_number().over(order))
    rows = once.select("target", "source", "path", "line").distinct().join(pages, ["target", "source", "path"])
    group = F.when((F.col("page") <= inline) & (F.col("line") == F.col("first")), 0).when(F.col("page") <= inline, 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("target").orderBy(group, "page", "line"))
    return rows.withColumn("place", place).select("target", "source", "path", "line", "passages", "place")
