"""Transcripts: merging of turns, numbering of speakers, names replaced."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_turns(cues: DataFrame, by: str, order: str, speaker: str, text: str) -> DataFrame:
    """(by, turn, speaker, first, cues, text): consecutive cues of a speaker as one turn, their texts joined by a space."""
    w = Window.partitionBy(by).orderBy(order)
    change = F.when(F.lag(speaker).over(w).eqNullSafe(F.col(speaker)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = cues.withColumn("_turn", F.sum(change).over(w))
    texts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("x"))))  # one turn's cues
    out = rows.groupBy(by, "_turn").agg(F.min(speaker).alias("speaker"), F.min(order).alias("first"), F.count("*").alias("cues"), texts.alias("t"))
    return out.select(by, F.col("_turn").alias("turn"), "speaker", "first", "cues", F.array_join(F.col("t.x"), " ").alias("text"))


def anchored(cues: DataFrame, by: str, start: str = "start", order: str = "index") -> DataFrame:
    """Cues with anchor: `t` and the second that a cue starts in; the n-th of one second takes `-n`."""
    base = F.concat(F.lit("t"), F.floor(start).cast("string"))
    nth = F.row_number().over(Window.partitionBy(by, F.floor(start)).orderBy(start, order))
    return cues.withColumn("anchor", F.when(nth == 1, base).otherwise(F.concat_ws("-", base, nth.cast("string"))))


def numbered_speakers(cues: DataFrame, by: str, order: str, speaker: str) -> DataFrame:
    """(by, speaker, number): by first appearance."""
    first = cues.groupBy(by, speaker).agg(F.min(order).alias("_first"))
    return first.withColumn("number", F.dense_rank().over(Window.partitionBy(by).orderBy("_first"))).drop("_first")


def replace_names(text: Column | str, names: list[str], mark: str = "[person]") -> Column:
    """Each name as a whole word replaced; the longest first, so that none cuts into another."""
    listed = "|".join(re.escape(n) for n in sorted(set(names), key=lambda n: (-len(n), n)))
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, rf"(?<![\p{{L}}\p{{N}}])(?:{listed})(?![\p{{L}}\p{{N}}])", mark) if listed else F.col(text) if isinstance(text, str) else text


def pseudonymized_transcript(cues: DataFrame, by: str, order: str, speaker: str, text: str, names: list[str], *, mark: str = "[person]", label: str = "Speaker") -> DataFrame:
    """`cues` with the speakers as `Speaker n` by first appearance in their transcript, and in the texts the listed names as the
    mark and the transcript's own speakers as their labels; null speakers stay."""
    numbered = numbered_speakers(cues.where(F.col(speaker).isNotNull()), by, order, speaker)
    named = numbered.select(by, speaker, F.concat_ws(" ", F.lit(label), F.col("number").cast("string")).alias("_label"))
    longest = F.array_sort(F.collect_list(F.struct((-F.length(speaker)).alias("n"), F.col(speaker).alias("s"), F.col("_label").alias("l"))))
    own = named.groupBy(by).agg(longest.alias("_own"))  # one transcript's speakers
    rows = cues.join(named, [by, speaker], "left").join(own, by, "left")
    # a name that the mark or a label has taken is not looked at again: speakers first, then the listed names
    quoted = lambda n: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), n, F.lit(r"\E(?![\p{L}\p{N}])"))
    held = F.aggregate(F.coalesce("_own", F.array().cast("array<struct<n:int,s:string,l:string>>")), F.col(text), lambda t, o: F.regexp_replace(t, quoted(o["s"]), o["l"]))
    out = {speaker: F.col("_label"), text: replace_names(held, names, mark)}
    return rows.select(*(out[c].alias(c) if c in out else F.col(c) for c in cues.columns))


def capitalised_runs(text: Column | str) -> Column:
    """Two or more neighbouring words, parted by blanks alone, that begin with a capital and hold a small letter."""
    word = r"\p{Lu}(?=[\p{L}\p{M}'’-]*\p{Ll})[\p{L}\p{M}\p{N}]*(?:['’-][\p{L}\p{M}\p{N}]+)*"
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){word}(?:[ \t]+{word})+"), F.lit(0))


def personal_mentions(text: Column | str, known: list[str]) -> Column:
    """Capitalised runs that hold none of the known names as whole words."""
    listed = "|".join(re.escape(n) for n in sorted({n for n in known if n}, key=lambda n: (-len(n), n)))
    runs = capitalised_runs(text)
    return F.filter(runs, lambda r: ~r.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{listed})(?![\p{{L}}\p{{N}}])")) if listed else runs


def pseudonymized(rows: DataFrame, text_cols: list[str], names: list[str], in_scope: Column, mark: str = "[person]") -> DataFrame:
    """`rows` with the names replaced in the columns of rows that are in the scope, arrays of texts item by item, and
    `replaced`, whether anything was."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    new = {c: F.transform(F.col(c), lambda x: replace_names(x, names, mark)) if kinds[c] == "array<string>" else replace_names(c, names, mark) for c in text_cols}
    scoped = {c: F.when(F.coalesce(in_scope, F.lit(False)), v).otherwise(F.col(c)) for c, v in new.items()}
    changed = F.lit(False)
    for c in text_cols:
        changed = changed | ~F.coalesce(scoped[c].eqNullSafe(F.col(c)), F.lit(True))
    return rows.select(*(scoped[c].alias(c) if c in scoped else F.col(c) for c in rows.columns), changed.alias("replaced"))


def withheld(documents: DataFrame, *, publish: bool, enabled: bool, dictionary: bool, rewritable: tuple[str, ...] = ("vtt", "srt")) -> DataFrame:
    """Documents (format, unit, ...) with `published` and `finding`: transcripts (unit `cue`) stay back unless they are to be
    published, or where names are to be replaced and there is no dictionary or no writer for the format; the last is
    W-PRIVACY-WITHHELD.  Other documents pass."""
    cue, can = F.col("unit") == "cue", F.col("format").isin(*rewritable)
    back = F.lit(not publish or (enabled and not dictionary))
    stuck = F.lit(publish and dictionary) & ~F.coalesce(can, F.lit(False))
    return documents.withColumns({"published": ~F.coalesce(cue, F.lit(False)) | (~back & ~stuck), "finding": F.when(cue & ~back & stuck, "W-PRIVACY-WITHHELD")})
