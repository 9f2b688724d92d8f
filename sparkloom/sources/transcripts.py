"""WebVTT and SubRip transcripts: reading into cues, and writing with the same time codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import cue_seconds, timecode

TIMING = r"((?:\d+:)?\d+:\d+[.,]\d+)\s+-->\s+((?:\d+:)?\d+:\d+[.,]\d+)"


def cues(files: DataFrame) -> DataFrame:
    """(path, index, start, end, speaker, text) from (path, text): blocks between blank lines that hold a timing; the
    speaker from a voice tag or a `Name: ` in front."""
    blocks = files.select("path", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n[ \t]*\n+")).alias("block", "b")).where(F.col("b").rlike(TIMING))
    body = F.regexp_extract("b", rf"(?s){TIMING}[^\n]*\n?(.*)", 3)
    voice = F.regexp_extract(body, r"<v(?:\.[^ >]*)? ([^>]*)>", 1)
    named = F.regexp_extract(body, r"^([\p{L}][^:\n]{0,40}): ", 1)
    plain = F.regexp_replace(F.regexp_replace(body, "</?[^>]+>", ""), r"\s+", " ")
    words = F.when((voice == "") & (named != ""), F.regexp_replace(plain, r"^[^:]{1,41}: ", "")).otherwise(plain)
    decoded = F.replace(F.replace(F.replace(F.replace(words, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    rows = blocks.select("path", "block", cue_seconds(F.regexp_extract("b", TIMING, 1)).alias("start"), cue_seconds(F.regexp_extract("b", TIMING, 2)).alias("end"), F.coalesce(F.nullif(voice, F.lit("")), F.nullif(named, F.lit(""))).alias("speaker"), F.trim(decoded).alias("text"))
    return rows.select("path", F.col("block").alias("index"), "start", "end", "speaker", "text")


def vtt(found: DataFrame) -> DataFrame:
    """(path, text): each file's cues as WebVTT again; a file's cues come together in one row."""
    t = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(timecode("start"), F.lit(" --> "), timecode("end"), F.lit("\n"), F.when(F.col("speaker").isNotNull(), F.concat(F.lit("<v "), "speaker", F.lit(">"))).otherwise(""), t("text"))
    rows = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("index", line.alias("l")))).alias("c"))
    return rows.select("path", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.col("c.l"), "\n\n"), F.lit("\n")).alias("text"))
