"""Links: folding of evidence, co-occurrence, relation typing, display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import normalize, round4

GLOSSARY = "glossary_occurrence"
BONUS, CAP = 0.05, 0.95


def combined(miss: Column) -> Column:
    """1 - what is missed, within [0, 1], to four decimals; to ten first, as the last digits of a product depend on the order
    in which its rows come."""
    return round4(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - miss)), 10))


def noisy_or(confidences: Column) -> Column:
    """1 - the product of (1 - c) over a group, within [0, 1], to four decimals."""
    return combined(F.product(1 - confidences))


def glossary_confidence(base: Column, occurrences: Column, bonus: float = BONUS, cap: float = CAP) -> Column:
    return round4(F.least(base + bonus * (occurrences - 1), F.lit(cap)))


KEY = ("from", "to", "relation")
PLACE = ("method", "path", "line", "section", "position")


def combine_links(evidence: DataFrame, *, keys: tuple[str, ...] = KEY, bonus: float = BONUS, cap: float = CAP) -> DataFrame:
    """(keys, confidence, methods, provenances) from flat evidence (keys, PLACE, confidence, occurrences).

    Equal evidence counts once; all glossary rows of a link are one method, whose confidence grows with their
    occurrences from the strongest one's; every other row is a method of its own.  Feeding the evidence twice changes
    nothing."""
    once = evidence.groupBy(*keys, *PLACE).agg(F.max("confidence").alias("confidence"), F.max("occurrences").alias("occurrences"))
    glossary = F.col("method") == GLOSSARY
    rows = once.groupBy(*keys).agg(
        F.coalesce(F.product(F.when(~glossary, 1 - F.col("confidence"))), F.lit(1.0)).alias("miss"),
        F.max(F.when(glossary, F.col("confidence"))).alias("base"),
        F.sum(F.when(glossary, F.col("occurrences"))).alias("n"),
        F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"),  # at most the nine methods
        F.count("*").alias("provenances"),
    )
    one = F.when(F.col("base").isNull(), 1.0).otherwise(1 - glossary_confidence(F.col("base"), F.col("n"), bonus, cap))
    confidence = combined(F.col("miss") * one)
    return rows.select(*keys, confidence.alias("confidence"), "methods", "provenances")


def cooccurrences(occurrences: DataFrame, k: int = 50, most: int = 200) -> DataFrame:
    """(id, neighbour, n, rank) from (paragraph, id): the `k` most frequent neighbours of each id, ties by id.  Of a
    paragraph the first `most` distinct ids count, which bounds its pairs."""
    once = occurrences.select("paragraph", "id").distinct()
    first = F.row_number().over(Window.partitionBy("paragraph").orderBy("id"))
    members = once.withColumn("r", first).where(F.col("r") <= most).drop("r")
    pairs = members.alias("a").join(members.alias("b"), "paragraph").where("a.id < b.id")
    counted = pairs.groupBy(F.col("a.id").alias("x"), F.col("b.id").alias("y")).agg(F.count("*").alias("n"))
    both = counted.select(F.col("x").alias("id"), F.col("y").alias("neighbour"), "n").unionByName(counted.select(F.col("y").alias("id"), F.col("x").alias("neighbour"), "n"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "neighbour"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def cooccurrence_links(neighbours: DataFrame, confidence: float = 0.4) -> DataFrame:
    """(from, to, n, confidence): undirected, from the smaller id, with the larger count of the two ends."""
    pair = neighbours.groupBy(F.least("id", "neighbour").alias("from"), F.greatest("id", "neighbour").alias("to"))
    return pair.agg(F.max("n").alias("n")).withColumn("confidence", F.lit(confidence))


def mention_links(found: DataFrame, entities: DataFrame, sections: DataFrame, allowed: DataFrame, *, undirected: tuple[str, ...] = ("related",), section: float = 0.7, base: float = 0.6) -> DataFrame:
    """(from, to, relation, method, confidence, path, line, section) for each mention of an entity in another's file.

    found: (path, line, section, target, confidence); entities: (id, type, path); sections: (type, heading (folded), name,
    relation, inverse), the sections that a type's profile maps; allowed: (relation, from_type, to_type).  A mention in a
    mapped section whose relation the pair of types allows carries that relation, turned round where it is inverse; any
    other is `related` at its own confidence.  Undirected relations go from the smaller id."""
    at = entities.select(F.col("path"), F.col("id").alias("own"), F.col("type").alias("own_type"))
    named = entities.select(F.col("id").alias("target"), F.col("type").alias("target_type"))
    rows = found.join(at, "path").join(named, "target").where(F.col("own") != F.col("target"))
    maps = sections.select(F.col("type").alias("own_type"), F.col("heading").alias("_h"), "name", F.col("relation").alias("produced"), "inverse")
    rows = rows.withColumn("_h", normalize("section")).join(maps, ["own_type", "_h"], "left")
    turned = F.coalesce(F.col("inverse"), F.lit(False))
    rows = rows.withColumns({"_f": F.when(turned, F.col("target_type")).otherwise(F.col("own_type")), "_t": F.when(turned, F.col("own_type")).otherwise(F.col("target_type"))})
    fits = allowed.select(F.col("relation").alias("produced"), F.col("from_type").alias("_f"), F.col("to_type").alias("_t"), F.lit(True).alias("_ok")).distinct()
    rows = rows.join(fits, ["produced", "_f", "_t"], "left")
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    relation = F.when(ok, F.col("produced")).otherwise("related")
    a, b = F.when(ok & turned, F.col("target")).otherwise(F.col("own")), F.when(ok & turned, F.col("own")).otherwise(F.col("target"))
    swap = relation.isin(*undirected) & (b < a)
    return rows.select(
        F.when(swap, b).otherwise(a).alias("from"), F.when(swap, a).otherwise(b).alias("to"), relation.alias("relation"),
        F.when(ok, "section_mention").otherwise(GLOSSARY).alias("method"), F.when(ok, F.lit(section)).otherwise(F.coalesce("confidence", F.lit(base))).alias("confidence"),
        "path", "line", F.when(ok, F.col("name")).alias("section"),
    )


def keyword_neighbours(occurrences: DataFrame, keywords: DataFrame, k: int = 50, most: int = 200) -> DataFrame:
    """(id, neighbour, n, rank) of the keywords (paragraph, id): what is named in the paragraphs where each is read, other
    keywords included; paragraphs without a keyword are left out before anything is paired."""
    shared = occurrences.select("paragraph", "id").join(keywords.select("paragraph").distinct(), "paragraph", "left_semi")
    found = cooccurrences(shared.unionByName(keywords.select("paragraph", "id")), k, most)
    return found.join(keywords.select("id").distinct(), "id", "left_semi")


def linked_to(links: DataFrame, entity: int | str, direction: str | None = None, relation: str | None = None) -> DataFrame:
    """(id, relation, direction, confidence, methods): what is linked to an entity at either end."""
    out = links.where(F.col("from") == F.lit(entity)).select(F.col("to").alias("id"), "relation", F.lit("out").alias("direction"), "confidence", "methods")
    in_ = links.where((F.col("to") == F.lit(entity)) & (F.col("from") != F.lit(entity))).select(F.col("from").alias("id"), "relation", F.lit("in").alias("direction"), "confidence", "methods")
    rows = out.unionByName(in_)
    rows = rows.where(F.col("direction") == direction) if direction else rows
    return rows.where(F.col("relation") == relation) if relation else rows


def related_to(links: DataFrame, types: DataFrame, entity: int | str, wanted: tuple[str, ...] = ("decision", "meeting")) -> DataFrame:
    """`linked_to` of the other ends whose type (id, type) is wanted."""
    return linked_to(links, entity).join(types.where(F.col("type").isin(*wanted)), "id")


def explained(links: DataFrame, entity: int | str, other: int | str) -> DataFrame:
    """(relation, direction, confidence, methods, provenances): every link between two entities, seen from the first."""
    x, y = F.lit(entity), F.lit(other)
    out = (F.col("from") == x) & (F.col("to") == y)
    rows = links.where(out | ((F.col("from") == y) & (F.col("to") == x)))
    return rows.select("relation", F.when(out, "out").otherwise("in").alias("direction"), "confidence", "methods", "provenances")


def type_relations(links: DataFrame, types: DataFrame, allowed: DataFrame, cap: float = 0.6) -> DataFrame:
    """(from, to, relation, confidence, finding) from links (from, to, relation, confidence), types (id, type) and the
    allowed pairs (relation, from_type, to_type), wildcards written out beforehand.

    A named relation must allow its pair of types, else E-META-REL.  `related` becomes the only relation that allows the
    pair; or, turned round, the only one that allows the reverse; several give I-REL-AMBIGUOUS; what stays `related` is
    capped and goes from the smaller id."""
    ends = links.join(types.select(F.col("id").alias("from"), F.col("type").alias("ft")), "from").join(types.select(F.col("id").alias("to"), F.col("type").alias("tt")), "to")
    by = allowed.groupBy("from_type", "to_type").agg(F.count_distinct("relation").alias("count"), F.min("relation").alias("one"))
    forward = by.select(F.col("from_type").alias("ft"), F.col("to_type").alias("tt"), F.col("count").alias("fn"), F.col("one").alias("f"))
    backward = by.select(F.col("to_type").alias("ft"), F.col("from_type").alias("tt"), F.col("count").alias("bn"), F.col("one").alias("b"))
    named = allowed.select("relation", F.col("from_type").alias("ft"), F.col("to_type").alias("tt"), F.lit(True).alias("ok")).distinct()
    rows = ends.join(forward, ["ft", "tt"], "left").join(backward, ["ft", "tt"], "left").join(named, ["relation", "ft", "tt"], "left")
    related = F.col("relation") == "related"
    ahead, back = related & (F.col("fn") == 1), related & F.col("fn").isNull() & (F.col("bn") == 1)
    stays = related & ~F.coalesce(ahead, F.lit(False)) & ~F.coalesce(back, F.lit(False))
    turn = F.coalesce(back, F.lit(False)) | (stays & (F.col("from") > F.col("to")))
    finding = F.when(~related & F.col("ok").isNull(), "E-META-REL").when(related & (F.coalesce("fn", "bn") > 1), "I-REL-AMBIGUOUS")
    return rows.select(
        F.when(turn, F.col("to")).otherwise(F.col("from")).alias("from"),
        F.when(turn, F.col("from")).otherwise(F.col("to")).alias("to"),
        F.when(ahead, F.col("f")).when(back, F.col("b")).otherwise(F.col("relation")).alias("relation"),
        F.when(stays, F.least(F.col("confidence"), F.lit(cap))).otherwise(F.col("confidence")).alias("confidence"),
        finding.alias("finding"),
    )


def displayed(links: DataFrame, most: int = 6, types: DataFrame | None = None, priorities: DataFrame | None = None) -> DataFrame:
    """(id, neighbour, relation, direction, confidence, rank): of each neighbour its best relation, in, out or both; the
    first `most` by confidence, then id.  With types (id, type) and the profile's priorities (type, neighbour_type, priority),
    those of the types that come first for the type of `id` go before; types without one come last."""
    out = links.select(F.col("from").alias("id"), F.col("to").alias("neighbour"), "relation", "confidence", F.lit("out").alias("d"))
    in_ = links.select(F.col("to").alias("id"), F.col("from").alias("neighbour"), "relation", "confidence", F.lit("in").alias("d"))
    both = out.unionByName(in_).where("id <> neighbour")
    best = both.groupBy("id", "neighbour").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "relation")).alias("b"), F.min("d").alias("low"), F.max("d").alias("high"))
    rows = best.select("id", "neighbour", F.col("b.relation").alias("relation"), F.when(F.col("low") != F.col("high"), "both").otherwise(F.col("low")).alias("direction"), (-F.col("b.c")).alias("confidence"))
    first = F.lit(0)
    if types is not None and priorities is not None:
        rows = rows.join(types.select("id", F.col("type").alias("_t")), "id").join(types.select(F.col("id").alias("neighbour"), F.col("type").alias("_n")), "neighbour")
        rows = rows.join(priorities.select(F.col("type").alias("_t"), F.col("neighbour_type").alias("_n"), F.col("priority").alias("_p")), ["_t", "_n"], "left")
        first = F.coalesce(F.col("_p"), F.lit(1 << 30))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(first, F.desc("confidence"), "neighbour"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("id", "neighbour", "relation", "direction", "confidence", "rank")
