"""Search: weighted postings, prefix ranking, facets, resolution of an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T

WEIGHTS = {"title": 5.0, "alias": 4.0, "summary": 2.0, "other": 1.0}


def postings(fields: DataFrame) -> DataFrame:
    """(shard, token, entity, weight) from (entity, field, text): a token weighs once for each field that holds it."""
    rows = fields.select("entity", "field", F.explode(T.search_tokens("text")).alias("token")).distinct()
    weight = F.coalesce(*(F.when(F.col("field") == f, w) for f, w in WEIGHTS.items()), F.lit(WEIGHTS["other"]))
    return rows.groupBy(F.substring("token", 1, 2).alias("shard"), "token", "entity").agg(F.sum(weight).alias("weight"))


def ranked(index: DataFrame, words: list[str], cited: DataFrame | None = None, keywords: DataFrame | None = None) -> DataFrame:
    """(entity, score, rank): entities that hold a token with each word as its prefix; the best weight a word, summed; what is
    no keyword page first, then by score, citations and id.  Only the shards of the words are read of a stored index."""
    hits = None
    for i, word in enumerate(dict.fromkeys(words)):
        some = index.where((F.col("shard") == word[:2]) & F.col("token").startswith(word)).groupBy("entity").agg(F.max("weight").alias(f"s{i}"))
        hits = some if hits is None else hits.join(some, "entity")
    score = sum((F.col(f"s{i}") for i in range(len(dict.fromkeys(words)))), F.lit(0.0))
    rows = hits.select("entity", score.alias("score"))
    rows = rows.join(cited, "entity", "left").withColumn("cited", F.coalesce("cited", F.lit(0))) if cited is not None else rows.withColumn("cited", F.lit(0).cast("long"))
    if keywords is not None:
        rows = rows.join(keywords.select("entity").distinct().withColumn("last", F.lit(1)), "entity", "left").withColumn("last", F.coalesce("last", F.lit(0)))
    else:
        rows = rows.withColumn("last", F.lit(0))
    # numbered within what is equal but for the id, whose sizes are summed up over the few distinct orders before
    order = ["last", F.desc("score"), F.desc("cited")]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("last", "score", "cited").orderBy("entity")))
    sizes = rows.groupBy("last", "score", "cited").agg(F.count("*").alias("n"))
    before = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return rows.join(before, ["last", "score", "cited"]).select("entity", "score", (F.col("ahead") + F.col("nth")).alias("rank"))


def filtered(rows: DataFrame, chosen: dict[str, list[str]], keywords: str = "any") -> DataFrame:
    """Rows that have one of the values of every facet chosen; keyword pages (column keyword) too, alone, or not at all."""
    for facet, values in chosen.items():
        rows = rows.where(F.col(facet).isin(*values)) if values else rows
    own = F.coalesce(F.col("keyword"), F.lit(False)) if "keyword" in rows.columns else F.lit(False)
    return rows.where(own) if keywords == "only" else rows.where(~own) if keywords == "exclude" else rows


def facet_counts(rows: DataFrame, chosen: dict[str, list[str]], keywords: str = "any") -> DataFrame:
    """(facet, value, n): how many rows each value has under the choices of the other facets and the keyword mode.  One pass:
    each row goes to the facets whose other conditions it meets."""
    rows = filtered(rows, {}, keywords)
    names = list(chosen)
    fits = {f: (F.col(f).isin(*v) if v else F.lit(True)) for f, v in chosen.items()}

    def others(f: str) -> Column:
        out = F.lit(True)
        for g in names:
            out = out & (fits[g] if g != f else F.lit(True))
        return out

    sent = F.array(*(F.when(others(f), F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"))) for f in names))
    return rows.select(F.explode(F.filter(sent, lambda x: x.isNotNull())).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def resolve(entities: DataFrame, expression: str) -> DataFrame:
    """(id, tier): entities (id, title) that an expression names, of the first tier that has any: 1 id, 2 title, 3 comparison
    form, 4 prefix of it."""
    form, own = F.array_join(T.tokens("title"), " "), F.array_join(T.tokens(F.lit(expression)), " ")
    tier = F.when(F.col("id") == expression, 1).when(F.col("title") == expression, 2).when(form == own, 3).when(form.startswith(own), 4)
    rows = entities.select("id", tier.alias("tier")).where("tier is not null")
    return rows.join(F.broadcast(rows.agg(F.min("tier").alias("tier"))), "tier").select("id", "tier")


def closest(index: DataFrame, word: str) -> DataFrame:
    """(token): where nothing begins with `word`, the token that shares the longest beginning of two characters at least
    with it; of equals the shortest, then the first."""
    common = sum((F.when(F.col("token").startswith(word[:n]), 1).otherwise(0) for n in range(1, len(word) + 1)), F.lit(0))
    rows = index.where(F.col("shard") == word[:2]).select("token").distinct().withColumn("common", common).where("common >= 2")
    best = F.max(F.struct("common", (-F.length("token")).alias("short"))).alias("b")
    top = rows.agg(best).select(F.col("b.common").alias("common"), (-F.col("b.short")).alias("size"))
    return rows.withColumn("size", F.length("token")).join(F.broadcast(top), ["common", "size"]).agg(F.min("token").alias("token"))


def passages(rows: DataFrame, phrase: str, around: int = 80) -> DataFrame:
    """(id, position, excerpt): rows (id, text) whose folded text holds the folded phrase, the first match and what stands
    about it."""
    folded = rows.select("id", T.normalize("text").alias("f")).withColumn("position", F.locate(phrase, F.col("f")).cast("long")).where("position > 0")
    low = F.greatest(F.lit(1), F.col("position") - around)
    return folded.select("id", "position", F.substring("f", low.cast("int"), (F.col("position") + len(phrase) + around - low).cast("int")).alias("excerpt"))
