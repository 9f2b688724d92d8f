"""Walks over links: neighbourhoods, shortest paths, components, emergent domains.  Each round is one join; visited ends
are taken out by an anti join and the round is stored, so the plan does not grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions.text import round4
from sparkloom.session import forget, stored


def undirected(links: DataFrame) -> DataFrame:
    """(a, b, c): both directions, the best confidence of each pair."""
    rows = links.select(F.col("from").alias("a"), F.col("to").alias("b"), F.col("confidence").alias("c")).where("a <> b")
    return rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "c")).groupBy("a", "b").agg(F.max("c").alias("c"))


def near(links: DataFrame, start: DataFrame, radius: int = 3) -> DataFrame:
    """(origin, id, depth, score): all within `radius` links of each row of `start` (id); score: the best sum of confidences
    over the ends of the level before."""
    edges = undirected(links)
    seen = front = stored(start.select(F.col("id").alias("origin"), "id", F.lit(0).alias("depth"), F.lit(0.0).alias("score")).distinct())
    for depth in range(1, radius + 1):
        step = front.join(edges, front["id"] == edges["a"]).groupBy("origin", F.col("b").alias("id")).agg(round4(F.max(F.col("score") + F.col("c"))).alias("score"))
        front = stored(step.join(seen.select("origin", "id"), ["origin", "id"], "left_anti").select("origin", "id", F.lit(depth).alias("depth"), "score"))
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def path(links: DataFrame, start: int | str, goal: int | str, most: int = 4) -> DataFrame:
    """(step, id): the path of fewest links from `start` to `goal`, then of the best sum of confidences, then through the
    smallest ids; no rows if it takes more than `most` links.  At most `most` + 1 rows come back."""
    edges = undirected(links)
    spark = links.sparkSession
    kind = edges.schema["a"].dataType
    front = spark.range(1).select(F.lit(start).cast(kind).alias("id"), F.lit(0.0).alias("score"), F.array(F.lit(start).cast(kind)).alias("way"))
    seen = front.select("id")
    for _ in range(most):
        if front.where(F.col("id") == F.lit(goal)).limit(1).count():
            break
        step = front.join(edges, front["id"] == edges["a"]).select(F.col("b").alias("id"), round4(F.col("score") + F.col("c")).alias("score"), "way", F.col("a").alias("by"))
        best = step.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "by", "way")).alias("m"))
        front = stored(best.join(seen, "id", "left_anti").select("id", (-F.col("m.s")).alias("score"), F.concat("m.way", F.array("id")).alias("way")))
        seen = seen.unionByName(front.select("id"))
    return front.where(F.col("id") == F.lit(goal)).select(F.posexplode("way").alias("step", "id"))


#: Parts in which the neighbours of a node are dealt out.
SALTS = 32


def lowest(edges: DataFrame) -> DataFrame:
    """(a, b) with m, the least b of each a.  A hub's edges stay in SALTS parts, each with its own minimum, and what comes
    together by node is at most SALTS of these."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy("a", "part").agg(F.min("b").alias("m"))
    nodes = parts.groupBy("a").agg(F.min("m").alias("m"), F.collect_list("part").alias("parts"))
    return dealt.join(nodes.select("a", "m", F.explode("parts").alias("part")), ["a", "part"]).select("a", "b", "m")


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable, by large-star and small-star rounds to the fixpoint."""
    now = stored(links.select(F.greatest("from", "to").alias("a"), F.least("from", "to").alias("b")).where("a > b").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = lowest(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = lowest(large).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        before, now = now, stored(small.select("e.a", "e.b").where("a > b").distinct())
        forget(before)
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was == state:
            break
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def degrees(links: DataFrame) -> DataFrame:
    return undirected(links).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))


def pivots(links: DataFrame, least: int, most: int) -> DataFrame:
    """(id, degree) of those whose number of neighbours lies within the bounds."""
    return degrees(links).where(F.col("degree").between(least, most))


def emergent_domains(links: DataFrame, pivot: DataFrame, radius: int = 3) -> DataFrame:
    """(id, pivot, distance): the nearest pivot of each id within `radius`; of equals the one of the higher degree, then the
    smaller id.  pivot: (id, degree)."""
    edges = undirected(links).select("a", "b")
    first = pivot.select("id", F.struct(F.lit(0).alias("distance"), (-F.col("degree")).alias("d"), F.col("id").alias("pivot")).alias("best"))
    now = stored(first)
    for _ in range(radius):
        step = now.join(edges, now["id"] == edges["a"]).select(F.col("b").alias("id"), F.struct((F.col("best.distance") + 1).alias("distance"), F.col("best.d").alias("d"), F.col("best.pivot").alias("pivot")).alias("best"))
        now = stored(now.unionByName(step).groupBy("id").agg(F.min("best").alias("best")))
    return now.select("id", "best.pivot", "best.distance")


def proposed_domains(entities: DataFrame, links: DataFrame, *, lock: DataFrame | None = None, least: int = 3, most: int = 1 << 30, radius: int = 2, stopwords: tuple[str, ...] = (), rejected: tuple[str, ...] = (), assign: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entities with domain and domain_origin, suggestions (check, entity, pivot, degree, distance, domain, own)).

    entities: (id, type, title, domain, domain_origin, ...).  First the lock (id, domain) files what no declaration does.
    Pivots are terms, whose title is neither rejected nor of stopwords alone, with `least` to `most` neighbours over the
    links; each unclassified entity within `radius` of one is a candidate for its domain, or for one named after it where it
    is unclassified itself.  `assign` files the candidates, with the origin `inferred`."""
    loose = F.col("domain_origin") == "unclassified"
    if lock is not None:
        entities = entities.join(lock.select("id", F.col("domain").alias("_lock")), "id", "left")
        taken = loose & F.col("_lock").isNotNull()
        entities = entities.withColumns({"domain": F.when(taken, F.col("_lock")).otherwise(F.col("domain")), "domain_origin": F.when(taken, "lock").otherwise(F.col("domain_origin"))}).drop("_lock")
    words = F.split(T.comparison_form("title"), " ")
    out = [T.comparison_form(F.lit(w)) for w in (*stopwords, *rejected)]
    plain = ~F.forall(words, lambda w: w.isin(*out)) & ~F.array_join(words, " ").isin(*out) if out else F.lit(True)
    terms = entities.where((F.col("type") == "term") & plain).select("id")
    pivot = pivots(links, least, most).join(terms, "id", "left_semi")
    near_ = emergent_domains(links, pivot, radius).join(pivot.select(F.col("id").alias("pivot"), "degree"), "pivot")
    name = F.regexp_extract(F.col("id").cast("string"), "([^/]*)$", 1)
    homes = entities.select(F.col("id").alias("pivot"), F.when(loose | F.col("domain").isNull(), name).otherwise(F.col("domain")).alias("proposed"), (~loose & F.col("domain").isNotNull()).alias("own"))
    found = entities.where(loose).select("id").join(near_, "id").join(homes, "pivot")
    suggested = found.select(F.lit("I-DOMAIN-SUGGESTED").alias("check"), F.col("id").alias("entity"), "pivot", "degree", "distance", F.col("proposed").alias("domain"), "own")
    if assign:
        entities = entities.join(found.select("id", "proposed"), "id", "left")
        entities = entities.withColumns({"domain": F.coalesce("proposed", "domain"), "domain_origin": F.when(F.col("proposed").isNotNull(), "inferred").otherwise(F.col("domain_origin"))}).drop("proposed")
    return entities, suggested
