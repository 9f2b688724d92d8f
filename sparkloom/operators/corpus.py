"""Questions on the whole corpus: filters, statistics, recency, findings, views."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import stored


def listed(entities: DataFrame, **wanted: str | int) -> DataFrame:
    """Entities that meet all of the equalities."""
    for name, value in wanted.items():
        entities = entities.where(F.col(name) == value)
    return entities


def count_by(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n) for each column and over all, in one pass of grouping sets; null is (none)."""
    sets = [[c] for c in columns] + [[]]
    counted = rows.select(columns).groupingSets(sets, *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    bit = lambda i: F.getbit(F.col("g"), F.lit(len(columns) - 1 - i))
    dimension = F.coalesce(*(F.when(bit(i) == 0, c) for i, c in enumerate(columns)), F.lit("all"))
    value = F.coalesce(*(F.when(bit(i) == 0, F.coalesce(F.col(c).cast("string"), F.lit("(none)"))) for i, c in enumerate(columns)), F.lit("all"))
    return counted.select(dimension.alias("dimension"), value.alias("value"), "n")


def group_summary(groups: DataFrame, rows: DataFrame, key: str, date: str) -> DataFrame:
    """(key, n, newest) for each of `groups`, empty ones too."""
    found = rows.groupBy(key).agg(F.count("*").alias("n"), F.max(date).alias("newest"))
    return groups.select(key).join(found, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def findings_of(findings: DataFrame, entity: int | str | None = None, check: str | None = None) -> DataFrame:
    """Findings of an entity, of a check, or of both."""
    rows = findings if entity is None else findings.where(F.col("entity") == F.lit(entity))
    return rows if check is None else rows.where(F.col("check") == check)


def recent(rows: DataFrame, date: str, since: str, *order: str) -> DataFrame:
    return rows.where(F.col(date) >= F.lit(since).cast("timestamp")).orderBy(F.desc(date), *order)


def bounded(rows: DataFrame, by: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first `most` rows of each group, with the number of those left out as `more`.  The first ones are chosen before
    anything is shuffled, and the counts are sums, so a large group meets no task as a whole."""
    total = rows.groupBy(*by).agg(F.greatest(F.lit(0), F.count("*") - most).alias("more"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most)
    total = total.select(*(F.col(c).alias(f"_{c}") for c in by), "more")
    on = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    return first.join(total, on).drop(*(f"_{c}" for c in by))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Rows with their place (from 1) in their group; `order` (columns, with a leading - for falling ones) tells all rows of
    a group apart.  Rows are range partitioned by group and order, counted by partition, and numbered behind those before:
    a group of any size is numbered by as many tasks as it fills."""
    keys = [*(F.col(c) for c in by), *(F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order)]
    part, ahead = "_part", "_ahead"
    held = stored(rows.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()))
    counts = held.groupBy(*by, part).agg(F.count("*").alias(name))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col(part).alias("_at"), F.coalesce(F.sum(name).over(before), F.lit(0)).alias(ahead))
    on = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.col(part) == F.col("_at"))
    nth = F.row_number().over(Window.partitionBy(*by, part).orderBy(*keys[len(by) :]))
    return held.withColumn(name, nth).join(counts, on).withColumn(name, F.col(name) + F.col(ahead)).select(*rows.columns, name)


def changed_with(rows: DataFrame, commit: list[str], key: str, value: int | str) -> DataFrame:
    """The other rows that changed in the commit of the row whose `key` is `value`."""
    own = rows.where(F.col(key) == F.lit(value)).select(*commit).distinct()
    return rows.join(own, commit, "left_semi").where(F.col(key) != F.lit(value))


def dormant(rows: DataFrame, key: str, date: Column, at: str, thresholds: dict[str, int], default: int = 180) -> DataFrame:
    """(key, newest, days) of groups without a change for more days than theirs."""
    days = F.datediff(F.lit(at).cast("date"), F.max(F.to_date(date)))
    limit = F.coalesce(*(F.when(F.col(key) == k, d) for k, d in thresholds.items()), F.lit(default))
    out = rows.groupBy(key).agg(F.max(F.to_date(date)).alias("newest"), days.alias("days"))
    return out.where(F.col("days") > limit)


def last_rule(rows: DataFrame, rules: list[tuple[Column, str]], default: str) -> Column:
    """The value of the last rule that holds."""
    return F.coalesce(*(F.when(c, v) for c, v in reversed(rules)), F.lit(default))


def folder_tree(rows: DataFrame, path: Column) -> DataFrame:
    """(folder, depth, n): every folder on the way to each row, sub-folders counted in."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda n: F.array_join(F.slice("p", F.lit(1), n), "/"))
    found = rows.select(parts.alias("p")).select(F.when(F.size("p") > 1, prefixes).alias("f")).select(F.explode("f").alias("folder"))
    return found.groupBy("folder").agg(F.count("*").alias("n")).select("folder", F.size(F.split("folder", "/")).alias("depth"), "n")


def merged_findings(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Local findings and those remote ones whose keys are new; keys compare nulls as equal."""
    new = remote.dropDuplicates(keys)
    on = [new[k].eqNullSafe(local[k]) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return local.unionByName(new.join(local, cond, "left_anti"), allowMissingColumns=True)


def symmetric_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side) of rows that only one of the two holds."""
    a, b = left.select(keys).distinct(), right.select(keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def repointed(links: DataFrame, folded: DataFrame) -> DataFrame:
    """Links with both ends led to what they were folded into (id, into); loops go, equal links are one."""
    at = lambda c: folded.select(F.col("id").alias(c), F.col("into").alias(f"{c}_into"))
    rows = links.join(at("from"), "from", "left").join(at("to"), "to", "left")
    rows = rows.select(F.coalesce("from_into", "from").alias("from"), F.coalesce("to_into", "to").alias("to"), "relation")
    return rows.where(F.col("from") != F.col("to")).distinct()


def first_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows with duplicate: whether an earlier row has the key."""
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def running_budget(rows: DataFrame, by: str, order: list[str], size: Column, most: int) -> DataFrame:
    """Rows with room: how much of each still fits when the sizes before it have been taken from `most`."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("room", F.greatest(F.lit(0), F.least(size, F.lit(most) - before)))


def cascaded(rows: DataFrame, rungs: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows with target and rung: the first lookup (key, target) whose key the row's column holds; ambiguous keys of a
    lookup do not count."""
    for i, (lookup, column) in enumerate(rungs):
        one = lookup.groupBy("key").agg(F.min("target").alias(f"_t{i}"), F.count_distinct("target").alias("_n")).where("_n = 1").drop("_n")
        rows = rows.join(one.withColumnRenamed("key", f"_k{i}"), F.col(column) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    found = [F.col(f"_t{i}") for i in range(len(rungs))]
    rung = F.coalesce(*(F.when(c.isNotNull(), i + 1) for i, c in enumerate(found)))
    return rows.withColumns({"target": F.coalesce(*found), "rung": rung}).drop(*(f"_t{i}" for i in range(len(rungs))))


def stats(model: dict[str, DataFrame]) -> DataFrame:
    """(dimension, value, n): entities by type, domain, source and application, and the keyword pages among them; links by
    relation and by method, each method of a link once; findings by severity and check; expressions by what became of them;
    and each block's total.

    entities: (type, domain, source, application, keyword); links: (relation, methods, split by commas); findings: (severity,
    check); terms: (fate)."""
    links = model["links"].withColumn("method", F.explode_outer(F.array_distinct(F.split("methods", ","))))
    by = lambda rows, names, prefix: count_by(rows, names).where("dimension <> 'all'").withColumn("dimension", F.concat(F.lit(prefix), "dimension"))
    total = lambda rows, name: rows.agg(F.lit("total").alias("dimension"), F.lit(name).alias("value"), F.count("*").alias("n"))
    keywords = model["entities"].where("keyword").agg(F.lit("total").alias("dimension"), F.lit("keyword pages").alias("value"), F.count("*").alias("n"))
    made = [
        by(model["entities"], ["type", "domain", "source", "application"], "entities by "), by(model["links"], ["relation"], "links by "), by(links, ["method"], "links by "),
        by(model["findings"], ["severity", "check"], "findings by "), by(model["terms"], ["fate"], "terms by "), keywords, *(total(model[b], b) for b in ("entities", "links", "findings", "terms")),
    ]
    return reduce(DataFrame.unionByName, made)
