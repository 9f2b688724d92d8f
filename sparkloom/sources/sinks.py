"""Sinks: the model as one parquet folder a block, canonical JSON, graph statements, search shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


#: The blocks of a model and what each is sorted by.
ORDERS = {"entities": ("id",), "links": ("from", "to", "relation"), "findings": ("check", "source", "path", "line", "entity", "message"), "occurrences": ("path", "line", "start", "target", "key"), "mentions": ("key", "path", "line", "position"), "contracts": ("id", "contract"), "terms": ("lang", "key"), "neighbours": ("id", "rank"), "provenances": ("from", "to", "relation", "method", "path", "line", "section")}


def canonical(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """In the order of the keys that there are, absent values first, numbers as numbers."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    held = [k for k in keys if k in kinds]
    return rows.orderBy(*(F.coalesce(F.col(k), F.lit("")) if kinds[k] == "string" else F.asc_nulls_first(k) for k in held))


def write_model(blocks: dict[str, DataFrame], path: str, keys: dict[str, tuple[str, ...]] | None = None) -> None:
    """Each block in its canonical order, columns in order of name, a folder each."""
    for name, block in blocks.items():
        canonical(block.select(*sorted(block.columns)), (keys or {}).get(name) or ORDERS[name]).write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str, blocks: list[str] | None = None) -> dict[str, DataFrame]:
    """The blocks of a written model, all that the folder holds or those that are asked for; raises where one is not there."""
    if blocks is None:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        blocks = sorted(f.getPath().getName() for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at) if f.isDirectory())
    return {name: spark.read.parquet(f"{path}/{name}") for name in blocks}


def ordered(column: Column, kind: DataType) -> Column:
    """A value whose structs, at any depth, have their fields in order of name."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(column.isNotNull(), F.struct(*(ordered(column.getField(f.name), f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: ordered(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(column, lambda k, v: ordered(v, kind.valueType)))))
    return column


def canonical_json(rows: DataFrame) -> DataFrame:
    """(value): each row as JSON, fields and keys in order of name at every depth, absent ones left out."""
    return rows.select(F.to_json(F.struct(*(ordered(F.col(f.name), f.dataType).alias(f.name) for f in sorted(rows.schema.fields, key=lambda f: f.name)))).alias("value"))


def fragments(entities: DataFrame, units: DataFrame, passages: DataFrame, pages: DataFrame, most: int = 20_000) -> DataFrame:
    """(id, sections, passages, documents, text): what the page of each entity (id, path) shows.

    sections: of its units (path, line, section, text) in order; passages: the places (id, path, line) where it is named;
    documents: its pages (id, document, number, text), their text cut where `most` characters of the entity's are used up;
    text: all of its units."""
    own = units.join(entities.select("id", "path"), "path").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line", "section", F.col("text").alias("x")))).alias("u"))  # one note's
    named = passages.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("path", "line"))).alias("passages"))  # one page's
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("id").orderBy("document", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.substring("text", F.lit(1), F.greatest(F.lit(0), F.least(F.length("text"), F.lit(most) - F.col("_b"))).cast("int"))
    kept = pages.withColumn("_b", before).select("id", "document", "number", cut.alias("text"))
    docs = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("document", "number", "text"))).alias("documents"))  # at most `most` characters
    rows = entities.select("id").join(own, "id", "left").join(named, "id", "left").join(docs, "id", "left")
    sections = F.array_distinct(F.filter(F.col("u.section"), lambda s: s.isNotNull()))
    return rows.select("id", sections.alias("sections"), "passages", "documents", F.array_join(F.col("u.x"), "\n").alias("text"))


def cypher(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(statement): a MERGE for each entity (id, type, title) and each link (from, to, relation, confidence)."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    label = lambda c: F.regexp_replace(F.initcap(F.regexp_replace(F.col(c), "[^A-Za-z0-9]+", " ")), " ", "")
    nodes = entities.select(F.concat(F.lit("MERGE (n:"), label("type"), F.lit(" {id: "), quoted("id"), F.lit("}) SET n.title = "), F.coalesce(quoted("title"), F.lit('""')), F.lit(";")).alias("statement"))
    edges = links.select(F.concat(F.lit("MATCH (a {id: "), quoted("from"), F.lit("}), (b {id: "), quoted("to"), F.lit("}) MERGE (a)-[r:"), F.upper(F.regexp_replace("relation", "[^A-Za-z0-9]+", "_")), F.lit("]->(b) SET r.confidence = "), F.col("confidence").cast("string"), F.lit(";")).alias("statement"))
    return nodes.unionByName(edges)


def write_index(postings: DataFrame, path: str) -> None:
    """A folder for each shard, so that a question reads those of its words alone."""
    postings.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
