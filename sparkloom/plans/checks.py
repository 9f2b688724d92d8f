"""Findings, sinks and the streaming extension over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import checks
from sparkloom.plans.registry import Tables, query
from sparkloom.sources import sinks
from sparkloom.streaming import events

FOUND = """f as (select case when quality = 0 then 'E-FM-INVALID' else 'W-TYPE-UNKNOWN' end as "check", cast(doc_id as varchar) as path from labels where quality = 0 or toxic = 1 union all select 'I-PII-DETECTED', cast(doc_id as varchar) from documents where text like '%@%')"""


def found(t: Tables) -> DataFrame:
    bad = t.labels.where("quality = 0 or toxic = 1").select(F.when(F.col("quality") == 0, "E-FM-INVALID").otherwise("W-TYPE-UNKNOWN").alias("check"), F.col("doc_id").cast("string").alias("path"))
    return bad.unionByName(t.documents.where(F.contains("text", F.lit("@"))).select(F.lit("I-PII-DETECTED").alias("check"), F.col("doc_id").cast("string").alias("path")))


@query(f"""with {FOUND} select "check", path, case when "check" like 'E-%' then 'error' when "check" = 'W-TYPE-UNKNOWN' then 'info' else 'info' end as severity from f""")
def k08_enriched_findings(t: Tables) -> DataFrame:
    return checks.enriched(found(t), severities={"W-TYPE-UNKNOWN": "info"}).select("check", "path", "severity")


@query("""with a as (select p_partkey as id from part where p_size <= 5), d as (select l_partkey as api, l_suppkey as consumer from lineitem where l_linenumber = 1 and l_quantity > 25 and l_partkey in (select id from a)),
c as (select distinct l_partkey as api, l_suppkey as consumer from lineitem where l_linenumber = 2 and l_partkey in (select id from a))
select 'W-API-NOCONSUMER' as "check", id as entity, 'nothing consumes it' as message from a where id not in (select api from d union all select api from c)
union all select 'W-API-CONSUMER-MISMATCH', api, 'declared, not citing: ' || consumer from (select distinct * from d except select * from c)
union all select 'W-API-CONSUMER-MISMATCH', api, 'citing, not declared: ' || consumer from (select * from c where api in (select api from d) except select * from d)""")
def j14_api_consumers(t: Tables) -> DataFrame:
    apis = t.part.where("p_size <= 5").select(F.col("p_partkey").alias("id"))
    some = lambda n: t.lineitem.where(F.col("l_linenumber") == n).select(F.col("l_partkey").alias("api"), F.col("l_suppkey").alias("consumer"))
    declared = t.lineitem.where("l_linenumber = 1 and l_quantity > 25").select(F.col("l_partkey").alias("api"), F.col("l_suppkey").alias("consumer")).join(apis.withColumnRenamed("id", "api"), "api", "left_semi")
    return checks.api_consumers(apis, declared, some(2).select(F.col("consumer").alias("from"), F.col("api").alias("to")))


@query("""select p_partkey, '{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}' as value from part""")
def k02_canonical_json(t: Tables) -> DataFrame:
    rows = t.part.select("p_size", "p_name", "p_brand", "p_partkey")
    return sinks.canonical_json(rows).select(F.get_json_object("value", "$.p_partkey").cast("long").alias("p_partkey"), F.regexp_replace("value", ',"p_partkey":\\d+', "").alias("value"))


@query("""select 'MERGE (n:' || upper(p_type[1]) || lower(p_type[2:]) || ' {id: "' || p_partkey || '"}) SET n.title = "' || p_name || '";' as statement from part
union all select 'MATCH (a {id: "' || l_partkey || '"}), (b {id: "s' || l_suppkey || '"}) MERGE (a)-[r:SUPPLIED_BY]->(b) SET r.confidence = 0.5;' from (select distinct l_partkey, l_suppkey from lineitem)""")
def k03_cypher_graph(t: Tables) -> DataFrame:
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("title"))
    edges = t.lineitem.select(F.col("l_partkey").alias("from"), F.concat(F.lit("s"), "l_suppkey").alias("to"), F.lit("supplied by").alias("relation"), F.lit(0.5).alias("confidence")).distinct()
    return sinks.cypher(nodes, edges)


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def z01_windowed_events(t: Tables) -> DataFrame:
    return events.windowed(t.events, "ts", ["event_type"])
