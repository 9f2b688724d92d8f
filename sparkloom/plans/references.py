"""References between the driver's pages, parts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import duplicates, references
from sparkloom.plans.registry import Tables, query
from sparkloom.plans.terms import FOLD

R4 = "floor(({0}) * 10000 + 0.5) / 10000.0"


@query("""select p_partkey, case p_size % 4 when 0 then p_brand || '/' || p_name when 1 then 'x/' || p_name when 2 then null else 'x/y/' || p_name end as path from part""")
def f15_normal_path(t: Tables) -> DataFrame:
    c = F.col("p_size") % 4
    raw = F.when(c == 0, F.concat(F.lit("x/../"), "p_brand", F.lit("/./"), "p_name")).when(c == 1, F.concat(F.lit("x/y/..//"), "p_name")).when(c == 2, F.concat(F.lit("x/../../"), "p_name")).otherwise(F.concat(F.lit("/x/y/"), "p_name"))
    return t.part.select("p_partkey", references.normal_path(raw).alias("path"))


LINKS = """l as (select event_id, 'n/' || event_id as path, case event_id % 4 when 0 then '../p/' || (event_id % 3000) when 1 then 'p/' || (event_id % 3000) || '#a' when 2 then 'https://x/' || event_id else '#top' end as target from events),
r as (select *, case event_id % 4 when 2 then 'external' when 3 then 'anchor' else case when event_id % 3000 in (select p_partkey from part) then 'file' else 'missing' end end as kind from l)"""


def links(t: Tables) -> DataFrame:
    e = F.col("event_id")
    n = (e % 3000).cast("string")
    target = F.when(e % 4 == 0, F.concat(F.lit("../p/"), n)).when(e % 4 == 1, F.concat(F.lit("p/"), n, F.lit("#a"))).when(e % 4 == 2, F.concat(F.lit("https://x/"), e.cast("string"))).otherwise("#top")
    rows = t.events.select("event_id", F.concat(F.lit("n/"), e.cast("string")).alias("path"), F.lit("n").alias("folder"), target.alias("target"))
    return references.resolved_links(rows, t.part.select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("path")))


@query(f"with {LINKS} select event_id, kind, case when kind = 'file' then 'p/' || (event_id % 3000) end as file from r")
def f16_resolve_link(t: Tables) -> DataFrame:
    return links(t).select("event_id", "kind", "file")


@query(f"""with {LINKS} select path as "from", 'p/' || (event_id % 3000) as "to", 'related' as relation, 1.0 as confidence, count(*) as n from r where kind = 'file' group by 1, 2""")
def l01_explicit_links(t: Tables) -> DataFrame:
    return references.explicit_links(links(t))[0]


@query(f"""with {LINKS} select distinct 'E-LINK-BROKEN' as "check", path, target from r where kind = 'missing'""")
def l01_broken_links(t: Tables) -> DataFrame:
    return references.explicit_links(links(t))[1]


@query("""with a as (select s_suppkey as "from", s_nationkey as ref from supplier), n as (select n_nationkey as id from nation)
select case when ref % 2 = 0 then "from" else ref end as "from", case when ref % 2 = 0 then ref else "from" end as "to", case when ref % 2 = 0 then 'located in' else 'holds' end as relation, 0.9 as confidence from a join n on ref = id""")
def l02_frontmatter_links(t: Tables) -> DataFrame:
    """Reference attributes as links; an inverse relation turns its ends round."""
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("a"), F.col("n_nationkey").cast("long").alias("b"))
    ahead = F.col("b") % 2 == 0
    return rows.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("from"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("to"), F.when(ahead, "located in").otherwise("holds").alias("relation"), F.lit(0.9).alias("confidence"))


RUNG = """p{0} as (select note, operation from (select * from n where note not in (select note from d{1})) n join (select * from o where operation not in (select operation from d{1})) o using ({2})),
m{0} as (select * from p{0} where note in (select note from p{0} group by 1 having count(*) = 1) and operation in (select operation from p{0} group by 1 having count(*) = 1)), d{0} as (select * from d{1} union all select * from m{0})"""


@query(f"""with n as (select c_custkey as note, cast(c_custkey as varchar) as a, c_nationkey || '/' || c_mktsegment as b, substr(c_name, 10) as c from customer), o as (select s_suppkey as operation, case when s_suppkey % 4 = 0 then cast(s_suppkey as varchar) end as a, s_nationkey || '/BUILDING' as b, substr(s_name, 10) as c from supplier),
d0 as (select note, operation from n join o using (a) where false), {RUNG.format(1, 0, 'a')}, {RUNG.format(2, 1, 'b')}, {RUNG.format(3, 2, 'c')} select *, 1 as rung from m1 union all select *, 2 from m2 union all select *, 3 from m3""")
def j12_match_operations(t: Tables) -> DataFrame:
    """Notes and imported operations by identifier, then by method and path, then by title."""
    notes = t.customer.select(F.col("c_custkey").alias("note"), F.col("c_custkey").cast("string").alias("a"), F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("b"), F.expr("substring(c_name, 10)").alias("c"))
    operations = t.supplier.select(F.col("s_suppkey").alias("operation"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.col("s_nationkey").cast("string"), F.lit("/BUILDING")).alias("b"), F.expr("substring(s_name, 10)").alias("c"))
    return references.matched_operations(notes, operations, ["a", "b", "c"])


@query("""with l as (select event_id, event_id % 6 as k, event_id % 3000 as n from events), f as (select p_partkey from part)
select event_id, case k when 0 then case when n in (select * from f) then 'file' else 'missing' end when 1 then case when n in (select * from f) then 'file' else 'missing' end when 2 then case when n in (select * from f) then 'file' else 'missing' end when 3 then 'external' when 4 then 'missing' else 'anchor' end as kind,
case when k = 0 and n in (select * from f) then 's' when k in (1, 2) and n in (select * from f) then 'o' end as to_source, case when k < 3 and n in (select * from f) then 'd/' || n || '.md' end as file from l""")
def l01_links_across_sources(t: Tables) -> DataFrame:
    """Links within a source, by the name of another, by its folder beside the root, and elsewhere."""
    return across(t, True).select("event_id", "kind", "to_source", "file")


@query("""with l as (select event_id, event_id % 6 as k, event_id % 3000 as n from events), f as (select p_partkey from part) select case when k in (1, 2) then 'W-LINK-CROSS-SOURCE' else 'E-LINK-BROKEN' end as "check", count(*) as n from l where k in (1, 2, 4) or (k = 0 and n not in (select * from f)) group by 1""")
def l01_cross_source_findings(t: Tables) -> DataFrame:
    return references.link_findings(across(t, False)).groupBy("check").agg(F.count("*").alias("n"))


def across(t: Tables, cross_source: bool) -> DataFrame:
    e = F.col("event_id")
    k, n = e % 6, F.concat((e % 3000).cast("string"), F.lit(".md"))
    target = F.when(k == 0, F.concat(F.lit("../d/"), n)).when(k == 1, F.concat(F.lit("o:d/"), n, F.lit("#x"))).when(k == 2, F.concat(F.lit("../../o/d/"), n)).when(k == 3, "mailto:a@b").when(k == 4, "../../../o/d/1.md").otherwise("#top")
    links = t.events.select("event_id", F.lit("s").alias("source"), F.concat(F.lit("n/"), e.cast("string")).alias("path"), F.lit("n").alias("folder"), target.alias("target"))
    own = t.part.select(F.concat(F.lit("d/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"))
    return references.located_links(links, own.select(F.lit("s").alias("source"), "path").unionByName(own.select(F.lit("o").alias("source"), "path")), cross_source)


@query("""with o as (select 'p' || p_partkey as path, p_partkey as id, 1 as own from part where p_size > 10 union all select 'p' || (p_partkey // 2), p_partkey, 0 from part) select path, max_by(id, own * 1000000000 + id) as id from o group by path""")
def j18_owners(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    own = F.when(F.col("p_size") > 10, F.concat(F.lit("p"), p.cast("string"))).otherwise("none")
    half = F.concat(F.lit("p"), F.floor(p / 2).cast("string"))
    return references.owners(t.part.select(p.alias("id"), own.alias("path"), F.array(half).alias("representations"))).where("path <> 'none'")


@query("select p_partkey, regexp_replace(p_name, '\\b(small|gi|re)', '<mark>\\1</mark>', 'g') as marked from part")
def f22_mark_title(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", references.marked("p_name", ["re", "small", "gi"]).alias("marked"))


@query("""select distinct p_type as heading, case lower(p_type) when 'economy' then 'uses' when 'small' then 'parts' when 'promo' then 'uses' end as section from part""")
def f24_mapped_section(t: Tables) -> DataFrame:
    labels = t.spark.createDataFrame([("economy", "uses"), ("small", "parts"), ("promo", "uses")], "label string, section string")
    rows = t.part.select(F.col("p_type").alias("heading")).distinct().withColumn("label", T.normalize("heading"))
    return rows.join(F.broadcast(labels), "label", "left").select("heading", "section")  # a profile's labels: three rows


@query(f"""with r as (select p_partkey as id, case when p_size % 3 = 0 then p_name || p_brand end as title, case when p_size % 3 = 1 then upper(p_name) || ' ' || replace(p_brand, '#', '-') end as heading from part),
k as (select id, trim(regexp_replace({FOLD.format('title')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as t, trim(regexp_replace({FOLD.format('heading')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as h from r) select distinct least(x.id, y.id) as a, greatest(x.id, y.id) as b from k x join k y on x.t = y.h and x.id <> y.id where x.t <> ''""".replace("p_name || p_brand end", "p_name || ' ' || p_brand end"))
def j08_title_is_heading(t: Tables) -> DataFrame:
    """Documents whose title is the heading of a note, whatever its case and signs."""
    size = F.col("p_size") % 3
    rows = t.part.select(F.col("p_partkey").alias("id"), F.when(size == 0, F.concat_ws(" ", "p_name", "p_brand")).alias("title"), F.when(size == 1, F.concat(F.upper("p_name"), F.lit(" "), F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")))).alias("heading"))
    return duplicates.title_pairs(rows)


@query("""with d as (select p_partkey as x, case p_size % 4 when 0 then p_partkey + 1 when 1 then p_partkey - 1 when 2 then p_partkey + 2 end as y from part) select distinct least(x, y) as a, greatest(x, y) as b from d where y in (select p_partkey from part)""")
def j09_declared_twins(t: Tables) -> DataFrame:
    """Twins that notes declare: from their folder, as `source:path`, and above the root in a sibling source."""
    p, c = F.col("p_partkey"), F.col("p_size") % 4
    name = lambda x: F.concat(F.lit("n"), x.cast("string"), F.lit(".md"))
    declared = F.when(c == 0, F.concat(F.lit("./../f/"), name(p + 1))).when(c == 1, F.concat(F.lit("s:f/"), name(p - 1))).when(c == 2, F.concat(F.lit("../../s/f/"), name(p + 2)))
    rows = t.part.select(p.alias("id"), F.lit("s").alias("source"), F.lit("f").alias("folder"), F.concat(F.lit("f/"), name(p)).alias("path"), declared.alias("declared"))
    return duplicates.declared_pairs(rows)


@query("""select p_partkey, case p_size % 4 when 0 then 's' when 1 then 'o' when 2 then 't' end as source, case p_size % 4 when 0 then 'b/' || p_name when 1 then 'x/' || p_name when 2 then 'u/' || p_name end as path from part""")
def f15_resolve_declared(t: Tables) -> DataFrame:
    c = F.col("p_size") % 4
    written = F.when(c == 0, F.concat(F.lit(".././b/"), "p_name")).when(c == 1, F.concat(F.lit("o:x/"), "p_name")).when(c == 2, F.concat(F.lit("../../t/u/"), "p_name")).otherwise(F.lit("../../t"))
    found = duplicates.declared_at(F.lit("s"), F.lit("a"), written)
    return t.part.select("p_partkey", found.alias("f")).select("p_partkey", "f.source", "f.path")


SCORES = """s as (select l_orderkey as k, l_linenumber as n, l_returnflag = 'A' as same_name, l_linestatus = 'O' as folder, l_discount * 10 as jac, l_quantity / 50 as ratio, l_shipdate < timestamp '1995-01-01' as commit_, l_tax * 10 as prox from lineitem)"""


@query(f"""with {SCORES} select k, n, {R4.format("least(1.0, case when same_name then case when folder then 0.7 else 0.5 end else 0.0 end + case when ratio < 0.5 then least(0.4, case when jac >= 0.8 then 0.7 when jac >= 0.6 then 0.4 else 0.0 end) when jac >= 0.8 then 0.7 when jac >= 0.6 then 0.4 else 0.0 end + case when commit_ then 0.3 else 0.0 end + " + R4.format("prox * 0.2") + ")")} as score from s""")
def l14_score_pair(t: Tables) -> DataFrame:
    no, c = F.lit(False), F.col
    score = duplicates.pair_score(no, c("l_returnflag") == "A", no, c("l_linestatus") == "O", no, c("l_discount") * 10, c("l_quantity") / 50, c("l_shipdate") < F.lit("1995-01-01").cast("timestamp"), c("l_tax") * 10)
    return t.lineitem.select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), score.alias("score"))


@query("""with p as (select l_partkey as a, l_suppkey as b, max(l_discount) as score from lineitem group by 1, 2), sep as (select l_partkey as a, l_suppkey as b from lineitem where l_tax = 0.08), mer as (select distinct l_partkey as a, l_suppkey as b from lineitem where l_quantity = 50)
select a, b, max(score) as score from (select * from p where (a, b) not in (select a, b from sep) union all select a, b, 1.0 from mer) group by 1, 2""")
def j10_lock_pairs(t: Tables) -> DataFrame:
    """Pairs that the lock separates leave, those that it merges come with certainty."""
    key = [F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")]
    pairs = t.lineitem.groupBy(*key).agg(F.max("l_discount").alias("score")).join(t.lineitem.where("l_tax = 0.08").select(*key), ["a", "b"], "left_anti")
    merged = t.lineitem.where("l_quantity = 50").select(*key, F.lit(1.0).alias("score"))
    return pairs.unionByName(merged).groupBy("a", "b").agg(F.max("score").alias("score"))
