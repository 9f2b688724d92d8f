"""Recognition, duplicates, search and questions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import duplicates, scan, search, terms
from sparkloom.plans.registry import Tables, once, query
from sparkloom.plans.terms import NORMAL, TOKENS
from sparkloom.session import freed, stored
from sparkloom.sources import sinks

R4 = "floor(({0}) * 10000 + 0.5) / 10000.0"
#: Phrases that the texts' function words make, as (form, priority, id).
PHRASES = (("of the", 1, "t1"), ("the of", 1, "t2"), ("and the", 1, "t3"), ("the", 2, "t4"), ("and the of", 1, "t5"), ("de la", 1, "t6"), ("der", 2, "t7"), ("DER", 1, "t8"), ("que", 3, "t9"), ("of the and", 1, "t10"))
FORMS = "forms as (select * from (values " + ", ".join(f"('{f}', {p}, '{i}')" for f, p, i in PHRASES) + ") v(form, priority, id))"
DICT = f"{FORMS}, keyed as (select array_to_string({TOKENS.format('form')}, ' ') as key, priority, id from forms), dict as (select key, len(string_split(key, ' ')) as words, list(id order by priority, id) as targets, count(*) > 1 as homonym from (select distinct * from keyed) where length(key) >= 3 group by key)"
FOUND = f"""{DICT}, units as (select path, line, {TOKENS.format('text')} as t from (select cast(doc_id as varchar) as path, unnest(string_split(text, chr(10))) as text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from documents) where trim(text) <> ''),
s as (select path, line, t, unnest(range(len(t))) as start from units), runs as (select path, line, start, start + n as "end", array_to_string(t[start + 1:start + n], ' ') as key from (select *, unnest(range(1, least(3, len(t) - start) + 1)) as n from s)),
found as (select runs.* from runs join dict using (key))"""
LONGEST = f"""{FOUND}, longest as (select path, line, start, "end", key from (select *, max("end") over (partition by path, line, start) as t, max("end") over (partition by path, line order by start range between unbounded preceding and 1 preceding) as b from found) where "end" = t and (b is null or "end" > b))"""


def dictionary(t: Tables) -> DataFrame:
    return scan.dictionary(t.spark.createDataFrame(list(PHRASES), "form string, priority int, id string"))


@query(f"with {DICT} select key, cast(words as integer) as words, array_to_string(targets, ',') as targets, homonym from dict")
def a11_build_dictionary(t: Tables) -> DataFrame:
    return dictionary(t).withColumn("targets", F.array_join("targets", ","))


@query(f'with {FOUND} select key, count(*) as n, count(distinct path) as documents, cast(sum(start) as bigint) as places from found group by key')
def j04_dictionary_scan(t: Tables) -> DataFrame:
    found = scan.occurrences(terms.units(t.documents), dictionary(t))
    return found.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("path").alias("documents"), F.sum("start").alias("places"))


@query(f'with {LONGEST} select path, line, cast(start as integer) as start, cast("end" as integer) as "end", key from longest')
def j05_longest_matches(t: Tables) -> DataFrame:
    found = scan.longest_matches(scan.occurrences(terms.units(t.documents), dictionary(t)))
    return found.select("path", F.col("line").cast("long").alias("line"), "start", "end", "key")


@query(f"""with {LONGEST}, m as (select l.path, l.line, key, unnest(targets) as target, {R4.format('0.6 * case when homonym then 0.5 else 1.0 end')} as confidence from longest l join dict using (key))
select path, target, count(*) as n, max(confidence) as confidence, min(line) as first_line from m group by path, target""")
def l04_scan_documents(t: Tables) -> DataFrame:
    known = dictionary(t)
    rows = scan.mentions(scan.longest_matches(scan.occurrences(terms.units(t.documents), known)), known)
    return rows.groupBy("path", "target").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.min("line").cast("long").alias("first_line"))


GRAMS = f"""w as (select doc_id as id, {TOKENS.format('text')} as w from documents), g as (select id, list_distinct(list_transform(range(1, len(w) - 3), lambda s: array_to_string(w[s:s + 4], ' '))) as g from w where len(w) >= 5),
e as (select id, len(g) as n, unnest(g) as shingle from g),
j as (select a.id as a, b.id as b, a.n as x, b.n as y, count(*) as s from e a join e b on a.shingle = b.shingle and a.id < b.id group by all),
jac as (select a, b, {R4.format('s / (x + y - s)')} as jaccard, {R4.format('least(x, y) / greatest(x, y)')} as size_ratio from j)"""


@query(f"with {GRAMS} select id, cast(len(g) as integer) as shingles from g")
def a19_shingles(t: Tables) -> DataFrame:
    return duplicates.shingles(t.documents).groupBy("id").agg(F.max("n").alias("shingles"))


@query()
def a20_minhash_pairs(t: Tables) -> DataFrame:
    """Pairs that share a band of four of 128 minima, with the estimate; its hashes are Spark's."""
    return duplicates.banded_pairs(duplicates.signatures(duplicates.shingles(t.documents)))


@query(f"""with recursive {GRAMS.replace('j as (', 'j as materialized (')}, scored as materialized (select a, b, {R4.format("least(1.0, case when size_ratio < 0.5 then 0.4 when jaccard >= 0.8 then 0.7 else 0.4 end + case when x.source = y.source then 0.2 else 0.0 end)")} as score from jac join documents x on x.doc_id = a join documents y on y.doc_id = b where jaccard >= 0.6),
edges as materialized (select a as x, b as y from scored where score > 0.8 union all select b, a from scored where score > 0.8), c(id, root) using key (id) as (select x as id, least(x, min(y)) as root from edges group by x union select e.y, min(c.root) from c join edges e on c.id = e.x join recurring.c r on r.id = e.y where c.root < r.root group by e.y)
select a, b, score, case when p.root = q.root then p.root end as root, case when score > 0.8 then 'merged' when p.root = q.root then 'folded' else 'reported' end as verdict from scored left join c p on p.id = a left join c q on q.id = b where score >= 0.4""")
def l15_resolve_duplicates(t: Tables) -> DataFrame:
    """Near copies of documents by content and source: scored, folded or reported.  A pair of less than 0.6 could not be
    reported, so pairs meet exactly, by the rarest shingles they share."""
    pairs = stored(duplicates.similar_pairs(duplicates.shingle_sets(t.documents), 0.6))
    at = lambda c: t.documents.select(F.col("doc_id").alias(c), F.col("source").alias(f"source_{c}"))
    rows = pairs.join(at("a"), "a").join(at("b"), "b")
    no = F.lit(False)
    folder = F.col("source_a") == F.col("source_b")
    score = duplicates.pair_score(no, no, no, folder, no, F.col("jaccard"), F.col("size_ratio"), no, F.when(folder, 1.0).otherwise(0.0))
    return duplicates.resolved(stored(rows.select("a", "b", score.alias("score"))), merge=0.8, report=0.4)


@query(f"with {GRAMS} select a, b, jaccard, size_ratio from jac where jaccard >= 0.8")
def l16_content_similarity(t: Tables) -> DataFrame:
    """Exact Jaccard of 5-word shingles of all documents, pairs of 0.8 or more, met by the rarest shingles they share."""
    return duplicates.similar_pairs(duplicates.shingle_sets(t.documents), 0.8)


@query(f"with {GRAMS} select count(*) as pairs, true as most from jac where jaccard >= 0.8")
def j06_band_recall(t: Tables) -> DataFrame:
    """How many pairs of 0.8 or more there are, and whether the bands meet 0.99 of them; the bands' hashes are Spark's, so
    SQL cannot give their pairs themselves."""
    true_ = stored(duplicates.similar_pairs(duplicates.shingle_sets(t.documents), 0.8).select("a", "b"))
    freed(t.spark)
    signed = stored(duplicates.signatures(duplicates.shingles(t.documents)))
    freed(t.spark)
    met, first = duplicates.banded_pairs(signed).select("a", "b"), duplicates.copies(signed)
    at = lambda n: first.select(F.col("id").alias(n), F.col("first").alias(f"f{n}"))
    # copies meet through their first one
    rows = true_.join(at("a"), "a").join(at("b"), "b").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"))
    hit = rows.join(met.withColumn("hit", F.lit(True)), ["a", "b"], "left").withColumn("hit", F.col("a").eqNullSafe(F.col("b")) | F.coalesce("hit", F.lit(False)))
    return hit.agg(F.count("*").alias("pairs"), (F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(1.0)) >= 0.99).alias("most"))


FIELDS = "fields as (select p_partkey as entity, 'title' as field, p_name as text from part union all select p_partkey, 'summary', p_type from part union all select p_partkey, 'other', p_brand from part)"
_norm = NORMAL.format("text")
POSTINGS = f"""{FIELDS}, w as (select entity, field, list_filter(string_split({_norm}, ' '), lambda x: x <> '') as w from fields), i as (select entity, field, w, flatten(list_transform(w, lambda x: regexp_split_to_array(x, '[-'']'))) as inn from w),
u as (select distinct entity, field, unnest(list_concat(w, list_transform(w, lambda w: {T.singular_sql('w')}), inn, list_transform(inn, lambda w: {T.singular_sql('w')}))) as token from i),
postings as (select substr(token, 1, 2) as shard, token, entity, sum(case field when 'title' then 5.0 when 'summary' then 2.0 else 1.0 end) as weight from u where length(token) >= 2 group by all)"""


def index(t: Tables) -> DataFrame:
    part = lambda field, c: t.part.select(F.col("p_partkey").alias("entity"), F.lit(field).alias("field"), F.col(c).alias("text"))
    return search.postings(part("title", "p_name").unionByName(part("summary", "p_type")).unionByName(part("other", "p_brand")))


def cited(t: Tables) -> DataFrame:
    counted = t.lineitem.groupBy(F.col("l_partkey").alias("entity")).agg(F.count_distinct("l_suppkey").alias("cited"))
    return once(t, "cited", lambda path: counted.write.parquet(path))


def stored_index(t: Tables) -> DataFrame:
    """The index of a folder's parts, built once a session and kept as a folder a shard."""
    return once(t, "parts", lambda path: sinks.write_index(index(t), path))


@query(f"with {POSTINGS} select * from postings")
def a16_search_index(t: Tables) -> DataFrame:
    """Builds the index and the citations that rank its hits, and stores both; questions read the shards of their words."""
    cited(t)
    return once(t, "parts", lambda path: sinks.write_index(index(t), path), anew=True).select("shard", "token", "entity", "weight")


@query(f"""with {POSTINGS}, a as (select entity, max(weight) as s0 from postings where starts_with(token, 'sma') group by entity),
b as (select entity, max(weight) as s1 from postings where starts_with(token, 'gi') group by entity), c as (select l_partkey as entity, count(distinct l_suppkey) as cited from lineitem group by 1),
r as (select a.entity, s0 + s1 as score, coalesce(cited, 0) as cited from a join b using (entity) left join c using (entity))
select entity, score, row_number() over (order by score desc, cited desc, entity) as rank from r""")
def q09_search(t: Tables) -> DataFrame:
    return search.ranked(stored_index(t), ["sma", "gi"], cited(t))


@query(f"""with {POSTINGS}, c as (select distinct token, case when starts_with(token, 'gizz') then 4 when starts_with(token, 'giz') then 3 else 2 end as common from postings where shard = 'gi')
select token from c order by common desc, length(token), token limit 1""")
def q10_closest_form(t: Tables) -> DataFrame:
    return search.closest(stored_index(t), "gizzard")


@query("""with c as (select *, p_brand in ('Brand#1', 'Brand#2') as b, p_size in ('1', '2', '3') as z from (select p_brand, p_type, cast(p_size as varchar) as p_size from part where p_partkey % 3 > 0))
select 'p_brand' as facet, p_brand as value, count(*) as n from c where z group by p_brand union all select 'p_size', p_size, count(*) from c where b group by p_size union all select 'p_type', p_type, count(*) from c where b and z group by p_type""")
def a15_facet_counts(t: Tables) -> DataFrame:
    """Counts under the other facets' choices, keyword pages left out (every third part is one)."""
    rows = t.part.select("p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"), (F.col("p_partkey") % 3 == 0).alias("keyword"))
    return search.facet_counts(rows, {"p_brand": ["Brand#1", "Brand#2"], "p_size": ["1", "2", "3"], "p_type": []}, keywords="exclude")


@query(f"""with e as (select cast(p_partkey as varchar) as id, p_name as title, array_to_string({TOKENS.format('p_name')}, ' ') as form from part), f as (select min(title) as title from e), k as (select e.id, case when e.title = 'no such' then 2 when starts_with(form, 'small') then 4 end as tier from e) select id, tier from k where tier is not null""")
def q01_resolve(t: Tables) -> DataFrame:
    return search.resolve(t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title")), "small")


@query(f"""with f as (select doc_id as id, {NORMAL.format('text')} as f from documents), p as (select id, f, strpos(f, 'of the') as position from f)
select id, position, substr(f, greatest(1, position - 80), position + 6 + 80 - greatest(1, position - 80)) as excerpt from p where position > 0""")
def q15_passages(t: Tables) -> DataFrame:
    return search.passages(t.documents.select(F.col("doc_id").alias("id"), "text"), "of the")


@query("""select p_partkey from part where p_brand in ('Brand#1', 'Brand#2') and p_size in (1, 2, 3) and not (p_type = 'ECONOMY')""")
def p08_facet_filter(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_brand", F.col("p_size").cast("string").alias("p_size"), (F.col("p_type") == "ECONOMY").alias("keyword"))
    return search.filtered(rows, {"p_brand": ["Brand#1", "Brand#2"], "p_size": ["1", "2", "3"]}, keywords="exclude").select("p_partkey")


@query("select 0 as p_partkey, 'deja|red|gear|l''eau' as asked")
def f20_question_words(t: Tables) -> DataFrame:
    """A question's words, folded, without what stands about them and each once."""
    return t.spark.createDataFrame([(0, "|".join(T.question_words('  "Déjà" (red) red, gear. l’eau a ')))], "p_partkey int, asked string")


FIRST_WORDS = f"""u as (select cast(doc_id as varchar) as path, unnest(string_split(text, chr(10))) as text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from documents),
w as (select path, line, text, {TOKENS.format('text')} as t, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}]+[^\\p{{L}}\\p{{M}}\\p{{N}}]*') as g from u where trim(text) <> '')"""
BLANK = "regexp_matches({0}, '^[\\p{{L}}\\p{{M}}\\p{{N}}]+\\s*$')"


@query(f"""with {FIRST_WORDS}, x as (select path, line, unnest(t) as w, unnest(g) as g, unnest(range(len(t))) as i from w), y as (select *, lag(w) over (partition by path, line order by i) as p1, lag(g) over (partition by path, line order by i) as g1, lag(w, 2) over (partition by path, line order by i) as p2, lag(g, 2) over (partition by path, line order by i) as g2 from x),
o as (select path, line, i, w, case when p1 = 'of' and p2 = 'the' and {BLANK.format('g1')} and {BLANK.format('g2')} then 'object' when p1 = 'of' and {BLANK.format('g1')} then 'screen' when p1 = 'and' and {BLANK.format('g1')} then 'rule' end as expected from y where w in ('the', 'that'))
select w as key, expected as expected_type, case when expected is null then 0.6 else 0.7 end as confidence, count(*) as n, count(distinct path) as documents from o group by all""")
def l05_announced_types(t: Tables) -> DataFrame:
    """Mentions that a type's prefix stands right before, the longest first; they count for more."""
    known = scan.dictionary(t.spark.createDataFrame([("the", 1, "t1"), ("that", 1, "t2")], "form string, priority int, id string"))
    units = terms.units(t.documents)
    found = scan.announced(units, scan.occurrences(units, known), {"screen": ["of"], "object": ["the of"], "rule": ["and"], "note": ["in"], "page": ["in"]})
    rows = scan.mentions(found, known)
    return rows.groupBy("key", "expected_type", "confidence").agg(F.count("*").alias("n"), F.count_distinct("path").alias("documents"))


@query(f"""with {LONGEST}, m as (select l.path, l.line, start, "end", key, unnest(targets) as target from longest l join dict using (key)), r as (select *, row_number() over (partition by path, line, start order by target, "end" desc, key) as n from m)
select path, line, cast(start as integer) as start, cast("end" as integer) as "end", target from r where n = 1""")
def l09_recognised_words(t: Tables) -> DataFrame:
    """The first target of each recognised span."""
    known = dictionary(t)
    rows = scan.recognised(scan.mentions(scan.longest_matches(scan.occurrences(terms.units(t.documents), known)), known))
    return rows.select("path", F.col("line").cast("long").alias("line"), "start", "end", "target")


@query("""with p as (select distinct l_suppkey as target, l_returnflag as source, cast(l_partkey as varchar) as path, l_linenumber as line, l_linestatus as type from lineitem), g as (select target, source, path, count(*) as passages, min(line) as first, bool_or(type = 'F') as lead from p group by all),
o as (select *, row_number() over (partition by target order by lead desc, passages desc, source, path) as page from g), q as (select distinct target, source, path, line from p), j as (select q.*, passages, first, page from q join o using (target, source, path))
select target, source, path, line, passages, cast(row_number() over (partition by target order by case when page <= 5 and line = first then 0 when page <= 5 then 1 else 2 end, page, line) as integer) as place from j""")
def w06_mention_panels(t: Tables) -> DataFrame:
    """The passages that name each supplier, in the order of its panel: a part's lines are a page's passages."""
    rows = t.lineitem.select(F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("source"), F.col("l_partkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("type"))
    return scan.panel(rows, lead_type="F")


@query()
def j04_dictionary_scan_300(t: Tables) -> DataFrame:
    """The scan with over 300 keys: the 320 most frequent runs of one and two words are looked for in all documents."""
    return wide_scan(t)


def wide_scan(t: Tables) -> DataFrame:
    units = terms.units(t.documents)
    runs = terms.ngrams(units).where("words <= 2").groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(320)
    known = scan.dictionary(stored(runs).select(F.col("key").alias("form"), F.lit(1).alias("priority"), F.col("key").alias("id")))
    found = scan.occurrences(units, stored(known))
    return found.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("path").alias("documents"), F.sum("start").alias("places"))
