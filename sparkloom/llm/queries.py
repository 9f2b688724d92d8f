"""The queries that apply the ten operators, with production parameters, to their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import ann, bpe, lm, packing, quality_model, quality_rules, sharding, simhash, urlfilter, warc
from sparkloom.llm.common import scratch, written
from sparkloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), k=3, threshold=3, blocks=2)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=1024, end=2)
    return packing.pack(found, capacity=1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode_texts(docs, tokenizer("word_bpe_49k.json"), outputs=outputs).select("doc_id", *outputs)


URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP6_SQL = r"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages
), f as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule from u
)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from f
"""


def op7_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(ship(spark), "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    read = warc.read_pages(spark, path, payloads=False).select("page_id", F.col("payload_bytes").alias("own"), "payload_digest", "record_type", "refers_to")
    read = written(read, "warc-read")
    lengths = read.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("own").alias("kept"))
    full = read.where("record_type = 'revisit'").join(lengths, ["refers_to", "payload_digest"], "left").withColumn("own", F.col("kept"))
    rows = read.where("record_type = 'response'").unionByName(full.drop("kept"))
    return rows.select("page_id", F.col("own").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


OP10_SQL = """
with p as (select page_id, coalesce(html, '') as t from pages),
d as (select page_id, cast(strlen(t) as bigint) as payload_bytes, sha1(t) as payload_digest from p),
k as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) end as keeper from d)
select page_id, payload_bytes, payload_digest, case when keeper <> page_id then 'revisit' else 'response' end as record_type,
  case when keeper <> page_id then keeper end as refers_to from k
"""

QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_boosted_quality": op3_boosted_quality,
    "op4_quality_rules": op4_quality_rules,
    "op5_backtracking_bpe": op5_backtracking_bpe,
    "op6_url_rules": op6_url_rules,
    "op7_histogram_sharding": op7_histogram_sharding,
    "op8_one_bit_search": op8_one_bit_search,
    "op9_deleted_interpolation": op9_deleted_interpolation,
    "op10_warc": op10_warc,
}
ORACLE_SQL = {"op4_quality_rules": quality_rules.ORACLE_SQL, "op6_url_rules": OP6_SQL, "op8_one_bit_search": ann.ORACLE_SQL, "op10_warc": OP10_SQL}
