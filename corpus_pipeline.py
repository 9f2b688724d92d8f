"""Quality rules, quality classifier, SimHash near-dedup and best-fit packing in turn; each stage is written as Parquet
and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import packing, quality_model, quality_rules, simhash
from sparkloom.llm.common import fresh, written
from sparkloom.llm.queries import table, tokenizer
from sparkloom.session import ship

#: A document is rejected below this probability of good quality.
THRESHOLD = 0.3


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with the lines that passed; n_chars counts what is left."""
    judged = quality_rules.clean_lines(docs).where("kept").withColumn("text", F.col("clean_text"))
    return judged.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, does not reject."""
    trees = quality_model.learn(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "_score")
    return quality_model.score(docs, trees, score_col=score).where(F.col(score) >= THRESHOLD).select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: linked by SimHash, or by a band where more bits differ, and of similarity
    0.8 or more over five-word shingles."""
    return simhash.deduplicated(docs, k=5, similarity=0.8).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 1024 tokens."""
    found = packing.pieces(docs, tokenizer("byte_bpe_50k.json"), capacity=1024, end=2)
    return packing.pack(found, capacity=1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", clean), ("quality classifier", classify), ("simhash near-dedup", deduplicate), ("best-fit packing", pack)]
#: The classifier, the fingerprints and the tokenizer are not SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
