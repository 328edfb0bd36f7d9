"""A training corpus from `documents`: five stages, each of whose result is written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import decontaminate, kd_shards, mixing, ngram_join, toxicity
from gaugeflow.llm._scratch import Owner, Scratch

#: Shards of the result.
SHARDS = 40

#: SQL can express neither the models nor the k-d tree; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 0").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word n-grams, directly or through others, the smallest id stays.

    Where ids repeat or are null, rows are told apart by their texts: of a group the row with the smallest id stays, one
    without an id only if no other has one, and of equal rows one. Documents without words are in no group.
    """
    found = ngram_join.ngram_components(docs, width=5, num=80, den=100).where("component is not null")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = found.groupBy("component").agg(F.min(row).alias("best"), F.count(F.lit(1)).alias("n"))
    met = found.join(best.where("n > 1"), "component").withColumn("stays", row.eqNullSafe(F.col("best")))
    gone = met.where("not stays").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__gone")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash"))
    kept = docs.join(gone, same, "left_anti")
    repeated = met.where("stays").groupBy("component").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def mix_to_target(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that the domains' tokens meet the target weights."""
    return mixing.mix(docs, mixing.fit_mixture(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and size."""
    return kd_shards.kd_shards(docs, SHARDS)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", one_of_each_group), ("decontamination", drop_benchmark), ("mixing", mix_to_target), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Null and empty texts pass the first three; an empty table gives an empty result. What a
    stage wrote for itself, and the table that it read, are deleted once its result is written."""
    scratch = Scratch(spark, "corpus")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with Owner(spark) as made:
            docs = scratch.table(stage(spark, docs, sf_dir))
        made.release()
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
