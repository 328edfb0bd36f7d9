"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import alignment, chat, chunk_dedup, column_dedup, decontaminate, fingerprints, kd_shards, licenses, mixing, ngram_join, quality, spelling, toxicity
from gaugeflow.llm.oracles import ORACLE_SQL  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    rates = mixing.with_rates(docs, mixing.fit_mixture(docs, labels), keep=["doc_id"])
    shares = [F.col("posterior")[i].alias(f"p_{name}") for i, name in enumerate(mixing.TARGET)]
    return rates.select("doc_id", "n_tokens", *shares, "rate", "copies")


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    placed = kd_shards.kd_shards(docs, 40).select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "shard")
    out = kd_shards.with_slots(placed, [F.col("doc_id"), F.col("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["first"].cast("long"))
    labels = lambda d: F.array_join(F.array_sort(F.array_distinct(F.transform(d, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_read(spark, sf_dir, "documents"), width=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op5_winnow_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = fingerprints.with_next(docs, "doc_id", F.xxhash64("text"), ["text", "sketch"], fingerprints.with_sketch).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = both.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next.text", half)))
    edited = edited.withColumn("edited_sketch", fingerprints.document_sketch(F.col("edited")))
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.document_fingerprint(F.col("sketch")).alias("fingerprint"), fingerprints.document_fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), fingerprints.likeness(F.col("sketch"), F.col("next.sketch")).alias("near_next"),
    )


def op7_column_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("doc_id", "held_out", "score", "predicted")


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_dedup.repeated_chunks(_read(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("+", x["start"], x["length"])), ",")
    return found.select("doc_id", "n_bytes", "n_repeats", "n_removed", F.sha2(spans, 256).alias("spans_sha256"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    events = chat.message_events(rows.unionByName(probe))
    done = chat.format_conversations(events)
    read = done.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.under_loss(F.col("segments")).alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(_read(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align_tokenizers(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("doc_id", "held_out", "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_soft_mixing, op2_kd_shards, op3_license_scan, op4_ngram_join, op5_winnow_decontaminate, op6_scaled_sketch, op7_column_dedup, op8_toxicity, op9_chunk_dedup, op10_chat_format, op11_spelling_variants, op12_tokenizer_alignment, op13_quality, pipeline)}
