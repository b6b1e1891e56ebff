"""The thin query of each operator, over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.quality_rules import judge

    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.warc import archive_round_trip

    out = archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.tokens import token_digests

    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op5_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def op6_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lodestrata.llm.sharding import shard

    out = shard(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.near_duplicates import classes

    out = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id", "copy_id", "n_links", "n_text_links")


def op8_text_to_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.decontamination import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.quality_classifier import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))
