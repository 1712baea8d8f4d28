"""The registered queries of the operators; oracle SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from depgraph.llm.token_counts import count_tokens

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depgraph.llm.neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from depgraph.llm.common import scratch_path
    from depgraph.llm.token_file import read_token_file, write_token_file

    path = scratch_path(spark, "token-file")
    write_token_file(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depgraph.llm.substring_dedup import remove_repeats

    found = remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depgraph.llm.line_dedup import dedup_lines

    found = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "longest_run", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depgraph.llm.common import scratch_path
    from depgraph.llm.shards import Store

    store = Store(spark, scratch_path(spark, "store"))
    store.append(_table(spark, sf_dir, "documents"), arrival="source")
    store.compact()
    store.vacuum()
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", "lang", "source", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depgraph.llm.decontaminate import find_hits, judged

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(find_hits(docs, _table(spark, sf_dir, "benchmark")))
    items = F.array_sort(F.col("contamination.items").cast("array<string>"))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depgraph.llm.quality import classify

    found = classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))
    return found.select("doc_id", "quality_score", "toxic_score", "keep")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depgraph.llm.jaccard_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(_table(spark, sf_dir, "documents"))


def byte_bpe_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    from depgraph.llm.byte_bpe import encode_decode
    from depgraph.llm.common import small_batches

    small_batches(docs.sparkSession)
    column = encode_decode(F.col("text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", column.alias("coded")).select(
        "doc_id",
        F.size("coded.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("coded.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depgraph.llm.private_data import KINDS, find_private, listed

    found = find_private(_table(spark, sf_dir, "documents"))
    # in SQL: a second parameter of a Python lambda would be given the place of the element
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depgraph.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depgraph.llm.divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_neighbours, op3_token_file, op4_substring_dedup, op5_line_dedup, op6_sharding, op7_decontamination, op8_quality, op9_jaccard_join, op10_byte_bpe, op11_private_data, op12_whitening, op13_divergence)}

def _oracles() -> dict[str, str]:
    from depgraph.llm.divergence import audit_sql
    from depgraph.llm.line_dedup import dedup_lines_sql

    return {
        "op5_line_dedup": dedup_lines_sql(),
        "op6_sharding": """SELECT doc_id, lang, source, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
            sha256(coalesce(text, '')) AS text_sha256 FROM documents""",
        "op13_divergence": audit_sql(),
    }


ORACLES = _oracles()
