"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm import byte_bpe, decontamination, edit_embedding, line_dedup, neighbour_quality, part_enum, personal_data, plane_files, toxicity, window_index
from itemloom.llm.shared import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folded(folds: int):
    return F.crc32(F.col("doc_id").cast("string")) % folds


def _scored(scores: DataFrame, held_out, threshold: float) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op1_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of fold 2 of 4 are held out."""
    documents, held_out = _table(spark, sf_dir, "documents"), _folded(4) == 2
    voters = neighbour_quality.fit(documents, _table(spark, sf_dir, "labels"), usable=~held_out)
    return _scored(neighbour_quality.score(documents, voters), held_out, 0.7)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of fold 0 of 5 are held out."""
    documents, held_out = _table(spark, sf_dir, "documents"), _folded(5) == 0
    machine = toxicity.fit(documents, _table(spark, sf_dir, "labels"), usable=~held_out)
    return _scored(toxicity.score(documents, machine), held_out, 0.5)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they decode to, as digests."""
    import public_tokenizers

    bpe = byte_bpe.ByteBpe.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(bpe.encode(_table(spark, sf_dir, "documents"), decoded=True))


def op3_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its half-replaced text."""
    return edit_embedding.compare_edits(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those that match an earlier one, and what stays."""
    found = line_dedup.deduplicate(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum as read back from the written files."""
    import public_tokenizers

    folder = scratch_path(spark, "plane-files")
    plane_files.write_ids(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return plane_files.read_ids(spark, folder).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside windows that occur earlier."""
    found = window_index.deduplicate(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_part_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a Jaccard similarity of 0.85."""
    found = part_enum.similar(_table(spark, sf_dir, "documents"), size=4, share=85, of=100)
    return found.withColumnRenamed("component", "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items."""
    hits = decontamination.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontamination.report(hits).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = personal_data.find(_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", personal_data.of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(personal_data.KINDS)]
    return found.select("doc_id", *counts, F.sha2(personal_data.written("base"), 256).alias("base_sha256"), personal_data.written("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbour_quality": op1_neighbour_quality,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_edit_embedding": op3_edit_embedding,
    "op4_line_dedup": op4_line_dedup,
    "op5_plane_files": op5_plane_files,
    "op6_window_index": op6_window_index,
    "op7_part_enum": op7_part_enum,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_personal_data": op10_personal_data,
}

ORACLE_SQL: dict[str, str] = {
    "op6_window_index": window_index.ORACLE_SQL,
    "op7_part_enum": part_enum.ORACLE_SQL,
    "op8_decontamination": decontamination.ORACLE_SQL,
}
