"""A corpus pipeline: each stage is one operator over what its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last
return the columns of ``documents``, without any others that the table has. In all
of them null texts count as empty, a row without a doc_id is a document of its own,
equal rows are treated alike, and an empty table gives an empty one.

A stage sets the session's limit on the bytes of an Arrow batch, since its result
is computed when it is written: the workers' memory holds for texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm import byte_bpe, decontamination, line_dedup, part_enum, toxicity
from itemloom.llm.shared import BATCH, BATCHED, discard, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A document goes at this toxicity and more.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on this table's labelled
    documents, doesn't reject. Without labels, or with labels of one class only,
    all have one score, which rejects none unless all are labelled toxic."""
    spark.conf.set(BATCHED, BATCH)
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = toxicity.score(docs.select(*COLUMNS), machine, more=COLUMNS[1:])
    return scores.where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that match an earlier one (Jaccard similarity of
    words 0.8 or more). A document that loses all it had goes with its lines."""
    spark.conf.set(BATCHED, BATCH)
    found = line_dedup.deduplicate(docs)
    changed = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return changed.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more of their
    5-word shingles, the one with the smallest doc_id. Rows without one stay."""
    found = part_enum.similar(docs).where("doc_id = component").select(F.col("doc_id").alias("first")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("first"), "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Items without text have
    none, and a document shorter than a window can only hold a short item."""
    hits = decontamination.find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dirty = hits.where("first IS NOT NULL").select(F.col("doc_id").alias("dirty_id"), "text_hash").distinct()
    return docs.join(dirty, (F.xxhash64("text") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("dirty_id")), "left_anti").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, as count and digests; one row for each row."""
    import public_tokenizers

    spark.conf.set(BATCHED, BATCH)
    bpe = byte_bpe.ByteBpe.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(bpe.encode(docs, decoded=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenize),
]

#: SQL can't express the stages: a trained classifier decides in the first one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
