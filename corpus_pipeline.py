"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm import decontamination, jaccard, packing, passages, toxicity
from mediacat.llm.queries import benchmark_items, tokenizer_file, training_labels
from mediacat.llm.shared import shared_folder, written

#: The toxicity machine is trained and the similarity join iterates, which SQL cannot express.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine calls toxic go; the others stay as they are."""
    machine = toxicity.learn_machine(docs, training_labels(spark, sf_dir), "doc_id", "text")
    return toxicity.without_toxic(docs, machine, "text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents that with the smallest id stays. Rows without an id stay; rows with
    one id stay or go together."""
    groups = jaccard.link_logs(docs, "doc_id", "text")
    gone = groups.where(F.col("component_id") != F.col("job_id")).select(F.col("job_id").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document has are cut out; a document of which nothing is
    left goes. n_chars follows the text. Documents that lose nothing stay as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = passages.remove_repeats(docs, "doc_id", "text", others)
    text = {"doc_id": F.col("job_id"), "text": F.col("kept")}
    lost = F.col("n_removed") > 0
    n_chars = F.when(lost, F.length("kept").cast("bigint")).otherwise(F.col("carried.n_chars"))
    return cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).select(
        *[(text.get(c) if c in text else n_chars if c == "n_chars" else F.col(f"carried.`{c}`")).alias(c) for c in docs.columns]
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; the others stay as they are."""
    return decontamination.without_leaks(docs, benchmark_items(spark, sf_dir), "text", split=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences of at most 4096 ids."""
    pieces = packing.token_pieces(docs, tokenizer_file(), "doc_id", "text")
    return packing.pack_pieces(pieces).withColumnRenamed("job_id", "doc_id")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("passages", passage_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return docs
