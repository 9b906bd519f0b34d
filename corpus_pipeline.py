"""A training corpus from documents, in five stages; each one's result is written and read again.

Language ID drops what it rejects, line dedup takes out lines that many documents share, near dedup
leaves one document of each group, decontamination drops documents with benchmark passages, and the
last stage encodes what is left.
"""

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm import decontaminate, language, line_dedup, near_dedup, pieces
from dayloom.runtime import ensure_checkpoint_dir, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the labelled ones among them."""
    small_batches(spark)
    held_out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.filter(~held_out))
    found = language.predict(docs, model, keep=COLUMNS[1:])
    return found.filter("not rejected").select(COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; `n_chars` follows the text."""
    small_batches(spark)
    index = line_dedup.build_index(docs, min_docs=10, min_chars=1)
    kept = line_dedup.drop_repeated_lines(docs, index, keep=["lang", "source"])
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return near_dedup.drop_near_copies(docs, threshold=0.8).select(COLUMNS)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, benchmark, threshold=0.8).select(COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every document: its number of ids and digests of ids, spans and decoded text."""
    small_batches(spark)
    return pieces.encoding_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("sentencepiece", encode_pieces),
]

#: Language ID learns a model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; tables between them go to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
