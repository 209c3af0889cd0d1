"""Corpus pipeline: language, quality, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each stage's result as
Parquet to the shared scratch folder and reads it again for the next stage.

All stages take an empty table (and return one), null ids, repeated rows, very long texts and extra columns
of any name. A filtering stage decides by the text, so equal rows share their fate, except that the
near-duplicates stage keeps one of the rows that repeat an id and text; rows without an id are kept or
rejected like others but are never duplicates. A null or empty text has no letter, so the language stage rejects it;
a stage on its own takes it as empty text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm import decontaminate, language, near_duplicates, packing, quality
from stridelake.llm.common import free_name, remainder, table
from stridelake.llm.queries import tokenizer_path
from stridelake.session import ensure_checkpoint_dir


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (``und``; null and empty ones too) and mixtures in which no language holds
    four tenths of the letters. Without a labelled row to learn from, every text is ``und``."""
    model = language.train(docs, remainder(docs["doc_id"], 4) != 2)
    p = free_name(docs, "language")
    seen = docs.withColumn(p, language.predictor(model)(docs["text"].cast("string")))
    good = (F.col(p)["lang_pred"] != language.UNKNOWN) & (F.col(p)["score"] >= 0.4)
    return seen.filter(good).drop(p)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that the classifier scores below 0.3. Null texts score like empty ones; without a label all score
    alike and stay."""
    trees = quality.train(docs, table(spark, sf_dir, "labels"), remainder(docs["doc_id"], 5) != 0)
    s = free_name(docs, "quality")
    return docs.withColumn(s, quality.scorer(trees)(docs["text"].cast("string"))).filter(F.col(s) >= 0.3).drop(s)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates stays; texts without a word and rows
    without an id stay, too."""
    return near_duplicates.one_of_each(docs)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a copy, edited or not, of a benchmark item; null and empty texts hold none."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all that is left; null and empty texts have
    one piece with the end id alone, rows without an id have a null doc_id."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language", keep_known_language),
    ("quality", keep_good_quality),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", keep_clean_of_benchmark),
    ("packing", pack),
]

#: No SQL: models, signatures and alignments are not expressible; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}-{name}")
    return docs
