"""The corpus pipeline: five operators one after another over `documents`.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents and no others.
A row with a null id is linked with no other; null texts have no passage, no words and no copies.

1. quality: documents that the classifier rejects go. It learns from all of `labels`.
2. near_dedup: of each near-duplicate component the document with the smallest id stays. Rows are judged by id and
   text: of rows that share an id but not the text each has its own judgement, and of rows alike in both one stays.
3. decontaminate: documents with a passage of `benchmark` go.
4. mix: documents are taken, left out or repeated so that sources come near their target weights. Whole documents
   only, each at most twice; a repeated document is a repeated row.
5. tokens: token files are written in ascending id order and read back, one row per document taken.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import decontaminate, mixing, near_dup, quality_model, token_files
from cadence.llm.common import table
from cadence.session import work_path, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model, keep=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = near_dup.near_duplicates(docs, row_keys=True).where("n_shingles > 0 AND doc_id IS NOT NULL")
    rows = judged.groupBy(F.col("doc_id").alias("judged_id"), "row_key").agg(F.first("first").alias("first"), F.count("*").alias("n"))
    rows = written(rows.where("NOT first OR n > 1"), "judged")
    of_row = (F.col("doc_id") == F.col("judged_id")) & (F.xxhash64("doc_id", "text") == F.col("row_key"))
    kept = docs.select(*COLUMNS).join(rows, of_row, "left_anti")
    repeated = rows.where("first AND n > 1")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(docs.select(*COLUMNS).join(repeated, of_row, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return judged.where("kept").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = mixing.curriculum(docs, keep=("text", "lang", "source", "n_chars"), whole=True)
    return copies.where("words > 0").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "tokens")
    token_files.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(spark, folder)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("mix", mix),
    ("tokens", tokens),
]

#: Trees, LSH and tokenization are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
