"""A corpus pipeline over ``documents``: quality, near duplicates, contamination, personal data, packing.

Each stage is (name, function) with ``function(spark, docs, sf_dir) -> DataFrame``;
its result is written and read again as the next one's ``docs``.  All but the
last return the columns they were given.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import decontaminate, near_dedup, packing, pii, quality
from terrace.llm.common import scratch, table
from terrace.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it is trained on the labelled rows of ``documents``."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    found = quality.scored(docs, model)
    return found.where(F.col(found.columns[-1]) == 1).drop(*found.columns[-2:])


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id; of rows that share that id and text, one."""
    found = near_dedup.near_duplicates(docs, near_dedup.NearDedup())
    # Of a group without ids one text stays, the smallest by digest.
    chosen = found.where("kept").groupBy("component").agg(F.min(F.struct("doc_id", "text_md5")).alias("__row")).select("__row.doc_id", "__row.text_md5").distinct()
    keyed = docs.withColumn("__md5", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    kept = keyed.join(
        chosen.select(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__text_md5")), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__md5") == F.col("__text_md5")), "left_semi"
    )
    return kept.dropDuplicates(["doc_id", "__md5"]).drop("__md5")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ``benchmark``, however long they are."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    tainted = found.select(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__text_md5")).distinct()
    keyed = docs.withColumn("__md5", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return keyed.join(tainted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__md5") == F.col("__text_md5")), "left_anti").drop("__md5")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in ``text`` replaced by its kind, ``n_chars`` following."""
    found = pii.find(docs, clean=True)
    found = found.withColumn("text", F.col(found.columns[-1]).getField("clean")).drop(found.columns[-1])
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return packing.pack(docs, packing.Packing(tokenizer_path()))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_first_copies),
    ("benchmark decontamination", keep_clean),
    ("PII", hide_personal_data),
    ("best-fit packing", pack_sequences),
]

#: Neither the trained models nor the tokenizer can be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = os.path.join(folder, str(k))
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
