"""A training corpus from raw documents in five stages, each by one operator of the library.

Toxic documents go, then those of no known language, then all but one of every near-duplicate group;
personal data are masked; what is left is packed into sequences. Every stage gets all rows that the
stage before kept, as the Parquet table that was written of them.

Documents are near duplicates where their sets of five words in a row have a Jaccard index of 0.8 or
more, as SimHash fingerprints estimate it (`simhash_gray`), and what hangs together is a group.

Defined results: rows are judged one by one, so documents that share a doc_id and those without one
are kept or dropped as any other; of a group the row with the least doc_id stays (one without comes
last), then that with the least hash of its text, and of equal rows one; an empty table gives empty
stages; columns beyond those of documents are passed on to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import common, language_id, pii_semicrf, queries, simhash_gray, toxicity_mil

#: Words in a row and Jaccard index of near duplicates.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.toxicity_model(docs, common.table(spark, sf_dir, "labels"))
    column = common.fresh(toxicity_mil.FOUND, docs)
    return toxicity_mil.judge(docs, model, column).where(F.col(column)["score"] < toxicity_mil.THRESHOLD).drop(column)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(queries.fold(4) != 2).select("text", "lang"))
    column = common.fresh(language_id.FOUND, docs)
    found = F.col(column)
    known = (found["lang_pred"] != language_id.UNKNOWN) & (found["known"] >= model.least_known)
    return language_id.judge(docs, model, column).where(known).drop(column)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_gray.one_of_each(docs, words=NEAR_WORDS, similarity=NEAR_SIMILARITY)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii_semicrf.redact(docs, pii_semicrf.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.packed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", packing),
]

#: Models and packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
