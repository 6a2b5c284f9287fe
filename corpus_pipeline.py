"""A training-corpus pipeline of five operators: language ID, line dedup, near-dedup, secret scan, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), gets all rows that its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Rows without text go in the first stage; documents that lose their last line go in the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlode.llm import langid, linededup, neardup, packing, secrets
from starlode.llm.common import DOCUMENT_COLUMNS, load, written
from starlode.llm.queries import tokenizer_file

#: A document goes if its text has no letter or if the mean probability of its best language is lower.
LEAST_SCORE = 0.35


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, langid.fit(docs), carry=DOCUMENT_COLUMNS[1:])
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*DOCUMENT_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(docs).where("n_kept > 0 or n_lines = 0").select(*DOCUMENT_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language_filter", language_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_masking", secret_masking),
    ("best_fit_packing", best_fit_packing),
]

#: The network of the first stage and the signatures of the others have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
