"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, langid, line_dedup, near_dup
from folioscope.llm.common import settle, table
from folioscope.llm.queries import PIECE_VOCABULARY, bpe_digest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is no more certain than this is rejected, as is one without letters.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. The models learn from the documents themselves (text and lang)."""
    model = langid.fit(docs, PIECE_VOCABULARY)
    found = langid.identify(docs, model, PIECE_VOCABULARY, lang_pred="__lang", score="__score")
    return found.where((F.col("__lang") != langid.UNDETERMINED) & (F.col("__score") > MIN_SCORE)).select(COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line makes superfluous; n_chars follows the text.

    A document that loses all its lines is dropped: nothing of it is left.
    """
    cut = line_dedup.dedup_lines(docs)
    return cut.where(F.trim("text") != "").withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each near-duplicate class."""
    return near_dup.keep_one(docs).select(COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), matches="__items")
    return found.where(F.size("__items") == 0).select(COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the encoding's length, and the digests of its ids and of the text decoded from them."""
    return bpe_digest(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express the language models; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is settled in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
