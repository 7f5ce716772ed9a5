"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet below the shared folder and
gives it, read again, to the next. All stages but the last return the columns of documents; further columns end there.

In every stage a null or empty text is a text without words; null ids, ties and repeated rows are as each stage's
docstring says; texts of any length are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import decontaminate, language, quality, queries, simhash
from hirelake.llm.common import table, through_disk

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the ranking, learned from the labels' rest of five, puts below its cut.

    A text without words is scored like any other; equal texts share their fate, and a score on the cut stays; rows with a
    null id are scored and never learned from; without labels of both kinds all scores are 0.5 and all documents stay.
    """
    model = quality.train_on_rest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).where("predicted = 1").select(COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a letter, and those in whose text no learned language is found.

    Repeated rows share their fate, rows with a null id are learned from and judged like any other, rows with a null lang
    are only judged; without any known language all documents go.
    """
    known = docs.where(F.col("lang").isNotNull() & ~language.held_out("doc_id", 4, 2))
    found = language.predict_languages(docs, language.train(known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))))
    return found.where("lang_pred <> 'und' AND score > 0").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the row with the smallest id, nulls last; of rows with equal ids one.

    Texts without words are copies of each other.
    """
    return simhash.without_near_copies(docs).select(COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; texts and items without words hold and are held by nothing.

    Repeated rows share their fate; without items all documents stay.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of the ids and of what they decode to, and the ids themselves, one row per document.

    A text without words has the end id alone, and those of its spaces; null ids and repeated rows are kept.
    """
    return queries.tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("language", keep_languages),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("tokens", tokenise),
]

#: SQL can't express the learned stages; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = through_disk(stage(spark, docs, sf_dir), name)
    return docs
