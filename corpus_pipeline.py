"""The corpus pipeline: documents told by language, freed of near-duplicates, mixed
to target weights and packed into sequences.

Each stage works on all that the stage before kept. All but the last return the
columns of `documents`, as they came, and further columns pass through. Empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import language, mixing, near_dup, packing
from winnow.llm.shared import free_name, written
from winnow.sources.packages import ship


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts, and texts without letters.

    The language models are learnt from these documents outside the held-out fold.
    Null and repeated doc_ids pass, row by row; rows with a null lang are told, but
    not learnt from. Without any labelled text all documents are dropped, as in no
    known language.
    """
    ship(spark)
    model = language.learn(docs.where(~language.held_out_id()))
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    told = language.identify(docs, model, pred=pred, score=score)
    return told.where(F.col(pred) != language.UND).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: 5-word shingles, similarity 0.8 or more.

    Rows are kept or dropped, not ids: a doc_id with several texts loses only those
    that are near another. Rows with a null doc_id, and texts without words, stay.
    Of rows equal in doc_id and text one stays. Ties go to the smallest doc_id.
    """
    ship(spark)
    return near_dup.distinct_documents(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents, whole, as often as brings it near its target words.

    A document that the mix takes twice is there twice. Each row is taken by its own
    place in the mix, whatever its doc_id; null is a source like others. Documents
    without words are taken with those beside them.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences: a row for each piece.

    A null text is packed as empty; each row is a document of its own.
    """
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the language models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, in order, over all documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
