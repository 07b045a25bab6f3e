"""A training corpus from raw documents, in stages of (name, function).

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.common import drop_since, drop_stored, small_batches, stored, written
from weftgraph.llm.decontam import drop_leaked
from weftgraph.llm.langid import keep_identified
from weftgraph.llm.minhash import keep_one
from weftgraph.llm.mixing import mixed
from weftgraph.llm.suffix_dedup import cut_repeats
from weftgraph.runtime import ensure_importable


def _ready(spark: SparkSession) -> None:
    ensure_importable(spark)
    small_batches(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't known go: null and empty texts, texts without a letter, texts that no learned language covers.
    Null doc_ids and langs, repeated rows and further columns stay as they are; an empty table stays empty."""
    _ready(spark)
    return keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; sets of shingles are linked from 80 % on (36 bands of 6: a pair
    at 80 % is missed with chance 2e-5). Null and empty texts and null doc_ids are linked with nothing and stay. Rows that repeat a doc_id
    are one document and stay or go together; an empty table stays empty."""
    _ready(spark)
    return keep_one(docs, percent=80, perms=108)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes stay where they stand first (smallest doc_id, null before all; then place). Documents of which nothing is left
    go; null, empty and short texts stay as they are; rows that agree in doc_id and text are one document; an empty table stays empty."""
    _ready(spark)
    return cut_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none and stay; repeated rows and null doc_ids are judged
    by their own text; items without a word match nothing; an empty table or benchmark changes nothing."""
    _ready(spark)
    return drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get the rate at which they are to be read; those of rate 0 go. Null and empty texts get the rate of the prior; repeated rows
    get one each; columns that have a name of a new one are replaced; without labels all rates are those of equal domains; an empty table stays empty."""
    _ready(spark)
    return mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("rate > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Classifiers, similarity and suffix sorting can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage stored on its way is deleted when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        mark = written()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
            drop_since(mark, docs)
            if before is not None:
                drop_stored(before)
            before = docs
    return docs
