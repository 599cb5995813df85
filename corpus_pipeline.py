"""From raw documents to packed training sequences, stage by stage; each stage is written and read again.

Defined results: a document with a null or empty text fails the quality rules; equal rows are judged alike by the first
two stages, and the third keeps one of them (rows with a null id all stay there); ties of votes, languages and components
are resolved as the operators say; a very long text is one row throughout and is cut into pieces by packing only; extra
columns of any name travel through to packing; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from holdfast.plans.storage import new_path, remove, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Quality verdicts, language models, sketches and packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base measures and whose votes speak for quality."""
    from holdfast.llm.rules import keep_good

    return keep_good(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart, by a model of the labelled ones among them."""
    from holdfast.llm.langid import fit, keep_known

    return keep_known(docs, fit(docs.select("text", "lang")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more)."""
    from holdfast.llm.neardup import keep_first

    return keep_first(docs)


def without_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark."""
    from holdfast.llm.decontaminate import remove_contaminated

    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its training sequence and place."""
    from holdfast.llm.packing import pack_documents
    from holdfast.llm.queries import tokenizer_file

    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good_quality),
    ("language", known_language),
    ("near duplicates", one_of_each_group),
    ("decontamination", without_contamination),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read by the next one.

    Once a stage is written, the tables it kept for itself and the rows of the stage before it are deleted.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
