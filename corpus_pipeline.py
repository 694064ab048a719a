"""From raw documents to shards of clean, distinct, balanced training data.

Each stage takes the documents that its predecessor kept, read back from Parquet, and returns documents; the last
returns them with their shard and slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.decontaminate import decontaminate
from corpusloom.llm.hilbert import shard_documents
from corpusloom.llm.mixing import mix_documents
from corpusloom.llm.near_copies import near_copy_dedup
from corpusloom.llm.queries import mixture_levels
from corpusloom.llm.toxicity import drop_toxic
from corpusloom.plans.materialize import materialize
from corpusloom.session import table

#: Tokens of the mixture, as a share of those that reach it.
MIXTURE_SHARE = 0.8
#: Weight of each language that the mixture does not list, and of rows without one.
OTHER_LANGUAGES = 0.05


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of weak labels rejects go.

    Null and empty texts hold no words and stay; rows of equal texts share their fate, null ids too; without labels of both classes all
    stay; an empty table gives an empty result; columns stay as they are, whatever their names.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies by SimHash and exact similarity, the row of the least id stays.

    Null, empty and blank texts are copies of each other; null ids come last; of rows equal in id and text one stays; rows of one id with unrelated
    texts all stay; an empty table gives an empty result; columns stay as they are.
    """
    return near_copy_dedup(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, or all but a fifth of its words, go.

    Null and empty texts hold nothing and stay; items that are null or shorter than five words match nothing; rows are judged one by one, so
    repeated rows and null ids share the fate of their text; an empty table or benchmark drops nothing; columns stay as they are.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The share of tokens that the weights of domain, language and source ask for.

    Documents without words go; languages without a weight of their own, and rows without one, share a small weight; rows equal in id and text
    count each; the last document of a leaf is cut to the tokens that are left; an empty table gives an empty result; columns stay as they are.
    """
    levels, weights = mixture_levels(OTHER_LANGUAGES)
    return mix_documents(docs, levels, weights, MIXTURE_SHARE)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot, in the order of a Hilbert curve over source, language and length.

    Null metadata and texts have places of their own; repeated rows take neighbouring slots; an empty table gives an empty result; columns with
    the name of a result are replaced by it, all others stay.
    """
    return shard_documents(docs, carry=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic_documents),
    ("simhash", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: The classifier of the first stage has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
