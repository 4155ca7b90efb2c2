"""The corpus pipeline: score, remove near duplicates, remove benchmark leaks, mask personal data, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents, whatever they are; extra columns
travel along, also such as have the names of the operators' own. An empty table passes through every stage.
Rows of null id, and rows that repeat an id, are rows like any other unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import decontam, jaccard, mixing, pii, quality
from tickframe.llm.common import small, spread, table, word_count, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. It is fitted on the labelled ones among docs.

    Needs doc_id, text, source and lang. A null text is one without words, a null source or language a value
    of its own. Rows of one id and text share their fate. Without any label all documents stay.
    """
    labels = table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.where("keep").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id.

    Needs doc_id and text. Rows that repeat the smallest id all stay. Null and blank texts have no
    duplicates, and rows of null id are nobody's; they stay.
    """
    found = jaccard.near_duplicates(docs.select("doc_id", "text"))
    others = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "duplicates")
    return docs.join(small(others, jaccard.BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Needs doc_id and text. All rows of an id go if one of them has a passage; null texts have none, and rows
    of null id stay.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind.

    Needs doc_id, text and n_chars, which follows the text; where the text is null both stay. Equal texts are masked alike.
    """
    out = pii.mask(docs, pii.train(docs))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, with copy, from 1.

    Needs doc_id, text and source; a null source is a source of its own. Rows of null id of one source share
    one coin. Texts without words have no size, and the coin of their source's rate decides on them too. A
    column copy of docs is replaced.
    """
    docs = docs.drop("copy")
    taken = mixing.mix(docs, word_count(F.col("text"))).where("mix_copies > 0")
    return taken.withColumn("copy", F.explode(F.expr("sequence(1, mix_copies)"))).select(*docs.columns, "copy")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontaminate", without_leaks),
    ("pii", masked),
    ("mix", mixed),
]

#: SQL can't express the classifier, the components or the random field.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
