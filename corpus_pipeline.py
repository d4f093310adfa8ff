"""From raw documents to token files: five stages, each one an operator of the ``llm`` subpackage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and reads again as the next one's ``docs``. All but the last
return the columns of ``documents``.

    language        documents in none of the learned languages, or without a letter, go
    near_duplicates one document of each near-duplicate group stays (5-word shingles, 0.8)
    decontaminate   documents in which a benchmark item was found go
    mix             sources are taken to their target weights; a document may come several times
    tokens          texts are encoded and written as directly addressable codes

Defined cases, stage by stage: a document with a null or empty text, or one without a letter, has no
language and goes in the first stage. Of rows that agree in id and text, all stay or all go in the first three
stages, and each is taken equally often by the mix; of a group of near duplicates the rows of the smallest id stay,
and rows without an id where no row of the group has one. Ties of language go to the first in order. Texts of any length are read whole. Columns of any
names besides those of ``documents`` are carried up to the last stage. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontam, langid, mixing, superminhash, tokenfile
from sparkloom.llm.common import shared_path, text_batches
from sparkloom.sources.tables import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that belong to a learned language."""
    text_batches(spark)
    return langid.accepted(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group."""
    text_batches(spark)
    return superminhash.kept(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents without a benchmark item."""
    text_batches(spark)
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the sources to their targets."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token file, and return what it holds for each document."""
    text_batches(spark)
    path = shared_path(spark, "tokens")
    tokenfile.write(docs, path)
    return tokenfile.read(spark, path)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: The first stage's model is beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
