"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import alignment, decontam, fuzzy_lines, langid, mixing, onebit, pii, prefix_trie, secret_scan, superminhash, tokenfile, toxicity, warc
from sparkloom.llm.common import shared_path, text_batches
from sparkloom.llm.sql import SQL  # noqa: F401
from sparkloom.sources.tables import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(text_batches(spark), sf_dir, "documents")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents by source."""
    return mixing.mix_report(documents(spark, sf_dir))


def op2_onebit_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every row whose id is divisible by 50."""
    return onebit.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents into a segment table, and read it back."""
    path = shared_path(spark, "tokens")
    tokenfile.write(documents(spark, sf_dir), path)
    return tokenfile.read(spark, path)


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents that repeat, nearly or exactly, an earlier one."""
    return fuzzy_lines.report(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in all documents."""
    return secret_scan.report(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the labels of rows that aren't held out; score all documents."""
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~langid.held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out"))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return toxicity.score(rows, model).select("doc_id", "held_out", "score", predicted, "spans")


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal values replaced, and where these stood."""
    found = pii.pseudonymised(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "text", "pii", (F.col("pii") != "").alias("has_pii"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the rows that aren't held out; predict all."""
    docs = documents(spark, sf_dir)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out"))
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op9_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items found in each document."""
    return decontam.report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on 2-word shingles."""
    return superminhash.groups(documents(spark, sf_dir), k=2, percent=80).drop("h")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align the tokens of two vocabularies over all documents."""
    return alignment.report(documents(spark, sf_dir))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as whole gzip streams, normalise these, and read the archives back."""
    source, path = shared_path(spark, "warc-streams"), shared_path(spark, "warc")
    warc.write(table(text_batches(spark), sf_dir, "pages"), source)
    warc.normalise(spark, source, path)
    return warc.report(spark, path)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_onebit_nearest": op2_onebit_nearest,
    "op3_token_codes": op3_token_codes,
    "op4_fuzzy_lines": op4_fuzzy_lines,
    "op5_secrets": op5_secrets,
    "op6_toxicity": op6_toxicity,
    "op7_feistel_pseudonyms": op7_feistel_pseudonyms,
    "op8_language_id": op8_language_id,
    "op9_bm25_decontamination": op9_bm25_decontamination,
    "op10_superminhash": op10_superminhash,
    "op11_token_alignment": op11_token_alignment,
    "op12_warc": op12_warc,
    "op13_prefix_trie": op13_prefix_trie,
}
