"""Queries of the corpus problems 6-8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import mixing, tokenizer, truncation
from gridloom.session import spread, stored, table

#: The data have no topic column; the target language is the third marginal of this corpus of sentence pairs.
TOPIC = "target_lang"


def documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The columns asked for, over all cores even where the table is one small file."""
    return spread(table(spark, d, "documents").select(*columns))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(documents(spark, d, "doc_id", "text"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_target")
    cells = stored(mixing.cells_of(mixing.document_tokens(documents(spark, d, "doc_id", "source", "lang", TOPIC, "text"), TOPIC)))
    return mixing.short_sources(mixing.calibrate(cells, targets), cells, targets)


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    targets = table(spark, d, "mix_target")
    tokens = stored(mixing.document_tokens(documents(spark, d, "doc_id", "source", "lang", TOPIC, "text"), TOPIC))  # numbers only, read twice
    calibrated = mixing.calibrate(mixing.cells_of(tokens), targets)
    return mixing.sample(tokens, calibrated), calibrated, targets, tokens


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    return _mixture(spark, d)[0].select("doc_id", "source", "copies")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of the mixture."""
    return mixing.report(*_mixture(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found(truncation.score(documents(spark, d, "doc_id", "source", "text")))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut texts per source."""
    return truncation.rates(truncation.score(documents(spark, d, "doc_id", "source", "text"))).withColumn("source", F.coalesce("source", F.lit("(none)")))


QUERIES = {f.__name__: f for f in (p6_ids, p7_found, p7_sample, p7_shares, p8_found, p8_rates)}
