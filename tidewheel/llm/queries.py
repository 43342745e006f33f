"""Queries of the corpus problems (p6 to p8) over the project's documents.

None has SQL beside it: a tokenizer, a search over packings and the sentence
rules are no matter of SQL.  They are tested against brute force in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import mixture, packing, sentences, tokens
from tidewheel.session import table


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", tokens.token_count(F.col("text")).alias("n_tokens"))


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sized(spark, d), table(spark, d, "container_sizes"), "doc_id", "n_tokens").withColumnRenamed("item_id", "doc_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    containers = table(spark, d, "container_sizes")
    return packing.packing_report(packing.pack(_sized(spark, d), containers, "doc_id", "n_tokens"), containers)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(_sized(spark, d), table(spark, d, "source_targets"), "doc_id", "source", "n_tokens")[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(_sized(spark, d), table(spark, d, "source_targets"), "doc_id", "source", "n_tokens")[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p6_packing, p6_report, p7_mixture, p7_shares, p8_found)}
SQL: dict[str, str] = {}
