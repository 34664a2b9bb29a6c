"""The p7..p9 queries: each applies its operator, with production parameters, to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import encode, leak, split, tokens
from loomlog.session import table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def p7_ids_multi(spark: SparkSession, d: str) -> DataFrame:
    """The same by the public tokenizer for many languages."""
    return encode.encode_corpus(table(spark, d, "documents"), tokens.ranks("byte_bpe_multi_50k"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Exact and re-parameterised leaks of passages and questions, with the number of matching windows."""
    return leak.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    leaks = leak.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), fields=("passage",))
    return leaks.filter("kind = 'exact'").select("doc_id", "item_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all oversized documents."""
    return split.split_documents(table(spark, d, "documents"), oversized_only=True)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """A document is oversized if it has a second piece; all its pieces are made, to the end of its text."""
    return p9_pieces(spark, d).filter(F.col("piece_no") == 1).select("doc_id")


QUERIES = {f.__name__: f for f in (p7_ids, p7_ids_multi, p8_found, p8_leaks, p9_found, p9_pieces)}
ORACLES: dict[str, str] = {}
