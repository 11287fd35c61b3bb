"""Queries p5 to p8: the text operators applied to the whole text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.functions import documented_functions
from tamarack.llm.mixing import mix
from tamarack.llm.spam import spam_pages
from tamarack.llm.tokenize import decode_corpus, encode_corpus, token_count
from tamarack.operators.bounded import spread
from tamarack.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions and procedures with a body whose comment says something."""
    return documented_functions(table(spark, d, "src_file"), file_id="file_id", text="source_text").select("file_id", "line_start", "routine_name")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and description of the same functions and procedures."""
    return documented_functions(table(spark, d, "src_file"), file_id="file_id", text="source_text", code=True).select("file_id", "line_start", "line_end", "routine_name", "description", "code")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return encode_corpus(table(spark, d, "documents"), doc_id="doc_id", text="text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return decode_corpus(p6_ids(spark, d), doc_id="doc_id", ids="ids")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = spread(table(spark, d, "documents").select("doc_id", "source", "text").where("source is not null"))
    sized = documents.select("doc_id", "source", token_count(spark, F.col("text")).alias("n_tokens"))
    return mix(sized, table(spark, d, "mix_target"), doc_id="doc_id", source="source", size="n_tokens")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mix(spark, d)[0].select("doc_id", "source", F.col("size").alias("n_tokens"), "copies")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return _mix(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages more than half of whose text is keywords, links or tags."""
    return spam_pages(table(spark, d, "documents"), doc_id="doc_id", text="text").select("doc_id")


QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_mix": p7_mix, "p7_report": p7_report, "p8_found": p8_found}

#: Tokenizing, lexing with comment rules and the automaton are beyond SQL, but what is encoded and decoded is the text: see tests/llm.
ORACLES: dict[str, str] = {"p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
