"""A corpus from raw documents to token counts: toxicity, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result as Parquet to the shared
folder and hands it, read again, to the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from packetloom.llm import bpe, exact_dedup, mixing, simhash, toxicity
from packetloom.llm.common import cut, split_of, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those predicted toxic, by a model of the labels of sf_dir, of which the held-out third teaches nothing. Null, empty and very long texts are scored whole; rows that repeat go or stay
    together; other columns are left alone; no rows give none."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), split_of("doc_id", 3) == 1)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, blanks aside: the longest, then that with the smallest id, null ids last. Null and empty texts are one text; of rows alike in all this any one stays; other columns are left
    alone; no rows give none."""
    return exact_dedup.drop_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are 0.8 alike, the smallest id. Fingerprints propose pairs, by the operator's pigeonhole links, minima of the sets those that
    fingerprints miss; the sets decide. Texts without words are one group; rows with a null id stay; rows that share an id stay or go
    together; other columns are left alone; no rows give none."""
    return simhash.near_dedup(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them. Null and empty texts don't occur; the null source is a source; rows with the same id and text occur equally often; other columns are left alone; no rows give
    none."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each of docs with its number of tokens and the digests of its ids and of what they decode to. A null text is empty; very long ones are encoded whole; repeated rows stay; no rows give
    none."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: No SQL: the classifier, the fingerprints and the merges are beyond it. tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
