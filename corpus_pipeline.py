"""A training corpus from documents: rules, near-duplicates, redaction, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.

All stages take documents with nulls in any column, empty and very long texts, repeated
rows, further columns of any names, and an empty table; what each does with them is said
below.  All but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import mixing, ngram_join, packing, pii, quality
from loomgraph.llm.common import drop_path, fresh_path, scratch, written
from loomgraph.llm.queries import byte_level_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that are above the limits.

    Null, empty and white texts have too few words and go. Repeated rows stay or go together.
    A null source is a host of its own, a null id an id below none."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: that with the smallest id, a
    null one last. Five words and 0.8; four and 0.85 are the contract of op5_ngram_join alone.

    Rows that share id and text become one, rows that share an id alone are judged apart. Texts
    without words are linked with nothing and stay."""
    return ngram_join.one_of_each(docs, ngram_join.Join(words=5, percent=80))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by [KIND]; null texts stay null, repeated rows repeat."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it; a null source is a source. Texts
    without words are taken as their order falls; equal rows share what is taken of them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of the tokenized documents: a row a piece, without the ids. A null text is an
    empty one, a piece of length 1; repeated rows are placed as often as they are there."""
    pieces = packing.tokenized(docs, byte_level_file())
    pieces = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(pieces)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", redact_pii),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The scores of boosted trees and seeded hashes have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's input and its own tables are removed when its
    output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name.split()[0].lower())
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
