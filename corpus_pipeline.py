"""A training-data pipeline in five stages, each written as Parquet and read by the next.

Rejects by quality rules, drops repeated lines, keeps one document of each near-duplicate group,
mixes the sources to target weights, and packs the result into token windows. Every stage reads all
rows the one before kept; an empty table goes through all of them and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import linededup, mixing, packing, rules, simhash
from recallgrid.llm.common import P, Scratch, documents


def _counted(df: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where the table has it."""
    if "n_chars" in df.columns:
        return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return df


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the current rule policy go; null and empty texts have too few words and go too.

    Repeated rows and null ids are judged like any other row. An empty table stays empty.
    """
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated across documents stay in the one with the largest id; documents left without any text go.

    Rows repeating an id are one document, and so are rows without an id, which is never the largest. A null text is
    one empty line and comes back empty. An empty table stays empty.
    """
    out = linededup.dedup_lines(docs, n_lines=P + "n_lines", n_dropped=P + "n_dropped")
    emptied = (F.col(P + "n_dropped") > 0) & (F.trim("text") == "")
    return _counted(out.where(~emptied)).select(*(f"`{c}`" for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: Jaccard similarity of 5-word shingles from 0.8.

    BK-trees of SimHash fingerprints link near copies, shingle sets confirm each link, MinHash bands add what lies beyond the trees' radius.
    It is the one with the least id. Of repeated rows one stays; rows that share an id but not the text go or stay by
    their own group; a row without an id stays only where its whole group has none. Null and empty texts are alike. An
    empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the one at the edge of a source's target in part.

    A null source is a source of its own, last in order; texts without words, null ones too, are taken no times. Repeated
    rows are each taken on their own; ties are settled by length and a hash of the text. An empty table stays empty.
    """
    return _counted(mixing.mix_documents(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens; each row, a null text's too, has one piece at least.

    Rows repeating an id, as the mix makes them, are packed as documents of their own. An empty table gives no rows.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

#: SQL has no tokenizer and no XXH64, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last materialised in the shared scratch folder."""
    scratch = Scratch(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        after = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
