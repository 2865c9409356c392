"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next one.
All but the last return the columns of documents, and any further columns of the input, whatever their names.

Defined results: documents with a null or empty text fail the quality rules; null and repeated ids are as good as others: rows are known by
their content, and of wholly equal rows one stays; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.llm import decontam, mixing, quality_rules, simhash, token_output
from timeloom.llm.common import discard, fresh, materialise, scope, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed; n_chars follows the text."""
    judged = quality_rules.quality_rules(docs, carry=tuple(docs.columns)).filter("kept")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.select(*[new[c].alias(c) if c in new else F.col(f"carried.{c}").alias(c) for c in docs.columns])


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that of the smallest id (null last), of rows that share it the first by hash."""
    rest = [F.col(c) for c in docs.columns if c != "doc_id"]
    # rows are known by id and 128 bits of their content, as ids may be null or shared by different texts
    key, rank = fresh(docs.columns, "key"), fresh(docs.columns, "rank")
    parts = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*rest).alias("h"), F.xxhash64(F.lit(1), *rest).alias("g"))
    # of the type it is read back with, nullable fields included, so that rank and join share one shuffle
    keyed = docs.withColumn(key, parts.cast(f"struct<no_id: boolean, doc_id: {dict(docs.dtypes)['doc_id']}, h: bigint, g: bigint>"))
    found = materialise(simhash.near_duplicates(keyed, id_col=key), "dedup")
    chosen = found.filter("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    # equal rows share a key: each task sends one of them on, so copies of any number are not gathered; the keys grow with the corpus
    # and are never broadcast
    one = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(F.col(key)["h"]))).filter(F.col(rank) == 1)
    return one.join(chosen.hint("merge"), key, "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), only_clean=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; their digests a row a document (or copy)."""
    return token_output.encode_corpus(docs)


STAGES = [("quality rules", clean), ("near duplicates", dedup), ("decontamination", decontaminate), ("mixing", mix), ("token output", tokens)]

#: Fingerprints, mixing and tokens are beyond SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote on its way is deleted once its own table is there, and that when the next one's is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        own = f"stage-{k + 1}" if k < len(STAGES) - 1 else "tokens"
        with scope(own):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = materialise(docs, own)
        if last is not None:  # the last stage has written its tokens
            discard(last)
        last = docs
    return docs
