"""The stages of corpus_pipeline.py: each takes (spark, docs, sf_dir) and keeps columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kneser, langid, minhash, packing
from .common import materialise, prepare, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language stay, and `lang` becomes the language that the PPM model names.

    Null texts, texts without letters and texts that cost the model far more than its training texts
    do go (langid.accepted); without labelled languages nothing goes.
    """
    prepare(spark)
    return langid.accepted(docs, langid.train(docs.filter(~langid.held_out())))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts stay whose perplexity is at most their language's threshold; see kneser.classify."""
    prepare(spark)
    return kneser.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest doc_id.

    Rows are told apart by themselves, not by their ids: of rows that share a doc_id, and of those
    without one, each stays that is no near copy of another. A null id comes after all others; of
    copies that are alike in their ids any one stays. Columns may have any names.
    """
    prepare(spark)
    names = docs.columns
    plain = docs.toDF(*(f"_{i}" for i in range(len(names))))
    doc_id, text = (F.col(f"_{names.index(x)}") for x in ("doc_id", "text"))
    counted = plain.groupBy(doc_id.cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if counted.filter("n > 1 or id is null").isEmpty():
        kept = minhash.near_duplicates(plain.select(doc_id.alias("doc_id"), text.alias("text"))).filter("kept").select(F.col("doc_id").alias("kept_id"))
        return plain.join(kept, doc_id.cast("long") == F.col("kept_id"), "left_semi").toDF(*names)
    # Numbers of rows, written once, stand for their ids.
    numbered = materialise(plain.withColumn("_node", F.monotonically_increasing_id()), "numbered")
    groups = minhash.near_duplicates(numbered.select(F.col("_node").alias("doc_id"), text.alias("text"))).select(F.col("doc_id").alias("_node"), "component_id")
    order = F.struct(doc_id.isNull().alias("none"), doc_id.cast("long").alias("id"), F.col("_node").alias("node"))
    first = numbered.select("_node", order.alias("order")).join(groups, "_node").groupBy("component_id").agg(F.min("order").alias("first"))
    return numbered.join(first.select(F.col("first.node").alias("_node")), "_node", "left_semi").select(*(f"_{i}" for i in range(len(names)))).toDF(*names)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in the corpus's own mixture; see packing.pack."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def run(spark: SparkSession, sf_dir: str, stages) -> DataFrame:
    """Every stage but the last is written and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(stages):
            docs = materialise(docs, f"stage-{name}")
    return docs
