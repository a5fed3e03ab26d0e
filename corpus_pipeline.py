"""From raw documents to packed sequences: quality, near duplicates, repeated passages, source weights, packing.

Every stage is a function of (spark, docs, sf_dir) that gives a DataFrame; run() writes each one's rows as Parquet in
the shared folder and reads them again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flightloom.llm import mixing, near, packing, quality, repeats
from flightloom.llm.queries import documents, fold, tokenizer
from flightloom.llm.shared import stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more."""
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(5) != 0)
    return quality.score(docs.withColumnRenamed("score", "__score"), net, keep_text=True).where("score >= 0.3").drop("score").withColumnRenamed("__score", "score")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least id. Texts without words have copies only in rows that
    are equal to them in an id; each of them without an id stays."""
    alone = F.first((F.col("grams") == 0) & F.col("doc_id").isNull()).alias("alone")
    by_text = near.placed(docs).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.bool_or("first").alias("first"), F.sum("rows").alias("rows"), alone)
    found = stored(by_text.where("first").select("__id", "__hash", (F.col("alone") | (F.col("rows") == 1)).alias("__all")), "pipeline-distinct")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (near.text_hash() == F.col("__hash"))
    left, again = docs.join(found.where("__all"), same, "left_semi"), found.where("not __all")
    if again.isEmpty():
        return left
    one = docs.join(again, same).dropDuplicates(["__id", "__hash"])
    return left.unionByName(one.select(*(F.col(f"`{c}`") for c in docs.columns)))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay at their first place only."""
    return repeats.remove(docs, stored(repeats.passages(docs), "pipeline-repeats"))


def weighted_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    key = ["__id", "__source", "__text_hash"]
    own = (F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.xxhash64("text").alias("__text_hash"))
    mixed = mixing.mix(docs.select("doc_id", "source", "text", *own))
    taken = mixed.groupBy(*key).agg(F.sum("copies").alias("__total"), F.count("*").alias("__rows")).where("__total > 0").select(*(F.col(k).alias(f"{k}_r") for k in key), "__total", "__rows")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in key]
    # rows that are equal in id, source and text share their copies
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    both = docs.select("*", *own).join(taken, same).withColumn("__nth", nth)
    copies = F.floor(F.col("__total") / F.col("__rows")) + F.when(F.col("__nth") <= F.col("__total") % F.col("__rows"), 1).otherwise(0)
    many = both.withColumn("__copies", copies.cast("int")).where("__copies > 0")
    return many.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality_classifier", good_documents),
    ("near_duplicates", distinct_documents),
    ("repeated_passages", without_repeats),
    ("source_mixing", weighted_sources),
    ("packing", packed_sequences),
]

#: A network, linked texts and a tokenizer have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
