"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flightloom.llm import fingerprints, language, licenses, manifest, mixing, near, packing, perplexity, quality, repeats, spelling, tokenfiles, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(0))


@_query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(3) == 1
    found = language.identify(documents(spark, sf_dir), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


@_query
def op2_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir).select("doc_id", "text"), fold(7) == 2
    return perplexity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), perplexity.train(docs.where(~held_out)))


@_query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))


@_query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(documents(spark, sf_dir))


@_query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.join(documents(spark, sf_dir))


@_query
def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.passages(documents(spark, sf_dir))


@_query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir).select("doc_id", "text"), fold(5) == 0
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return quality.score(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer())


@_query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


@_query
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLES["op10_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, x -> cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, x -> x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), p -> p[1] * p[2])) as bigint) as score
  from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""


@_query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


@_query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(documents(spark, sf_dir), tokenizer())


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
