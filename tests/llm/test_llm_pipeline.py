"""Each stage of the pipeline on what its predecessor kept."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from flightloom.llm import mixing, repeats
from test_llm_operators import brute_groups


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, sf_dir).cache()
    left = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in left for i in clean) >= 0.9 * len(clean)

    apart = stages["near_duplicates"](spark, good, sf_dir).cache()
    texts = {r.doc_id: r.text for r in good.collect()}
    assert {r.doc_id for r in apart.collect()} == {i for i, x in brute_groups(texts).items() if x[0] == i}

    cut = stages["repeated_passages"](spark, apart, sf_dir).cache()
    assert cut.columns == docs.columns and repeats.passages(cut).where("repeated and n_words >= 55").count() == 0

    mixed = stages["source_mixing"](spark, cut, sf_dir).cache()
    want = {r.doc_id: r.copies for r in mixing.mix(cut).collect() if r.copies}
    assert dict(collections.Counter(r.doc_id for r in mixed.collect())) == want and mixed.columns == docs.columns

    pieces = stages["packing"](spark, mixed, sf_dir)
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("each")).collect()
    assert {r.doc_id: r.n // r.each for r in whole} == want and all(r.n % r.each == 0 for r in whole)


def test_one_row_of_each_class_stays_without_ids_too(spark):
    a, b, c = (" ".join(f"{x}{i * i % 97}" for i in range(90)) for x in "abc")
    rows = [(None, a), (None, a), (None, a + " tail"), (None, b), (1, b + " end"), (2, c), (2, c), (2, b), (None, ""), (None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.distinct_documents(spark, docs, "").collect())
    assert got in [{(None, x): 1, (1, b + " end"): 1, (2, c): 1, (None, ""): 1, (None, None): 1, (3, ""): 1} for x in (a, a + " tail")]


def test_equal_rows_share_their_copies(spark):
    rows = [(1, "a b c", "en", "s", 5)] * 3 + [(None, None, None, None, None)] * 2 + [(2, "d e f g h i", "en", "t", 11)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter(r.doc_id for r in corpus_pipeline.weighted_sources(spark, docs, "").collect())
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    assert got == +want
