"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows (component, weight); components play the part of terms. Candidates lie in blocks,
each with one posting list per component (rows of the block, their weights). A query row takes its components one after
the other and scatters weight times weight into a dense array of scores, one for each row of the block. The best k of
each (query, block) are selected by partitioning; the blocks' winners are merged to the k of each query.

Scale: every query meets every row, as it must, in blocks: queries and candidates are numbered into blocks of fixed
size, both sides are dealt out to (query block, candidate block) pairs, and a task holds one pair at a time. Only k rows
for each query and block are shuffled again. No block depends on a key that may be frequent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

RESULT = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as long; rows that are null or hold null, NaN or infinity go."""
    x = F.col(embedding)
    fit = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(fit).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v")
    )


def _postings(rows: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    lengths = np.array([len(v) for v in rows])
    row, term = np.repeat(np.arange(len(rows)), lengths), np.concatenate([np.arange(n) for n in lengths])
    weight = np.concatenate(rows)
    keep = weight != 0
    row, term, weight = row[keep], term[keep], weight[keep]
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, int)
    return {int(term[a]): (row[a:b], weight[a:b]) for a, b in zip(at, np.append(at[1:], len(term)))}


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id, in order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, ties = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        ties = ties[np.argsort(ids[ties], kind="stable")[: k - len(above)]]
        chosen = np.concatenate([above, ties])
    else:
        chosen = np.arange(len(scores))
    return chosen[np.lexsort((ids[chosen], -scores[chosen]))]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, query_block: int = 1024, least_blocks: int = 24) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with all other rows.

    `vectors` and `queries` are (vec_id, v) of integer arrays. A query's own id is no candidate; of rows with one id
    each is a candidate (and a query) of its own, ordered by id; components beyond the shorter vector count nothing.
    Sums are 64-bit integers. Fewer candidates than k: all.
    """
    n, q = vectors.count(), queries.count()
    blocks, query_blocks = max(-(-n // block), min(least_blocks, max(n, 1))), max(-(-q // query_block), 1)
    number = lambda of: F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int")
    left = queries.select("vec_id", "v", number(query_blocks).alias("qb")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = vectors.select("vec_id", "v", number(blocks).alias("cb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def pair(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(rows):
            ids = rows["vec_id"].to_numpy()
            postings = _postings([np.asarray(v, np.int64) for v in rows["v"]])
            for query, v in zip(asked["vec_id"].to_numpy(), asked["v"]):
                scores = np.zeros(len(ids), np.int64)
                for term, weight in enumerate(np.asarray(v, np.int64)):
                    if weight and term in postings:
                        at, value = postings[term]
                        scores[at] += weight * value
                others = np.flatnonzero(ids != query)
                top = others[best(scores[others], ids[others], k)]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[top], "score": scores[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    parts = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(pair, RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
