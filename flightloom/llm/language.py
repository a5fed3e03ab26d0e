"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of up to `order` bytes is counted on a bounded sample of labelled texts and
frozen. The length of a text's code under a language is exact: a byte is coded in the longest context of the tree that
ends there; a context with n bytes counted, d of them distinct, gives byte b the share c(b)/(n+d) and the escape
d/(n+d) (method C), and what has escaped is left out of the shorter contexts (full exclusion). Because a context's bytes
all occur in its shorter ones, the bytes left out depend only on the context just escaped from, so every context stores
two pairs of numbers: its own (n, d) and the (n, d) that remain of its suffix once its bytes are left out.

Scale: the model is bounded by `sample_bytes` and broadcast; scoring is one pass without a shuffle. In a task the
(order+1)-grams of a slice of texts are made distinct first, so each is looked up once whatever its frequency.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flightloom.llm.shared import lookup, summed
from flightloom.llm.text import joined, slices

SCORED = "lang_pred string, score double, bits_per_byte double"


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For every byte the last order+1 bytes as one number; before a text's begin stand zero bytes."""
    out = data.astype(np.uint64)
    into = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order + 1):
        out[k:] |= np.where(into[k:] >= k, data[:-k], 0).astype(np.uint64) << np.uint64(8 * k)
    return out


class Tree:
    """One language's contexts: `logs` of totals and escapes for entry from above (own) and after an escape (left)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int):
        self.order, self.grams, self.contexts = order, [], []
        for k in range(order + 1):
            g, c = summed(keys & np.uint64((1 << (8 * (k + 1))) - 1), counts)
            ctx, at = np.unique(g >> np.uint64(8), return_index=True)
            n, d = np.add.reduceat(c, at), np.diff(np.append(at, len(g)))
            left_n, left_d = np.zeros_like(n), np.zeros_like(d)
            if k:  # the suffix without this context's bytes
                low, low_c = self.grams[-1]
                shared = low_c[np.searchsorted(low, g & np.uint64((1 << (8 * k)) - 1))]
                suffix, own = self.contexts[-1][0], self.contexts[-1][1]
                s = np.searchsorted(suffix, ctx & np.uint64((1 << (8 * (k - 1))) - 1))
                left_n, left_d = own[0][s] - np.add.reduceat(shared, at), own[1][s] - d
            self.grams.append((g, c))
            self.contexts.append((ctx, (n, d), (left_n, left_d)))

    def bits(self, wanted: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each gram after the bytes before it."""
        cost, open_ = np.zeros(len(wanted)), np.arange(len(wanted))
        after = np.full(len(wanted), -1, np.int64)  # the context escaped from, one byte longer
        for k in range(self.order, -1, -1):
            if not len(open_):
                return cost
            w = wanted[open_]
            ctx, own, _ = self.contexts[k]
            at, there = lookup(ctx, (w & np.uint64((1 << (8 * (k + 1))) - 1)) >> np.uint64(8))
            n, d = own[0][at].astype(float), own[1][at].astype(float)
            if k < self.order:
                _, _, (left_n, left_d) = self.contexts[k + 1]
                escaped = after[open_] >= 0
                n = np.where(escaped, left_n[after[open_]], n)
                d = np.where(escaped, left_d[after[open_]], d)
            g, c = self.grams[k]
            found_at, found = lookup(g, w & np.uint64((1 << (8 * (k + 1))) - 1))
            # a suffix with nothing left passes on without cost
            alive = there & (n + d > 0)
            total = np.log2(np.where(alive, n + d, 1))
            share = np.where(found, np.log2(c[found_at]), np.log2(np.where(d > 0, d, 1)))
            cost[open_] += np.where(alive, total - share, 0)
            after[open_] = np.where(there, at, -1)
            open_ = open_[~(there & found)]
        seen = len(self.grams[0][0])
        cost[open_] += np.log2(256 - seen) if seen < 256 else 0
        return cost


def sample(docs: DataFrame, learn, sample_bytes: int) -> DataFrame:
    """(lang, text): for every language texts in the order of a hash up to an equal share of `sample_bytes`, short
    texts first, one text at least. Only about twice the share of a language is ever ranked."""
    rows = docs.where(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        "lang", "text", F.octet_length("text").cast("long").alias("b"), F.xxhash64("doc_id", "text").alias("h")
    )
    stats = rows.groupBy("lang").agg(F.sum("b").alias("all_b"), F.min("h").alias("least"))
    languages = stats.count()  # one row for each language
    share = max(1, sample_bytes // max(1, languages))
    chance = F.col("h") / F.lit(float(1 << 64)) + 0.5
    near = rows.join(F.broadcast(stats), "lang").where((chance < 2.0 * share / F.col("all_b")) | (F.col("h") == F.col("least")))
    order = Window.partitionBy("lang").orderBy(F.col("b") > share // 8, "h", "text").rowsBetween(Window.unboundedPreceding, -1)
    return near.withColumn("before", F.coalesce(F.sum("b").over(order), F.lit(0))).where(F.col("before") < share).select("lang", "text")


def train(docs: DataFrame, learn, sample_bytes: int = 8 << 20, order: int = 4) -> dict[str, Tree]:
    """Trees by language, counted in Spark. At most sample_bytes * (order + 1) contexts in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            data, offsets = joined(batch.column("text"))
            for lang in sorted(set(langs)):
                rows = np.flatnonzero(langs == lang)
                part = [data[offsets[i] : offsets[i + 1]] for i in rows]
                keys, n = summed(grams(np.concatenate(part), np.cumsum([0, *map(len, part)]), order))
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys)), "gram": keys.astype(np.int64), "n": n.astype(np.int64)})

    counted = sample(docs, learn, sample_bytes).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()
    return {lang: Tree(*summed(g["gram"].to_numpy().astype(np.uint64), g["n"].to_numpy()), order) for lang, g in rows.groupby("lang")}


def predict(docs: DataFrame, trees: dict[str, Tree], text: str = "text") -> DataFrame:
    """docs with lang_pred, score and bits_per_byte.

    The language is the one of the shortest code (ties: the first by name). score is that language's share of
    2^-bits over all languages, with equal priors. Null texts and texts without a letter are `und` with score 0;
    so is everything if nothing could be learned.
    """
    names, order = sorted(trees), next(iter(trees.values())).order if trees else 0
    model = docs.sparkSession.sparkContext.broadcast([trees[n] for n in names])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = joined(batch.column(text))
            letters = batch.column("__letter").to_numpy(zero_copy_only=False)
            n, bits = batch.num_rows, np.zeros((batch.num_rows, len(names)))
            for a, b in slices(offsets):
                at = offsets[a : b + 1] - offsets[a]
                codes, keys = pd.factorize(grams(data[offsets[a] : offsets[b]], at, order))
                for j, tree in enumerate(model.value):
                    total = np.concatenate([[0.0], np.cumsum(tree.bits(keys)[codes])])
                    bits[a:b, j] = total[at[1:]] - total[at[:-1]]
            if names:
                best = bits.argmin(1)
                least = bits[np.arange(n), best]
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                pred = np.where(letters, np.array(names, object)[best], "und")
            else:
                least, share, pred = np.zeros(n), np.zeros(n), np.full(n, "und", object)
            known = letters & bool(names)
            out = {
                "lang_pred": pa.array(pred, pa.string()),
                "score": pa.array(np.where(known, share, 0.0)),
                "bits_per_byte": pa.array(np.where(known, least / np.maximum(np.diff(offsets), 1), 0.0)),
            }
            kept = [c for c in batch.schema.names if c not in ("__letter", *out)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *out.values()], names=[*kept, *out])

    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest)
    marked = docs.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    return marked.mapInArrow(score, f"{ddl}, {SCORED}")


def identify(docs: DataFrame, learn, sample_bytes: int = 8 << 20, order: int = 4) -> DataFrame:
    """Learns from the rows where `learn` holds (doc_id, text and lang are read there) and predicts every row."""
    trees = train(docs.select("doc_id", "text", "lang"), learn, sample_bytes, order)
    return predict(docs.select("doc_id", "text"), trees).select("doc_id", "lang_pred", "score", "bits_per_byte")
