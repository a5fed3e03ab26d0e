"""Interpolated modified Kneser-Ney bigram model, counted in Spark, scored from memory-mapped sorted hash arrays.

Tokens are words (everything but ASCII white space, A-Z lower-cased) and one end token for each text; the first token
follows a begin mark. p(w|v) = max(c(vw) - D(c), 0)/c(v) + g(v) p1(w), and p1 interpolates discounted counts of the
distinct words before w with the uniform 1/(V+1). D takes one of three values by count 1, 2, 3+ (modified discounts).

Scale: three passes over the text (words, bigrams, scores). Tasks send sums of hashes as packed arrays, split over
shards by hash; bigrams are sharded by their first word, so a context's totals need no further shuffle, except those of
the frequent words (at least 1/1024 of all tokens, hence at most 1024 of them), which are split by bigram so that no
shard holds a hot word. Each shard writes its sorted arrays to the shared folder once; scoring tasks map the files and
look up each distinct word and bigram of a slice once. Nothing but sums and the frequent words reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flightloom.llm import shared
from flightloom.llm.text import Words, joined, mix, slices

END, BEGIN = np.uint64(0xE0F5A1D3C2B49687), np.uint64(0xB1D2A3F4E5968778)
#: A word is frequent from this share of all tokens on.
FREQUENT = 1024


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, an END after each, and where each text begins."""
    n = words.counts
    first = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(first[-1], END, np.uint64)
    out[np.arange(len(words.hash)) + words.text] = words.hash
    return out, first


def before(tok: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each, BEGIN at a text's first."""
    out = np.concatenate([[BEGIN], tok[:-1]])
    out[first[:-1]] = BEGIN
    return out


def pair_key(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(ctx * np.uint64(0x9FB21C651E98DF25) + word)


def pair_shard(ctx: np.ndarray, key: np.ndarray, frequent: np.ndarray, shards: int) -> np.ndarray:
    """By context; by pair if the context is frequent."""
    _, hot = shared.lookup(frequent, ctx)
    return shared.shard_of(np.where(hot, key, mix(ctx)), shards)


def discounts(n: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2, 3+ from how many keys have count 1, 2, 3, 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3) <= 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.0, [0.0, 1.0, 2.0, 3.0])


@dataclass
class Model:
    folder: str
    shards: int
    frequent: np.ndarray
    train_tokens: int
    distinct: int
    types: int
    gamma1: float  # weight of the uniform share below the word level


COUNTED = "shard int, n long, v long, n1 long, n2 long, n3 long, n4 long, hot binary"


def train(docs: DataFrame, text: str = "text") -> Model:
    """Counts all texts given. Runs its jobs at once; what stays is the folder of arrays."""
    spark = docs.sparkSession
    folder, shards = shared.new_folder(spark, "kneser-ney"), shared.shards_for(docs, text)
    texts = docs.select(F.col(text).alias("text"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = shared.Gather(shards)
        for batch in batches:
            data, offsets = joined(batch.column("text"))
            for a, b in slices(offsets):
                yield from gather.add(tokens(Words(data, offsets, a, b))[0])
        yield from gather.flush()

    def word_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, n = shared.unpack(table)
        shared.save_array(folder, f"word-{key[0].as_py()}", keys)
        shared.save_array(folder, f"count-{key[0].as_py()}", n)
        return pa.table({"shard": [key[0].as_py()], "n": [int(n.sum())], "v": [len(n)], **{f"n{k}": [0] for k in range(1, 5)},
                         "hot": pa.array([b""], pa.binary())}).cast(_schema())

    def _schema() -> pa.Schema:
        return pa.schema([("shard", pa.int32()), *((x, pa.int64()) for x in ("n", "v", "n1", "n2", "n3", "n4")), ("hot", pa.binary())])

    sums = shared.stored(texts.mapInArrow(words_of, shared.PACKED_DDL).groupBy("shard").applyInArrow(word_shard, COUNTED), "kneser-ney-words")
    total = sums.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    train_tokens, distinct = int(total["n"] or 0), int(total["v"] or 0)

    def hot_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column("shard").to_pylist():
                keys, n = shared.load_array(folder, f"word-{s}", np.uint64), shared.load_array(folder, f"count-{s}", np.int64)
                yield pa.RecordBatch.from_pydict({"word": np.asarray(keys[n * FREQUENT >= train_tokens]).view(np.int64)})

    hot = sums.select("shard").mapInArrow(hot_words, "word long").toPandas()["word"].to_numpy()  # FREQUENT rows at most
    frequent = np.sort(np.append(hot.astype(np.int64).view(np.uint64), BEGIN))

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            ctx, word = (np.concatenate(x) for x in zip(*held))
            key = pair_key(ctx, word)
            order = np.argsort(key)
            key, ctx, word = key[order], ctx[order], word[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            c = np.diff(np.append(at, len(key)))
            ctx, word = ctx[at], word[at]
            # both hashes travel side by side in `keys`
            shard = pair_shard(ctx, key[at], frequent, shards)
            by = np.lexsort((ctx, shard))
            ctx, word, c, shard = ctx[by], word[by], c[by], shard[by]
            cut = np.searchsorted(shard, np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cut)):
                part = slice(cut[s], cut[s + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([ctx[part].tobytes() + word[part].tobytes()], pa.binary()), pa.array([c[part].astype(np.uint32).tobytes()], pa.binary())],
                    schema=shared.PACKED,
                )

        for batch in batches:
            data, offsets = joined(batch.column("text"))
            for a, b in slices(offsets):
                tok, first = tokens(Words(data, offsets, a, b))
                held.append((before(tok, first), tok))
                n += len(tok)
                if n >= shared.FLUSH:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def pair_shard_counts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The shard's pairs, kept until the discounts are known; sums of count classes; new left neighbours by word."""
        s = key[0].as_py()
        ctx, word, c = [], [], []
        for k, n in zip(table["keys"], table["counts"]):
            both = np.frombuffer(k.as_py(), np.uint64)
            ctx.append(both[: len(both) // 2])
            word.append(both[len(both) // 2 :])
            c.append(np.frombuffer(n.as_py(), np.uint32))
        ctx, word, c = np.concatenate(ctx), np.concatenate(word), np.concatenate(c).astype(np.int64)
        keys = pair_key(ctx, word)
        order = np.argsort(keys)
        keys, ctx, word, c = keys[order], ctx[order], word[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, ctx, word, c = keys[at], ctx[at], word[at], np.add.reduceat(c, at)
        shared.save_array(folder, f"pair-{s}", keys)
        shared.save_array(folder, f"paircount-{s}", np.minimum(c, 0xFFFFFFFF).astype(np.uint32))
        # contexts' totals and count classes: whole here, but for the frequent ones, of which every shard has a part
        order = np.argsort(ctx, kind="stable")
        sorted_ctx, by_ctx = ctx[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], sorted_ctx[1:] != sorted_ctx[:-1]]))
        stats = np.stack([np.add.reduceat(x, at) for x in (by_ctx, by_ctx == 1, by_ctx == 2, by_ctx > 2)], 1).astype(np.int64)
        _, is_hot = shared.lookup(frequent, sorted_ctx[at])
        shared.save_array(folder, f"context-{s}", sorted_ctx[at][~is_hot])
        shared.save_array(folder, f"contextstats-{s}", stats[~is_hot])
        hot = np.concatenate([sorted_ctx[at][is_hot].view(np.int64)[:, None], stats[is_hot]], 1)
        follow, lefts = shared.summed(word)
        back = shared.packed(follow, lefts, shards)
        n = len(back)
        sums = {f"n{k}": [int((c == k).sum())] + [0] * n for k in range(1, 5)}
        return pa.table({
            "shard": pa.array([-1, *back.column("shard").to_pylist()], pa.int32()), "v": [len(c)] + [0] * n, **sums,
            "hot": pa.array([hot.tobytes(), *[None] * n], pa.binary()),
            "keys": pa.array([None, *back.column("keys").to_pylist()], pa.binary()), "counts": pa.array([None, *back.column("counts").to_pylist()], pa.binary()),
        })

    pair_ddl = "shard int, v long, n1 long, n2 long, n3 long, n4 long, hot binary, keys binary, counts binary"
    pairs = shared.stored(texts.mapInArrow(pairs_of, shared.PACKED_DDL).groupBy("shard").applyInArrow(pair_shard_counts, pair_ddl), "kneser-ney-pairs")
    got = pairs.where("shard = -1").agg(*(F.sum(x).alias(x) for x in ("v", "n1", "n2", "n3", "n4"))).first()
    types, d = int(got["v"] or 0), discounts(np.array([got[f"n{k}"] or 0 for k in range(1, 5)]))

    # the frequent contexts' stats: at most FREQUENT + 1 keys, summed over shards in Spark
    def hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("hot").to_pylist():
                rows = np.frombuffer(x, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(5)], names=["ctx", "c", "n1", "n2", "n3"])

    hot_stats = (
        pairs.where("shard = -1").select("hot").mapInArrow(hot_rows, "ctx long, c long, n1 long, n2 long, n3 long")
        .groupBy("ctx").agg(*(F.sum(x).alias(x) for x in ("c", "n1", "n2", "n3"))).toPandas()
    )
    hot_keys = hot_stats["ctx"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(hot_keys)
    shared.save_array(folder, "context-hot", hot_keys[by])
    shared.save_array(folder, "contextstats-hot", hot_stats[["c", "n1", "n2", "n3"]].to_numpy(np.int64)[by])
    shared.save_array(folder, "discounts", d)

    def left_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, n = shared.unpack(table)
        shared.save_array(folder, f"left-{key[0].as_py()}", keys)
        shared.save_array(folder, f"leftcount-{key[0].as_py()}", n)
        return pa.table({"shard": [key[0].as_py()], "n": [int(n.sum())], "v": [len(n)], **{f"n{k}": [int((n == k).sum())] for k in range(1, 5)},
                         "hot": pa.array([b""], pa.binary())}).cast(_schema())

    lefts = shared.stored(pairs.where("shard >= 0").select("shard", "keys", "counts").groupBy("shard").applyInArrow(left_shard, COUNTED), "kneser-ney-lefts")
    low = lefts.agg(*(F.sum(x).alias(x) for x in ("v", "n1", "n2", "n3", "n4"))).first()
    d1 = discounts(np.array([low[f"n{k}"] or 0 for k in range(1, 5)]))
    shared.save_array(folder, "leftdiscounts", d1)
    seen, ones, twos = (int(low[x] or 0) for x in ("v", "n1", "n2"))
    gamma1 = (d1[1] * ones + d1[2] * twos + d1[3] * (seen - ones - twos)) / types if types else 1.0
    return Model(folder, shards, frequent, train_tokens, distinct, types, gamma1)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1], [True]])) if len(shard) else np.zeros(1, int)
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(shard[order[a]]), order[a:b]


def _find(model: Model, keys: np.ndarray, shard: np.ndarray, key_file: str, value_file: str, dtype, width: int = 1) -> np.ndarray:
    """Values of the keys, 0 where there is none."""
    out = np.zeros((len(keys), width), np.int64)
    for s, rows in _by_shard(shard):
        try:
            known = shared.load_array(model.folder, f"{key_file}-{s}", np.uint64)
        except FileNotFoundError:  # no key fell into this shard
            continue
        at, there = shared.lookup(known, keys[rows])
        values = shared.load_array(model.folder, f"{value_file}-{s}", dtype).reshape(-1, width)
        out[rows[there]] = values[at[there]]
    return out[:, 0] if width == 1 else out


def word_scores(model: Model, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of distinct words, and their p1."""
    shard = shared.shard_of(words, model.shards)
    count = _find(model, words, shard, "word", "count", np.int64)
    lefts = _find(model, words, shard, "left", "leftcount", np.int64)
    d = shared.load_array(model.folder, "leftdiscounts", float)
    p = np.maximum(lefts - d[np.minimum(lefts, 3)], 0) / max(model.types, 1) + model.gamma1 / (model.distinct + 1)
    return count, p


def pair_scores(model: Model, ctx: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The discounted share of each distinct pair, and its context's weight of p1."""
    shard = pair_shard(ctx, key, model.frequent, model.shards)
    c = _find(model, key, shard, "pair", "paircount", np.uint32)
    d = shared.load_array(model.folder, "discounts", float)
    distinct, back = np.unique(ctx, return_inverse=True)
    hot_at, hot = shared.lookup(shared.load_array(model.folder, "context-hot", np.uint64), distinct)
    stats = _find(model, distinct, shared.shard_of(mix(distinct), model.shards), "context", "contextstats", np.int64, 4)
    hot_stats = shared.load_array(model.folder, "contextstats-hot", np.int64).reshape(-1, 4)
    stats[hot] = hot_stats[hot_at[hot]]
    total = stats[:, 0]
    weight = np.where(total > 0, (stats[:, 1:] @ d[1:]) / np.maximum(total, 1), 1.0)
    return np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total, 1)[back], weight[back]


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs (without the text) with token counts, the add-one unigram score and the model's log10 probability.

    Null texts are empty and have the end token alone. Without training texts both scores are 0. Columns with the names of
    results are replaced.
    """
    rest = [f for f in docs.schema if f.name != text and f.name not in {x.split()[0] for x in SCORES.split(", ")}]
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = handle.value
        shared.forget_arrays(m.folder)
        for batch in batches:
            data, offsets = joined(batch.column(text))
            parts = []
            for a, b in slices(offsets):
                tok, first = tokens(Words(data, offsets, a, b))
                words, which = np.unique(tok, return_inverse=True)
                count, p1 = word_scores(m, words)
                ctx = before(tok, first)
                key = pair_key(ctx, tok)
                order = np.argsort(key)
                at = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
                share, weight = pair_scores(m, ctx[order[at]], key[order[at]])
                group = np.empty(len(tok), np.int64)
                group[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(tok))))
                base = np.log10((count + 1) / (m.train_tokens + m.distinct + 1))[which]
                full = np.log10(share[group] + weight[group] * p1[which]) if m.train_tokens else np.zeros(len(tok))
                add = lambda x: np.add.reduceat(x, first[:-1])
                parts.append((np.diff(first), add((count > 0)[which].astype(np.int64)), add(base), add(full)))
            n, known, base, full = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
            out = [pa.array(n), pa.array(known), pa.array(np.full(len(n), m.train_tokens)), pa.array(base), pa.array(full), pa.array(10 ** (-full / np.maximum(n, 1)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *out], names=[*(f.name for f in rest), *(x.split()[0] for x in SCORES.split(", "))])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return docs.select(*(f"`{f.name}`" for f in rest), f"`{text}`").mapInArrow(run, f"{ddl}, {SCORES}" if rest else SCORES)
