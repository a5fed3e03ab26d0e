"""Quality scores from a byte-level convolutional network in numpy.

One layer of learned filters runs over all bytes of a text; each filter's highest answer is taken in every chunk (chunks
of two half-chunks, overlapping by one); a text is described by the mean, the maximum and the minimum of its chunks'
answers, and a small hidden layer combines these into one probability. Training (Adam, log loss) follows the places of
the highest answers only, so its cost is that of the forward pass.

Scale: the network is fitted once on a bounded sample of labelled texts (`sample_rows` of each label, of `sample_bytes`
at most) and is a few hundred kB; scoring is one pass without a shuffle. For scoring the filters are tabulated over
pairs of bytes, which halves the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flightloom.llm.text import joined, slices


#: Bytes of texts scored at once: the answers of all filters take 64 times as much.
SCORED_BYTES = 1 << 17


@dataclass(frozen=True)
class Shape:
    width: int = 8
    filters: int = 16
    hidden: int = 16
    half_chunk: int = 256


class Network:
    """Parameters: filters[place, byte, filter], hidden and output layers."""

    def __init__(self, shape: Shape, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.shape = shape
        # filters start from random directions in a small space of byte classes, so that similar bytes answer alike
        self.p = {
            "filters": (rng.normal(0, 0.3, (shape.width, 256, shape.filters))).astype(np.float32),
            "bias": np.zeros(shape.filters, np.float32),
            "hidden": rng.normal(0, 0.3, (3 * shape.filters, shape.hidden)).astype(np.float32),
            "hidden_bias": np.zeros(shape.hidden, np.float32),
            "out": rng.normal(0, 0.3, shape.hidden).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        self.prior: float | None = None  # set if there was nothing to learn from

    def tables(self) -> list[np.ndarray]:
        """Answers by pairs of bytes, one table for every two places of the filters."""
        f = self.p["filters"]
        return [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, self.shape.width, 2)]

    def answers(self, data: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """(places, filters) of zero-padded bytes; the last width - 1 bytes begin no place."""
        n = len(data) - self.shape.width + 1
        out = np.zeros((n, self.shape.filters), np.float32)
        if tables is None:
            for j in range(self.shape.width):
                out += self.p["filters"][j][data[j : j + n]]
        else:
            pair = data[:-1].astype(np.int32) * 256 + data[1:]
            for j, table in enumerate(tables):
                out += table[pair[2 * j : 2 * j + n]]
        return out

    def layout(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Half-chunks of padded texts: begin and stop of each, and how many each text has (one at least). A text's last
        place is its first padding byte: those after it reach into the next text."""
        halves = np.maximum(-(-lengths // self.shape.half_chunk), 1)
        padded = lengths + self.shape.width
        first = np.concatenate([[0], np.cumsum(padded)])[:-1]
        within = np.arange(halves.sum()) - np.repeat(np.cumsum(halves) - halves, halves)
        starts, last = np.repeat(first, halves) + within * self.shape.half_chunk, np.cumsum(halves) - 1
        stops = starts + self.shape.half_chunk
        stops[last] = first + lengths + 1
        return starts, stops, halves

    def maxima(self, answers: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The highest answers of each half-chunk."""
        return np.maximum.reduceat(answers, np.stack([starts, stops], 1).ravel())[::2]

    def pad(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text followed by `width` zero bytes."""
        lengths = np.diff(offsets)
        out = np.zeros(int(lengths.sum()) + self.shape.width * (len(lengths) + 1), np.uint8)
        out[np.arange(len(data)) + np.repeat(np.arange(len(lengths)) * self.shape.width, lengths)] = data
        return out

    def chunks(self, halves_max: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maxima of overlapping chunks, which half holds each, and each text's first chunk."""
        stop = np.cumsum(halves)
        last = np.zeros(len(halves_max), bool)
        last[stop - 1] = True
        lonely = last & np.repeat(halves == 1, halves)
        begin = np.flatnonzero(~last | lonely)
        partner = np.where(lonely[begin], begin, begin + 1)
        second = halves_max[partner] > halves_max[begin]
        chosen = np.where(second, partner[:, None], begin[:, None])
        count = np.maximum(halves - 1, 1)
        return np.maximum(halves_max[begin], halves_max[partner]), chosen, np.cumsum(count) - count

    def head(self, pooled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict]:
        """Log odds of each text from its chunks' rectified maxima."""
        act = np.maximum(pooled + self.p["bias"], 0)
        n = np.diff(np.append(first, len(act)))
        x = np.concatenate([np.add.reduceat(act, first) / n[:, None], np.maximum.reduceat(act, first), np.minimum.reduceat(act, first)], 1)
        z = np.einsum("ij,jk->ik", x, self.p["hidden"]) + self.p["hidden_bias"]
        h = np.maximum(z, 0)
        return (h * self.p["out"]).sum(1) + self.p["out_bias"], {"act": act, "n": n, "x": x, "z": z, "h": h}

    def score(self, data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(offsets) - 1, self.prior)
        padded = self.pad(data, offsets)
        starts, stops, halves = self.layout(np.diff(offsets))
        pooled, _, first = self.chunks(self.maxima(self.answers(padded, tables), starts, stops), halves)
        return 1 / (1 + np.exp(-np.clip(self.head(pooled, first)[0].astype(float), -30, 30)))

    def fit(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.004, seed: int = 11) -> Network:
        """Adam on the weighted log loss; deterministic."""
        rng, m, v, step = np.random.default_rng(seed), {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                grad = self.gradient([texts[i] for i in rows], labels[rows], weights[rows])
                step += 1
                speed = rate * (1 - epoch / epochs) + rate * 0.05
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def gradient(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        offsets = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        padded = self.pad(data, offsets)
        starts, stops, halves = self.layout(np.diff(offsets))
        answers = self.answers(padded)
        half_max = self.maxima(answers, starts, stops)
        pooled, chosen, first = self.chunks(half_max, halves)
        odds, at = self.head(pooled, first)
        d = ((1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels) * weights / len(texts)).astype(np.float32)
        grad = {"out": (at["h"] * d[:, None]).sum(0), "out_bias": np.array([d.sum()], np.float32)}
        dz = d[:, None] * self.p["out"] * (at["z"] > 0)
        grad["hidden"], grad["hidden_bias"] = np.einsum("ij,ik->jk", at["x"], dz), dz.sum(0)
        dx = np.einsum("ik,jk->ij", dz, self.p["hidden"])
        k, act, n, text = self.shape.filters, at["act"], at["n"], np.repeat(np.arange(len(texts)), at["n"])
        dact = dx[text, :k] / n[text, None]
        for part, of in ((dx[:, k : 2 * k], at["x"][:, k : 2 * k]), (dx[:, 2 * k :], at["x"][:, 2 * k :])):
            same = act == of[text]
            share = np.add.reduceat(same, first, dtype=np.float32)
            dact = dact + np.where(same, part[text] / share[text], 0)
        dact = dact * (act > 0)
        grad["bias"] = dact.sum(0)
        # the place of each half-chunk's maximum: the first that reaches it
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(answers))))
        filters = np.zeros_like(self.p["filters"])
        for f in range(k):
            hit = np.flatnonzero(answers[:, f] == half_max[owner, f])
            place = np.zeros(len(starts), np.int64)
            place[owner[hit][::-1]] = hit[::-1]
            p = place[chosen[:, f]]
            for j in range(self.shape.width):
                filters[j, :, f] = np.bincount(padded[p + j], dact[:, f], 256)
        grad["filters"] = filters
        return grad


def sample(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int, sample_bytes: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, labels and weights of a bounded sample: of each label the `sample_rows` texts of smallest hash, whatever
    their length; of a longer one the `sample_bytes` bytes at a place that its hash gives. Weights restore the labels'
    shares. A doc_id labelled twice counts as good if any is; its texts are taken once each; null texts are not taken."""
    known = labels.where(F.col("quality").isin(0, 1) & learn).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("hash"))
    every = texts.join(known, "doc_id").groupBy("doc_id", "hash").agg(F.max("quality").alias("quality"))
    chosen = None
    for q in (0, 1):
        part = every.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id", "hash").limit(sample_rows)
        chosen = part if chosen is None else chosen.union(part)
    raw, size = F.encode("text", "UTF-8"), F.octet_length("text")
    place = F.pmod("hash", F.greatest(size - sample_bytes + 1, F.lit(1))).cast("int") + 1
    # 2 * sample_rows rows of three numbers
    same = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(F.broadcast(chosen), ["doc_id", "hash"])
    rows = same.select("doc_id", "hash", "quality", F.substring(raw, place, F.lit(sample_bytes)).alias("part")).dropDuplicates(["doc_id", "hash"]).toPandas()
    rows = rows.sort_values(["doc_id", "hash"])
    y = rows["quality"].to_numpy(np.float32)
    have = {q: max(int((y == q).sum()), 1) for q in (0, 1)}
    weight = np.where(y == 1, shares.get(1, 0) / have[1], shares.get(0, 0) / have[0]).astype(np.float32)
    return [bytes(t) for t in rows["part"]], y, weight / max(weight.mean(), 1e-9) if len(weight) else weight


def train(docs: DataFrame, labels: DataFrame, learn: Column, shape: Shape = Shape(), sample_rows: int = 1200, sample_bytes: int = 12_000) -> Network:
    """The network fitted on the sample. With no or one label only, a constant score: its share, or 0.5."""
    net = Network(shape)
    texts, y, weight = sample(docs, labels, learn, sample_rows, sample_bytes)
    if len(set(y.tolist())) < 2:
        net.prior = float(y.mean()) if len(y) else 0.5
        return net
    return net.fit(texts, y, weight)


def score(docs: DataFrame, net: Network, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with `score`, the probability of label 1. Null texts are scored as empty ones."""
    rest = [f for f in docs.schema if f.name != "score" and (keep_text or f.name != text)]
    model = docs.sparkSession.sparkContext.broadcast(net)
    read = [f.name for f in rest] + ([] if keep_text else [text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.value.tables()
        for batch in batches:
            data, offsets = joined(batch.column(text))
            parts = [model.value.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tables) for a, b in slices(offsets, SCORED_BYTES)]
            out = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(out, pa.float64())], names=[*(f.name for f in rest), "score"])

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return docs.select(*(f"`{c}`" for c in read)).mapInArrow(run, f"{ddl}score double")
