"""N-gram Jaccard join by MinHash banding.

A text's n-grams are its runs of five words (white space apart, A-Z lower-cased; a text of fewer words is one n-gram; a
text without words has none and no link). Texts of one n-gram set form a class; only its representative is joined.
Band and row counts follow from the recall wanted at the threshold. Representatives meet on band hashes: each bucket
ties its members to its least one, and what is tied together becomes a candidate group. Inside a group every pair is
verified on the full n-gram sets.

Scale: band hashes are shuffled as ids; n-gram sets travel once, to their group. A group of more than `block` members is
cut into blocks and each task compares one pair of blocks, so neither a bucket nor a group has to fit in a task, and
pairs are counted there, never emitted: a task passes on each member's links and a spanning forest of the verified
pairs. Copies, however many, are one representative: the least id's text, or a row without an id if no other is there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flightloom.llm.components import components
from flightloom.llm.shared import stored
from flightloom.llm.text import Words, joined, mix, shingles, slices


def bands_for(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows): the most rows for which at most `most` hashes find a pair at the threshold with this recall."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def signatures(docs: DataFrame, bands: int, rows: int, width: int = 5) -> DataFrame:
    """(id, version, row, grams, key, bands) of (id, version, row, text): the number of n-grams, a 128-bit hash of their
    set, and the band hashes."""
    salts = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = joined(batch.column("text"))
            own, n = [batch.column(c) for c in ("id", "version", "row")], batch.num_rows
            count, low, high = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            hashes = np.zeros((n, bands), np.uint64)
            for a, b in slices(offsets):
                grams, owner = gram_sets(Words(data, offsets, a, b), width)
                if not len(grams):
                    continue
                at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                rows_of = a + owner[at]
                count[rows_of] = np.diff(np.append(at, len(grams)))
                low[rows_of], high[rows_of] = np.add.reduceat(grams, at), np.add.reduceat(mix(grams + np.uint64(1)), at)
                for band in range(bands):
                    total = np.full(len(at), band, np.uint64)
                    for r in range(rows):
                        # one multiplication and one rotation of well-mixed hashes make another order
                        x = (grams ^ salts[band * rows + r]) * np.uint64(0xD6E8FEB86659FD93)
                        total = mix(total * np.uint64(0x9FB21C651E98DF25) + np.minimum.reduceat(x, at))
                    hashes[rows_of, band] = total
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(hashes.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*own, pa.array(count), pa.array([bytes(k) for k in np.stack([low, high], 1)], pa.binary()), lists], names=["id", "version", "row", "grams", "key", "bands"])

    return docs.select("id", "version", "row", "text").mapInArrow(run, "id long, version long, row long, grams long, key binary, bands array<long>")


def gram_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct n-grams in order, and their text."""
    grams, first = shingles(words, width)
    owner = np.repeat(np.arange(words.texts), np.diff(first))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], owner[new]


def set_key(grams: np.ndarray) -> bytes:
    """128 bits of a set of n-grams."""
    return np.array([grams.sum(dtype=np.uint64), mix(grams + np.uint64(1)).sum(dtype=np.uint64)], np.uint64).tobytes()


def _verify(sets_a: list[np.ndarray], sets_b: list[np.ndarray], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in a, in b) of Jaccard similarity of at least the threshold; of a block with itself each once."""
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    grams, places = np.unique(np.concatenate(sets_a), return_inverse=True)
    member = np.repeat(np.arange(len(sets_a)), size_a)
    order = np.argsort(places, kind="stable")
    member, begin = member[order], np.searchsorted(places[order], np.arange(len(grams) + 1))
    out_a, out_b = [], []
    for j, own in enumerate(sets_b):
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        at = at[grams[at] == own]
        n = begin[at + 1] - begin[at]
        stop = np.cumsum(n)
        posted = member[np.repeat(begin[at] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        common = np.bincount(posted, minlength=len(sets_a))
        hit = np.flatnonzero(common >= threshold * (size_a + size_b[j] - common) - 1e-9)
        if same:
            hit = hit[hit < j]
        out_a.append(hit)
        out_b.append(np.full(len(hit), j))
    return np.concatenate(out_a), np.concatenate(out_b)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Pairs that connect all that the pairs connect."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return kept


def verified(groups: DataFrame, docs: DataFrame, threshold: float, width: int, block: int) -> DataFrame:
    """(u, links, v): for each member of a group its verified links, per pair of blocks, and in rows without links the
    forest's edges (u, v). `groups` is (id, component, key, rep_id, rep_version), `docs` (id, version, text); a member's
    text is that of its rep_id and rep_version."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            # of equal rows a task passes on one
            new = [i for i, x in enumerate(batch.column("id").to_pylist()) if x not in seen and not seen.add(x)]
            batch = batch.take(pa.array(new, pa.int64()))
            data, offsets = joined(batch.column("text"))
            wanted, held, mine = batch.column("key").to_pylist(), [], []
            for a, b in slices(offsets):
                grams, owner = gram_sets(Words(data, offsets, a, b), width)
                cut = np.searchsorted(owner, np.arange(b - a + 1))
                for i in range(b - a):
                    own = grams[cut[i] : cut[i + 1]]
                    held.append(own.tobytes())
                    mine.append(set_key(own) == wanted[a + i])
            out = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("component"), batch.column("blocks"), pa.array(held, pa.binary())], names=["id", "component", "blocks", "grams"])
            yield out.filter(pa.array(mine, pa.bool_()))

    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    same = F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("version") == F.col("rep_version"))
    texts = docs.select("id", "version", "text").join(groups.join(sizes, "component").withColumnRenamed("id", "member"), same)
    sets = texts.select(F.col("member").alias("id"), "component", "blocks", "key", "text").mapInArrow(sets_of, "id long, component long, blocks int, grams binary")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("left"), F.greatest(o, F.col("own")).alias("right")))
    dealt = sets.withColumn("own", mine).withColumn("pair", F.explode(others)).select("component", "pair.left", "pair.right", "own", "id", "grams")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("id").sort_values("id")
        left, right = int(rows["left"].iloc[0]), int(rows["right"].iloc[0])
        a, b = rows[rows["own"] == left], rows[rows["own"] == right]
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "links": [], "v": []})
        unpack = lambda x: [np.frombuffer(g, np.uint64) for g in x["grams"]]
        ids_a, ids_b = a["id"].to_numpy(), b["id"].to_numpy()
        at, bt = _verify(unpack(a), unpack(b), threshold, left == right)
        links = pd.concat([pd.Series(ids_a[at]), pd.Series(ids_b[bt])]).value_counts()
        kept = _forest(at, bt if left == right else bt + len(a), len(a) + len(b))
        return pd.concat([
            pd.DataFrame({"u": links.index.to_numpy(), "links": links.to_numpy(), "v": pd.array([None] * len(links), "Int64")}),
            pd.DataFrame({"u": ids_a[at[kept]], "links": pd.array([None] * len(kept), "Int64"), "v": ids_b[bt[kept]]}),
        ])

    return dealt.groupBy("component", "left", "right").applyInPandas(compare, "u long, links long, v long")


def join(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9995, most: int = 128, block: int = 192) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links, n_copies, text_hash, class_hash, copy_hash) for the documents of (doc_id, text).

    copy_of is the least doc_id with the same n-gram set; class_id the least one that a chain of links leads to (both null
    if no row of them has an id; the hashes are those of their texts); n_links counts the other representatives (texts of
    other n-gram sets) of similarity of at least `threshold`; n_copies the documents with the same set. Each text of an
    id is a document, each row without an id too; rows equal in id and text are one. Runs its jobs at once.
    """
    return placed(docs, threshold, width, recall, most, block).drop("first", "rows", "grams")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def placed(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9995, most: int = 128, block: int = 192) -> DataFrame:
    """The rows of join with `grams`, the rows of docs that they stand for, and whether each is the first of its class."""
    bands, rows = bands_for(threshold, recall, most)
    no_id = F.col("doc_id").isNull()
    # rows without an id get a number, kept in the written signatures
    row = F.when(no_id, F.monotonically_increasing_id()).otherwise(0).alias("row")
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), text_hash().alias("version"), row, F.coalesce("text", F.lit("")).alias("text"))
    signed = stored(signatures(keyed, bands, rows, width).groupBy("id", "version", "row").agg(F.min(F.struct("key", "grams", "bands")).alias("s"), F.count("*").alias("rows")).select("id", "version", "row", "rows", "s.*"), "near-signatures")
    worded = signed.where("grams > 0")
    # ids before rows without one
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", "version", "row")
    classes = stored(worded.groupBy("key").agg(F.min(own).alias("rep"), F.count("*").alias("n_copies")).withColumn("node", F.monotonically_increasing_id()), "near-classes")
    chosen = classes.select("node", F.col("rep.id").alias("rep_id"), F.col("rep.version").alias("rep_version"), F.col("rep.row").alias("rep_row"))
    is_rep = F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("version") == F.col("rep_version")) & (F.col("row") == F.col("rep_row"))
    reps = worded.join(chosen, is_rep)
    met = reps.select(F.col("node").alias("id"), F.posexplode("bands").alias("band", "hash"))
    least = met.groupBy("band", "hash").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "hash", "least")
    ties = met.join(least, ["band", "hash"]).where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct()
    named = classes.select(F.col("node").alias("id"), "key", F.col("rep.id").alias("rep_id"), F.col("rep.version").alias("rep_version"))
    found = stored(verified(components(ties).join(named, "id"), keyed, threshold, width, block), "near-verified")
    linked = components(found.where("v is not null").select("u", "v"))
    links = found.where("links is not null").groupBy(F.col("u").alias("r")).agg(F.sum("links").alias("n_links"))
    heads = linked.join(classes.select(F.col("node").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("head"))
    headed = linked.join(heads, "component").select("id", "head")
    per_rep = classes.join(links, F.col("node") == F.col("r"), "left").join(headed, F.col("node") == F.col("id"), "left").select(
        "key", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("head", "rep").alias("head")
    )
    every = signed.select("id", "version", "row", "rows", "key", "grams").join(per_rep, "key", "left")
    where_worded = lambda c, other: F.when(F.col("grams") > 0, F.col(c)).otherwise(other)
    return every.select(
        F.col("id").alias("doc_id"),
        where_worded("head.id", F.col("id")).alias("class_id"),
        where_worded("rep.id", F.col("id")).alias("copy_of"),
        where_worded("n_links", F.lit(0)).alias("n_links"),
        where_worded("n_copies", F.lit(1)).alias("n_copies"),
        F.col("version").alias("text_hash"),
        where_worded("head.version", F.col("version")).alias("class_hash"),
        where_worded("rep.version", F.col("version")).alias("copy_hash"),
        ((F.col("grams") == 0) | (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("version") == F.col("head.version")) & (F.col("row") == F.col("head.row")))).alias("first"),
        "rows", "grams",
    )
