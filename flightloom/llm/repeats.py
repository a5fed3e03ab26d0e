"""Repeated passages from a sparse suffix array.

Suffixes of words are kept at content-selected places only: a place is kept if the hash of the `k` words from there on
is the least of `window` such hashes in a row (minimisers), so any passage of k + window - 1 words or more has a kept
suffix at the same place of each of its copies. Kept suffixes whose k words occur once cannot repeat and go. The rest
are sorted by the words that follow, then by the words before, and neighbours are compared: their match is extended
right and left over the words that travel with them (`reach` and `window` words). A match of `least` words or more is a
repeated passage. A run of suffixes that all share a passage has a first copy, the one of least (doc_id, version, place); the
later of two matching neighbours is a later copy too. What is cut thus stands in an earlier place, and the first stays.

Scale: occurrence counts of the k words are packed sums by shard, the repeated hashes stay as sorted array files that
tasks map; the suffix array is a range-partitioned sort over suffix, document and place, so a passage that a third of
all texts share is split; neighbours in different partitions are joined by the partitions' first and last rows alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from flightloom.llm import shared
from flightloom.llm.text import Words, joined, mix, slices

LEAST, K, WINDOW, REACH = 50, 10, 40, 64
NULL_ID = -(1 << 63)


def versioned(docs: DataFrame) -> DataFrame:
    """docs with `__version`, which tells apart the texts of one doc_id: a hash of the text and, of rows without an id,
    of their number among those of equal text (one task numbers them). Rows equal in id and text are one document."""
    text = F.coalesce("text", F.lit(""))
    numbered = F.col("doc_id").isNull() & (text != "")
    nth = F.row_number().over(Window.partitionBy(F.xxhash64(text)).orderBy(F.lit(0)))
    return docs.where(~numbered).withColumn("__version", F.xxhash64(text)).unionByName(docs.where(numbered).withColumn("__version", F.xxhash64(text, nth)))


def minimisers(words: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept places (word numbers) and the hashes of their k words. Texts of fewer than k words have none."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words.hash[j : n - k + 1 + j]
    h = mix(h)
    stop = np.repeat(words.first[1:], words.counts)[: len(h)]
    valid = np.arange(len(h)) + k <= stop
    h = np.where(valid, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    # the least of each window by doubling, ties to the right, within a text
    span, low = 1, h.copy()
    size = min(window, len(h))
    while span * 2 <= size:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if size > span:
        low = np.minimum(low[: len(h) - size + 1], low[size - span : size - span + len(h) - size + 1])
    keep = np.zeros(len(h), bool)
    # windows that lie within one text; a text with fewer places than a window has one window of them all
    text = words.text[: len(h)]
    whole = np.flatnonzero((text[: len(low)] == text[size - 1 : size - 1 + len(low)]) & valid[size - 1 : size - 1 + len(low)]) if size == window else np.zeros(0, np.int64)
    if len(whole):
        # a place is kept if some window that covers it has it as its least
        reachable = np.zeros(len(h), np.uint64)
        best = np.zeros(len(h), np.uint64)  # the greatest of the window minima that cover a place
        minima = np.zeros(len(low), np.uint64)
        minima[whole] = low[whole]
        pad = np.concatenate([np.zeros(window - 1, np.uint64), minima, np.zeros(max(0, len(h) - len(low)), np.uint64)])
        top, span = pad, 1
        while span * 2 <= window:
            top = np.maximum(top[:-span], top[span:])
            span *= 2
        if window > span:
            top = np.maximum(top[: len(pad) - window + 1], top[window - span : window - span + len(pad) - window + 1])
        best[: len(top)] = top[: len(h)]
        keep |= valid & (h == best) & (best > reachable)
    places = np.maximum(words.counts - k + 1, 0)
    for t in np.flatnonzero((places > 0) & (places < window)):
        a = words.first[t]
        part = h[a : a + places[t]]
        keep[a + np.flatnonzero(part == part.min())] = True
    at = np.flatnonzero(keep)
    return at, h[at]


SUFFIX = "hash long, right binary, left binary, doc long, version long, place long"


def suffixes(docs: DataFrame, k: int = K, window: int = WINDOW, reach: int = REACH) -> DataFrame:
    """(hash, right, left, doc, version, place) of the kept suffixes whose k words occur more than once. `docs` is (id, version, text).

    right and left are the words from the place on and those before it, nearest first, four bytes of hash each.
    """
    shards, folder = shared.shards_for(docs), shared.new_folder(docs.sparkSession, "repeats")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = shared.Gather(shards)
        for batch in batches:
            data, offsets = joined(batch.column("text"))
            for a, b in slices(offsets):
                yield from gather.add(minimisers(Words(data, offsets, a, b), k, window)[1])
        yield from gather.flush()

    def keep_repeated(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, n = shared.unpack(table)
        shared.save_array(folder, f"repeated-{key[0].as_py()}", keys[n > 1])
        return pa.table({"n": [int((n > 1).sum())]})

    shared.stored(docs.select("text").mapInArrow(count, shared.PACKED_DDL).groupBy("shard").applyInArrow(keep_repeated, "n long"), "repeats-shards")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.forget_arrays(folder)
        for batch in batches:
            data, offsets = joined(batch.column("text"))
            ids, versions = batch.column("id").to_numpy(), batch.column("version").to_numpy()
            for a, b in slices(offsets):
                words = Words(data, offsets, a, b)
                at, h = minimisers(words, k, window)
                again, shard = np.zeros(len(h), bool), shared.shard_of(h, shards)
                for s in np.unique(shard):
                    mine = shard == s
                    try:
                        again[mine] = shared.lookup(shared.load_array(folder, f"repeated-{s}", np.uint64), h[mine])[1]
                    except FileNotFoundError:
                        continue
                at, h = at[again], h[again]
                if not len(at):
                    continue
                text = words.text[at]
                short = (words.hash >> np.uint64(32)).astype(">u4")
                stop, begin = np.minimum(words.first[text + 1], at + reach), np.maximum(words.first[text], at - window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)), pa.array([short[i:j].tobytes() for i, j in zip(at, stop)], pa.binary()),
                        pa.array([short[i:j][::-1].tobytes() for i, j in zip(begin, at)], pa.binary()),
                        pa.array(ids[a + text]), pa.array(versions[a + text]), pa.array(at - words.first[text]),
                    ],
                    names=[x.split()[0] for x in SUFFIX.split(", ")],
                )

    return docs.select("id", "version", "text").mapInArrow(emit, SUFFIX)


def _common(a: bytes, b: bytes) -> int:
    """Words that two contexts have in common from their begin on."""
    n = min(len(a), len(b)) // 4
    if a[: 4 * n] == b[: 4 * n]:
        return n
    x, y = np.frombuffer(a, ">u4", n), np.frombuffer(b, ">u4", n)
    return int((x != y).argmax())


FOUND = "run long, doc long, version long, place long, start long, stop long, cut_from long, cut_to long, r long, l long, part int, edge binary"
_N = 10


class _Suffix:
    """A row of the sorted order: start and stop of its match with either neighbour, cut_from and cut_to of that with an
    earlier copy, its run, and the words (r right, l left) it shares with the suffix before it in the run."""

    __slots__ = ("hash", "right", "left", "doc", "version", "place", "start", "stop", "cut_from", "cut_to", "run", "r", "l")

    def __init__(self, row: tuple):
        self.hash, self.right, self.left, self.doc, self.version, self.place = row
        self.start = self.stop = self.cut_from = self.cut_to = self.place
        self.run, self.r, self.l = None, None, None

    def meet(self, after: _Suffix, least: int) -> tuple[int, int] | None:
        """The words shared with the next suffix, noted on both, if there are enough."""
        if self.hash != after.hash:
            return None
        r, l = _common(self.right, after.right), _common(self.left, after.left)
        if r + l < least:
            return None
        for s in (self, after):
            s.start, s.stop = min(s.start, s.place - l), max(s.stop, s.place + r)
        late = after if (self.doc, self.version, self.place) < (after.doc, after.version, after.place) else self
        late.cut_from, late.cut_to = min(late.cut_from, late.place - l), max(late.cut_to, late.place + r)
        return r, l

    def found(self) -> tuple:
        return self.run, self.doc, self.version, self.place, self.start, self.stop, self.cut_from, self.cut_to, self.r, self.l


def _rows(rows: list[tuple], part: int, edge: bytes | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*(pa.array(list(c), pa.int64()) for c in zip(*rows)), pa.array([part] * len(rows), pa.int32()), pa.array([edge] * len(rows), pa.binary())],
        names=[x.split()[0] for x in FOUND.split(", ")],
    )


def neighbours(suffix_table: DataFrame, least: int = LEAST, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(run, doc, version, place, start, stop, cut_from, cut_to, r, l) of the suffixes that match a neighbour, see _Suffix, and
    (run, into) of the runs that go on from another partition, a row for each partition at most.

    A run goes on while the least words that any two neighbours in it share, right and left, are `least` together: so
    all its members share that passage. The sort is written once; a partition hands over its first and last row, and
    the driver sees two rows a partition.
    """
    import pickle

    tasks = parts or int(suffix_table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = ["hash", "right", "left", "doc", "version", "place"]
    dealt = suffix_table.repartitionByRange(tasks, *in_order).sortWithinPartitions(*in_order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        first = before = first_least = None
        low = (0, 0)  # least right and left words shared in the run so far
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if before and row[3:] == (before.doc, before.version, before.place):  # a repeated row of one document
                    continue
                now = _Suffix(row)
                shared_words = before.meet(now, least) if before else None
                both = shared_words and ((min(low[0], shared_words[0]), min(low[1], shared_words[1])) if before.r is not None else shared_words)
                if both and sum(both) >= least:
                    low, (now.r, now.l) = both, shared_words
                else:
                    if before and first_least is None:
                        first_least = low if number == 0 and before.r is not None else (1 << 40, 1 << 40)
                    number += 1
                    low = (1 << 40, 1 << 40)
                now.run = part * (1 << 40) + number
                if before and before is not first and before.stop > before.start:  # the first row waits for the end
                    out.append(before.found())
                first, before = first or now, now
            if out:
                yield _rows(out, part)
        if before:
            edge = pickle.dumps((first, first_least or low, before if before is not first else None, low))
            yield _rows([(None,) * _N], part, edge)

    found = shared.stored(dealt.mapInArrow(walk, FOUND), "repeats-found")
    rows, same, last, last_low = [], {}, None, None
    for r in found.where("edge is not null").select("part", "edge").orderBy("part").collect():
        first, first_low, final, final_low = pickle.loads(r["edge"])
        met = last.meet(first, least) if last else None
        joins = False
        if met:
            low = tuple(min(x) for x in zip(met, last_low, first_low))
            if sum(low) >= least:
                joins, same[first.run], (first.r, first.l) = True, same.get(last.run, last.run), met
        rows += [first] if final is None else [first, final]
        one_run = final is None or final.run == first.run
        last, last_low = final or first, (low if joins and one_run else final_low)
    spark = suffix_table.sparkSession
    columns = ", ".join(FOUND.split(", ")[:_N])
    kept = [s.found() for s in rows if s.stop > s.start]
    whole = found.where("edge is null").drop("part", "edge").unionByName(spark.createDataFrame(kept, columns))
    return whole, spark.createDataFrame(list(same.items()), "run long, into long")


SPANS = "doc long, version long, first_doc long, first_version long, start long, stop long, repeated boolean"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of a document in a run, those that overlap merged: all of them, and the later copies among them."""
    for batch in batches:
        at, column = batch.column("at"), lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        of = pc.list_parent_indices(at).to_numpy()
        place, start, stop, cut_from, cut_to = (x.to_numpy() for x in at.flatten().flatten())
        doc, version, first_doc, first_version = (column(c) for c in ("doc", "version", "first_doc", "first_version"))
        low_r, low_l = (pc.fill_null(batch.column(c), 0).to_numpy() for c in ("low_r", "low_l"))
        later = (((doc != first_doc) | (version != first_version))[of] | (place > column("first_place")[of])) & (low_r + low_l > 0)[of]
        cut = cut_to > cut_from
        row = np.concatenate([of, of[cut], of[later]])
        begin = np.concatenate([start, cut_from[cut], (place - low_l[of])[later]])
        end = np.concatenate([stop, cut_to[cut], (place + low_r[of])[later]])
        group = 2 * row + np.repeat([0, 1, 1], [len(of), cut.sum(), later.sum()])
        order = np.lexsort((begin, group))
        group, begin, end = group[order], begin[order], end[order]
        if not len(group):
            continue
        # one line of numbers on which groups lie apart, so that one running maximum serves them all
        far = group * (int(end.max()) + 1)
        reached = np.maximum.accumulate(far + end)
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (reached[:-1] < far[1:] + begin[1:])])
        first = np.flatnonzero(new)
        row, top = group[first] // 2, np.maximum.reduceat(end, first)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[row]), pa.array(version[row]), pa.array(first_doc[row]), pa.array(first_version[row]), pa.array(begin[first]), pa.array(top), pa.array(group[first] % 2 == 1)],
            names=[x.split()[0] for x in SPANS.split(", ")],
        )


def passages(docs: DataFrame, least: int = LEAST, k: int = K, window: int = WINDOW, reach: int = REACH) -> DataFrame:
    """(doc_id, start, stop, n_words, first_doc, repeated, version, first_version): the repeated passages of each document
    of (doc_id, text); version tells apart the texts of one doc_id (see versioned).

    start and stop count words from 0. Rows with repeated = false are all passages that occur elsewhere too, first
    copies among them; those with true are the parts that an earlier place (doc_id, version, then word; null ids first)
    holds as well. Overlapping passages of a kind are merged; first_doc is the least document of their runs. Rows equal in
    doc_id and text count as one document, each row without an id as one of its own. Runs its jobs at once.
    """
    if k + window - 1 > least or reach < window:
        raise ValueError("a passage of `least` words must hold a kept suffix, and matches must reach the next one")
    keyed = versioned(docs.select("doc_id", "text")).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("__version").alias("version"), F.coalesce("text", F.lit("")).alias("text"))
    found, into = neighbours(shared.stored(suffixes(keyed, k, window, reach), "repeats-suffixes"), least)
    # words that go round in a circle have a kept suffix in every round: a document meets each of its runs with one row
    places = F.collect_list(F.struct("place", "start", "stop", "cut_from", "cut_to")).alias("at")
    by_doc = shared.stored(found.groupBy("run", "doc", "version").agg(F.min("place").alias("place"), F.min("r").alias("r"), F.min("l").alias("l"), places), "repeats-documents")
    parts = by_doc.groupBy("run").agg(F.min(F.struct("doc", "version", "place")).alias("first"), F.min("r").alias("low_r"), F.min("l").alias("low_l"), F.count("*").alias("n"))
    # the parts of a run in several partitions, one row each, share what holds for the whole run
    named, whole = parts.join(F.broadcast(into), "run", "left"), Window.partitionBy(F.coalesce("into", "run"))
    runs = shared.stored(named.select("run", *(F.min(c).over(whole).alias(c) for c in ("first", "low_r", "low_l")), "n"), "repeats-firsts")
    # runs of over a thousandth of all these rows, a thousand at most, are broadcast, so no task gets a hot run whole
    total = runs.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot, rest = runs.where(F.col("n") > total / 1000), runs.where(F.col("n") <= total / 1000)
    own = by_doc.select("run", "doc", "version", "at")
    both = own.join(F.broadcast(hot), "run").unionByName(own.join(rest, "run"))
    marked = both.select("doc", "version", F.col("first.doc").alias("first_doc"), F.col("first.version").alias("first_version"), F.col("first.place").alias("first_place"), "low_r", "low_l", "at").mapInArrow(_spans, SPANS)
    order = Window.partitionBy("doc", "version", "repeated").orderBy("start", "stop", "first_doc", "first_version")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("reached") >= F.col("start"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = marked.distinct().withColumn("reached", reached).withColumn("island", island).groupBy("doc", "version", "repeated", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min(F.struct("first_doc", "first_version")).alias("first")
    )
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    words = (F.col("stop") - F.col("start")).alias("n_words")
    return merged.select(real("doc").alias("doc_id"), "start", "stop", words, real("first.first_doc").alias("first_doc"), "repeated", "version", F.col("first.first_version").alias("first_version"))


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without their repeated passages (all copies but the first); n_chars, if it is a column, follows the text.

    A text is cut from the first word of a passage to its last; texts of which nothing but white space is left go.
    Documents without repeated passages stay as they are.
    """
    cuts = found.where("repeated").groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__doc"), F.col("version").alias("__of")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__cuts"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    # only documents with cuts pass through Python
    both = versioned(docs).join(cuts, (key == F.col("__doc")) & (F.col("__version") == F.col("__of")), "left")
    schema, names = docs.schema, docs.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = joined(batch.column("text"))
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("__cuts").to_pylist()):
                if not spans:
                    continue
                words = Words(data, offsets, i, i + 1)
                raw, out, at = words.data.tobytes(), [], 0
                for s in spans:
                    out.append(raw[at : words.start[s["start"]]])
                    at = max(at, int(words.end[min(s["stop"], len(words.end)) - 1]))
                texts[i] = b"".join([*out, raw[at:]]).decode()
            keep = [i for i, (t, c) in enumerate(zip(texts, batch.column("__cuts").to_pylist())) if not c or t.strip()]
            columns = []
            for f in schema:
                if f.name == "text":
                    columns.append(pa.array(texts, pa.string()))
                elif f.name == "n_chars":
                    own, spans = batch.column(f.name), batch.column("__cuts").to_pylist()
                    columns.append(pa.array([len(t) if s else n for t, s, n in zip(texts, spans, own.to_pylist())], own.type))
                else:
                    columns.append(batch.column(f.name))
            yield pa.RecordBatch.from_arrays(columns, names=names).take(pa.array(keep, pa.int64()))

    return both.select(*(F.col(f"`{c}`") for c in docs.columns), "__cuts").mapInArrow(cut, ddl)
