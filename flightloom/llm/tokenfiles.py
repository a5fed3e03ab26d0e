"""Token ids in files of Re-Pair grammars.

Documents' ids, each document's followed by an end id, are written in ascending order of doc_id. A file is a row of
blocks; a block holds whole documents of about `SHARD` ids, or one document that is longer. Ids of a block are cut into
shards of at most SHARD ids, and each shard is a grammar: rounds replace frequent pairs of neighbouring symbols by new
nonterminals until a round is not worth its rules. In a round a pair is replaced where it is more frequent than the pairs
that overlap it, so all replacements of a round are made at once; a pair left with fewer than `least` places gets no
rule. Rules, the number of ids that each expands to, and the ids before every 1,024th symbol are stored, so any
range of ids is decoded from the symbols that cover it.

Block: magic, documents, shards (int64); ids of the documents (int64), whether they have one (uint8), their numbers of
ids (int64); for each shard its first byte, bytes and ids (int64); the shards. Shard: numbers of terminals, rules,
symbols and rounds, bytes of a symbol, ids, and the sum of ids' crc32 (int64); terminals (uint32); left and right sides
of the rules; their expansion lengths (uint32); the first rule of each round (uint32); symbols; ids before every 1,024th symbol
(uint32). Little-endian throughout.

Scale: ids are shuffled once, by ranges of (doc_id, hash of the ids, number of the row), so rows that share an id are
spread. A task writes one file under a name of its own and passes on a row for each block; only files named in the
written table of these rows count, so a task that is lost or runs twice leaves no half file behind that anyone reads.
Reading deals blocks out, whatever file they are in. A task holds a block, or a shard of a long document.

Null and empty texts have the end id alone. Rows without doc_id come first; rows of one doc_id follow by a hash of ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from flightloom.llm import shared
from flightloom.llm.packing import WordCoder, split_marks
from flightloom.llm.text import NOT_WHITE, Words, joined, stretches

SHARD = 1 << 18
MAGIC = b"FLTOKRP1"
_EVERY = 1024
_BUCKETS = 18


def grammar(ids: np.ndarray, least: int = 4, worth: float = 0.01) -> bytes:
    """A shard. Rounds go on while they shorten the symbols by `worth` of their number, after the rules' cost."""
    terminals = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    number = np.zeros(int(terminals[-1]) + 1 if len(terminals) else 1, np.uint32)
    number[terminals] = np.arange(len(terminals))
    symbols, known = number[ids], len(terminals)
    lengths = [np.ones(known, np.int64)]
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    rounds: list[int] = []
    while len(symbols) > 1:
        key = symbols[:-1].astype(np.uint64) * np.uint64(known) + symbols[1:]
        place, pair = _replaced(key, least)
        distinct, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        good = count >= least
        saved = int(count[good].sum()) - 3 * int(good.sum())
        if saved < worth * len(symbols):
            break
        mine = good[which]
        place = place[mine]
        fresh = np.cumsum(good) - 1 + known
        symbols[place] = fresh[which[mine]]
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        symbols = symbols[keep]
        a, b = np.divmod(distinct[good], np.uint64(known))
        rounds.append(known - len(terminals))
        left.append(a.astype(np.int64))
        right.append(b.astype(np.int64))
        size = np.concatenate(lengths)
        lengths = [size, size[left[-1]] + size[right[-1]]]
        known += int(good.sum())
    size = np.concatenate(lengths)
    width = 2 if known <= 1 << 16 else 4
    sides = f"<u{width}"
    before = np.concatenate([[0], np.cumsum(size[symbols])])[:-1:_EVERY] if len(symbols) else np.zeros(0, np.int64)
    none = [np.zeros(0, np.int64)]
    head = struct.pack("<7q", len(terminals), known - len(terminals), len(symbols), len(rounds), width, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
    return b"".join(
        [
            head, terminals.astype("<u4").tobytes(), np.concatenate(none + left).astype(sides).tobytes(), np.concatenate(none + right).astype(sides).tobytes(),
            size[len(terminals) :].astype("<u4").tobytes(), np.array(rounds, "<u4").tobytes(), symbols.astype(sides).tobytes(), before.astype("<u4").tobytes(),
        ]
    )


def _replaced(key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that are more frequent than both pairs they overlap, and the pairs. Counts are of buckets of
    pairs, so now and then a pair seems more frequent than it is; equal neighbours are taken in turns."""
    bits = np.uint64(min(max(len(key).bit_length(), 4), _BUCKETS))
    bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> (np.uint64(64) - bits)).view(np.int64)
    found = np.bincount(bucket, minlength=1 << int(bits)).astype(np.int32)
    count = found[bucket]
    order = ((found.astype(np.int64) << bits.view(np.int64)) | np.arange(len(found)))[bucket]
    take = count >= least
    take[1:] &= order[1:] >= order[:-1]
    take[:-1] &= order[:-1] >= order[1:]
    at = np.flatnonzero(take)
    # places side by side are of equal neighbours only
    close = np.diff(at, prepend=-2) == 1
    if close.any():
        nth = np.arange(len(at))
        at = at[(nth - np.maximum.accumulate(np.where(close, 0, nth))) % 2 == 0]
    return at, key[at]


class Shard:
    """A grammar in memory."""

    def __init__(self, data: bytes):
        t, r, s, rounds, width, self.n, self.crc = struct.unpack_from("<7q", data)
        at = 56

        def array(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.terminals = array(t, "<u4")
        self.left, self.right = array(r, f"<u{width}"), array(r, f"<u{width}")
        self.size = np.concatenate([np.ones(t, np.int64), array(r, "<u4")])
        self.rounds = array(rounds, "<u4")
        self.symbols = array(s, f"<u{width}")
        self.before = array(-(-s // _EVERY), "<u4")

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        t = len(self.terminals)
        out = symbols.astype(np.int64)
        for first in self.rounds[::-1].tolist():
            ruled = out >= t + first
            if not ruled.any():
                continue
            place = np.cumsum(ruled) - ruled + np.arange(len(out))
            wider = np.empty(len(out) + int(ruled.sum()), np.int64)
            rule = out[ruled] - t
            wider[place] = out
            wider[place[ruled]] = self.left[rule]
            wider[place[ruled] + 1] = self.right[rule]
            out = wider
        return self.terminals[out]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop, from the symbols that cover them."""
        stop = self.n if stop is None else min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        if start == 0 and stop == self.n:
            return self.expanded(self.symbols)
        group = int(np.searchsorted(self.before, start, side="right")) - 1
        last = int(np.searchsorted(self.before, stop, side="left"))
        part = self.symbols[group * _EVERY : last * _EVERY]
        before = int(self.before[group]) + np.concatenate([[0], np.cumsum(self.size[part])])
        a, b = int(np.searchsorted(before, start, side="right")) - 1, int(np.searchsorted(before, stop, side="left"))
        return self.expanded(part[a:b])[start - before[a] : stop - before[a]]


def block(docs: list[tuple[int | None, np.ndarray]], most: int = SHARD) -> Iterator[bytes]:
    """The bytes of a block of documents (doc_id, ids), in parts."""
    n = len(docs)
    every = np.concatenate([x for _, x in docs]) if n > 1 else docs[0][1]
    shards = [grammar(every[a : a + most].astype(np.uint32)) for a in range(0, len(every), most)]
    start = 24 + 17 * n + 24 * len(shards)
    directory = []
    for i, s in enumerate(shards):
        directory.append((start, len(s), min(most, len(every) - i * most)))
        start += len(s)
    yield MAGIC + struct.pack("<2q", n, len(shards))
    yield np.array([0 if i is None else i for i, _ in docs], "<i8").tobytes()
    yield np.array([i is not None for i, _ in docs], np.uint8).tobytes()
    yield np.array([len(x) for _, x in docs], "<i8").tobytes()
    yield np.array(directory, "<i8").tobytes()
    yield from shards


class Block:
    """A block of a file: documents' ids and sizes at once, shards when they are asked for."""

    def __init__(self, source: pa.NativeFile, place: int):
        self.source, self.place = source, place
        head = self._bytes(0, 24)
        if head[:8] != MAGIC:
            raise ValueError("no block of token ids begins here")
        n, shards = struct.unpack_from("<2q", head, 8)
        table = self._bytes(24, 17 * n + 24 * shards)
        has_id = np.frombuffer(table, np.uint8, n, 8 * n).tolist()
        self.doc_ids = [i if h else None for i, h in zip(np.frombuffer(table, "<i8", n).tolist(), has_id)]
        self.sizes = np.frombuffer(table, "<i8", n, 9 * n)
        self.shards = np.frombuffer(table, "<i8", 3 * shards, 17 * n).reshape(-1, 3)
        self.first = np.concatenate([[0], np.cumsum(self.shards[:, 2])])

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(self.place + at)
        return self.source.read(n)

    def shard(self, i: int) -> Shard:
        return Shard(self._bytes(int(self.shards[i, 0]), int(self.shards[i, 1])))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the block; shards outside are not read."""
        parts = [np.zeros(0, np.uint32)]
        for i in range(len(self.shards)):
            if start < self.first[i + 1] and stop > self.first[i]:
                parts.append(self.shard(i).ids(max(0, start - int(self.first[i])), stop - int(self.first[i])))
        return np.concatenate(parts)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, ids, their crc32) of each document, decoding one shard at a time."""
        held, i = self.shard(0).ids() if len(self.shards) else np.zeros(0, np.uint32), 0
        for doc_id, size in zip(self.doc_ids, self.sizes.tolist()):
            crc, left = 0, size
            while left:
                if not len(held):
                    i += 1
                    held = self.shard(i).ids()
                part, held = held[:left], held[left:]
                crc, left = zlib.crc32(np.ascontiguousarray(part, "<u4").data, crc), left - len(part)
            yield doc_id, size, crc


_CODERS: dict[str, WordCoder] = {}


def encoded(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text") -> DataFrame:
    """(doc_id, ids, n, row): ids of the whole text and `end_id` as 4-byte integers, or as 2-byte ones if all of the
    tokenizer's fit; n of them, and a number of the row that is fixed once the table is written."""
    from tokenizers import Tokenizer

    narrow = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16
    kind = "<u2" if narrow else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _CODERS:
            _CODERS[tokenizer] = WordCoder(tokenizer)
        coder, end = _CODERS[tokenizer], np.array([end_id], kind).tobytes()
        for batch in batches:
            doc_ids = batch.column(0)
            data, offsets = joined(batch.column(1))
            open_, begun = -1, []  # a long text of which parts are coded

            def rows(a: int, made: list[bytes]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [doc_ids.slice(a, len(made)), pa.array(made, pa.binary()), pa.array([len(x) // (2 if narrow else 4) for x in made], pa.int64())], names=["doc_id", "ids", "n"]
                )

            for a, at in stretches(data, offsets, NOT_WHITE):
                words = Words(data, at, 0, len(at) - 1, hashed=False)
                got, first = coder.encode(split_marks(words.data, words)) if len(words.data) else (np.zeros(0, np.uint32), np.zeros(len(at), np.int64))
                raw, step = got.astype(kind).tobytes(), 2 if narrow else 4
                made = [raw[step * i : step * j] for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
                if open_ >= 0 and a != open_:
                    yield rows(open_, [b"".join(begun) + end])
                    open_, begun = -1, []
                if len(at) == 2:
                    open_, begun = a, [*begun, made[0]]
                else:
                    yield rows(a, [x + end for x in made])
            if open_ >= 0:
                yield rows(open_, [b"".join(begun) + end])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary, n long")
    return out.withColumn("row", F.monotonically_increasing_id())


_BLOCKS = "file string, block int, place long, docs long, ids long, bytes long, first_id long, first_hash long, first_row long"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard: int = SHARD, file_ids: int = 1 << 25) -> DataFrame:
    """Writes files of about `file_ids` ids to the folder; their blocks (file, block, place, docs, ids, bytes, and the
    order of the file's first document) as a written table. Runs its jobs at once."""
    spark = docs.sparkSession
    coded = shared.stored(encoded(docs, tokenizer, end_id), "token-ids")
    total = coded.agg(F.sum("n").alias("n")).first()["n"] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // file_ids))
    narrow = F.octet_length("ids") == 2 * F.col("n")
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    keyed = coded.select("doc_id", F.xxhash64("ids").alias("hash"), "row", "ids", narrow.alias("narrow"))
    ranged = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = shared._open(folder)
        name, out, rows, at = f"ids-{uuid.uuid4().hex}.rp", None, [], 0
        held: list[tuple[int | None, np.ndarray]] = []
        size, first = 0, None

        def put() -> None:
            nonlocal out, at, size
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}")
            begun = at
            for part in block(held, shard):
                out.write(part)
                at += len(part)
            rows.append((name, len(rows), begun, len(held), size, at - begun, *first))
            held.clear()
            size = 0

        for batch in batches:
            column = batch.column(3)
            for i, (doc_id, hashed, row, narrow_) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist())):
                ids = np.frombuffer(column[i].as_buffer(), "<u2" if narrow_ else "<u4")
                if held and size + len(ids) > shard:
                    put()
                first = first or (doc_id, hashed, row)
                # a copy, so that a batch is let go before its last document is written
                held.append((doc_id, ids.copy()))
                size += len(ids)
        if held:
            put()
        if out is not None:
            out.close()
        types = [pa.string(), pa.int32(), *[pa.int64()] * 7]
        columns = list(zip(*rows)) if rows else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

    return shared.stored(ranged.mapInArrow(run, _BLOCKS), "token-blocks")


def placed(blocks: DataFrame) -> DataFrame:
    """blocks with `start`: the ids before each. One window runs over the files, which are few, one over a file."""
    files = blocks.groupBy("file").agg(F.sum("ids").alias("n"), F.min(F.struct(F.col("first_id").isNotNull(), "first_id", "first_hash", "first_row")).alias("first"))
    earlier = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = F.sum("ids").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn("own", F.coalesce(own, F.lit(0))).join(base, "file").withColumn("start", F.col("own") + F.col("base")).drop("own", "base")


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(blocks: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a table of blocks (see write)."""
    spark = blocks.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = shared._open(folder)
        for batch in batches:
            for file, place, start in zip(*(batch.column(c).to_pylist() for c in range(3))):
                with fs.open_input_file(f"{path}/{file}") as source:
                    made = list(Block(source, place).documents())
                ids, sizes, crc = zip(*made)
                begin = start + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                for a in range(0, len(made), 10_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c[a : a + 10_000]), pa.int64()) for c in (ids, begin, sizes, crc)], names=[c.split()[0] for c in _READ.split(", ")]
                    )

    # blocks are dealt out by their number: a file's blocks go to different tasks
    dealt = placed(blocks).select("file", "place", "start").repartition(tasks, "file", "place")
    return dealt.mapInArrow(run, _READ)


def read_ids(folder: str, file: str, place: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of the block at a place of a file, without reading its other shards."""
    fs, path = shared._open(folder)
    with fs.open_input_file(f"{path}/{file}") as source:
        return Block(source, place).ids(start, stop)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the documents to files in the shared folder and reads them back: (doc_id, start, n_tokens, ids_crc32)."""
    folder = shared.new_folder(docs.sparkSession, "token-files")
    return read(write(docs, folder, tokenizer, end_id), folder)
