"""Packing token sequences by cutting-stock column generation.

Documents are tokenised and cut at every `capacity` tokens; what remains of each is rounded up to a multiple of `grain`
tokens and only the histogram of these lengths is packed. The linear program over patterns (how many pieces of each
length fill one sequence) starts from one pattern for each length; its dual prices make a knapsack problem whose dynamic
program finds the pattern of most value, which enters the basis until none is worth more than a sequence. Patterns are
used a whole number of times; the pieces left over fill sequences by falling length. Pieces are then ranked within their
length and take the places of the patterns in that order.

Scale: one pass tokenises; only (doc_id, start, length, checksum) of pieces go on. The program sees a histogram of
capacity/grain numbers, whatever the corpus. Ranks come from counts over (length, slice) and ranks inside a slice, so a
length that a third of all pieces have is split; a sequence holds `capacity` pieces at most.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flightloom.llm import shared
from flightloom.llm.text import FOLD, Words, joined, slices

CAPACITY = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Ends of words that are coded by themselves after a letter or digit of ASCII: neither apostrophes nor what special
#: tokens end with.
_MARKS = np.zeros(256, bool)
_MARKS[list(b'.,;:!?#*$%&()[]{}"/\\=+-_~^@')] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


#: Where the tokenizer cuts words of these characters, which its first steps leave as they are.
_CUTS = "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+"
_SIMPLE = "[!-@\\[-~\u00df-\u00f6\u00f8-\u00ff]+"
#: Its characters for the bytes of \u00df to \u00ff: C3 and 9F to BF.
_BYTE_TEXT = {c: "\u00c3" + chr({0x9F: 0x141, 0xA0: 0x142, 0xAD: 0x143}.get(c - 0x40, c - 0x40)) for c in range(0xDF, 0x100)}


class WordCoder:
    """Token ids of words; every distinct word is coded once and the most recent ones are remembered.

    The tokenizer splits at white space and lower-cases, so a text's ids are those of its words in order. Only its
    special contents are matched in the text as it is written: words that hold one in any case are told apart by their
    case and coded as they stand.
    """

    def __init__(self, path: str, remembered: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.simple, self.cuts, self.pieces = re.compile(_SIMPLE).fullmatch, re.compile(_CUTS).findall, {}
        self._forget()

    def _forget(self) -> None:
        """No words are known; those known have sorted keys and the ids self.ids[self.first:self.first+self.n]."""
        self.keys, self.first, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(first, ids): the ids of word i are ids[first[i]:first[i+1]]."""
        counts, parts = np.zeros(len(words), np.int64), []
        for i, w in enumerate(words):
            got = self._cut(w) if self.simple(w) and "<|" not in w else self.tokenizer.encode(w, add_special_tokens=False).ids
            counts[i] = len(got)
            parts += got
        return np.concatenate([[0], np.cumsum(counts)]), np.array(parts, np.uint32)

    def _cut(self, word: str) -> list[int]:
        """Ids of a word whose pieces need the tokenizer's model alone."""
        out: list[int] = []
        for piece in self.cuts(word):
            got = self.pieces.get(piece)
            if got is None:
                got = [t.id for t in self.tokenizer.model.tokenize(piece if piece.isascii() else piece.translate(_BYTE_TEXT))]
                if len(piece) < 4 and len(self.pieces) < 50_000:  # digits, marks, endings
                    self.pieces[piece] = got
            out += got
        return out

    def _special(self, words: Words, raw: bytes) -> np.ndarray:
        """Words that hold a special content in any case."""
        found = set()
        for content in self.special:
            pattern = content.lower().encode()
            at = raw.find(pattern)
            while at >= 0:
                found.update(range(int(np.searchsorted(words.end, at, side="right")), int(np.searchsorted(words.start, at + len(pattern)))))
                at = raw.find(pattern, at + 1)
        return np.array(sorted(found), np.int64)

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and where each text's begin."""
        raw = FOLD[words.data].tobytes()
        special = self._special(words, raw)
        hashes = words.hash
        if len(special):
            hashes = hashes.copy()
            for i in special.tolist():
                hashes[i] = _case_hash(words.data[words.start[i] : words.end[i]].tobytes())
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        place, there = shared.lookup(self.keys, distinct)
        new = np.flatnonzero(~there)
        spelled = [raw[a:b].decode("utf-8") for a, b in zip(words.start[at[new]].tolist(), words.end[at[new]].tolist())]
        for i in np.flatnonzero(np.isin(at[new], special)).tolist():
            spelled[i] = words.data[words.start[at[new[i]]] : words.end[at[new[i]]]].tobytes().decode("utf-8")
        new_first, new_ids = self.encode_words(spelled)
        n, source = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        n[there], source[there] = self.n[place[there]], self.first[place[there]]
        n[new], source[new] = np.diff(new_first), len(self.ids) + new_first[:-1]
        table = np.concatenate([self.ids, new_ids])
        ids = table[spread(source[which], n[which])]
        first = np.concatenate([[0], np.cumsum(n[which])])[words.first]
        if len(self.keys) + len(new) > self.remembered:
            self._forget()  # and begin again with what comes next
        elif len(new):
            where = np.searchsorted(self.keys, distinct[new])
            self.keys, self.first, self.n = np.insert(self.keys, where, distinct[new]), np.insert(self.first, where, source[new]), np.insert(self.n, where, n[new])
            self.ids = table
        return ids, first


def _case_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... (n[i] of them), for all i."""
    stop = np.cumsum(n)
    return np.repeat(first - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)


def split_marks(data: np.ndarray, words: Words) -> Words:
    """Words (hashed or not) whose end is a run of marks after a letter or digit become two, hashed; fewer distinct ones
    are left to code."""
    if not len(words.start):
        return words
    mark = _MARKS[data]
    # the last byte before each place that is no mark
    last = np.maximum.accumulate(np.where(mark, -1, np.arange(len(data))))
    stem = last[words.end - 1] + 1
    cut = (stem < words.end) & (stem > words.start) & _PLAIN[data[np.maximum(stem - 1, 0)]]
    if not cut.any():
        return words.recut(words.start, words.end)
    start = np.sort(np.concatenate([words.start, stem[cut]]))
    end = np.sort(np.concatenate([words.end, stem[cut]]))
    return words.recut(start, end)


_CODERS: dict[str, WordCoder] = {}


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and `end_id`, cut at every capacity tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _CODERS.setdefault(tokenizer, None) or WordCoder(tokenizer)
        _CODERS[tokenizer] = coder
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            data, offsets = joined(batch.column(text))
            rows: list[tuple] = []
            for a, b in slices(offsets):
                words = Words(data, offsets, a, b, hashed=False)
                got, first = coder.encode(split_marks(words.data, words))
                for i in range(b - a):
                    own = np.append(got[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(own), capacity):
                        part = own[s : s + capacity]
                        rows.append((ids[a + i], s, len(part), zlib.crc32(part.tobytes()), len(own)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, PIECES)


def knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern (counts by size) of most value within capacity; a size may be used again and again."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    positive = np.flatnonzero(value > 1e-12)
    size, worth = sizes[positive], value[positive]
    for c in range(1, capacity + 1):
        fits = size <= c
        if not fits.any():
            continue
        total = np.where(fits, best[np.maximum(c - size, 0)] + worth, -1.0)
        j = int(total.argmax())
        if total[j] > best[c - 1] + 1e-15:
            best[c], took[c] = total[j], positive[j]
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0 or best[c] == best[c - 1]:
            c -= 1
            continue
        pattern[took[c]] += 1
        c -= int(sizes[took[c]])
    return float(best[capacity]), pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots; no threads of a linear algebra library inside the driver."""
    n = len(a)
    both = np.concatenate([a, np.eye(n)], 1)
    for k in range(n):
        p = k + int(np.abs(both[k:, k]).argmax())
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        others = np.flatnonzero(both[:, k])
        others = others[others != k]
        both[others] -= both[others, k, None] * both[k]
    return both[:, n:]


def patterns(demand: np.ndarray, sizes: np.ndarray, capacity: int, rounds: int = 400, close: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their use in the linear program, by revised simplex with generated columns.

    Ends when no pattern is worth more than a sequence, or the duals scaled by the best pattern's worth, which bound
    the optimum from below, show that less than half a sequence or `close` of all is left to gain; or when 40 columns
    in a row, or `rounds` in all, have entered without saving anything (any basis gives a whole packing).
    """
    unit = int(np.gcd.reduce(np.append(sizes, capacity)))
    sizes, capacity = sizes // unit, capacity // unit
    # the first basis: sequences filled by falling size, each filling used until one size runs out. That size is in no
    # later filling, so the columns are independent; sizes that run out together get a column of their own
    m = len(sizes)
    basis, left, open_ = np.zeros((m, m)), demand.astype(float).copy(), np.ones(m, bool)
    for k in range(m):
        room, column = capacity, np.zeros(m)
        for i in np.flatnonzero(open_)[::-1]:
            n = min(int(np.ceil(left[i])), room // int(sizes[i]))
            column[i], room = n, room - n * int(sizes[i])
        gone = int(np.flatnonzero(open_)[0])
        if column.any():
            ratio = np.where(column > 0, left / np.maximum(column, 1), np.inf)
            gone = int(ratio.argmin())
            left = np.maximum(left - ratio[gone] * column, 0)
        else:
            column[gone] = 1
        left[gone], open_[gone], basis[:, k] = 0, False, column
    inverse = _inverse(basis)
    x = np.maximum((inverse * demand).sum(1), 0)
    even, least, history = sizes / capacity, 0.0, []
    for k in range(rounds):
        price, used = inverse.sum(0), float(x.sum())  # every pattern costs one sequence
        history.append(used)
        if k > 40 and history[-41] - used < close * used:
            break
        # prices drawn towards the sizes' shares of a sequence find full patterns first; they swing less
        for pull in (0.98, 0.9, 0.5, 0.0):
            drawn = pull * even + (1 - pull) * price
            value, column = knapsack(drawn, sizes, capacity)
            least = max(least, float((drawn * demand).sum()) / max(value, 1.0))
            if (column * price).sum() > 1 + 1e-7:
                break
        if (column * price).sum() <= 1 + 1e-7 or used - least < max(0.5, close * used):
            break
        direction = (inverse * column).sum(1)
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * direction, 0)
        x[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
        if k % 200 == 199:
            inverse = _inverse(basis)
            x = np.maximum((inverse * demand).sum(1), 0)
    return basis.round().astype(np.int64), x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(pattern, how many sequences)] that hold exactly the histogram's pieces; pattern: size -> pieces."""
    sizes = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    cols, x = patterns(left.astype(float), sizes, capacity)
    out: list[tuple[dict[int, int], int]] = []

    def use(column: np.ndarray, times: int) -> None:
        nonlocal left
        if times > 0 and column.any():
            out.append(({int(s): int(n) for s, n in zip(sizes, column) if n}, times))
            left = left - times * column

    for j in np.argsort(-x):
        fits = cols[:, j] > 0
        use(cols[:, j], min(int(x[j] + 1e-6), int((left[fits] // cols[fits, j]).min())))
    while left.any():  # what rounding left over: by falling size, the same filling as often as it can be repeated
        room, column = capacity, np.zeros(len(sizes), np.int64)
        for i in range(len(sizes) - 1, -1, -1):
            n = min(int(left[i]), room // int(sizes[i]))
            column[i], room = n, room - n * int(sizes[i])
        fits = column > 0
        use(column, int((left[fits] // column[fits]).min()))
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, grain: int = 8, slices_: int = 64) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have the end id alone. Rows with one doc_id are cut each for itself. Runs the tokenising pass
    and the program at once.
    """
    size = F.least(F.ceil(F.col("length") / grain) * grain, F.lit(capacity)).cast("int")
    cut = shared.stored(
        pieces(docs, tokenizer, end_id, capacity).withColumn("size", size).withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slices_)).cast("int")), "packing-pieces"
    )
    counts = shared.stored(cut.groupBy("size", "slice").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # capacity/grain rows
    chosen = plan(histogram, capacity)
    # where the pieces of each size go: from rank `begin` on, `each` a sequence, from sequence `first` on
    rows, next_rank, first = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in chosen:
        for s, n in pattern.items():
            rows.append((s, next_rank[s], n, first))
            next_rank[s] += n * times
        first += times
    order: dict[int, list[tuple[int, int, int]]] = {}
    for s, begin, n, f in rows:
        order.setdefault(s, []).append((begin, n, f))
    table = {s: np.array(v, np.int64) for s, v in order.items()}
    earlier = Window.partitionBy("size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("size", "slice").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("own", own).join(F.broadcast(before), ["size", "slice"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "slice")

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for s in np.unique(sizes):
                mine = np.flatnonzero(sizes == s)
                at = np.searchsorted(table[int(s)][:, 0], rank[mine], side="right") - 1
                begin, n, f = table[int(s)][at].T
                sequence[mine], slot[mine] = f + (rank[mine] - begin) // n, (rank[mine] - begin) % n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(slot)], names=[*batch.schema.names, "sequence_id", "slot"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    seated = ranked.mapInArrow(seat, f"{ddl}, sequence_id long, slot long")
    within = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    return seated.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
