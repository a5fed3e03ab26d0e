"""Spelling variants by reduced alphabets.

Letters are dealt to `symbols` classes; a word's reduced form is its sequence of classes. Two words that differ in one
inserted, deleted or replaced letter have reduced forms that are equal or differ in one symbol, so the join of every
word's full one-edit neighbourhood over the small alphabet with the reduced vocabulary misses no pair; the original
strings decide. Neighbourhoods are hashes of edited forms, each from prefix sums of the form in one step, so a word of
n letters costs 2 * symbols * n numbers whatever its length.

Scale: occurrences are counted in the task (a table of at most `HELD` words, passed on when full) before the shuffle of
(word, count). What is joined is the vocabulary, not the text. A variant meets only words of its own reduced form: more
symbols make these groups smaller. No pair leaves the join that the strings do not confirm. Chains of forms grow tenfold
in count at each step, so they are short and pointer doubling ends after a few rounds.

Null texts have no words; a null id reads as the empty text in `<id>:<run>`. Repeated rows count each time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flightloom.llm import shared
from flightloom.llm.text import FOLD, Words, joined, mix, stretches

#: Words and bytes of words that a task counts before it passes them on.
HELD, HELD_BYTES = 300_000, 16 << 20
#: Variants made at a time.
AT_ONCE = 1 << 19

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
#: U+00C0 to U+00FF are C3 followed by 80 to BF in UTF-8
_LEAD = 0xC3
_MAY_BE_INSIDE = _LETTER.copy()
_MAY_BE_INSIDE[_LEAD] = _MAY_BE_INSIDE[0x80:0xC0] = True

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def letter_runs(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, code points) of the maximal runs of A-Z, a-z and U+00C0 to U+00FF in texts part[at[i]:at[i+1]]."""
    n = len(part)
    lead = part == _LEAD
    keep = _LETTER[part] | lead
    keep[1:] |= lead[:-1]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    begins, ends = keep.copy(), keep.copy()
    begins[1:] &= ~keep[:-1] | cut[1:n]
    ends[:-1] &= ~keep[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return start, end, end - start - (leads[end] - leads[start])


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of a prefix and data[start:end], for many ranges at once; `before` holds the prefixes' crc32."""
    out = np.zeros(len(start), np.uint32)
    size = end - start
    for i in np.flatnonzero(size > 256):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i]))
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= 256]
    c, place, longest = ~before[order], start[order], size[order]
    active = len(order)
    for j in range(int(longest[0]) if active else 0):
        active = int(np.searchsorted(-longest[:active], -j, side="left"))
        now = c[:active]
        c[:active] = _CRC[(now ^ data[place[:active] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out[order] = ~c
    return out


def counted(docs: DataFrame, least_length: int, one_in: int, text: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of at least least_length code points and their occurrences; a run whose crc32 with
    the document's id is divisible by `one_in` is counted without code point crc32 % length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            words, n = list(total), list(total.values())
            total.clear()
            held = 0
            for a in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 20_000], pa.binary()).cast(pa.string()), pa.array(n[a : a + 20_000], pa.int64())], names=["word", "n"])

        for batch in batches:
            data, offsets = joined(batch.column(1))
            prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()], np.uint32)
            for a, at in stretches(data, offsets, _MAY_BE_INSIDE):
                part, at = FOLD[data[at[0] : at[-1]]], at - at[0]
                if not len(part):
                    continue
                start, end, size = letter_runs(part, at)
                long = size >= least_length
                start, end, size = start[long], end[long], size[long]
                if not len(start):
                    continue
                doc = a + np.searchsorted(at, start, side="right") - 1
                crc = crc32_of(part, start, end, prefix[doc])
                hit = crc % np.uint32(one_in) == 0
                raw = part.tobytes()
                for s, e, h, k in zip(start[hit].tolist(), end[hit].tolist(), crc[hit].tolist(), size[hit].tolist()):
                    if k > least_length:
                        word = _without(raw[s:e], h % k, k)
                        held += len(word) if word not in total else 0
                        total[word] = total.get(word, 0) + 1
                words = Words.__new__(Words)
                words.data, words.texts, words._at = part, len(at) - 1, at
                words.recut(start[~hit], end[~hit])
                _, first, n = np.unique(words.hash, return_index=True, return_counts=True)
                for s, e, k in zip(words.start[first].tolist(), words.end[first].tolist(), n.tolist()):
                    word = raw[s:e]
                    held += e - s if word not in total else 0
                    total[word] = total.get(word, 0) + k
                if len(total) >= HELD or held >= HELD_BYTES:
                    yield from flush()
        yield from flush()

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _without(word: bytes, place: int, length: int) -> bytes:
    if len(word) == length:
        return word[:place] + word[place + 1 :]
    letters = word.decode()
    return (letters[:place] + letters[place + 1 :]).encode()


_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = np.uint64(pow(_STEP, -1, 1 << 64))


def reduced(codes: np.ndarray, symbols: int) -> np.ndarray:
    """The class 1 to `symbols` of each code point."""
    return (mix(codes.astype(np.uint64) + np.uint64(0x51ED)) % np.uint64(symbols)) + np.uint64(1)


class Forms:
    """Reduced forms of many words: their keys and the keys of their one-edit neighbourhoods.

    A form's key mixes the sum of symbol times power of the place with its length, modulo 2**64. Different forms may
    share a key; the strings decide.
    """

    def __init__(self, words: list[str], symbols: int):
        self.symbols = symbols
        self.size = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.letters = reduced(codes, symbols)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.place = np.arange(len(codes)) - np.repeat(self.first[:-1], self.size)
        self.word = np.repeat(np.arange(len(words)), self.size)
        power = np.full(int(self.size.max(initial=0)) + 1, _STEP, np.uint64)
        power[0] = 1
        self.power = np.cumprod(power)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters * self.power[self.place])])
        self.before = sums[:-1] - sums[self.first[self.word]]
        self.whole = sums[self.first[1:]] - sums[self.first[:-1]]

    def _key(self, total: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(total + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def keys(self) -> np.ndarray:
        return self._key(self.whole, self.size)

    def neighbourhoods(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, key): every distinct form that equals the word's or differs from it in one edit, in parts."""
        yield np.arange(len(self.size)), self.keys()
        after_all = np.flatnonzero(self.size >= 0)
        for s in range(1, self.symbols + 1):  # behind the last letter
            last = np.where(self.size > 0, self.letters[np.maximum(self.first[1:] - 1, 0)] if len(self.letters) else 0, 0)
            new = after_all[last != s]
            yield new, self._key(self.whole[new] + np.uint64(s) * self.power[self.size[new]], self.size[new] + 1)
        for a in range(0, len(self.letters), AT_ONCE):
            b = min(a + AT_ONCE, len(self.letters))
            word, place, letter = self.word[a:b], self.place[a:b], self.letters[a:b]
            size, power, before, whole = self.size[word], self.power[place], self.before[a:b], self.whole[word]
            previous = np.where(place > 0, self.letters[np.maximum(np.arange(a, b) - 1, 0)], 0)
            # without the first letter of each run of equal ones
            new = letter != previous
            rest = (whole - before - letter * power) * _BACK
            yield word[new], self._key(before[new] + rest[new], size[new] - 1)
            moved = before + (whole - before) * np.uint64(_STEP)
            for s in range(1, self.symbols + 1):
                s64 = np.uint64(s)
                new = letter != s64
                yield word[new], self._key(whole[new] + (s64 - letter[new]) * power[new], size[new])
                new = previous != s64  # in front of a letter, but not behind an equal one
                yield word[new], self._key(moved[new] + s64 * power[new], size[new] + 1)


def _groups(words: list[str], most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of words of about `most` letters; a longer word is a run of its own."""
    a, held = 0, 0
    for i, w in enumerate(words):
        if held and held + len(w) > most:
            yield a, i
            a, held = i, 0
        held += len(w)
    if words:
        yield a, len(words)


def _filter(keys: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a bitmap of 2**bits bits: one is set for the topmost `bits` bits of every key. At most 2**(bits-15)
    rows of 4 KB come to the driver."""
    bit = F.shiftrightunsigned("key", 64 - bits)
    found = keys.groupBy(F.shiftright(bit, 15).alias("bucket")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("bitmap"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in found.toLocalIterator():
        out[row["bucket"] * 4096 : (row["bucket"] + 1) * 4096] = np.frombuffer(row["bitmap"], np.uint8)
    return out


def near_pairs(vocabulary: DataFrame, symbols: int = 8, most_bits: int = 29) -> DataFrame:
    """(word, near, near_n): every two words of (word, n) that differ by one inserted, deleted or replaced code point,
    in both directions.

    A bitmap of the reduced vocabulary, of 32 bits a word and 2**most_bits at most (64 MB), goes to all tasks; variants
    whose bit is not set meet nothing and are left out before the shuffle. With more words than it has room for it lets
    more variants pass, none is lost.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for a, b in _groups(words):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array(Forms(words[a:b], symbols).keys().view(np.int64)), *part.columns], names=["key", "near", "near_n"])

    reduced_ = shared.stored(vocabulary.select("word", "n").mapInArrow(keys, "key long, near string, near_n long"), "spelling-keys")
    bits = min(max(20, (32 * reduced_.count()).bit_length()), most_bits)
    known = vocabulary.sparkSession.sparkContext.broadcast(_filter(reduced_, bits))

    def variants_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, shift = known.value, np.uint64(64 - bits)
        for batch in batches:
            column = batch.column(0)
            words = column.to_pylist()
            for a, b in _groups(words):
                part = column.slice(a, b - a)
                # a long word's copies are put out a few at a time
                step = max(1, (8 << 20) // max(max(map(len, words[a:b])), 16))
                for word, key in Forms(words[a:b], symbols).neighbourhoods():
                    bit = key >> shift
                    there = np.flatnonzero(bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1))
                    for i in range(0, len(there), step):
                        at = there[i : i + step]
                        yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), part.take(pa.array(word[at]))], names=["key", "word"])

    left = vocabulary.select("word").mapInArrow(variants_, "key long, word string")
    # what a task makes of a word is not in the planner's sizes: no side is to be broadcast for its small input
    met = left.hint("merge").join(reduced_, "key").where(F.levenshtein("word", "near", 1) == 1)
    return met.select("word", "near", "near_n").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each word's chain, by pointer doubling. Chains have no circles."""
    now = shared.stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after = shared.stored(moved, "spelling-roots")
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, one_in: int = 31, symbols: int = 8) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n. Runs its jobs at once."""
    found = counted(docs, least_length, one_in)
    vocabulary = shared.stored(found.where(F.col("n") >= least_count), "spelling-words")
    # the most frequent near word, of several the first in code-point order (that of UTF-8 bytes)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(vocabulary, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.less") >= ratio * F.col("n")
    joined_ = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    whole = shared.stored(joined_, "spelling-forms")
    ends = roots(whole.where("form is not null"))
    return whole.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
