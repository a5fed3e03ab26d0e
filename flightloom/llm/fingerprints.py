"""I-Match fingerprints with randomised lexicons.

The lexicon holds the terms of a band of inverse document frequency: those of at least 1/`rarest` of all texts and at
most 1/`commonest`. A text's terms within a lexicon, distinct and sorted, are hashed to one value; besides the whole
lexicon there are `each` random subsets at every rate 1/4, 1/16, ..., so that texts of any length have subsets in which
an edit leaves the hash as it was. A text without a term in the band uses all its terms.

Scale: the lexicon has at most `rarest` times the mean number of distinct terms of a text, whatever the corpus, so it is
broadcast; document frequencies come from one pass of packed partial counts. The comparison with the next document
deals texts out by ranges of doc_id, each with the first row of the range after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from flightloom.llm import shared
from flightloom.llm.text import Words, joined, mix, slices


@dataclass(frozen=True)
class Scheme:
    rarest: int = 512
    commonest: int = 8
    each: int = 12
    levels: int = 6

    @property
    def subsets(self) -> int:
        return 1 + self.each * (self.levels - 1)


def lexicon(docs: DataFrame, scheme: Scheme, text: str = "text") -> np.ndarray:
    """Hashes of the terms within the band, sorted. Runs its job at once."""
    shards, total = shared.shards_for(docs, text), docs.count()
    low, high = max(1.0, total / scheme.rarest), max(2.0, total / scheme.commonest)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = shared.Gather(shards)
        for batch in batches:
            data, offsets = joined(batch.column(text))
            for a, b in slices(offsets):
                yield from gather.add(distinct(Words(data, offsets, a, b))[0])
        yield from gather.flush()

    def band(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, df = shared.unpack(table)
        return pa.table({"term": keys[(df >= low) & (df <= high)].view(np.int64)})

    found = docs.select(text).mapInArrow(terms, shared.PACKED_DDL).groupBy("shard").applyInArrow(band, "term long").toPandas()
    return np.sort(found["term"].to_numpy(np.int64).view(np.uint64))


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct terms in order of their hashes, and the text of each."""
    text = words.text
    order = np.lexsort((words.hash, text))
    h, t = words.hash[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], t[new]


def fingerprints(words: Words, terms: np.ndarray, scheme: Scheme) -> np.ndarray:
    """(texts, subsets) hashes of sorted distinct terms; 0 where no term of the text is in the subset."""
    h, t = distinct(words)
    _, inside = shared.lookup(terms, h)
    none = np.bincount(t[inside], minlength=words.texts) == 0
    kept = inside | none[t]
    h, t = h[kept], t[kept]
    out = np.zeros((words.texts, scheme.subsets), np.uint64)
    for k in range(scheme.subsets):
        level = 0 if k == 0 else 1 + (k - 1) // scheme.each
        salt = np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        # term k of the sorted list enters with its place's weight, so the hash is one of the sequence
        mine = (mix(h ^ salt) & np.uint64((1 << (2 * level)) - 1)) == 0
        hk, tk = h[mine], t[mine]
        if not len(hk):
            continue
        at = np.flatnonzero(np.concatenate([[True], tk[1:] != tk[:-1]]))
        place = np.arange(len(tk)) - np.repeat(at, np.diff(np.append(at, len(tk))))
        value = np.add.reduceat(mix(hk + salt + (place.astype(np.uint64) << np.uint64(1))), at)
        out[tk[at], k] = np.maximum(mix(value), np.uint64(1))
    return out


def written(prints: np.ndarray) -> list[str]:
    """Sixteen hexadecimal digits for each subset."""
    return [x.tobytes().hex() for x in prints.astype(">u8")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes among the subsets that hold terms of either text; 1 if none does."""
    either = (a > 0) | (b > 0)
    same = (either & (a == b)).sum(1)
    return np.where(either.any(1), same / np.maximum(either.sum(1), 1), 1.0)


def fingerprint(docs: DataFrame, terms: np.ndarray, scheme: Scheme = Scheme(), text: str = "text") -> DataFrame:
    """docs (without the text) with `fingerprint`. Null is the empty text; equal texts have equal fingerprints."""
    rest = [f for f in docs.schema if f.name not in (text, "fingerprint")]
    lex = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _bounded(whole, len(rest))):
            prints = written(_batch_prints(batch.column(len(rest)), lex.value, scheme))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(prints, pa.string())], names=[*(f.name for f in rest), "fingerprint"])

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return docs.select(*(f"`{f.name}`" for f in rest), text).mapInArrow(run, f"{ddl}fingerprint string")


def _batch_prints(column: pa.Array, terms: np.ndarray, scheme: Scheme) -> np.ndarray:
    data, offsets = joined(column)
    parts = [fingerprints(Words(data, offsets, a, b), terms, scheme) for a, b in slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, scheme.subsets), np.uint64)


def _bounded(batch: pa.RecordBatch, text: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a batch whose texts have about `most` bytes, so that what is made of them is bounded too."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy()
    for a, b in slices(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), most):
        yield batch.slice(a, b - a)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, halo, doc_id, text) in ranges of doc_id; a range ends with a copy of the next one's first row.

    The bounds are ids of the table, so a range begins with a row of its bound: that row's id alone tells which rows
    are to be copied. Equal ids are ordered by text. Null ids come first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    found = rows.agg(F.percentile_approx(key, [i / parts for i in range(parts + 1)], 100 * parts).alias("b"), F.min(key).alias("least")).first()
    bounds = sorted({found["least"], *(found["b"] or [])[:-1]}) if found["least"] is not None else []
    starts = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<long>")
    # the number of bounds at or below the id
    part = F.size(F.filter(starts, lambda b: b <= key)) if len(bounds) <= 64 else F.expr(_bisect(bounds, "coalesce(doc_id, -9223372036854775808L)"))
    before = F.when(part == 1, F.lit(len(bounds))).otherwise(part - 1)
    own = F.struct(part.alias("part"), F.lit(False).alias("halo"))
    halo = F.struct(before.alias("part"), F.lit(True).alias("halo"))
    at_bound = F.array_contains(starts, key)
    return rows.withColumn("p", F.explode(F.when(at_bound, F.array(own, halo)).otherwise(F.array(own)))).select("p.part", "p.halo", "doc_id", "text")


def _bisect(bounds: list[int], key: str) -> str:
    """How many bounds are at or below the key, as nested halves."""

    def half(a: int, b: int) -> str:
        if a == b:
            return str(a)
        m = (a + b) // 2
        return f"if({key} < {bounds[m]}L, {half(a, m)}, {half(m + 1, b)})"

    return half(0, len(bounds))


def compare_edited(docs: DataFrame, scheme: Scheme = Scheme(), parts: int | None = None) -> DataFrame:
    """For every row: its fingerprint, that of its edited text, and their likeness and the next document's.

    The edited text has the last floor(n_chars/4) code points replaced by the first as many (or all) of the next
    document by ascending doc_id (after the last: the first). Null text is empty. A table of one row is followed by
    itself.
    """
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(lexicon(docs, scheme))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or min(4 * tasks, 2048)
    dealt = with_next(docs, parts).repartition(tasks, "part").sortWithinPartitions("part", "halo", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the part so far: (part, id, text, print)
        for batch in (part for whole in batches for part in _bounded(whole, 3)):
            part, halo, ids = (batch.column(k).to_pylist() for k in (0, 1, 2))
            texts = batch.column(3).to_pylist()
            prints = _batch_prints(batch.column(3), terms.value, scheme)
            rows = []  # (id, text, print, next text, next print)
            for i in range(len(part)):
                if held is not None and held[0] == part[i]:
                    rows.append((*held[1:], texts[i], prints[i]))
                # of several copied rows only the first follows
                held = None if halo[i] else (part[i], ids[i], texts[i], prints[i])
            if not rows:
                continue
            edited = []
            for _, text, _, after, _ in rows:
                k = len(text) // 4
                edited.append(text[: len(text) - k] + after[:k])
            new = _batch_prints(pa.array(edited, pa.large_string()), terms.value, scheme)
            own, follow = np.stack([r[2] for r in rows]), np.stack([r[4] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]), pa.array(written(own)), pa.array(written(new)),
                    pa.array(likeness(own, new)), pa.array(likeness(own, follow)),
                ],
                names=[x.split()[0] for x in EDITED.split(", ")],
            )

    return dealt.mapInArrow(run, EDITED)
