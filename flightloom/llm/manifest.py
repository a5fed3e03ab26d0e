"""A Merkle manifest of a dataset, its leaves placed by bitmap ranks.

Every row is a leaf. A tree holds the leaves of one language in ascending order of doc_id; its height follows from the
number of leaves, and the roots of the languages are the leaves of one more tree. A leaf's place is a rank: tasks note
the ids of each (tree, range of 32,768 ids) in compressed bitmaps (sorted positions while there are few), the bitmaps of
a range are merged, a directory of running counts goes with each, and ranges are added up within their tree. Rows then
ask the bitmap of their range for their rank; no row is sorted. Places in hand, rows scatter into slot arrays of 8**5
leaves, whose nodes a task computes on five levels at a time; what stands above all of a tree's arrays is the same
again over their top nodes. Sibling paths come back down the same way.

Scale: a range, a slot array and a group of rows that ask one bitmap have bounded sizes, so a language that has a third
of all rows, or all of them, is spread. A range whose ids repeat (all null ids are one id) is asked by several groups;
rows of one id are placed by their leaves, equal leaves by any order, which gives the same tree.

Null ids come first in their tree, the null language's tree first among the trees, other languages bytewise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flightloom.llm.shared import stored

FANOUT = 8
#: Levels of a slot array, which has 8**5 leaves.
LEVELS = 5
#: Ids of a range, and the bits between two entries of its directory of counts.
RANGE, STRIDE = 1 << 15, 512
#: Rows that ask one copy of a bitmap.
ASKING = 1 << 16
_NULL_RANGE = -(1 << 48) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a row of documents with this text, as 32 bytes."""
    fields = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.unhex(F.sha2(F.concat(*fields, _field(text)), 256))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(tree, doc_id, leaf, now, row): the digest as it is kept and as it is now, where `tampered` says that it changed,
    and a number of the row's own, fixed once the rows are written."""
    changed = F.translate("text", _UPPER, _LOWER)
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang")))
    now = F.when(F.coalesce(tampered, F.lit(False)) & (changed != F.col("text")), leaf(changed))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"), now.alias("now"), F.monotonically_increasing_id().alias("row"))


def _range(doc_id: Column) -> Column:
    return F.coalesce(F.shiftright(doc_id, 15), F.lit(_NULL_RANGE))


def _position(doc_id: Column) -> Column:
    return F.coalesce(doc_id.bitwiseAND(F.lit(RANGE - 1)), F.lit(0)).cast("int")


class Bitmap:
    """The distinct positions of a range: two bytes each while there are few, else a bit each, with running counts;
    and how many more rows those positions have that are there more than once."""

    def __init__(self, kind: int, data: bytes, counts: bytes, repeated: bytes, more: bytes):
        self.kind = kind
        self.positions = np.frombuffer(data, "<u2") if kind == 0 else None
        self.bits = np.frombuffer(data, np.uint8) if kind else None
        self.counts = np.frombuffer(counts, "<u2")
        self.repeated, self.more = np.frombuffer(repeated, "<u2"), np.concatenate([[0], np.cumsum(np.frombuffer(more, "<i8"))])

    @classmethod
    def parts(cls, rows: np.ndarray) -> tuple[int, bytes, bytes, bytes, bytes]:
        """From the number of rows at each position."""
        there = np.flatnonzero(rows)
        many = there[rows[there] > 1]
        repeated, more = many.astype("<u2").tobytes(), (rows[many] - 1).astype("<i8").tobytes()
        if 2 * len(there) <= RANGE // 8:
            return 0, there.astype("<u2").tobytes(), b"", repeated, more
        bits = np.packbits(rows > 0, bitorder="little")
        directory = np.cumsum((rows > 0).reshape(-1, STRIDE).sum(1))
        return 1, bits.tobytes(), np.concatenate([[0], directory[:-1]]).astype("<u2").tobytes(), repeated, more

    def all(self) -> np.ndarray:
        return self.positions.astype(np.int64) if self.kind == 0 else np.flatnonzero(np.unpackbits(self.bits, bitorder="little"))

    def rank(self, position: np.ndarray) -> np.ndarray:
        """Rows at smaller positions."""
        if self.kind == 0:
            distinct = np.searchsorted(self.positions, position)
        else:
            block = position // STRIDE
            words = self.bits.view("<u8").reshape(-1, STRIDE // 64)[block]
            left = (position % STRIDE)[:, None] - np.arange(0, STRIDE, 64)  # bits of each word below the position
            mask = np.where(left >= 64, ~np.uint64(0), (np.uint64(1) << np.clip(left, 0, 63).astype(np.uint64)) - np.uint64(1))
            distinct = self.counts[block].astype(np.int64) + np.bitwise_count(words & mask).sum(1)
        return distinct + self.more[np.searchsorted(self.repeated, position)]

    def repeats(self, position: np.ndarray) -> np.ndarray:
        """Whether a position has more than one row."""
        at = np.minimum(np.searchsorted(self.repeated, position), max(len(self.repeated) - 1, 0))
        return self.repeated[at] == position if len(self.repeated) else np.zeros(len(position), bool)


_BITMAP = "tree string, range long, kind int, data binary, counts binary, repeated binary, more binary, rows long"
#: Rows whose positions a task holds before it passes bitmaps on.
_HELD = 1 << 20


def bitmaps(rows: DataFrame) -> DataFrame:
    """(tree, range, kind, data, counts, repeated, more, rows) of (tree, doc_id), one row for each range."""
    names = [c.split()[0] for c in _BITMAP.split(", ")]

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*made)) if made else [[]] * len(names)
        types = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            tree = table["tree"].combine_chunks().dictionary_encode()
            code, ids, position = tree.indices.to_numpy(), table["range"].to_numpy(), table["position"].to_numpy()
            order = np.lexsort((position, ids, code))
            code, ids, position = code[order], ids[order], position[order]
            new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (ids[1:] != ids[:-1])]))
            made = []
            for a, b in zip(new, np.append(new[1:], len(code))):
                made.append((tree.dictionary[int(code[a])].as_py(), int(ids[a]), *_few(position[a:b]), int(b - a)))
                if len(made) == 1000:
                    yield batch_of(made)
                    made = []
            yield batch_of(made)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= _HELD:
                yield from flush()
        if held:
            yield from flush()

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        count = np.zeros(RANGE, np.int64)
        for kind, data, counts, repeated, more in zip(*(table[c].to_pylist() for c in names[2:7])):
            part = Bitmap(kind, data, counts, repeated, more)
            count[part.all()] += 1
            count[part.repeated] += np.diff(part.more)
        return pa.Table.from_batches([batch_of([(key[0].as_py(), key[1].as_py(), *Bitmap.parts(count), int(count.sum()))])])

    asked = rows.select("tree", _range(F.col("doc_id")).alias("range"), _position(F.col("doc_id")).alias("position"))
    return asked.mapInArrow(note, _BITMAP).groupBy("tree", "range").applyInArrow(merge, _BITMAP)


def _few(position: np.ndarray) -> tuple[int, bytes, bytes, bytes, bytes]:
    """Bitmap.parts of sorted positions."""
    if 2 * len(position) > RANGE // 8:
        return Bitmap.parts(np.bincount(position, minlength=RANGE))
    there, rows = np.unique(position, return_counts=True)
    many = rows > 1
    return 0, there.astype("<u2").tobytes(), b"", there[many].astype("<u2").tobytes(), (rows[many] - 1).astype("<i8").tobytes()


def running(counts: DataFrame) -> DataFrame:
    """counts with `before`: the rows of smaller ranges of the tree. Ranges are added up by 32,768 first, so a window
    holds at most that many of them, or the 2**18 sums of a tree."""
    upper = F.shiftright("range", 15).alias("upper")
    sums = counts.groupBy("tree", upper).agg(F.sum("rows").alias("n"))
    below = F.sum("n").over(Window.partitionBy("tree").orderBy("upper").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("tree", "upper", F.coalesce(below, F.lit(0)).alias("base"))
    own = F.sum("rows").over(Window.partitionBy("tree", "upper").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    inner = counts.withColumn("upper", upper).withColumn("own", F.coalesce(own, F.lit(0)))
    return inner.join(sums, ["tree", "upper"]).withColumn("before", F.col("own") + F.col("base")).drop("upper", "own", "base")


_PLACED = "tree string, doc_id long, leaf binary, now binary, row long, place long, many boolean"

_PLACED_ARROW = pa.schema(
    [("tree", pa.string()), ("doc_id", pa.int64()), ("leaf", pa.binary()), ("now", pa.binary()), ("row", pa.int64()), ("place", pa.int64()), ("many", pa.bool_())]
)


def placed(rows: DataFrame, asking: int = ASKING) -> DataFrame:
    """rows (tree, doc_id, leaf, now, row) with `place`: where the leaf stands in its tree, from 0. A bitmap answers
    about `asking` rows at a time."""
    maps = stored(running(bitmaps(rows)), "manifest-bitmaps")
    rows = rows.withColumn("range", _range(F.col("doc_id")))
    hot = maps.where(F.col("rows") > asking).select("tree", "range", F.ceil(F.col("rows") / asking).cast("int").alias("copies"))
    salted = rows.join(hot, ["tree", "range"], "left").withColumn("copy", F.coalesce(F.pmod(F.xxhash64("row"), F.col("copies")), F.lit(0)).cast("int")).drop("copies")
    copies = F.ceil(F.col("rows") / asking).cast("int")
    dealt = maps.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(copies - 1, F.lit(0)))))

    def ask(table: pa.Table, own: pa.Table) -> pa.Table:
        if not table.num_rows or not own.num_rows:  # copies are dealt by chance, one may be asked by no row
            return _PLACED_ARROW.empty_table()
        bitmap = Bitmap(*(own[c][0].as_py() for c in ("kind", "data", "counts", "repeated", "more")))
        position = pa.compute.fill_null(table["doc_id"], 0).to_numpy() & (RANGE - 1)
        rank = own["before"][0].as_py() + bitmap.rank(position)
        return table.select(_PLACED_ARROW.names[:5]).append_column("place", pa.array(rank, pa.int64())).append_column("many", pa.array(bitmap.repeats(position)))

    key = ["tree", "range", "copy"]
    salted = salted.repartition(*key)  # not as a join by (tree, range) left them
    out = stored(salted.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(ask, _PLACED), "manifest-placed")
    many = out.where("many")
    if many.isEmpty():
        return out.drop("many")
    return out.where("not many").drop("many").unionByName(_among_equals(many.drop("many")))


def _among_equals(rows: DataFrame) -> DataFrame:
    """Rows of one id follow each other by their leaves; equal leaves in any order.

    Counts are taken of (id, leaf, part), where parts cut rows with one leaf; windows run over 4,096 sums of an id, over
    the sums of one of these, and over the rows of a part."""
    rows = stored(rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(4096)).cast("int")), "manifest-repeated")
    counts = rows.groupBy("tree", "doc_id", "leaf", "part").agg(F.count("*").alias("n")).withColumn("head", F.substring(F.hex("leaf"), 1, 3))
    sums = counts.groupBy("tree", "doc_id", "head").agg(F.sum("n").alias("n"))
    before = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("tree", "doc_id", "head", F.coalesce(F.sum("n").over(before("head").partitionBy("tree", "doc_id")), F.lit(0)).alias("base"))
    inner = counts.withColumn("own", F.coalesce(F.sum("n").over(before("leaf", "part").partitionBy("tree", "doc_id", "head")), F.lit(0)))
    same = inner["tree"].eqNullSafe(sums["tree"]) & inner["doc_id"].eqNullSafe(sums["doc_id"]) & (inner["head"] == sums["head"])
    start = inner.join(sums, same).select(inner["tree"].alias("t"), inner["doc_id"].alias("d"), inner["leaf"].alias("l"), inner["part"].alias("p"), (F.col("own") + F.col("base")).alias("start"))
    met = rows.join(start, (F.col("tree") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("leaf") == F.col("l")) & (F.col("part") == F.col("p")))
    nth = F.row_number().over(Window.partitionBy("tree", "doc_id", "leaf", "part").orderBy("row"))
    return met.withColumn("place", (F.col("place") + F.col("start") + nth - 1).cast("long")).select("tree", "doc_id", "leaf", "now", "row", "place")


def digest(parts: list[bytes]) -> bytes:
    """H over digests as hexadecimal text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def raised(nodes: list[bytes], whole: bool, levels: int) -> list[list[bytes]]:
    """The nodes of a slot array and `levels` levels above them, or those up to one node if it is the `whole` tree."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= levels:
        below = out[-1]
        out.append([digest(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return out


_ARRAY = "tree string, array long, n int, whole boolean, ids binary, has_id binary, nodes binary, now binary, changed binary, top binary"


def slot_arrays(nodes: DataFrame, levels: int) -> DataFrame:
    """One row for each slot array of (tree, place, doc_id, leaf, now): its leaves in order of place, and its top node."""
    wide = FANOUT**levels
    totals = nodes.groupBy("tree").agg(F.count("*").alias("total"))

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, array, total = (k.as_py() for k in key)
        n = table.num_rows
        at = table["place"].to_numpy() - array * wide
        ids, has_id = np.zeros(n, "<i8"), np.zeros(n, np.uint8)
        has_id[at] = pa.compute.is_valid(table["doc_id"]).to_numpy()
        ids[at] = pa.compute.fill_null(table["doc_id"], 0).to_numpy()
        kept, now, changed = np.zeros((n, 32), np.uint8), np.zeros((n, 32), np.uint8), np.zeros(n, np.uint8)
        kept[at] = np.frombuffer(b"".join(table["leaf"].to_pylist()), np.uint8).reshape(n, 32)
        was = pa.compute.is_valid(table["now"]).to_numpy()
        changed[at] = was
        now[at[was]] = np.frombuffer(b"".join(x for x in table["now"].to_pylist() if x is not None), np.uint8).reshape(-1, 32)
        whole = total <= wide
        top = raised(_hex(kept.tobytes()), whole, levels)[-1][0]
        row = (tree, array, n, whole, ids.tobytes(), has_id.tobytes(), kept.tobytes(), now[changed > 0].tobytes(), changed.tobytes(), bytes.fromhex(top.decode()))
        types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 6]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in _ARRAY.split(", ")])

    dealt = nodes.join(totals, "tree").withColumn("array", F.floor(F.col("place") / wide).cast("long"))
    # dealt anew: the join may have put all rows of a tree together, which would do for the grouping
    dealt = dealt.repartition("tree", "array")
    return stored(dealt.groupBy("tree", "array", "total").applyInArrow(fill, _ARRAY), "manifest-arrays")


def _hex(data: bytes) -> list[bytes]:
    text = data.hex().encode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _paths(levels: list[list[bytes]], above: tuple[tuple[int, bytes], ...]) -> Iterator[tuple[tuple[int, bytes], ...]]:
    """For each lowest node in order: (siblings to its left, siblings) on every level, then what is above."""

    def siblings(level: list[bytes], i: int) -> tuple[int, bytes]:
        a = i - i % FANOUT
        return i - a, b"".join([*level[a:i], *level[i + 1 : a + FANOUT]])

    # the shared part of eight neighbours' paths is made once
    rest = [above]
    for level in reversed(levels[1:-1]):
        rest = [(siblings(level, i), *rest[i // FANOUT]) for i in range(len(level))]
    if len(levels) == 1:
        yield above
        return
    for i in range(len(levels[0])):
        yield (siblings(levels[0], i), *rest[i // FANOUT])


_PATH = "array<struct<at:int,siblings:binary>>"


def _told(path: list[dict]) -> tuple[tuple[int, bytes], ...]:
    return tuple((step["at"], step["siblings"]) for step in path)


def climb(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(arrays, above) of (tree, place, doc_id, leaf, now): the slot arrays, and for each the path (tree, array, path)
    from its top node to the root of its tree, with the root (a digest). Runs its jobs at once."""
    arrays = slot_arrays(nodes, levels)
    tops = arrays.select("tree", F.col("array").alias("place"), "top", "whole")
    done = tops.where("whole").select("tree", F.col("place").alias("array"), F.lit(None).cast(_PATH).alias("path"), F.col("top").alias("root"))
    done = done.withColumn("path", F.coalesce("path", F.array().cast(_PATH)))
    more = tops.where("not whole")
    if more.isEmpty():
        return arrays, done
    none = F.lit(None)
    upper, over = climb(more.select("tree", "place", none.cast("long").alias("doc_id"), F.col("top").alias("leaf"), none.cast("binary").alias("now")), levels)
    return arrays, done.unionByName(lowered(upper, over, levels).select("tree", F.col("place").alias("array"), "path", "root"))


def _with_path(arrays: DataFrame, above: DataFrame) -> DataFrame:
    return arrays.join(above, ["tree", "array"])


def lowered(arrays: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """(tree, place, path, root) for every leaf of the slot arrays: its path to the root of its tree."""
    wide = FANOUT**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.binary())]))
        for batch in batches:
            for row in batch.to_pylist():
                paths = _paths(raised(_hex(row["nodes"]), row["whole"], levels), _told(row["path"]))
                n, base = row["n"], row["array"] * wide
                for a in range(0, n, 1024):
                    some = [[{"at": at, "siblings": s} for at, s in path] for path, _ in zip(paths, range(min(1024, n - a)))]
                    k = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["tree"]] * k), pa.array(range(base + a, base + a + k), pa.int64()), pa.array(some, step), pa.array([row["root"]] * k, pa.binary())],
                        names=["tree", "place", "path", "root"],
                    )

    return _with_path(arrays, above).mapInArrow(run, f"tree string, place long, path {_PATH}, root binary")


_OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(arrays: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of slot arrays whose paths lead to the root of
    all trees; every proof is folded anew from the leaf as it is now."""
    names = [c.split()[0] for c in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kept, path, root = _hex(row["nodes"]), _told(row["path"]), row["root"].hex()
                changed = np.flatnonzero(np.frombuffer(row["changed"], np.uint8)).tolist()
                now = dict(zip(changed, _hex(row["now"])))
                ids, has_id = np.frombuffer(row["ids"], "<i8").tolist(), row["has_id"]
                subroot, made = row["subroot"].hex(), []
                for i, steps in enumerate(_paths(raised(kept, row["whole"], levels), path)):
                    proof = hashlib.sha256(b"".join([s for _, s in steps])).hexdigest()
                    node = now.get(i, kept[i])
                    for at, s in steps:
                        node = digest([s[: 64 * at], node, s[64 * at :]])
                    folded = node.decode()
                    made.append((ids[i] if has_id[i] else None, kept[i].decode(), subroot, root, proof, folded, folded == root))
                    if len(made) == 4096 or i == row["n"] - 1:
                        columns = list(zip(*made))
                        types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)
                        made = []

    return _with_path(arrays, above).mapInArrow(run, _OUT)


def numbered(trees: DataFrame) -> DataFrame:
    """trees (tree, ...) with `place`: their order by name, by ranges and places within a range."""
    ranged = stored(trees.repartitionByRange("tree").withColumn("part", F.spark_partition_id()), "manifest-trees")
    size = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("part").orderBy("tree")) - 1
    starts = size.select("part", before.alias("before"))
    return ranged.withColumn("own", own).join(starts, "part").withColumn("place", F.col("own") + F.col("before")).drop("part", "own", "before")


def manifest(docs: DataFrame, tampered: Column, levels: int = LEVELS, asking: int = ASKING) -> DataFrame:
    """One row for each row of documents; `tampered` marks rows whose text is lower-cased (A-Z) behind the manifest's
    back. Runs its jobs at once.

    An empty table gives no row. A row without doc_id comes before those that have one; equal ids are ordered by leaf.
    """
    rows = stored(leaves(docs, tampered), "manifest-leaves")
    arrays, above = climb(placed(rows, asking), levels)
    subroots = numbered(above.select("tree", "root").dropDuplicates(["tree"]))
    none = F.lit(None)
    top, over = climb(subroots.select(F.lit("").alias("tree"), "place", none.cast("long").alias("doc_id"), F.col("root").alias("leaf"), none.cast("binary").alias("now")), levels)
    ways = lowered(top, over, levels).select("place", F.col("path").alias("upper"), F.col("root").alias("all"))
    joined = subroots.select("tree", "place", F.col("root").alias("subroot")).join(ways, "place").drop("place")
    whole = above.drop("root").join(joined, "tree").select("tree", "array", F.concat("path", "upper").alias("path"), "subroot", F.col("all").alias("root"))
    return proofs(arrays, whole, levels)
