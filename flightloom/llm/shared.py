"""Tables of hashes: counted in tasks as packed arrays, kept as sorted array files that tasks map into memory."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from flightloom.session import shared_folder

#: Tokens or keys a task gathers before it passes them on.
FLUSH = 3 << 20


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: it survives lost executors and ends the lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def save_array(folder: str, name: str, values: np.ndarray) -> None:
    """Written under a name of its own, then renamed: a task that runs twice leaves one whole file."""
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    fs.move(own, f"{path}/{name}")


_MAPPED: dict[tuple[str, str], np.ndarray] = {}


def load_array(folder: str, name: str, dtype) -> np.ndarray:
    """The array, mapped: a shared mount is mapped in place, from any other store a copy without a name is mapped."""
    key = (folder, name)
    if key not in _MAPPED:
        fs, path = _open(folder)
        whole = f"{path}/{name}"
        if isinstance(fs, pafs.LocalFileSystem):
            _MAPPED[key] = np.memmap(whole, dtype, "r") if os.path.getsize(whole) else np.zeros(0, dtype)
        else:
            import tempfile

            with tempfile.TemporaryFile() as copy, fs.open_input_stream(whole) as source:
                while block := source.read(1 << 24):
                    copy.write(block)
                copy.flush()
                _MAPPED[key] = np.memmap(copy, dtype, "r") if copy.tell() else np.zeros(0, dtype)
    return _MAPPED[key]


def forget_arrays(folder: str) -> None:
    """Other runs' arrays are let go, so a reused worker maps those of one run only."""
    for key in [k for k in _MAPPED if not k[0].startswith(folder)]:
        del _MAPPED[key]


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts (of their appearances, without counts)."""
    if counts is None:
        keys = np.sort(keys)
        if not len(keys):
            return keys, np.zeros(0, np.int64)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return keys[new], np.add.reduceat(counts, np.flatnonzero(new))


PACKED = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
PACKED_DDL = "shard int, keys binary, counts binary"


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def packed(keys: np.ndarray, counts: np.ndarray, shards: int, shard: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each shard: its sorted keys and their counts as raw arrays."""
    shard = shard_of(keys, shards) if shard is None else shard
    order = np.argsort(shard, kind="stable")
    keys, counts = keys[order], counts[order]
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(full.astype(np.int32)),
            pa.array([keys[cut[s] : cut[s + 1]].tobytes() for s in full], pa.binary()),
            pa.array([counts[cut[s] : cut[s + 1]].astype(np.uint32).tobytes() for s in full], pa.binary()),
        ],
        schema=PACKED,
    )


class Gather:
    """Keys of a task, summed and passed on whenever there are FLUSH of them."""

    def __init__(self, shards: int, most: int = FLUSH):
        self.shards, self.most, self.parts, self.n = shards, most, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(keys)
        self.n += len(keys)
        if self.n >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            keys, counts = summed(np.concatenate(self.parts))
            self.parts, self.n = [], 0
            yield packed(keys, counts, self.shards)


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys and counts of a shard, summed."""
    keys = np.frombuffer(b"".join(x.as_py() for x in table["keys"]), np.uint64)
    counts = np.frombuffer(b"".join(x.as_py() for x in table["counts"]), np.uint32).astype(np.int64)
    return summed(keys, counts)


def shards_for(docs: DataFrame, text: str = "text", each: int = 1 << 24) -> int:
    """Shards such that each holds the distinct words of about `each` bytes of text at most."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // each))
