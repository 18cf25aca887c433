"""Arrays as files in shared storage, memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, shared_dir


def _local(uri: str) -> str | None:
    """The path, if the storage is a file system that is mounted here."""
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def write(folder: str, kind: str, *arrays: np.ndarray) -> str:
    """Write arrays one after the other to a new file; a task that runs again writes another one."""
    name = f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}.bin"
    path = _local(name)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            for a in arrays:
                f.write(np.ascontiguousarray(a).data)
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(name)
        with store.open_output_stream(inner) as f:
            for a in arrays:
                f.write(np.ascontiguousarray(a).tobytes())
    return name


@lru_cache(maxsize=100_000)
def mapped(uri: str) -> np.ndarray:
    """The file's bytes, mapped into memory; a remote file through an unlinked local copy."""
    path = _local(uri)
    if path is not None:
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    with tempfile.NamedTemporaryFile() as f, store.open_input_stream(inner) as source:
        while part := source.read(1 << 24):
            f.write(part)
        f.flush()
        return np.memmap(f.name, np.uint8, "r") if f.tell() else np.zeros(0, np.uint8)


class SortedLongs:
    """A set of 64-bit integers as sorted files in shared storage, which workers map and search.

    Its size is bounded by storage alone: what tasks carry is a name for each ``PART`` values.
    """

    PART = 1 << 22

    def __init__(self, values: DataFrame, kind: str):
        """``values`` has one column of distinct non-null longs and is read twice: give a saved one."""
        name, n, folder = values.columns[0], values.count(), shared_dir(values.sparkSession, kind)
        many = n > self.PART
        ordered = values.repartitionByRange(-(-n // self.PART), name).sortWithinPartitions(name) if many else values.coalesce(1).sortWithinPartitions(name)

        def put(batches):
            parts = [b.column(0).to_numpy() for b in batches]
            v = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array([int(v[0])]), pa.array([write(folder, kind, v)])], names=["low", "uri"])

        files = sorted(map(tuple, arrow_map(ordered, put, "low long, uri string").collect()))
        self.low, self.uris = np.array([f[0] for f in files], np.int64), [f[1] for f in files]

    def __contains__(self, value: int) -> bool:
        return bool(self.has(np.array([value], np.int64))[0])

    def has(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), bool)
        part = np.searchsorted(self.low, values, side="right") - 1
        for p in np.unique(part[part >= 0]):
            of = np.flatnonzero(part == p)
            held = mapped(self.uris[p]).view(np.int64)
            at = np.searchsorted(held, values[of])
            out[of] = held[np.minimum(at, len(held) - 1)] == values[of]
        return out


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted 64-bit keys and 32-bit values, by planes of bytes so that zeros lie together.

    A value that 32 bits cannot hold is an error, not another value.
    """
    if any(len(v) and int(v.max()) > 0xFFFFFFFF for v in values):
        raise OverflowError("a count over 4,294,967,295 does not fit the packed arrays")
    out = [np.array([len(keys)], "<u8").tobytes()]
    delta = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    out.append(delta.view(np.uint8).reshape(-1, 8).T.tobytes())
    out += [v.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for v in values]
    return b"".join(out)


def unpack(blob, values: int) -> list[np.ndarray]:
    b = np.frombuffer(blob, np.uint8)
    n = int(b[:8].view("<u8")[0])
    keys = np.cumsum(np.ascontiguousarray(b[8 : 8 + 8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)
    out, at = [keys], 8 + 8 * n
    for _ in range(values):
        out.append(np.ascontiguousarray(b[at : at + 4 * n].reshape(4, n).T).view("<u4").ravel().astype(np.int64))
        at += 4 * n
    return out


def summed(keys: list[np.ndarray], values: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Distinct sorted keys, and each value's sums over equal keys."""
    k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(k, kind="stable")
    k = k[order]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return [k[head], *[np.add.reduceat(np.concatenate(v)[order], head) if len(k) else np.zeros(0, np.int64) for v in values]]
