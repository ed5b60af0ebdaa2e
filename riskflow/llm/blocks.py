"""Texts of an Arrow batch as flat byte arrays: word bounds, line bounds and substring hashes in numpy.

A block holds whole documents (at most ``limit`` bytes together, or one longer document), so
that the memory of a task depends on the block size and on the longest single text.
A null text counts as an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskflow.session import checkpoint_dir

BLOCK_BYTES = (2 << 20) - 2  # the tables of powers then have 2 ** 21 entries

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z

_BASE = 0x9E3779B97F4A7C15  # odd and 5 modulo 8: powers differ in their low bits
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (the splitmix64 constants)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Prefix:
    """Prefix hashes of a byte array; ``sub`` hashes substrings [s, e) in constant time each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _powers(1 << max(16, int(n + 1).bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=self.sums[1:])

    def sub(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.sums[e] - self.sums[s]) * self.down[s])


@dataclass
class Block:
    data: np.ndarray  # uint8
    off: np.ndarray  # int64, n + 1
    cols: dict[str, pa.Array]

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.off[i]:self.off[i + 1]].tobytes()

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """True bytes of the mask in each document."""
        return between(mask, self.off[:-1], self.off[1:])


def between(mask: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[e] - sums[s]


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls are empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if not len(col) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    for batch in batches:
        data, off = flat(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield Block(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo],
                        {c: batch.column(c).slice(lo, hi - lo) for c in batch.schema.names if c != text})
            lo = hi


def words(b: Block, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of non-separators; runs end with the document."""
    solid = ~space[b.data]
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    full = b.off[1:] > b.off[:-1]
    before[b.off[:-1][full]] = False
    after[b.off[1:][full] - 1] = False
    s, e = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return s, e, np.repeat(np.arange(b.n), np.diff(np.searchsorted(s, b.off)))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the key occurs more than once; the key occurred earlier."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    many = same.copy()
    many[:-1] |= same[1:]
    out, late = np.empty_like(many), np.empty_like(many)
    out[order], late[order] = many, same
    return out, late


def stored(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet in the shared checkpoint folder and read it: what follows does not depend on executors' disks."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``stored``, once nothing reads them any more."""
    for df in tables:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        at = jvm.org.apache.hadoop.fs.Path(df.stored_path)
        at.getFileSystem(sc.hadoopConfiguration()).delete(at, True)
