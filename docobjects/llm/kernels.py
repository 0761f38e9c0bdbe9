"""Vectorised byte kernels shared by the operators that run on Arrow batches.

Texts of a batch lie end to end in one byte buffer; tokens, hashes and shingles are
found with whole-array operations, so no Python code runs per document or per word.
"""

from __future__ import annotations

import ctypes
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
#: Bytes that separate words: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes whose words are hashed at once.
SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over uint64, so that every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base & MASK, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, dtype=U64)

    def _table(self, base: int, n: int) -> np.ndarray:
        out = np.full(n, U64(base))
        out[0] = 1
        return np.multiply.accumulate(out)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 1 << 16)
            self._up, self._down = self._table(self.base, size), self._table(self.inverse, size)
        return self._up, self._down


POWERS = Powers()


def prefix_hash(data: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """P with P[j]-P[i] = sum of (data[k]+1)*base**k for i <= k < j, modulo 2**64."""
    up, _ = powers.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Polynomial hashes of data[start:end], independent of where they stand."""
    _, down = powers.upto(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and int64 offsets, len(column)+1 of them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Gives freed memory back to the system: a Python worker outlives its task, and its memory counts as the executor's."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def blocks(batch: pa.RecordBatch, text: str, most: int):
    """Slices of a batch whose texts hold at most `most` bytes (a longer text is alone in its slice)."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    _, offs = text_bytes(column)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end
    release()


class Tokens:
    """Words of a block of texts: start and end bytes, document index, 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        self.offsets, self.n_docs = offsets, len(offsets) - 1
        n = len(data)
        word = ~SPACE[data]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)  # of each document, and the total
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            out, i = np.empty(len(self.start), dtype=U64), 0
            while i < len(out):  # slice by slice, so that the prefix sums stay small
                low = int(self.start[i])
                j = max(i + 1, int(np.searchsorted(self.end, low + SLICE, side="right")))
                out[i:j] = range_hash(prefix_hash(self.data[low : self.end[j - 1]]), self.start[i:j] - low, self.end[i:j] - low)
                i = j
            self._hash = mix(out + (self.end - self.start).astype(U64) * U64(0xD6E8FEB86659FD93))
        return self._hash

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def shingles(tokens: Tokens, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes as (document index, hash), sorted by both; a text with fewer words has its
    whole sequence as one shingle, a text without words has none."""
    h, n = tokens.hash, len(tokens.hash)
    acc = np.zeros(max(n - k + 1, 0), dtype=U64)
    for j in range(k):
        if len(acc):
            acc = acc * U64(BASE) + h[j : n - k + 1 + j]
    doc = tokens.doc[: len(acc)]
    fits = doc == tokens.doc[k - 1 :] if len(acc) else np.zeros(0, bool)
    value, doc = mix(acc[fits]), doc[fits]
    short = np.flatnonzero((tokens.count > 0) & (tokens.count < k))
    if len(short):
        extra = []
        for d in short:
            x = int(tokens.count[d])
            for t in h[tokens.first[d] : tokens.first[d + 1]]:
                x = (x * BASE + int(t)) & MASK
            extra.append(x)
        value = np.concatenate([value, mix(np.array(extra, dtype=U64))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], value[new]


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; the bytes of equal significance lie together, so small numbers cost little."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<cBq", a.dtype.kind.encode(), a.dtype.itemsize, len(a)))
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if a.dtype.itemsize > 1 else a.tobytes())
    return _PACK.compress(b"".join(head + body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = _UNPACK.decompress(blob)
    (count,), at, kinds = struct.unpack_from("<B", raw), 1, []
    for _ in range(count):
        kinds.append(struct.unpack_from("<cBq", raw, at))
        at += 10
    out = []
    for kind, width, n in kinds:
        planes = np.frombuffer(raw, dtype=np.uint8, count=width * n, offset=at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(np.dtype(f"{kind.decode()}{width}")))
        at += width * n
    return out


def gaps(sorted_values: np.ndarray) -> np.ndarray:
    """Differences of a sorted uint64 array; np.cumsum restores it."""
    return np.diff(sorted_values, prepend=U64(0)) if len(sorted_values) else sorted_values


def narrow(a: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds these counts."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def crc_mod5(ids) -> np.ndarray:
    """crc32 of each id written as text, modulo 5; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 5 for i in ids], dtype=np.int64)


def home_key(block: str, keys: int) -> int:
    """The range that carries a block's own documents through a shuffle: blocks spread evenly over all ranges."""
    return zlib.crc32(block.encode()) % keys
