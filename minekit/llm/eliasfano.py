"""Elias-Fano sequences over memory-mapped arrays, and files that hold named arrays."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np

#: Bits of a block of the zero directory.
BLOCK = 256
#: Position of the r-th one of a byte, at [byte, r].
_IN_BYTE = np.array([[p for p in range(8) if b >> p & 1] + [8] * (8 - b.bit_count()) for b in range(256)], np.int64)
_U = np.uint64


def select(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th one (from 0) of each 64-bit word; it must exist."""
    ones, high = _U(0x0101010101010101), _U(0x8080808080808080)
    s = words - ((words >> _U(1)) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    s = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * ones  # ones up to and with each byte
    r = r.astype(np.uint64)
    at = (np.bitwise_count(((r * ones | high) - s) & high) << np.uint8(3)).astype(np.uint64)  # bytes that end before it
    before = (s << _U(8)) >> at & _U(255)
    return at.astype(np.int64) + _IN_BYTE[(words >> at & _U(255)).astype(np.intp), (r - before).astype(np.intp)]


class EliasFano:
    """A rising sequence of unsigned 64-bit values with vectorised search.

    The low bits (a multiple of 8, whichever makes the whole smallest) are stored plainly, the
    high bits in unary: a one for each value, a zero at the end of each high value. The k-th
    zero is found by a directory of the zeros before each block.
    """

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.n, self.low_bytes, self.last = (int(x) for x in arrays["meta"])
        self.low, self.high, self.zeros = arrays["low"], arrays["high"], arrays["zeros"]
        self.words = self.high.view(np.uint64)
        self.ones = np.arange(len(self.zeros)) * BLOCK - self.zeros

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        values = np.asarray(values, np.uint64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        k = min(range(8), key=lambda b: (n * 8 * b + (last >> (8 * b)) if (last >> (8 * b)) < 64 * (n + 64) else 1 << 62 - b))
        upper = (values >> np.uint64(8 * k)).astype(np.int64)
        bits = n + int(upper[-1] if n else 0) + 2  # a zero behind the last value
        size = -(-bits // BLOCK) * BLOCK
        flags = np.zeros(size, bool)
        flags[upper + np.arange(n)] = True
        flags[bits:] = True  # no zeros behind the end
        low = np.zeros((n, k), np.uint8)
        for b in range(k):
            low[:, b] = (values >> np.uint64(8 * b)).astype(np.uint8)
        ones = flags.reshape(-1, BLOCK).sum(1, dtype=np.int64)
        zeros = np.concatenate([[0], np.cumsum(BLOCK - ones)])
        return {"meta": np.array([n, k, last], np.uint64), "low": low, "high": np.packbits(flags, bitorder="little"), "zeros": zeros}

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th zeros, from 0; all must exist."""
        block = np.searchsorted(self.zeros, k, "right") - 1
        left, at = k - self.zeros[block], block * (BLOCK // 64)
        for _ in range(BLOCK // 64 - 1):
            here = 64 - np.bitwise_count(self.words[at]).astype(np.int64)
            on = left >= here
            if not on.any():
                break
            left, at = np.where(on, left - here, left), at + on
        return at * 64 + select(~self.words[at], left)

    def _lows(self, at: np.ndarray) -> np.ndarray:
        rows, out = self.low[at], np.zeros(len(at), np.uint64)
        for b in range(self.low_bytes):
            out |= rows[:, b].astype(np.uint64) << np.uint64(8 * b)
        return out

    def find(self, keys: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of each key, -1 where it is absent; with lo and hi only indices in [lo, hi) are searched."""
        out = np.full(len(keys), -1, np.int64)
        keys = np.asarray(keys, np.uint64)
        inside = np.flatnonzero(keys <= self.last) if self.n else np.zeros(0, np.int64)
        if not len(inside):
            return out
        keys = keys[inside]
        high = (keys >> np.uint64(8 * self.low_bytes)).astype(np.int64)
        # a high value's entries lie between the zero before it and the next one, mostly in the same word
        bit = np.full(len(keys), -1, np.int64)
        some = high > 0
        bit[some] = self._select0(high[some] - 1)
        start, bit = bit + 1 - high, bit + 1
        rest = ~self.words[bit >> 6] >> (bit & 63).astype(np.uint64)
        end = start + np.bitwise_count((rest & (~rest + _U(1))) - _U(1))
        far = np.flatnonzero(rest == 0)
        if len(far):
            end[far] = self._select0(high[far]) - high[far]
        low = keys & np.uint64((1 << (8 * self.low_bytes)) - 1)
        if lo is not None and hi is not None:
            start, end = np.maximum(start, lo[inside]), np.minimum(end, hi[inside])
        stop = end.copy()
        while (open_ := np.flatnonzero(start < end)).size:
            mid = (start[open_] + end[open_]) >> 1
            less = self._lows(mid) < low[open_]
            start[open_] = np.where(less, mid + 1, start[open_])
            end[open_] = np.where(less, end[open_], mid)
        hit = start < stop
        hit[hit] = self._lows(start[hit]) == low[hit]
        out[inside[hit]] = start[hit]
        return out

    def get(self, index: np.ndarray) -> np.ndarray:
        """Values at rising or arbitrary indices (select of ones, by bisection over the zero directory)."""
        index = np.asarray(index, np.int64)
        block = np.searchsorted(self.ones, index, "right") - 1
        left, at = index - self.ones[block], block * (BLOCK // 64)
        for _ in range(BLOCK // 64 - 1):
            here = np.bitwise_count(self.words[at]).astype(np.int64)
            on = left >= here
            left, at = np.where(on, left - here, left), at + on
        upper = (at * 64 + select(self.words[at], left) - index).astype(np.uint64)
        return (upper << np.uint64(8 * self.low_bytes)) | self._lows(index)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays, written beside and moved into place, so that a repeated task does no harm."""
    files, path = _filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = [a.dtype.str, list(a.shape), at]
        at += -(-a.nbytes // 64) * 64
    spelt = json.dumps(head).encode()
    spelt = spelt.ljust(-(-(len(spelt) + 8) // 64) * 64 - 8)
    beside = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(beside) as f:
        f.write(len(spelt).to_bytes(8, "little") + spelt)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(b"\0" * (-a.nbytes % 64))
    files.move(beside, path)


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; a file of a remote store is mapped from a copy that has no name and goes with the process."""
    from pyarrow import fs

    files, path = _filesystem(uri)
    if not isinstance(files, fs.LocalFileSystem):
        with tempfile.NamedTemporaryFile() as copy:
            with files.open_input_stream(path) as f:
                while data := f.read(1 << 24):
                    copy.write(data)
            copy.flush()
            raw = np.memmap(copy.name, np.uint8, "r")
    else:
        raw = np.memmap(path, np.uint8, "r")
    raw = raw.view(np.ndarray)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head, base, out = json.loads(raw[8 : 8 + size].tobytes()), 8 + size, {}
    for name, (kind, shape, at) in head.items():
        count = int(np.prod(shape)) if shape else 1
        nbytes = count * np.dtype(kind).itemsize
        out[name] = raw[base + at : base + at + nbytes].view(kind).reshape(shape)
    return out


def named(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}


def part(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k.removeprefix(f"{prefix}."): v for k, v in arrays.items() if k.startswith(f"{prefix}.")}
