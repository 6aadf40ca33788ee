"""Words of Arrow text columns as numpy arrays: no Python object per text or word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
LONG = 512  # bytes of a string from which its hash is taken of the whole at once
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def spaced_words() -> np.ndarray:
    """256 flags: bytes of words between blanks."""
    inside = np.ones(256, bool)
    inside[list(SPACES)] = False
    return inside


def plain_words() -> np.ndarray:
    """256 flags, for lower-cased bytes: digits, a-z and every byte of a character beyond ASCII."""
    inside = np.zeros(256, bool)
    inside[0x30:0x3A] = inside[0x61:0x7B] = inside[0x80:] = True
    return inside


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each (nulls are empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out = off - off[0]
    if col.null_count:
        size = np.diff(off) * np.asarray(col.is_valid())
        keep = np.repeat(np.asarray(col.is_valid()), np.diff(off))
        return raw[off[0]:off[-1]][keep], np.concatenate([[0], np.cumsum(size)])
    return raw[off[0]:off[-1]], out


def blocks(offsets: np.ndarray, most: int):
    """Row ranges [i, j) whose texts hold about ``most`` bytes (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for key, b in (("up", _BASE), ("down", _BACK)):
            step = np.full(max(n, 1 << 20), b, np.uint64)
            step[0] = 1
            _POWERS[key] = np.multiply.accumulate(step)
    return _POWERS["up"], _POWERS["down"]


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end): eight bytes at a time, each scrambled together with what came before.

    No sum over positions, so no structured pair of strings (such as a Thue-Morse word and its complement) meets by algebra.
    """
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    size = (end - start).astype(np.int64)
    out = mixed(size.astype(np.uint64) * _STEP)
    for k in np.flatnonzero(size >= LONG):
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k]:end[k]].tobytes(), digest_size=8).digest(), "little")
    live = np.flatnonzero((size > 0) & (size < LONG))
    at, left = start[live].astype(np.int64), size[live]
    while len(live):
        block = eight[at]
        part = left < 8
        block[part] &= (np.uint64(1) << (left[part] * 8).astype(np.uint64)) - np.uint64(1)
        out[live] = mixed(out[live] * _STEP + block)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


class Words:
    """Words of a run of texts: start, end, doc (row of each word), first (words before each row), hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, hashed: bool = True):
        low = _LOWER[data]
        is_in = np.zeros(len(low) + 1, bool)
        is_in[1:] = inside[low]
        edge = is_in[1:] & ~is_in[:-1]
        stop = np.zeros(len(low) + 1, bool)
        stop[:-1] = ~is_in[1:] & is_in[:-1]
        stop[-1] = is_in[-1]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(low))]
        cut = np.unique(cut[is_in[cut] & is_in[cut + 1]]) if len(cut) else cut  # a word may not cross two texts
        edge[cut] = True
        stop[cut] = True
        self.low, self.start, self.end = low, np.flatnonzero(edge), np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        if hashed:
            self.hash = byte_hashes(low, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every n-word shingle; a text with 1 to n-1 words gives its whole sequence as one."""
    h = words.hash
    count = len(h)
    acc = np.zeros(max(count - n + 1, 0), np.uint64)
    for k in range(n):
        acc = mixed(acc * _STEP + h[k: k + len(acc)]) if len(acc) else acc
    doc = words.doc[: len(acc)]
    whole = doc == words.doc[n - 1: n - 1 + len(acc)] if len(acc) else np.zeros(0, bool)
    out, rows = acc[whole], doc[whole]
    sizes = np.diff(words.first)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = sizes[short] > k
            extra[has] = mixed(extra[has] * _STEP + h[words.first[short[has]] + k])
        extra = mixed(extra + sizes[short].astype(np.uint64))
        out, rows = np.concatenate([out, extra]), np.concatenate([rows, short])
    return out, rows


def word_hash(word: str) -> np.uint64:
    """Hash of one lower-case word, as Words gives it."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), np.ones(256, bool)).hash[0]
