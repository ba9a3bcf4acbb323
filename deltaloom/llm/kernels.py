"""Words and word windows of many texts at once, as arrays.

A word is a run of bytes other than ASCII white space. Words and windows are known by 64-bit hashes: words by a
polynomial over random byte values, windows by a sum of word hashes times random odd numbers, both mixed.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
BYTE = _RANDOM.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
PLACE = _RANDOM.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 2**64))
HASH_BYTES = 1 << 21
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, by doubling."""
    out = []
    for b in (BASE, INVERSE):
        p = np.empty(n, U)
        p[0] = 1
        have, step = 1, b
        while have < n:
            more = min(have, n - have)
            p[have : have + more] = p[:more] * step
            have, step = have + more, U(int(step) * int(step) % 2**64)
        out.append(p)
    return out[0], out[1]


@dataclass
class Words:
    """Words of a list of texts: hashes, byte places in the joined buffer, and the first word of each text."""

    buffer: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one longer than the texts
    doc: np.ndarray

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash at each word of the window that starts there, and whether it ends in the same text."""
        n = len(self.hashes) - length + 1
        if n <= 0:
            return np.empty(0, U), np.empty(0, bool)
        h = np.zeros(n, U)
        with np.errstate(over="ignore"):
            for j in range(length):
                h += self.hashes[j : j + n] * PLACE[j % 256]
            h = mix(h + U(length))
        return h, self.doc[:n] == self.doc[length - 1 :]


def words_of(texts: list[bytes], with_hashes: bool = True) -> Words:
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    return Words(buffer, _word_hashes(buffer, starts, ends) if with_hashes else np.empty(0, U), starts, ends, first, doc)


def _word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words by stretches of about HASH_BYTES, so that the tables of powers stay small."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + HASH_BYTES, "right")))
        part = buffer[base : ends[upto - 1]]
        power, inverse = _powers(max(HASH_BYTES, len(part)))
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, U), np.cumsum(BYTE[part] * power[: len(part)], dtype=U)))
            s, e = starts[at:upto] - base, ends[at:upto] - base
            out[at:upto] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U))
        at = upto
    return out


def in_doc_sums(flags: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Sum over the bytes of each text of a value per byte of the joined buffer."""
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def by_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum over the words of each text of a value per word."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def spread(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of the given length that starts at one of starts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, n), -1)
    return np.cumsum(change)[:n] > 0


def encoded(texts: list[str | None], lower: bool = False) -> list[bytes]:
    """UTF-8 bytes; null as empty; A-Z lower-cased where asked for."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    return [t.lower() for t in raw] if lower else raw
