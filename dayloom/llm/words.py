"""Words and hashes of many texts at once, on NumPy arrays.

A word is a run of ASCII letters, digits and non-ASCII characters in lower case. Words are hashed
from the bytes of the joined texts by prefix sums: with an odd base, the sum over a word times the
inverse power of its start doesn't depend on where the word stands.
"""

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

#: Texts are worked on in lots of about this many characters; a longer one is a lot of its own.
LOT = 500_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: a random number, and whether it belongs to a word."""
    inside = np.zeros(256, bool)
    inside[128:] = True
    for first, last in ("09", "az", "AZ"):
        inside[ord(first) : ord(last) + 1] = True
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)), inside


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * LOT:
            _POWERS[base] = have
    return have[:n]


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's way to hand free memory back, which keeps up to 64 MB; nothing where it has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def gives_back(run: Callable) -> Callable:
    """A function for `mapInArrow` whose batches' memory goes back to the system when its task ends.

    A Python worker lives on after its task, beside those of other tasks, and Arrow's pool and the C
    library would keep what the largest batches and arrays took.
    """

    @wraps(run)
    def returning(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        _trim()(0)

    return returning


def values(column: pa.Array, rows: int = 64) -> Iterator:
    """The values of a column in order, of which a few rows at a time are Python objects."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def lots(texts: Iterable[str | None], size: int = LOT) -> Iterator[list[str]]:
    """The texts in order, NULL as empty, in lots of about `size` characters."""
    lot, n = [], 0
    for t in texts:
        t = t or ""
        if lot and n + len(t) > size:
            yield lot
            lot, n = [], 0
        lot.append(t)
        n += len(t)
    if lot:
        yield lot


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of every word, in order."""
    coded = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    values, inside = _byte_values()
    edge = np.diff(inside[data].view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.cumsum(values[data] * _powers(_BASE, len(data)))
    before = np.where(starts > 0, sums[np.maximum(starts - 1, 0)], np.uint64(0))
    hashes = mix((sums[ends - 1] - before) * _powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    stops = np.cumsum([len(c) + 1 for c in coded])
    return np.searchsorted(stops, starts, side="right"), hashes


def shingles(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of every run of `width` words; a shorter text is one run of all its words."""
    doc, words = word_hashes(texts)
    if not len(words):
        return doc, words
    n = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    weights = _powers(0xC2B2AE3D27D4EB4F, width + 1)[1:]
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = np.zeros(len(words), np.uint64)
    # Words of the next document don't count, which matters for texts shorter than a run.
    left = (first + n)[doc] - np.arange(len(words))
    for j in range(width):
        total += np.where(left > j, padded[j : j + len(words)] * weights[j], np.uint64(0))
    full = (left >= width) | ((n[doc] < width) & (np.arange(len(words)) == first[doc]))
    return doc[full], mix(total[full] + np.minimum(n[doc[full]], width).astype(np.uint64))


def occurrences(doc: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) sorted by both, where the j-th copy of an item in a document has a hash of its own.

    Bags become sets this way: two bags share as many of these hashes as the sum of the smaller counts.
    """
    order = np.lexsort((items, doc))
    doc, items = doc[order], items[order]
    if not len(doc):
        return doc, items
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (items[1:] != items[:-1])])
    at = np.arange(len(doc))
    copy = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return doc, mix(items + copy * np.uint64(0xA0761D6478BD642F))
