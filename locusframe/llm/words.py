"""Words as arrays: places, hashes and hashes of runs of words, without a Python object for each word."""

from __future__ import annotations

import numpy as np

#: Bytes of white space, as in [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes whose words are hashed at once.
CHUNK = 1 << 20

_rng = np.random.default_rng(19)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[SPACE] = 0


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _weight(place: np.ndarray) -> np.ndarray:
    """An odd number for each place in a word, however far: places don't repeat."""
    return mix64((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


#: The weights of the first places, which nearly all bytes have.
_PLACE = _weight(np.arange(256))


def _weights(place: np.ndarray) -> np.ndarray:
    out = _PLACE[np.minimum(place, _PLACE.size - 1)]
    if (far := np.flatnonzero(place >= _PLACE.size)).size:
        out[far] = _weight(place[far])
    return out


def places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of bytes."""
    inside = np.zeros(data.size + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; chunk by chunk, as the arrays in between are 8 times as large as the text."""
    out = np.empty(starts.size, np.uint64)
    lo = 0
    while lo < starts.size:
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK, "right")))
        a, b = starts[lo], ends[hi - 1]
        at = starts[lo:hi] - a
        sizes = np.diff(np.append(at, b - a))
        place = np.arange(b - a) - np.repeat(at, sizes)
        h = np.add.reduceat(_BYTE[data[a:b]] * _weights(place), at)
        out[lo:hi] = mix64(h + (ends[lo:hi] - starts[lo:hi]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        lo = hi
    return out


def run_hashes(words: np.ndarray, k: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """A hash of each run of k words: n - k + 1 of them, none where there are fewer words. By doubling, so k counts by its logarithm."""
    if words.size < k:
        return np.zeros(0, np.uint64)
    n = words.size - k + 1
    out, have, power, size, q = None, 0, words, 1, base
    while size <= k:
        if k & size:
            part = power[have : have + n]
            out = part if out is None else out * np.uint64(q) + part
            have += size
        if size * 2 <= k:
            power = power[:-size] * np.uint64(q) + power[size:]
        size, q = size * 2, q * q % (1 << 64)
    return mix64(out)


class Words:
    """The words of several texts. doc: the first word of each text, and the number of all words."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        buffer = b"\n".join([*texts, b""])
        self.data = np.frombuffer(buffer, np.uint8)
        if lower:
            self.data = LOWER[self.data]
        self.starts, self.ends = places(self.data)
        at = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.doc = np.searchsorted(self.starts, at)
        self.hashes = word_hashes(self.data, self.starts, self.ends)

    def __iter__(self):
        """Each text's hashes of words."""
        for a, b in zip(self.doc[:-1], self.doc[1:]):
            yield self.hashes[a:b]


def slices(texts: list[bytes], most: int = 4 << 20):
    """Ranges of texts of most bytes together, one text at least."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)
