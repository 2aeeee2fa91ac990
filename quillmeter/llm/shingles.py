"""Word shingles of whole texts as sorted 64-bit hashes, vectorised over the bytes of many texts.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D, A-Z lower-cased. A text's set
holds its distinct five-word shingles; a text of fewer words has the whole sequence as its only
shingle; a text without words has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 250_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (two multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    data = np.frombuffer(b"".join(x for t in texts for x in (t, b" ")), np.uint8)
    word = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(start, bounds))
    if not len(start):
        return np.zeros(0, np.uint64), counts
    lengths = end - start
    own = data[word]
    own = np.where((own >= 65) & (own <= 90), own + 32, own)
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(own)) - np.repeat(begins, lengths)
    powers = np.full(int(lengths.max()), _BASE)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.add.reduceat(_BYTE[own] * powers[place], begins)
    return mix(sums + lengths.astype(np.uint64) * _PLACE[WORDS]), counts


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    n = len(words)
    joined = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        joined += words[k : k + len(joined)] * _PLACE[k]
    joined = mix(joined)
    out, at = [], 0
    for c in counts.tolist():
        if c >= WORDS:
            out.append(np.unique(joined[at : at + c - WORDS + 1]))
        elif c:
            short = words[at : at + c]
            out.append(mix((short * _PLACE[:c]).sum(keepdims=True, dtype=np.uint64) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def slices(texts: list[bytes]):
    """Ranges of texts of about SLICE_BYTES each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
