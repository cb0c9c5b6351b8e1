"""Hashes of words and word sequences for many texts at once, in arrays.

Texts are lower-cased and split at ASCII white space. A word's hash comes from prefix sums of
byte * P**position modulo 2**64, so a batch of texts needs no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
P_INVERSE = pow(P, -1, 1 << 64)
BATCH_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Powers:
    """P**i and P**-i up to the longest batch met so far."""

    def __init__(self):
        self.up, self.down = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = powers(P, n), powers(P_INVERSE, n)
        return self.up, self.down

    def __reduce__(self):
        return Powers, ()  # tasks make their own


POWERS = Powers()


#: By byte: 0 white space, 1 letters, digits and all beyond ASCII, 2 marks.
KINDS = np.full(256, 2, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = 0
KINDS[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1


def word_hashes(texts: list[str], split_marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (and the end).

    With split_marks, runs of letters and runs of marks are words of their own.
    """
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    encoded = [x.lower().encode("utf-8", "replace") for x in texts]
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in encoded])
    kind = KINDS[data] if split_marks else KINDS[data] != 0
    changes = np.flatnonzero(kind[1:] != kind[:-1]) + 1  # data ends with white space
    edges = np.concatenate([[0], changes])
    starts = edges[kind[edges] != 0]
    stops = changes[kind[changes - 1] != 0]  # the byte after each word
    up, down = POWERS(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    hashes = mixed((sums[stops] - sums[starts]) * down[starts])
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])


def sequence_hashes(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within each text; a shorter text is one run of its words."""
    total = len(hashes)
    sizes = np.diff(offsets)
    end = np.repeat(offsets[1:], sizes)
    first = np.repeat(offsets[:-1], sizes)
    at = np.arange(total)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        inside = at + k < end
        word = np.zeros(total, np.uint64)
        word[: total - k] = hashes[k:] if k else hashes
        out += np.where(inside, word * np.uint64(2 * k + 1) ^ (word >> np.uint64(k + 1)), np.uint64(0))
    begins = (at + n <= end) | (at == first)
    counts = np.where(sizes > 0, np.maximum(sizes - n + 1, 1), 0)
    return mixed(out[begins]), np.concatenate([[0], np.cumsum(counts)])


def batches_of(texts: list[str | None], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The texts in order, in lists of about `limit` characters; a longer text is a list of its own."""
    some, held = [], 0
    for text in texts:
        text = text or ""
        if some and held + len(text) > limit:
            yield some
            some, held = [], 0
        some.append(text)
        held += len(text)
    if some:
        yield some


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The set of n-word shingles of each text, as sorted hashes; empty for a text without words."""
    for some in batches_of(texts):
        hashes, offsets = sequence_hashes(*word_hashes(some), n)
        for low, high in zip(offsets[:-1], offsets[1:], strict=True):
            yield np.unique(hashes[low:high])
