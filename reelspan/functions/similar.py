"""Upper bounds of the Ratcliff-Obershelp ratio for many pairs of texts at once.

The characters that a ratio counts as matched are a common subsequence, and the
characters two texts share. Both bounds hold for every pair, so that a pair they
leave out can't reach the ratio.
"""

from __future__ import annotations

import numpy as np

#: A signature has so many words of 64 bits.
WORDS = 8


class Forms:
    """Texts side by side: characters in one row, lengths, and a signature of each text.

    A signature has a bit for each character and the number of its kind before
    it; ``spill`` counts those whose bit another one of the text has already.
    """

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(texts)), self.length)
        order = np.lexsort((self.flat, owner))
        char, owner = self.flat[order].astype(np.uint64), owner[order]
        new = np.ones(len(char), dtype=bool)
        new[1:] = (char[1:] != char[:-1]) | (owner[1:] != owner[:-1])
        starts = np.nonzero(new)[0]
        nth = (np.arange(len(char)) - np.repeat(starts, np.diff(np.append(starts, len(char))))).astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (char * np.uint64(1_000_003) + nth) * np.uint64(0x9E3779B97F4A7C15)
        bit = (mixed >> np.uint64(40)) % np.uint64(64 * WORDS)
        self.signature = np.zeros((len(texts), WORDS), dtype=np.uint64)
        np.bitwise_or.at(self.signature, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        self.spill = (self.length - np.bitwise_count(self.signature).sum(axis=1)).astype(np.int32)


def shared(queries: Forms, low: int, high: int, texts: Forms) -> np.ndarray:
    """For the queries from ``low`` to ``high`` and every text, no less than the characters both have."""
    most = np.minimum(queries.spill[low:high, None], texts.spill[None, :])
    for w in range(WORDS):
        most += np.bitwise_count(queries.signature[low:high, None, w] & texts.signature[None, :, w])
    return most


def subsequence(queries: list[str], texts: Forms, q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair (queries[q], texts[t]), bit-parallel over the query."""
    words = -(-max(1, *map(len, queries)) // 64)
    number = np.zeros(0x110000, dtype=np.int32)
    chars = sorted(set("".join(queries)))
    number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    place = np.zeros((words, len(chars) + 1, len(queries)), dtype=np.uint64)
    for k, text in enumerate(queries):
        for at, c in enumerate(text):
            place[at >> 6, number[ord(c)], k] |= np.uint64(1 << (at & 63))
    code = number[texts.flat]
    order = np.argsort(-texts.length[t], kind="stable")
    who, start, length = q[order], texts.first[t[order]], texts.length[t[order]]
    left = np.full((words, len(order)), ~np.uint64(0))
    for at in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -at, side="left"))  # longer than ``at``
        here, carry = code[start[:n] + at], np.zeros(n, dtype=np.uint64)
        for w in range(words):
            same, v = place[w, here, who[:n]], left[w, :n]
            hit = v & same
            total = v + hit
            over = total < v
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            left[w, :n] = total | (v & ~same)
    found = np.empty(len(order), dtype=np.int64)
    found[order] = np.bitwise_count(~left).sum(axis=0)
    return found
