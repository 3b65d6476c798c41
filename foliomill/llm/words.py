"""Words of texts as numbers, for whole Arrow batches at a time."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import xxhash

#: A word: a run of letters and digits.
WORD = re.compile(r"[^\W_]+")


class Hasher:
    """64-bit numbers of words, remembered between batches up to a bound on the remembered words."""

    def __init__(self, bound: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.bound = bound

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All words of the texts in order as numbers, and how many each text has.  Null and empty texts have none."""
        known, out, counts = self.known, [], np.zeros(len(texts), dtype=np.int64)
        if len(known) > self.bound:
            known.clear()
        for i, text in enumerate(texts):
            if not text:
                continue
            words = WORD.findall(text.lower())
            counts[i] = len(words)
            for w in words:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh64_intdigest(w)
                out.append(h)
        return np.array(out, dtype=np.uint64), counts


def mix(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit number of several columns of such numbers, order mattering."""
    total = np.zeros(len(parts[0]), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            total = (total ^ p) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
            total *= np.uint64(0xBF58476D1CE4E5B9)
            total ^= total >> np.uint64(32)
    return total
