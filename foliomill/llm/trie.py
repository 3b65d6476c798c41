"""Levenshtein automata run against a vocabulary trie, for many words at once."""

from __future__ import annotations

import numpy as np


class Trie:
    """A vocabulary as a trie in flat arrays: children of a node lie next to each other."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted(set(words))
        self.code = {c: i + 1 for i, c in enumerate(sorted({c for w in self.words for c in w}))}
        chars, first, last, ends = [0], [0], [0], [-1]
        # breadth first: each entry is a node with the range of words below it
        level, depth = [(0, 0, len(self.words))], 0
        while level:
            following = []
            for node, lo, hi in level:
                if lo < hi and len(self.words[lo]) == depth:
                    ends[node] = lo
                    lo += 1
                first[node] = len(chars)
                while lo < hi:
                    c, up = self.words[lo][depth], lo
                    while up < hi and self.words[up][depth] == c:
                        up += 1
                    following.append((len(chars), lo, up))
                    chars.append(self.code[c])
                    first.append(0)
                    last.append(0)
                    ends.append(-1)
                    lo = up
                last[node] = len(chars)
            level, depth = following, depth + 1
        self.chars, self.first, self.last, self.ends = (np.array(v, dtype=np.int32) for v in (chars, first, last, ends))

    def within(self, words: list[str], most: int = 2, block: int = 512) -> dict[str, list[str]]:
        """All vocabulary words within ``most`` edits of each word (complete, in the vocabulary's order)."""
        found: dict[str, list[str]] = {w: [] for w in words}
        by_length: dict[int, list[str]] = {}
        for w in found:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            for a in range(0, len(group), block):
                part = group[a : a + block]
                coded = np.array([[self.code.get(c, -1) for c in w] for w in part], dtype=np.int32).reshape(len(part), length)
                for s, v in self._intersect(coded, most):
                    found[part[s]].append(self.words[v])
        return found

    def _intersect(self, coded: np.ndarray, most: int) -> list[tuple[int, int]]:
        n, length = coded.shape
        out: list[tuple[int, int]] = [(i, int(self.ends[0])) for i in range(n)] if self.ends[0] >= 0 and length <= most else []  # the empty word
        node, who = np.zeros(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        state = np.tile(np.minimum(np.arange(length + 1), most + 1).astype(np.int8), (n, 1))
        depth = 0
        while len(node):
            count = self.last[node] - self.first[node]
            at = np.repeat(np.arange(len(node)), count)
            child = np.repeat(self.first[node], count) + (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count))
            depth += 1
            low, high = max(0, depth - most), min(length, depth + most)
            if low > length or not len(at):
                break
            who, old, char = who[at], state[at], self.chars[child]
            new = np.full((len(at), length + 1), most + 1, dtype=np.int8)
            if low == 0:
                new[:, 0] = min(depth, most + 1)
            target = coded[who]
            for j in range(max(1, low), high + 1):
                step = old[:, j - 1] + (target[:, j - 1] != char)
                new[:, j] = np.minimum(np.minimum(step, np.minimum(old[:, j], new[:, j - 1]) + 1), most + 1)
            live = new[:, low : high + 1].min(axis=1) <= most
            node, who, state = child[live].astype(np.int32), who[live], new[live]
            hit = np.flatnonzero((self.ends[node] >= 0) & (state[:, length] <= most))
            out += zip(who[hit].tolist(), self.ends[node[hit]].tolist(), strict=True)
        return out
