"""Evaluation texts that leak into training text (problem 7).

Each task puts its training texts into shards and sorts all suffixes of a shard, whole, down to the end of their text.
The suffix arrays are written to the shared folder once and serve any number of test sets.  Every suffix of the
evaluation texts is looked up in every shard by binary search; from the places found the longest verbatim passages follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.words import WORD, Hasher
from foliomill.session import materialize

#: Consecutive words that make a leak.
LEAST_WORDS = 12
#: Words of training text in one suffix array (memory of a task: about 80 bytes a word when it is built).
SHARD_WORDS = 1_000_000
#: Words of evaluation texts that are sent to the tasks at once; more are processed in further blocks.
BLOCK_WORDS = 400_000
#: Hits that are followed at once.
HITS_AT_ONCE = 1_000_000

_INDEX = "ids binary, begins binary, vocabulary binary, tokens binary, places binary, words long, suffixes long"


class Tests:
    """One block of evaluation texts as hashed words: every suffix of at least ``least`` words is a query."""

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        words, counts = Hasher()([text for _, text in items])
        self.ids, self.least = np.array([i for i, _ in items], dtype=np.int64), least
        self.vocabulary, at = np.unique(words, return_inverse=True)
        # each text is followed by a place without a word
        ends = np.cumsum(counts)
        self.words = np.insert(at.astype(np.int64), ends, -1) if len(items) else np.zeros(0, np.int64)
        self.starts = ends - counts + np.arange(len(items))
        many = np.maximum(0, counts - least + 1)
        self.item_of = np.repeat(np.arange(len(items)), many)
        self.queries = np.repeat(self.starts, many) + np.arange(len(self.item_of)) - np.repeat(np.cumsum(many) - many, many)

    def in_shard(self, vocabulary: np.ndarray) -> np.ndarray:
        """The words as numbers of a shard (from 1); -1 for words that it doesn't hold and for ends."""
        if not len(vocabulary) or not len(self.vocabulary):
            return np.full(len(self.words), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(vocabulary, self.vocabulary), len(vocabulary) - 1)
        known = np.append(np.where(vocabulary[at] == self.vocabulary, at + 1, -1), -1)
        return known[self.words]


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Start places of all suffixes in order; a suffix ends with its text, behind which stands a 0.

    The first three words of each suffix are sorted at once; then only suffixes that are still equal are compared further, by
    the ranks of what follows them, over twice as many words each time.  Equal suffixes stay in the order of their places.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, dtype=np.int64)
    t = np.concatenate([tokens.astype(np.int64), np.zeros(3, np.int64)])
    left = np.flatnonzero(tokens == 0)
    left = (left if len(left) and left[-1] == n - 1 else np.append(left, n))
    rest = np.repeat(left, np.diff(np.append(-1, left)))[:n] - np.arange(n)  # words up to the end of the text
    first, second = t[:n], np.where(rest > 1, t[1 : n + 1], 0)
    third = np.where(rest > 2, t[2 : n + 2], 0)
    if int(t.max()) < 1 << 21:
        key = (first << 42) | (second << 21) | third
        order = np.argsort(key, kind="stable")
        new = np.ones(n, dtype=bool)
        new[1:] = key[order][1:] != key[order][:-1]
    else:
        order = np.lexsort((third, second, first))
        new = np.ones(n, dtype=bool)
        new[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0) | (np.diff(third[order]) != 0)
    slots = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    width = 3
    while True:
        # runs of equal suffixes that go on behind the words compared so far
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(slots)))
        on = np.repeat(size > 1, size) & (rest[order[slots]] >= width)
        slots = slots[on]
        if not len(slots):
            return order[int((tokens == 0).sum()) :]
        place = order[slots]
        own, following = rank[place], rank[place + width]
        by = np.lexsort((following, own))
        place, own, following = place[by], own[by], following[by]
        order[slots] = place
        new = np.ones(len(slots), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (following[1:] != following[:-1])
        rank[place] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        width *= 2


def search(tokens: np.ndarray, array: np.ndarray, tests: np.ndarray, queries: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix the range of the suffix array that shares its first ``least`` words (binary search for all at once)."""
    padded = np.concatenate([tokens, np.zeros(least, tokens.dtype)])
    wanted = tests[queries[:, None] + np.arange(least)]

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), len(array), dtype=np.int64)
        while True:
            on = np.flatnonzero(lo < hi)
            if not len(on):
                return lo
            mid = (lo[on] + hi[on]) // 2
            there = padded[array[mid][:, None] + np.arange(least)]
            unlike = there != wanted[on]
            first = unlike.argmax(axis=1)
            rows = np.arange(len(on))
            equal = ~unlike[rows, first]
            below = (there[rows, first] < wanted[on][rows, first]) | (equal & upper)
            lo[on[below]] = mid[below] + 1
            hi[on[~below]] = mid[~below]

    return bound(False), bound(True)


def _follow(tokens: np.ndarray, tests: np.ndarray, place: np.ndarray, at: np.ndarray, known: int) -> np.ndarray:
    """How many words the texts have in common from each pair of places on (``known`` of them for certain)."""
    length, live, step = np.full(len(place), known, dtype=np.int64), np.arange(len(place)), 16
    padded = np.concatenate([tokens, np.zeros(step, tokens.dtype)])
    asked = np.concatenate([tests, np.full(step, -1, tests.dtype)])
    while len(live):
        i, j = np.minimum(place[live] + length[live], len(tokens)), np.minimum(at[live] + length[live], len(tests))
        unlike = padded[i[:, None] + np.arange(step)] != asked[j[:, None] + np.arange(step)]
        whole = ~unlike.any(axis=1)
        length[live] += np.where(whole, step, unlike.argmax(axis=1))
        live = live[whole]
    return length


def passages(tokens: np.ndarray, array: np.ndarray, vocabulary: np.ndarray, tests: Tests, at_once: int = HITS_AT_ONCE) -> Iterator[tuple[np.ndarray, ...]]:
    """Longest verbatim passages of one shard: item (its index), place in the tests, place in the shard, words."""
    words, least = tests.in_shard(vocabulary), tests.least
    unknown = np.concatenate([[0], np.cumsum(words < 0)])
    can = unknown[tests.queries + least] == unknown[tests.queries]  # a suffix with a word that the shard lacks matches nowhere
    queries, item_of = tests.queries[can], tests.item_of[can]
    if not len(queries) or not len(array):
        return
    lo, hi = search(tokens, array, words, queries, least)
    n = hi - lo
    queries, item_of, lo, n = (v[n > 0] for v in (queries, item_of, lo, n))
    # each suffix's hits in blocks; what can be extended to the left is part of a longer passage that begins there
    before = np.concatenate([[0], tokens])
    ahead = np.concatenate([[-1], words])
    done = 0
    total = np.concatenate([[0], np.cumsum(n)])
    while done < total[-1]:
        stop = min(total[-1], done + at_once)
        hit = np.arange(done, stop)
        which = np.searchsorted(total, hit, side="right") - 1
        place, at = array[lo[which] + hit - total[which]], queries[which]
        begins = before[place] != ahead[at]
        place, at, which = place[begins], at[begins], which[begins]
        yield item_of[which], at, place, _follow(tokens, words, place, at, least)
        done = stop


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs (2, 3 or 4)."""
    most = int(numbers.max(initial=0))
    size = 2 if most < 1 << 16 else 3 if most < 1 << 24 else 4
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size]).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.int64)
    out = np.zeros((n, 4), dtype=np.uint8)
    out[:, : len(data) // n] = np.frombuffer(data, dtype=np.uint8).reshape(n, -1)
    return out.view("<u4").ravel().astype(np.int64)


def _build(batches: Iterator[pd.DataFrame], shard_words: int) -> Iterator[pd.DataFrame]:
    """Suffix arrays of one task's texts, one row a shard."""
    hasher, ids, parts, total = Hasher(), [], [], 0

    def shard() -> pd.DataFrame:
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        vocabulary, at = np.unique(np.concatenate(parts), return_inverse=True)
        tokens = np.insert(at.astype(np.int64) + 1, np.cumsum(lengths), 0)  # 0 stands behind each text
        array = suffix_array(tokens)
        begins = np.cumsum(lengths + 1) - lengths - 1
        return pd.DataFrame(
            {
                "ids": [np.array(ids, dtype=np.int64).tobytes()], "begins": [begins.tobytes()], "vocabulary": [vocabulary.tobytes()],
                "tokens": [_pack(tokens)], "places": [_pack(array)], "words": [len(tokens)], "suffixes": [len(array)],
            }
        )

    for batch in batches:
        keep = [(d, t) for d, t in zip(batch["doc_id"], batch["text"], strict=True) if t and not pd.isna(d)]
        words, counts = hasher([t for _, t in keep])
        for (doc, _), part in zip(keep, np.split(words, np.cumsum(counts)[:-1]), strict=True) if keep else ():
            if not len(part):
                continue
            ids.append(doc)
            parts.append(part)
            total += len(part)
            if total >= shard_words:
                yield shard()
                ids, parts, total = [], [], 0
    if parts:
        yield shard()


def suffix_index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Suffix arrays of the texts of (doc_id, text), one row a shard, kept in the shared folder for :func:`search_index`.

    Words are runs of letters and digits, in lower case.  Null and empty texts, texts without a word and rows without
    id are left out; a text longer than ``shard_words`` gets a suffix array of its own; an empty table gives no shard.
    """
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(lambda b: _build(b, shard_words), _INDEX), "suffixes")


def _search_shards(batches: Iterator[pd.DataFrame], tests: Tests) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            tokens, array = _unpack(row.tokens, row.words), _unpack(row.places, row.suffixes)
            ids, begins = np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.begins, dtype=np.int64)
            for item, at, place, words in passages(tokens, array, np.frombuffer(row.vocabulary, dtype=np.uint64), tests):
                doc = np.searchsorted(begins, place, side="right") - 1
                yield pd.DataFrame(
                    {"doc_id": ids[doc], "item_id": tests.ids[item], "doc_word": place - begins[doc], "item_word": at - tests.starts[item], "words": words}
                )


def search_index(index: DataFrame, items: DataFrame, least: int = LEAST_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All longest verbatim passages of ``items`` (item_id, text) in an index of :func:`suffix_index`.

    Output: ``doc_id, item_id, doc_word, item_word, words`` (places counted in words from 0), of at least ``least`` words each.

    The evaluation texts are the stated query set: they are sent to the tasks in blocks of at most ``block_words``
    words (a longer text is a block of its own), each block one pass over the suffix arrays.
    """
    spark = index.sparkSession
    blocks: list[list[tuple[int, str]]] = [[]]
    room = block_words
    for row in items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id").toLocalIterator():
        n = len(WORD.findall(row["text"]))
        if n > room and blocks[-1]:
            blocks.append([])
            room = block_words
        blocks[-1].append((row["item_id"], row["text"]))
        room -= n
    found: DataFrame | None = None
    for block in blocks:
        sent = spark.sparkContext.broadcast(Tests(block, least))
        hits = index.mapInPandas(lambda batches, sent=sent: _search_shards(batches, sent.value), "doc_id long, item_id long, doc_word long, item_word long, words long")
        found = hits if found is None else found.unionByName(hits)
    return found


def leaked_passages(
    docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """:func:`search_index` over a fresh index of ``docs`` (doc_id, text).

    Null and empty texts and texts with fewer than ``least`` words hold no passage; rows without id are left out; repeated
    rows give repeated passages; empty tables give no rows; other columns are ignored.
    """
    return search_index(suffix_index(docs, shard_words), items, least, block_words)


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Which items leaked into which documents: distinct ``doc_id, item_id``."""
    return leaked_passages(docs, items, least).select("doc_id", "item_id").distinct()


def without_leaks(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The documents that hold no passage of any item, with all their columns."""
    bad = leaked_passages(docs, items, least).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_leaked"], "left_anti")


__all__ = ["LEAST_WORDS", "leaked_passages", "leaks", "search_index", "suffix_index", "without_leaks"]
