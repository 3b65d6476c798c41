"""Near-duplicate texts (problem 5) with a token-group matrix.

Texts become sets of hashed word shingles (tokens); equal sets are one class.  Classes are partitioned into small groups of
similar ones: range-partitioned and sorted by a minimum hash of their rarest tokens and by size, together while bitmaps are close.  The matrix holds one row
for each group: the union of the tokens that lead its members (so many of each set's rarest that no partner can miss them),
a bitmap of each member's whole set, and the least and greatest size.  Groups then ask each other: the overlap of the asking
group's and the asked group's unions is summed over their tokens, and only where the sum can reach what the sizes demand the
two are opened; groups whose bitmaps differ too much don't even meet, or each frequent token would send as many pairs as it
has texts, squared.  The members that the same bounds leave are compared exactly.
The rest of a set, behind its leading tokens, isn't written anywhere: at 100 shingles a text it is several times the input.

Tokens are ordered rarest first by counters of fixed size, and where a counter holds more noise than signal by the
frequencies of the token's words, which don't depend on how much text there is.  The order decides about cost only.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.words import Hasher, mix
from foliomill.session import lookup_side, materialize, release

#: Counters of the frequency sketch: a fixed size (one byte each when sent to the tasks), whatever the number of texts.
SKETCH_BITS, SKETCH_BLOCKS = 24, 64
#: Words whose frequencies are sent to the tasks, at most (the most frequent ones; all others count as rarer).
WORDS = 1_000_000
#: How often a counter's average must fit into it for the counter to say something about the token.
NOISE = 3.0
#: Classes and tokens of a group, at most (one class may have more tokens); with more, a run of similar classes makes several groups.
GROUP_CLASSES, GROUP_TOKENS = 64, 100_000
#: Rows of one key (groups of a token, ids of a class) beyond which the key is dealt to a grid of tasks.
HOT_ROWS = 4_096
#: Pairs that a task makes at once.
PAIRS_AT_ONCE = 2_000_000
#: Classes of a task whose tokens are remembered as sent, at most.
REMEMBERED = 1_000_000


class Sketch:
    """Frequency classes of tokens: 1 for a single text, then four classes to each doubling; 0 for a token not counted."""

    def __init__(self, counters: np.ndarray, noise: float, words: np.ndarray, frequency: np.ndarray, total: float) -> None:
        """counters: class of each counter; noise: average of a counter; words, frequency: of the most frequent words, sorted by word."""
        self.bits = int(math.log2(len(counters)))
        self.counters, self.noise = counters, 1 + 4 * math.log2(max(1.0, NOISE * noise)) if noise > 0.6 else 1.0
        self.words, self.total = words, math.log2(max(total, 1.0))
        self.share = np.log2(np.maximum(frequency, 1)) - math.log2(max(float(frequency.sum()), 1.0)) if len(words) else np.zeros(0)
        self.rare = float(self.share.min()) if len(words) else 0.0

    def level(self, tokens: np.ndarray) -> np.ndarray:
        return self.counters[_bucket(tokens, self.bits)]

    def order(self, tokens: np.ndarray, level: np.ndarray, words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
        """Order of tokens (rarest first) as numbers from 0 to 255, equal for equal tokens; 0: in a single text for certain.

        first: place of each token's first word in ``words``.
        """
        key = np.where(level <= 1, 0, 63 + np.minimum(level, 192).astype(np.int64))
        vague = np.flatnonzero((level > 1) & (level <= self.noise)) if self.noise > 1 and len(self.words) else np.zeros(0, np.int64)
        if len(vague):
            asked = words[first[vague][:, None] + np.arange(width)]
            at = np.minimum(np.searchsorted(self.words, asked), len(self.words) - 1)
            share = np.where(self.words[at] == asked, self.share[at], self.rare).sum(axis=1)
            key[vague] = np.minimum(key[vague], np.clip(np.floor(64 + 4 * (share + self.total)), 1, 255)).astype(np.int64)
        return key


class Shingler:
    """Token sets of whole batches; with a sketch each set is in the global order: rarest first, then by hash."""

    def __init__(self, width: int, sketch: Sketch | None = None) -> None:
        self.width, self.sketch, self.hasher = width, sketch, Hasher()

    def bag(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]:
        """All tokens of all texts with their text's row, repeated ones too, the number of texts, the words and each token's first word."""
        words, counts = self.hasher(texts)
        row = np.repeat(np.arange(len(counts)), counts)
        n = len(words) - self.width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), len(counts), words, np.zeros(0, np.int64)
        whole = np.flatnonzero(row[:n] == row[self.width - 1 :])
        return mix(*[words[i : n + i] for i in range(self.width)])[whole], row[whole], len(counts), words, whole

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens of all texts in order, whether each stands in a single text for certain, and how many each text has."""
        token, doc, n, words, first = self.bag(texts)
        key = self.sketch.order(token, self.sketch.level(token), words, first, self.width) if self.sketch else np.ones(len(token), np.int64)
        order = np.lexsort((token, (doc << 8) | key))
        token, doc, key = token[order], doc[order], key[order]
        keep = np.ones(len(token), dtype=bool)
        keep[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        return token[keep], key[keep] == 0, np.bincount(doc[keep], minlength=n)


def _bucket(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame], width: int, bits: int) -> Iterator[pd.DataFrame]:
    """One task's counters in compressed blocks, and how often it saw each word."""
    shingler, total = Shingler(width), np.zeros(1 << bits, dtype=np.uint32)
    seen, often, some = np.zeros(0, np.uint64), np.zeros(0, np.int64), False

    def words() -> pd.DataFrame:
        return pd.DataFrame({"block": -1, "counts": None, "word": seen.view(np.int64), "n": often})

    for batch in batches:
        tokens, _, _, ws, _ = shingler.bag(batch["text"].tolist())
        if not len(ws):
            continue
        some = True
        total += np.bincount(_bucket(tokens, bits), minlength=len(total)).astype(np.uint32)
        w, n = np.unique(ws, return_counts=True)
        both, at = np.unique(np.concatenate([seen, w]), return_inverse=True)
        seen, often = both, np.bincount(at, weights=np.concatenate([often, n]), minlength=len(both)).astype(np.int64)
        if len(seen) > 2_000_000:
            yield words()
            seen, often = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if some:
        yield words()
        for i, part in enumerate(np.split(total, SKETCH_BLOCKS)):
            yield pd.DataFrame({"block": [i], "counts": [zlib.compress(part.astype(np.uint64).tobytes(), 1)], "word": [None], "n": [int(part.sum())]})


def _add(batches: Iterator[pd.DataFrame], last: bool) -> Iterator[pd.DataFrame]:
    """Sums of the blocks, which come sorted, one block after another; ``last``: as frequency classes."""
    at, total, n = None, None, 0

    def whole() -> pd.DataFrame:
        counts = total
        if last:
            counts = np.where(total == 0, 0, np.minimum(255, 1 + np.floor(4 * np.log2(np.maximum(total, 1)) + 1e-9))).astype(np.uint8)
        return pd.DataFrame({"block": [at], "counts": [zlib.compress(counts.tobytes(), 1)], "n": [n]})

    for batch in batches:
        for block, counts, m in zip(batch["block"], batch["counts"], batch["n"], strict=True):
            more = np.frombuffer(zlib.decompress(counts), dtype=np.uint64)
            if at != block:
                if at is not None:
                    yield whole()
                at, total, n = block, np.zeros(len(more), dtype=np.uint64), 0
            total += more
            n += m
    if at is not None:
        yield whole()


def frequency_sketch(texts: DataFrame, width: int, bits: int = SKETCH_BITS, words: int = WORDS) -> Sketch:
    """How many texts hold each token, as a class of a counter that it shares with others (never too small), and the word frequencies."""
    rows = materialize(texts.select("text").mapInPandas(lambda b: _count(b, width, bits), "block int, counts binary, word long, n long"), "counts")
    blocks = rows.where("block >= 0").select("block", "counts", "n")
    for parts in (32, 1):  # in two steps, so that no task adds up the counters of all others
        if parts > 1:
            blocks = blocks.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts))).repartition("block", "part").sortWithinPartitions("block", "part")
        else:
            blocks = blocks.repartition("block").sortWithinPartitions("block")
        blocks = blocks.select("block", "counts", "n").mapInPandas(lambda b, last=parts == 1: _add(b, last), "block int, counts binary, n long")
    counters, total = np.zeros((SKETCH_BLOCKS, (1 << bits) // SKETCH_BLOCKS), dtype=np.uint8), 0
    for r in blocks.collect():
        counters[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint8)
        total += r["n"]
    del blocks
    known = rows.where("block < 0").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(words).toPandas()
    release(texts.sparkSession, rows)
    word = known["word"].to_numpy(dtype=np.int64).view(np.uint64)
    by = np.argsort(word)
    return Sketch(counters.ravel(), total / (1 << bits), word[by], known["n"].to_numpy(dtype=np.float64)[by], float(total))


def _probe(size: np.ndarray, t: float) -> np.ndarray:
    """How many leading tokens a set needs so that none of its partners can be missed."""
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def _signature(tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set, whatever the order of its tokens."""
    with np.errstate(over="ignore"):
        mixed = mix(tokens, np.full(len(tokens), 7, np.uint64))
        return (np.add.reduceat(mixed, np.cumsum(size) - size) ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def _bitmap(tokens: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """256 bits of each set: every token turns one over; sets differ in at least as many tokens as their bits differ."""
    turned = np.bincount((row << 8) | (tokens & np.uint64(255)).astype(np.int64), minlength=n << 8)
    return np.packbits((turned & 1).astype(np.uint8).reshape(n, 256), axis=1)


def _unlike(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """In how many bits the numbers of two bitmaps differ (as unsigned ones: of a negative number its absolute value would count)."""
    return sum(np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64) for x, y in zip(a, b, strict=True))


#: Bytes of a leading token in the matrix.
TOKEN_BYTES = 5


def _pack(tokens: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, 8 - TOKEN_BYTES :])


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // TOKEN_BYTES, 8), dtype=np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view(np.int64).ravel()


_HEAD = "id long, sig long, size int, seed long, alone int, lead binary"


def _heads(batches: Iterator[pa.RecordBatch], shingler: Shingler, t: float, hot: int) -> Iterator[pa.RecordBatch]:
    """Per text: class signature, size, group seed (minimum hash of the leading tokens), bitmap and leading tokens as bytes.

    A token that stands in no other text for certain can't be shared, so it is left out (it counts in the size).  Classes
    without another leading token have no partner and no bytes here; nor have texts whose class the task has sent before.
    The last bit of a token says whether its counter allows more than the hot number of texts.
    """
    sent: set[int] = set()
    for batch in batches:
        tokens, alone, sizes = shingler(batch.column(1).to_pylist())
        rows = np.flatnonzero(sizes)
        if not len(rows):
            continue
        size = sizes[rows]
        start = np.cumsum(size) - size
        sig = _signature(tokens, size)
        row = np.repeat(np.arange(len(rows)), size)
        place = np.arange(len(tokens)) - start[row]
        lead = (place < _probe(size, t)[row]) & ~alone
        seed = np.minimum.reduceat(np.where(lead, mix(tokens, np.full(len(tokens), 11, np.uint64)), np.uint64(2**64 - 1)), start).view(np.int64)
        edge = np.concatenate([[0], np.cumsum(np.add.reduceat(lead.astype(np.int64), start))])
        leading = tokens[lead]
        marked = np.where(shingler.sketch.level(leading) >= hot, leading | np.uint64(1 << 24), leading & ~np.uint64(1 << 24))
        packed, bits = _pack(marked), _bitmap(tokens, row, len(rows))
        if len(sent) > REMEMBERED:
            sent.clear()
        blobs: list[bytes | None] = []
        for i, (s, a, b) in enumerate(zip(sig.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            if b > a and s not in sent:
                sent.add(s)
                blobs.append(bits[i].tobytes() + packed[a:b].tobytes())
            else:
                blobs.append(None)
        single = np.add.reduceat(alone.astype(np.int64), start).astype(np.int32)
        ints = [pa.array(v) for v in (sig, size.astype(np.int32), seed, single)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *ints, pa.array(blobs, pa.binary())], names=["id", "sig", "size", "seed", "alone", "lead"])


_GROUP = "grp long, least int, most int, tokens binary, behind array<int>, f0 long, f1 long, radius int, sigs array<long>, sizes array<int>, b0 array<long>, b1 array<long>, b2 array<long>, b3 array<long>"


def _groups(batches: Iterator[pa.RecordBatch], t: float, classes: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of the matrix from classes sorted by seed, size and signature: a group is a run of one seed with at most
    ``classes`` classes and ``most`` leading tokens whose sizes and bitmaps could still be similar to the first's.

    f0, f1: the first's bitmap at half the width; radius: in how many bits of it the others differ at most."""
    before = None
    for batch in batches:
        if not len(batch):
            continue
        sig, size, seed, alone = (batch.column(i).to_numpy() for i in range(4))
        fresh = np.ones(len(sig), dtype=bool)
        fresh[1:] = sig[1:] != sig[:-1]
        fresh[0] = sig[0] != before  # several tasks may have sent a class
        before = sig[-1]
        kept = np.flatnonzero(fresh)
        if not len(kept):
            continue
        blobs = batch.column(4).take(pa.array(kept)).to_pylist()
        held = np.array([(len(b) - 32) // TOKEN_BYTES for b in blobs])
        group, g, first, count, many, apart = np.zeros(len(kept), dtype=np.int64), -1, None, 0, 0, (1 - t) / (1 + t)
        for n, (s, z, h, b) in enumerate(zip(seed[kept].tolist(), size[kept].tolist(), held.tolist(), blobs, strict=True)):
            if (
                first is None or s != first[0] or z * t > first[1] + 1e-9 or count == classes or many + h > most
                or (int.from_bytes(b[:32]) ^ int.from_bytes(first[2])).bit_count() > apart * (z + first[1]) + 1e-9
            ):
                g, first, count, many = g + 1, (s, z, b[:32]), 0, 0
            count, many = count + 1, many + h
            group[n] = g
        token = _unpack(b"".join(b[32:] for b in blobs))
        bits = np.frombuffer(b"".join(b[:32] for b in blobs), dtype=np.uint8).reshape(-1, 32)
        of = np.repeat(group, held)
        by = np.lexsort((token, of))
        new = np.ones(len(by), dtype=bool)
        new[1:] = (token[by][1:] != token[by][:-1]) | (of[by][1:] != of[by][:-1])
        union = np.ascontiguousarray(token[by][new].view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES])
        begin = np.searchsorted(of[by][new], np.arange(g + 2))
        edge = np.searchsorted(group, np.arange(g + 2))
        n = size[kept]
        # how many tokens stand behind each token of a union, in the member where most do
        row = np.repeat(np.arange(len(kept)), held)
        place = alone[kept][row] + np.arange(len(token)) - (np.cumsum(held) - held)[row]
        behind = np.maximum.reduceat((n[row] - place - 1)[by], np.flatnonzero(new)).astype(np.int32)
        words = np.ascontiguousarray(bits).view(np.int64)  # four numbers; the halves together are the bitmap of half the width
        fold = [words[:, i] ^ words[:, i + 2] for i in range(2)]
        radius = np.maximum.reduceat(_unlike(fold, [f[edge[:-1]][group] for f in fold]), edge[:-1]).astype(np.int32)
        cut = lambda values: pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(values))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(sig[kept][edge[:-1]]), pa.array(np.minimum.reduceat(n, edge[:-1])), pa.array(np.maximum.reduceat(n, edge[:-1])),
                pa.array([union[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(behind)),
                *[pa.array(f[edge[:-1]]) for f in fold], pa.array(radius), cut(sig[kept]), cut(n), *[cut(np.ascontiguousarray(words[:, i])) for i in range(4)],
            ],
            names=[x.split()[0] for x in _GROUP.split(", ")],
        )


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each token of each group's union: token, grp, bounds (least and greatest size), tokens behind it, whether it may be hot, bitmap and radius."""
    for batch in batches:
        blobs = batch.column(3).to_pylist()
        token = _unpack(b"".join(blobs))
        row = np.repeat(np.arange(len(blobs)), [len(b) // TOKEN_BYTES for b in blobs])
        bounds = (batch.column(1).to_numpy().astype(np.int64) << 32) + batch.column(2).to_numpy()
        columns = [pa.array(token >> 1), pa.array(batch.column(0).to_numpy()[row]), pa.array(bounds[row]), batch.column(4).flatten(), pa.array((token & 1).astype(bool))]
        columns += [pa.array(batch.column(i).to_numpy()[row]) for i in (5, 6, 7)]
        yield pa.RecordBatch.from_arrays(columns, names=["token", "grp", "bounds", "behind", "hot", "f0", "f1", "radius"])


def _meetings(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Pairs of groups that share a token, from rows sorted by token and cell; in a hot token's cell askers (role 1, 3) meet the asked (2, 3).

    Left out are pairs whose sizes can't be similar, tokens behind which too little is left for an overlap that begins with
    them, and pairs whose members' bitmaps all differ in more bits than similar sets in tokens.  need: the least overlap that makes members of the two groups similar; behind: what is left behind the token.
    """
    columns = ["token", "cell", "role", "grp", "bounds", "behind", "f0", "f1", "radius"]
    carry: list[np.ndarray] | None = None

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, cell, role, grp, bounds, behind, f0, f1, radius = rows
        least, most = bounds >> 32, bounds & 0xFFFFFFFF
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])
        begin = np.flatnonzero(new)
        width = np.diff(np.append(begin, len(token)))
        own = np.repeat(np.arange(len(begin)), width)
        many = np.where(width[own] > 1, width[own], 0)  # each row meets all rows of its run
        edge = np.cumsum(many)
        at = 0
        while at < len(token):
            end = max(at + 1, int(np.searchsorted(edge, (edge[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            a = np.repeat(np.arange(at, end), many[at:end])
            b = begin[own[a]] + np.arange(len(a)) - np.repeat(np.cumsum(many[at:end]) - many[at:end], many[at:end])
            # a grid holds each pair in both orders, a plain run in one of them
            ok = (grp[a] < grp[b]) & (role[a] & 1 > 0) & (role[b] & 2 > 0)
            a, b = a[ok], b[ok]
            p, q = np.maximum(least[a], np.ceil(t * least[b] - 1e-9)), np.maximum(least[b], np.ceil(t * least[a] - 1e-9))
            need, left = np.ceil(t / (1 + t) * (p + q) - 1e-9), np.minimum(behind[a], behind[b])
            ok = (p <= most[a]) & (q <= most[b]) & (1 + left >= need)
            unlike = _unlike((f0[a], f1[a]), (f0[b], f1[b])) - radius[a] - radius[b]
            ok &= unlike <= (1 - t) / (1 + t) * (most[a] + most[b]) + 1e-9
            a, b, need, left = a[ok], b[ok], need[ok].astype(np.int32), left[ok].astype(np.int32)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (grp[a], grp[b], need, left)], names=["grp", "other", "need", "behind"])
            at = end

    for batch in batches:
        rows = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
        if not len(rows[0]):
            continue
        if carry is not None:
            rows = [np.concatenate([c, r]) for c, r in zip(carry, rows, strict=True)]
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])  # the last run may go on in the next batch
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        carry = [r[cut:] for r in rows]
        if cut:
            yield from pairs([r[:cut] for r in rows])
    if carry is not None:
        yield from pairs(carry)


def _sets(batches: Iterator[pd.DataFrame], shingler: Shingler) -> Iterator[pd.DataFrame]:
    """The whole sets of wanted classes (of ids with several texts only the wanted one)."""
    for batch in batches:
        tokens, _, sizes = shingler(batch["text"].tolist())
        rows = np.flatnonzero(sizes)
        if not len(rows):
            continue
        sig = _signature(tokens, sizes[rows])
        parts = np.split(tokens.view(np.int64), np.cumsum(sizes[rows])[:-1])
        right = sig == batch["sig"].to_numpy()[rows]
        yield pd.DataFrame({"sig": sig[right], "tokens": [p for p, ok in zip(parts, right, strict=True) if ok]})


def _grid(rows: DataFrame, key: str, by: str, hot: DataFrame | None, left: bool) -> DataFrame:
    """Rows with ``cell``: those of a hot key (``key``, ``side``) are dealt by ``by`` to one line of a grid of side x side cells, so that
    each pair of rows meets in one cell; all others have the cell 0."""
    if hot is None:
        return rows.withColumn("cell", F.lit(0))
    own = F.pmod(F.xxhash64(by), F.col("side"))
    line = F.sequence(F.lit(0), F.col("side") - 1)
    cells = F.transform(line, (lambda i: own * F.col("side") + i) if left else (lambda i: i * F.col("side") + own))
    return rows.join(hot, key, "left").withColumn("cell", F.explode(F.when(F.col("side").isNull(), F.array(F.lit(0))).otherwise(cells.cast("array<int>")))).drop("side")


def _hot(counts: DataFrame, key: str, limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows (``key, n``), with the side of their grid; None if there is none."""
    found = materialize(counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("side")), "hot")
    n = found.count()  # no more than the rows counted, divided by the limit
    return lookup_side(found, n) if n else None


def meet(many: DataFrame, few: DataFrame, key: str, by: str, limit: int, counted: DataFrame | None = None) -> DataFrame:
    """Join on ``key``; rows of ``many`` whose key has more than ``limit`` of them are dealt by ``by``, and the key's rows of ``few`` go to each part.

    counted: rows of which the keys are counted, if not those of ``many``.
    """
    hot = _hot((many if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, limit)
    if hot is None:
        return many.join(few, key)
    part = F.when(F.col("side").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("side"))).cast("int")
    dealt = many.join(hot, key, "left").withColumn("part", part).drop("side")
    spread = few.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("side", F.lit(1)) - 1))).drop("side")
    return dealt.join(spread, [key, "part"]).drop("part")


class Similar:
    """Similar classes of a table of texts: ``members`` (id, sig) and ``pairs`` (sig_a, sig_b, similarity)."""

    def __init__(self, texts: DataFrame, width: int = 5, threshold: float = 0.8, hot_rows: int = HOT_ROWS, bits: int = SKETCH_BITS, words: int = WORDS,
                 group_classes: int = GROUP_CLASSES, group_tokens: int = GROUP_TOKENS) -> None:
        """texts: ``id`` bigint, ``text``; a Jaccard similarity of ``threshold`` or more makes a pair.

        Null and empty texts and texts with fewer than ``width`` words have no set and no partner.  Rows repeated with
        the same id and text count once; one id with several texts belongs to several classes.  Rows without id are left
        out, other columns ignored; an empty table has no members.  ``hot_rows``: rows of one key from which it is dealt
        to a grid of tasks.
        """
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be in (0, 1]")
        spark, t = texts.sparkSession, threshold
        self.hot_rows = hot_rows
        base = texts.select(F.col("id").cast("long").alias("id"), "text").where("id IS NOT NULL AND text IS NOT NULL")
        sent = spark.sparkContext.broadcast(frequency_sketch(base, width, bits, words))
        hot_class = 1 + int(4 * math.log2(max(2, hot_rows)))
        heads = materialize(base.mapInArrow(lambda b: _heads(b, Shingler(width, sent.value), t, hot_class), _HEAD), "heads")
        self.members = materialize(heads.select("id", "sig").distinct(), "members")
        groups = materialize(
            heads.where("lead IS NOT NULL").select("sig", "size", "seed", "alone", "lead")
            .repartitionByRange("seed", "size", "sig").sortWithinPartitions("seed", "size", "sig")
            .mapInArrow(lambda b: _groups(b, t, group_classes, group_tokens), _GROUP).select(*[F.col(x.split()[0]) for x in _GROUP.split(", ")]), "groups",
        )
        release(spark, heads)
        cells = groups.select("grp", "least", "most", "tokens", "behind", "f0", "f1", "radius").mapInArrow(_cells, "token long, grp long, bounds long, behind int, hot boolean, f0 long, f1 long, radius int")
        # only tokens whose counter allows it are counted to find those that too many groups hold
        hot = _hot(cells.where("hot").groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token", hot_rows)
        shown = ["token", "grp", "bounds", "behind", "f0", "f1", "radius"]
        cells = cells.select(*shown)
        if hot is None:
            laid = cells.repartition("token").sortWithinPartitions("token").withColumn("cell", F.lit(0)).withColumn("role", F.lit(3))
        else:
            own, side = F.pmod(F.xxhash64("grp"), F.col("side")).cast("int"), F.col("side")
            at = lambda cell, role: F.struct(cell.cast("int").alias("cell"), F.lit(role).alias("role"))
            others = F.filter(F.sequence(F.lit(0), side - 1), lambda i: i != own)
            grid = F.concat(F.array(at(own * side + own, 3)), F.transform(others, lambda i: at(own * side + i, 1)), F.transform(others, lambda i: at(i * side + own, 2)))
            laid = cells.join(hot, "token", "left").select(*shown, F.explode(F.when(side.isNull(), F.array(at(F.lit(0), 3))).otherwise(grid)).alias("x"))
            laid = laid.select(*shown, "x.cell", "x.role").repartition("token", "cell").sortWithinPartitions("token", "cell")
        met = laid.mapInArrow(lambda b: _meetings(b, t), "grp long, other long, need int, behind int").groupBy("grp", "other").agg(
            F.max("need").alias("need"), F.count(F.lit(1)).alias("m"), F.min("behind").alias("low"), F.max("behind").alias("high")
        )
        # of one member each, the tokens counted and those behind the last of them are all that can be shared; of several
        # members the last token needn't be the pair's, so only what stands behind the first is certain
        single = lambda key, name: groups.where(F.size("sigs") > 1).select(F.col("grp").alias(key), F.lit(True).alias(name))
        met = opened = materialize(met.where(F.col("m") + F.col("high") >= F.col("need")), "met")
        crowded = groups.where(F.size("sigs") > 1).select("grp").count()
        for key, name in (("grp", "x"), ("other", "y")):
            opened = opened.join(lookup_side(single(key, name), crowded), key, "left")
        opened = materialize(opened.where(F.col("x").isNotNull() | F.col("y").isNotNull() | (F.col("m") + F.col("low") >= F.col("need"))).select("grp", "other"), "opened")
        release(spark, met)
        # the groups' members; of a pair of groups those that sizes and bitmaps leave
        bits = [f"b{i}" for i in range(4)]
        classes = groups.select("grp", F.explode(F.arrays_zip("sigs", "sizes", *bits)).alias("x")).select("grp", F.col("x.sigs").alias("sig"), F.col("x.sizes").alias("size"), *[f"x.{b}" for b in bits])
        asked = classes.select(F.col("grp").alias("other"), F.col("sig").alias("osig"), F.col("size").alias("osize"), *[F.col(b).alias(f"o{b}") for b in bits])
        across = meet(meet(opened, classes, "grp", "other", hot_rows), asked, "other", "sig", hot_rows).drop("grp", "other")
        names = ["sigs", "sizes", *bits]
        of = lambda i, prefix: [F.get(n, i).alias(prefix + n.removesuffix("s")) for n in names]
        twos = groups.where(F.size("sigs") > 1).select(*names, F.posexplode("sigs").alias("i", "_i")).select(*names, "i", F.posexplode("sigs").alias("j", "_j")).where("i < j")
        within = twos.select(*of(F.col("i"), ""), *of(F.col("j"), "o"))
        unlike = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"o{b}"))) for b in bits), F.lit(0))
        total = F.col("size") + F.col("osize")
        allowed = (F.least("size", "osize") >= F.lit(t) * F.greatest("size", "osize") - 1e-9) & ((total - unlike) / 2 >= F.lit(t / (1 + t)) * total - 1e-9)
        candidates = materialize(across.unionByName(within).where(allowed & (F.col("sig") != F.col("osig"))).select("sig", F.col("osig").alias("other"), F.col("size").alias("q"), F.col("osize").alias("s")), "candidates")
        release(spark, groups, opened)
        # the exact check: whole sets of the classes that are left, made from one text each
        wanted = candidates.select("sig").union(candidates.select("other")).distinct()
        chosen = self.members.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("id").alias("id"))
        sets = materialize(base.join(lookup_side(chosen), "id").select("sig", "text").mapInPandas(lambda b: _sets(b, Shingler(width)), "sig long, tokens array<long>").dropDuplicates(["sig"]), "sets")
        shared = F.size(F.array_intersect("a", "b"))
        checked = meet(meet(candidates, sets.select("sig", F.col("tokens").alias("a")), "sig", "other", hot_rows), sets.select(F.col("sig").alias("other"), F.col("tokens").alias("b")), "other", "sig", hot_rows, candidates)
        self.pairs = materialize(
            checked.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.col("q") + F.col("s") - F.col("shared"))).where(F.col("similarity") >= F.lit(t) - 1e-12)
            .select(F.least("sig", "other").alias("sig_a"), F.greatest("sig", "other").alias("sig_b"), "similarity").dropDuplicates(["sig_a", "sig_b"]), "similar",
        )
        release(spark, candidates, sets)

    def point_pairs(self) -> DataFrame:
        """Every pair of ids with similar or equal sets, ``id_a < id_b``, distinct.

        Ids of a class with many copies are dealt to tasks, where the pairs of the class go to each of them.
        """
        ids = lambda name, sig: self.members.select(F.col("id").alias(name), F.col("sig").alias(sig))
        unlike = meet(ids("x", "sig_a"), self.pairs.select("sig_a", "sig_b"), "sig_a", "x", self.hot_rows).select("x", "sig_b")
        unlike = meet(ids("y", "sig_b"), unlike, "sig_b", "y", self.hot_rows).select("x", "y")
        counts = self.members.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
        hot = _hot(counts, "sig", self.hot_rows)
        repeated = self.members.join(counts.where("n > 1").select("sig"), "sig", "left_semi")
        left = _grid(repeated.select(F.col("id").alias("x"), "sig"), "sig", "x", hot, True)
        right = _grid(repeated.select(F.col("id").alias("y"), "sig"), "sig", "y", hot, False)
        alike = left.join(right, ["sig", "cell"]).where("x < y").select("x", "y")
        return unlike.where("x <> y").unionByName(alike).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

    def groups(self) -> DataFrame:
        """One row per id: ``id, group_id`` (smallest id that similar classes connect it with), ``copies`` (ids of its class), ``links`` (similar other classes)."""
        edges = self.pairs.select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b"))
        label = connect(edges, self.hot_rows)
        links = edges.select("a").union(edges.select(F.col("b"))).groupBy(F.col("a").alias("sig")).agg(F.count(F.lit(1)).alias("links"))
        classes = self.members.groupBy("sig").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
        known = classes.join(label, "sig", "left").join(links, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        first = known.groupBy("label").agg(F.min("least").alias("group_id"))
        told = known.join(first, "label").select("sig", "group_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
        return meet(self.members, told, "sig", "id", self.hot_rows).groupBy("id").agg(F.min("group_id").alias("group_id"), F.max("copies").alias("copies"), F.max("links").alias("links"))


def connect(edges: DataFrame, hot_rows: int = HOT_ROWS, rounds: int | None = None) -> DataFrame:
    """Connected components of ``a, b``: ``sig, label`` (smallest connected node), by alternating large and small stars.

    Each round is written to the shared folder; rounds grow with the logarithm of the nodes.  No edges give no rows.
    If the stars still change after ``rounds`` (by default many more than are needed) an error is raised.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    size = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    before = size(current)
    for _ in range(4 * (2 + math.ceil(math.log2(before["n"] + 2))) if rounds is None else rounds):
        least = both(current).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = meet(both(current), least, "a", "b", hot_rows).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "stars")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = meet(large, lower, "a", "b", hot_rows).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        current = materialize(small.where("a <> b").distinct(), "stars")
        now = size(current)
        if now == before:
            nodes = current.select(F.col("a").alias("sig"), F.col("b").alias("label"))
            return nodes.groupBy("sig").agg(F.min("label").alias("label"))
        before = now
    raise RuntimeError("connected components haven't converged")


def similar_points(texts: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Distinct pairs ``id_a < id_b`` of the rows (id, text) whose shingle sets have at least ``threshold`` of their union in common."""
    return Similar(texts, width, threshold).point_pairs()


__all__ = ["Similar", "connect", "meet", "similar_points"]
