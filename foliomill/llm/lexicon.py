"""Repair of scanned texts with a vocabulary of any size (problem 1), which stays a table.

Records are dealt to blocks of bounded text.  A block is repaired with the answers it has and notes what it had to ask: words,
pairs of neighbours, candidates.  The questions of all blocks are answered by joins, those for candidates by Levenshtein
automata over one trie per shard of the vocabulary, until no block has an open question.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm import scans
from foliomill.llm.trie import Trie
from foliomill.session import materialize

#: Characters of a block, about; a longer text is a block of its own or shares one.
BLOCK_CHARS = 4_000_000
#: Words of a trie and words looked up in it by one task, about.
SHARD_WORDS, SHARD_ASKED = 200_000, 50_000
#: Words from this length on share a class; a word is looked up in the classes of lengths within reach.
LONGEST = 40

_ASKED = "block long, kind string, key string"
_ANSWERS = "block long, kind string, key string, n long, word string, confusions int, name boolean"


class Asked:
    """Counts known so far; what isn't known is noted and taken for ``default``."""

    def __init__(self, known: dict[str, int], default: int) -> None:
        self.known, self.default, self.open = known, default, set()

    def get(self, key: str, _: int = 0) -> int:
        if key not in self.known:
            self.open.add(key)
        return self.known.get(key, self.default)

    def __contains__(self, key: str) -> bool:
        return self.get(key) > 0


class AskingRepairer(scans.Repairer):
    """A repairer that knows the answers to a block's questions."""

    def __init__(self, answers: pd.DataFrame) -> None:
        of = {k: a for k, a in answers.groupby("kind")}
        counts = lambda kind: dict(zip(of[kind]["key"], of[kind]["n"].tolist(), strict=True)) if kind in of else {}
        self.words, self.pairs, self.parts = Asked(counts("word"), 1), Asked(counts("pair"), 0), Asked(counts("part"), 0)
        self.memory: dict[str, list[tuple[int, int, str]]] = {}
        self.names, self.open, self.fine = set(), set(), set()
        if "near" in of:
            a = of["near"]
            for key, n, word, confusions, name in zip(a["key"], a["n"], a["word"], a["confusions"], a["name"], strict=True):
                found = self.memory.setdefault(key, [])
                if isinstance(word, str):
                    found.append((int(confusions), -int(n), word))
                    if name:
                        self.names.add(word)
            for found in self.memory.values():
                found.sort()

    def wants(self, text: str) -> set[str]:
        return set()

    def learn(self, suspects: set[str]) -> None:
        """Nothing: a word's candidates are asked for when they are needed."""

    def candidates(self, word: str) -> list[tuple[int, int, str]]:
        if word not in self.memory:
            self.open.add(word)
        return self.memory.get(word, [])

    def questions(self) -> list[tuple[str, str]]:
        kinds = (("word", self.words.open), ("pair", self.pairs.open), ("part", self.parts.open), ("near", self.open))
        return [(kind, key) for kind, keys in kinds for key in keys]


def _ask(records: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    found = []
    if len(records):
        r = AskingRepairer(answers)
        scans.repair_batch(r, records)
        found = r.questions()
    out = pd.DataFrame(found, columns=["kind", "key"])
    out.insert(0, "block", records["block"].iloc[0] if len(records) else 0)
    return out


def _repair(records: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    return scans.repair_batch(AskingRepairer(answers), records)


def _meet(asked: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a shard of the vocabulary for some words."""
    n, k = dict(zip(words["w"], words["n"], strict=True)), dict(zip(words["w"], words["k"], strict=True))
    out = []
    if len(asked) and n:
        for key, near in Trie([w for w in n if not any(c.isdigit() for c in w)]).within(list(asked["key"]), scans.EDITS).items():
            for v in near:
                c = scans.explained(v, key) if v != key else scans.CONFUSIONS_MOST + 1
                if c <= scans.CONFUSIONS_MOST:
                    out.append((key, n[v], v, c, not k[v]))
    return pd.DataFrame(out, columns=["key", "n", "word", "confusions", "name"])


def candidates(asked: DataFrame, seen: DataFrame, shard: int = SHARD_WORDS, block: int = SHARD_ASKED) -> DataFrame:
    """``key, n, word, confusions, name``: all candidates of the distinct words ``key`` in the vocabulary ``w, n, k``.

    Words are sharded by length and hash; a word is looked up in every shard of the lengths within reach, in blocks.
    """
    spark = asked.sparkSession
    size = lambda c: F.least(F.length(c), F.lit(LONGEST))
    sizes = lambda df, c: {r[0]: r[1] for r in df.groupBy(size(c)).count().collect()}  # noqa: E731  (at most LONGEST + 1 rows)
    have, want = sizes(seen, "w"), sizes(asked, "key")
    grid = [(a, math.ceil(n / shard), b, math.ceil(m / block)) for a, n in have.items() for b, m in want.items() if abs(a - b) <= scans.EDITS]
    g = F.broadcast(spark.createDataFrame(grid, "wc int, wp int, sc int, sp int"))
    cell, deal = ["wc", "v", "sc", "s"], lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    parts = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    words = seen.withColumn("wc", size("w")).join(g, "wc").withColumn("v", deal("w", "wp")).withColumn("s", parts("sp"))
    looked = asked.withColumn("sc", size("key")).join(g, "sc").withColumn("s", deal("key", "sp")).withColumn("v", parts("wp"))
    met = looked.select(*cell, "key").groupBy(*cell).cogroup(words.select(*cell, "w", "n", "k").groupBy(*cell))
    return met.applyInPandas(_meet, "key string, n long, word string, confusions int, name boolean")


def _forms(batches):
    for b in batches:
        rows = [(f, w) for w in b["w"] for f in scans.read_as(w)]
        yield pd.DataFrame(rows, columns=["form", "w"])


def confusable(seen: DataFrame) -> DataFrame:
    """``w``: words that share what they can be read as with another word of the vocabulary, and the sign of a number."""
    forms = materialize(seen.select("w").mapInPandas(_forms, "form string, w string"), "forms")
    often = forms.groupBy("form").count().where("count > 1")
    return forms.join(often, "form", "left_semi").select("w").union(seen.sparkSession.createDataFrame([("0",)], "w string")).distinct()


def repair_by_asking(given: DataFrame, seen: DataFrame, clean: DataFrame) -> DataFrame:
    """The records ``src, rec_id, file_path, text, lost_ends, running`` repaired (columns of ``scans.REPAIRED``).

    seen: the vocabulary ``w, n, k``; clean: its texts.  The result is that of a repairer that holds the whole vocabulary.
    """
    chars = given.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = math.ceil((chars + 1) / BLOCK_CHARS)
    records = materialize(given.withColumn("block", F.monotonically_increasing_id() % blocks), "records")
    close = materialize(confusable(seen), "confusable")
    pairs = scans.counted_pairs(clean).withColumn("x", F.substring_index("pair", " ", 1)).withColumn("y", F.substring_index("pair", " ", -1))
    for side in ("x", "y"):
        pairs = pairs.join(close.select(F.col("w").alias(side), F.lit(True).alias(f"near_{side}")), side, "left")
    fact = lambda kind, key, n: [F.lit(kind).alias("kind"), F.col(key).alias("key"), n.alias("n")]
    prefixes = seen.where("w LIKE '%-%'").select(F.substring_index("w", "-", 1).alias("w")).distinct()
    facts = seen.select(*fact("word", "w", F.col("n"))).union(pairs.where("near_x OR near_y").select(*fact("pair", "pair", F.col("n"))))
    facts = materialize(facts.union(prefixes.select(*fact("part", "w", F.lit(1).cast("long")))), "facts")
    spark, known = given.sparkSession, []

    def blockwise(step, schema: str) -> DataFrame:
        answers = spark.createDataFrame([], _ANSWERS)
        for a in known:
            answers = answers.union(a)
        return records.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(step, schema)

    while True:  # ends: a round adds answers to questions that weren't asked before, and a block's text has so many
        asked = materialize(blockwise(_ask, _ASKED), "asked")
        if asked.isEmpty():
            return blockwise(_repair, scans.REPAIRED)
        plain = asked.where("kind <> 'near'").join(facts, ["kind", "key"], "left")
        answers = plain.selectExpr("block", "kind", "key", "coalesce(n, 0L) AS n", "CAST(NULL AS string) AS word", "CAST(NULL AS int) AS confusions", "false AS name")
        near = asked.where("kind = 'near'")
        keys = materialize(near.select("key").distinct(), "suspects")
        if not keys.isEmpty():
            found = near.join(candidates(keys, seen), "key", "left")
            answers = answers.union(found.selectExpr("block", "kind", "key", "n", "word", "confusions", "coalesce(name, false)"))
        known.append(materialize(answers, "answers"))
