"""Subject areas of documents (problem 8) by class-association rules.

Sentences of a bounded sample of labelled documents become weighted baskets of words and subjects.  Parallel
frequent-pattern growth counts each frequent word and, in its conditional base, the more frequent words beside it, by
subject; growth stops at the length that a rule may have, so no sentence, however long or often repeated, makes it explode.
Sets that speak for a subject become rules, and rules that a more general one makes redundant are pruned.  A sentence's
evidence for a subject is the sum of its matching rules' log odds; the evidence that makes a sentence count is calibrated
for each subject on labelled documents that were kept back.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.session import materialize

#: Labelled documents used to mine the rules and to calibrate them, at most (drawn by a hash of the id).
MINED_DOCS = 12_000
#: Sentences that must hold a set of words, confidence and lift over the subject's share that a rule needs.
SUPPORT, CONFIDENCE, LIFT = 3, 0.3, 2.0
#: Confidences are drawn towards the subject's share as by so many sentences, so rules of few sentences weigh less.
SHRINK = 2.0
#: Sentences that must hold both words of a rule of two words (the longest), and how far the lower bound of its confidence
#: (DEVIATIONS of the binomial distribution below it) must lie above the confidence of both shorter rules.
PAIR_SUPPORT, DEVIATIONS, GAIN = 6, 2.0, 0.15
#: Labelled documents of a subject that calibration needs to give it a cut of its own.
CALIBRATED = 50
#: Pairs of words that a task counts at once.
PAIRS_AT_ONCE = 2_000_000
#: Share of a document's sentences that must be about a subject.
SHARE = 0.25

_END = re.compile(r"(?<=[.!?])(?<![\s(]\d\.)(?<![\s(]\d\d\.)[\s\"'»”)]+|\n\s*\n|\n(?=\s*[-#*])")
_WORD = re.compile(r"[^\W\d_]{3,}(?:-[^\W\d_]+)*")


def sentences(text: str | None) -> list[str]:
    """Sentences of a text: they end with ``.``, ``!`` or ``?`` (not behind the number of a day); headings and lines without an end are none."""
    if not text:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\u00a0", " ").replace("\t", " ")
    found = []
    for part in _END.split(text):
        part = part.strip().lstrip("-*").strip()
        if part and part[0] != "#" and part[-1] in ".!?" and _WORD.search(part):
            found.append(part)
    return found


def sentence_words(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower()))


def labelled_sentences(docs: DataFrame, labels: DataFrame, limit: int = MINED_DOCS) -> DataFrame:
    """``doc_id, subjects (array<int>), words (array<string>), n (sentences of the document)`` of a bounded sample of labelled
    documents: those with the ``limit`` smallest hashes."""
    given = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject_id")).alias("subjects"))
    given = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(d, s, sorted(sentence_words(x)), len(all_)) for d, s, t in zip(b["doc_id"], b["subjects"], b["text"], strict=True) for all_ in [sentences(t)] for x in all_]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "subjects", "words", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(given, "doc_id").mapInPandas(split, "doc_id long, subjects array<int>, words array<string>, n int")


class Rules:
    """Pruned class-association rules with the calibrated cuts of their evidence (by subject, else the common one)."""

    def __init__(self, weights: dict[str, dict[int, float]], pairs: dict[tuple[str, str], dict[int, float]]) -> None:
        self.weights, self.pairs = weights, pairs
        self.beside: dict[str, dict[str, dict[int, float]]] = defaultdict(dict)  # the pairs by their first word
        for (a, b), by in pairs.items():
            self.beside[a][b] = by
        self.cut, self.cuts = 0.0, {}

    def evidence(self, words: set[str]) -> dict[int, float]:
        """Log odds of each subject that a rule speaks for: the more specific rule replaces those it contains."""
        hit = [w for w in words if w in self.weights]
        total: dict[int, float] = defaultdict(float)
        covered = set()
        for a in sorted(self.beside.keys() & words):
            for b in sorted(self.beside[a].keys() & words):
                for c, v in self.beside[a][b].items():
                    total[c] += v
                    covered.add((a, c))
                    covered.add((b, c))
        for w in hit:
            for c, v in self.weights[w].items():
                if (w, c) not in covered:
                    total[c] += v
        return total


def _pair_counts(batches: Iterator[pd.DataFrame], rank: dict[str, int]) -> Iterator[pd.DataFrame]:
    """Conditional bases of the frequent words, one level deep: how often each pair of them stands in sentences of each subject.

    A basket's words are brought into the order of frequency; beside each of them stand the more frequent ones.
    """

    def count(pair: list[np.ndarray], c: list[np.ndarray], k: list[np.ndarray]) -> pd.DataFrame:
        p, s, n = np.concatenate(pair), np.concatenate(c), np.concatenate(k)
        order = np.lexsort((s, p))
        p, s, n = p[order], s[order], n[order]
        new = np.ones(len(p), dtype=bool)
        new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
        first = np.flatnonzero(new)
        return pd.DataFrame({"pair": p[first], "c": s[first], "k": np.add.reduceat(n, first)})

    pair, c, k, held = [], [], [], 0
    lower: list[tuple | None] = [None] * 257  # places of all pairs of so many words
    for b in batches:
        for words, subjects, weight in zip(b["words"], b["subjects"], b["weight"], strict=True):
            at = np.array(sorted(rank[w] for w in words if w in rank), dtype=np.int64)
            about = [int(x) for x in subjects if x is not None] or [-1]
            # all pairs of a sentence at once; those of a very long one word by word, so that what is held stays bounded
            n = len(at)
            if 1 < n <= len(lower) - 1 and lower[n] is None:
                lower[n] = np.tril_indices(n, -1)
            for j in range(1, n) if n >= len(lower) else [0] if n > 1 else []:
                one = (at[j] << 32) + at[:j] if j else (at[lower[n][0]] << 32) + at[lower[n][1]]
                for s in about:
                    pair.append(one)
                    c.append(np.full(len(one), s, np.int32))
                    k.append(np.full(len(one), weight / len(about)))
                    held += len(one)
                if held >= PAIRS_AT_ONCE:
                    yield count(pair, c, k)
                    pair, c, k, held = [], [], [], 0
    if pair:
        yield count(pair, c, k)


def _confident(n: float, by: dict[int, float], prior: dict[int, float]) -> dict[int, float]:
    """Subjects whose confidence, drawn towards the subject's share, makes a rule."""
    found = {}
    for c, k in by.items():
        conf = (k + SHRINK * prior[c]) / (n + SHRINK)
        if conf >= CONFIDENCE and conf >= LIFT * prior[c]:
            found[c] = conf
    return found


def mine(train: DataFrame) -> Rules:
    """Rules of the sentences ``doc_id, subjects, words, n``.

    A sentence of a document without subject speaks for none.  One of a document with several subjects first speaks for
    each of them with an equal part of its weight; the rules found so tell which of them it is about, and with that
    the rules are found anew.  Equal sentences are one basket with their number as weight.
    """
    baskets = materialize(train.groupBy("words", "subjects").agg(F.count(F.lit(1)).cast("double").alias("weight")), "baskets")
    rules = _mine(baskets)
    if not rules.weights or baskets.where(F.size("subjects") > 1).isEmpty():
        return rules
    sent = train.sparkSession.sparkContext.broadcast(rules)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            chosen = []
            for words, subjects in zip(b["words"], b["subjects"], strict=True):
                if len(subjects) > 1:
                    found = sent.value.evidence(set(words))
                    best = max((found.get(int(c), 0.0), -int(c)) for c in subjects if c is not None)
                    subjects = [-best[1]] if best[0] > 0 else []
                chosen.append([int(c) for c in subjects if c is not None])
            yield pd.DataFrame({"words": b["words"], "subjects": chosen, "weight": b["weight"]})

    return _mine(materialize(baskets.mapInPandas(decide, "words array<string>, subjects array<int>, weight double"), "decided"))


def _mine(baskets: DataFrame) -> Rules:
    about = F.explode(F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.array(F.lit(-1)))).alias("c")
    part = F.col("weight") / F.greatest(F.size("subjects"), F.lit(1))
    sentences_ = {r["c"]: r["k"] for r in baskets.select(about, part.alias("k")).groupBy("c").agg(F.sum("k").alias("k")).collect()}
    total = sum(sentences_.values())
    prior = {c: k / total for c, k in sentences_.items() if c >= 0}
    if not prior:
        return Rules({}, {})
    by_subject = lambda rows, key: rows.groupBy(key).agg(F.sum("k").alias("n"), F.map_from_entries(F.collect_list(F.struct("c", "k"))).alias("by"))
    word = baskets.select(F.explode("words").alias("w"), "subjects", "weight").select("w", about, part.alias("k")).groupBy("w", "c").agg(F.sum("k").alias("k"))
    singles = by_subject(word, "w").where(F.col("n") >= SUPPORT - 1e-6).collect()  # the words of the sample, bounded like it
    order = sorted(singles, key=lambda r: (-r["n"], r["w"]))
    single = {r["w"]: _confident(r["n"], {c: k for c, k in r["by"].items() if c >= 0}, prior) for r in order}
    rank = {r["w"]: i for i, r in enumerate(order)}
    names = [r["w"] for r in order]
    sent = baskets.sparkSession.sparkContext.broadcast(rank)
    counted = baskets.mapInPandas(lambda b: _pair_counts(b, sent.value), "pair long, c int, k double").groupBy("pair", "c").agg(F.sum("k").alias("k"))
    best = F.array_max(F.map_values(F.map_filter("by", lambda c, _: c >= 0)))
    pairs_ = by_subject(counted, "pair").where((F.col("n") >= PAIR_SUPPORT - 1e-6) & (best >= CONFIDENCE / 2 * F.col("n"))).collect()
    logit = lambda p: math.log(min(max(p, 0.02), 0.98) / (1 - min(max(p, 0.02), 0.98)))
    weights = {w: {c: logit(conf) - logit(prior[c]) for c, conf in by.items()} for w, by in single.items() if by}
    pairs: dict[tuple[str, str], dict[int, float]] = defaultdict(dict)
    for r in pairs_:
        ws = (names[r["pair"] >> 32], names[r["pair"] & 0xFFFFFFFF])
        for c, conf in _confident(r["n"], {c: k for c, k in r["by"].items() if c >= 0}, prior).items():
            lone = max(single[w].get(c, prior[c]) for w in ws)
            z, n = DEVIATIONS**2, r["n"]
            least = (conf + z / (2 * n) - DEVIATIONS * math.sqrt(conf * (1 - conf) / n + z / (4 * n * n))) / (1 + z / n)  # Wilson's lower bound
            if least >= lone + GAIN:
                pairs[tuple(sorted(ws))][c] = logit(conf) - logit(prior[c])
    return Rules(weights, dict(pairs))


def score_sentences(rules: Rules, text: str | None) -> tuple[int, dict[int, int]]:
    """Sentences of a text and, by subject, how many of them are about it (evidence above the calibrated cut)."""
    found = sentences(text)
    about: dict[int, int] = defaultdict(int)
    for s in found:
        for c, v in rules.evidence(sentence_words(s)).items():
            if v > rules.cuts.get(c, rules.cut):
                about[c] += 1
    return len(found), about


def _best_cut(score: np.ndarray, want: np.ndarray, lost: int = 0) -> tuple[float, float]:
    """The cut of the documents' scores that agrees best (F1) with their labels, and that F1; ``lost``: labelled documents without score."""
    order = np.argsort(-score, kind="stable")
    score, want = score[order], want[order]
    tp = np.cumsum(want)
    f1 = 2 * tp / (np.arange(1, len(score) + 1) + want.sum() + lost)
    f1[:-1][score[:-1] == score[1:]] = -1  # equal scores are cut together
    f1[score <= 0] = -1
    at = int(f1.argmax())
    if f1[at] < 0:
        return 0.0, 0.0
    return float((score[at] + max(0.0, score[at + 1] if at + 1 < len(score) else 0.0)) / 2), float(f1[at])


def calibrate(rules: Rules, held: pd.DataFrame, share: float = SHARE) -> Rules:
    """Choose the cut of the sentence evidence, for each subject, at which the documents agree best (F1) with labels kept back.

    A document is about a subject if ``share`` of its sentences are above the cut, so its score is the evidence of the
    sentence that completes this share.  Subjects with fewer than CALIBRATED such documents get the cut of all together.
    """
    if held.empty:
        return rules
    docs: dict[int, tuple[set, int, dict]] = {}
    for d, subjects, words, n in held[["doc_id", "subjects", "words", "n"]].itertuples(index=False):
        by = docs.setdefault(d, ({int(s) for s in subjects if s is not None}, n, defaultdict(list)))[2]
        for c, v in rules.evidence(set(words)).items():
            by[c].append(v)
    scored: dict[int, list[tuple[float, bool]]] = defaultdict(list)
    lost: dict[int, int] = defaultdict(int)
    for want, n, by in docs.values():
        need = max(1, math.ceil(share * n - 1e-9))
        for c in want | set(by):
            values = sorted(by.get(c, ()), reverse=True)
            if len(values) >= need:
                scored[c].append((values[need - 1], c in want))
            elif c in want:
                lost[c] += 1
    every = [x for xs in scored.values() for x in xs]
    if every:
        rules.cut, rules.f1 = _best_cut(np.array([v for v, _ in every]), np.array([w for _, w in every]), sum(lost.values()))
    for c, xs in scored.items():
        if sum(w for _, w in xs) >= CALIBRATED:
            rules.cuts[c] = _best_cut(np.array([v for v, _ in xs]), np.array([w for _, w in xs]), lost[c])[0]
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, limit: int = MINED_DOCS) -> Rules:
    """Mine on four fifths of the sampled labelled documents, calibrate on the rest."""
    sample = materialize(labelled_sentences(docs, labels, limit).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5))), "labelled")
    rules = mine(sample.where("fold > 0").drop("fold"))
    return calibrate(rules, sample.where("fold = 0").drop("fold").toPandas())


def document_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = SHARE, limit: int = MINED_DOCS) -> DataFrame:
    """``doc_id, subject, about, sentences``: each subject of each document with the sentences about it.

    ``docs`` (doc_id, text), ``labels`` (doc_id, subject_id; null: none), ``subjects`` (subject_id, name).  Null and empty
    texts and texts without a whole sentence have no subject; documents repeated with the same text give one row per
    subject; rows without id are left out; without labels there are no rules and no rows; subjects that no label names
    are never found; other columns are ignored.
    """
    rules = fit_rules(docs, labels, limit)
    names = {r["subject_id"]: r["name"] for r in subjects.select("subject_id", "name").where("subject_id IS NOT NULL AND name IS NOT NULL").collect()}
    sent = docs.sparkSession.sparkContext.broadcast((rules, names))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules, names = sent.value
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                n, about = score_sentences(rules, t)
                out += [(d, names[c], k, n) for c, k in about.items() if k >= share * n and c in names]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "subject", "about", "sentences"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").mapInPandas(score, "doc_id long, subject string, about int, sentences int")
    return scored.groupBy("doc_id", "subject").agg(F.max("about").alias("about"), F.max("sentences").alias("sentences"))


def composition(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents by subject and source: ``source, subject, docs``."""
    return found.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "subject").agg(F.countDistinct("doc_id").alias("docs"))
