"""Noise in text from scanned pages (problem 1): page furniture, broken words, misread characters, reflow.

The vocabulary comes from the texts that can't be scans.  Words outside it are looked up with Levenshtein automata in a
trie of the vocabulary, so no candidate within reach is missed; candidates must be explained by confusions of printed
characters and are ranked by their words' neighbours and by frequency.  Then page furniture is removed and the lines are
joined to paragraphs.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.trie import Trie
from foliomill.session import lookup_side, materialize

#: Words and pairs of neighbours (all that stand twice in the clean texts) that are sent to the tasks, at most; where there are
#: more, they stay tables and are asked by joins.
VOCABULARY = 1_000_000
#: A line is a running header of its file if it stands in so many of the file's places and at least this share of them is
#: where furniture stands (beside a page number, at an end of the record, within a sentence).
HEADER_PLACES, HEADER_SHARE = 3, 0.5
#: A word that stands beside a number less often than once in so many times says nothing about one there.
RARELY = 2_000
#: Edits within which candidates are retrieved, and confusions that may explain one.
EDITS, CONFUSIONS_MOST = 2, 2

# What printed characters are read as (true, read).
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("a", "o"), ("t", "f"), ("f", "t"), ("h", "b"), ("i", "l"), ("l", "i"), ("i", "1"), ("l", "1"), ("o", "0"), ("s", "5"),
    ("b", "6"), ("é", "6"), ("g", "9"), ("z", "2"), ("n", "ri"), ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("ü", "ii"), ("w", "vv"), ("li", "h"), ("ä", "a"), ("ö", "o"), ("ü", "u"),
    ("é", "e"), ("è", "e"), ("ê", "e"), ("à", "a"), ("â", "a"), ("á", "a"), ("í", "i"), ("ó", "o"), ("ú", "u"), ("ñ", "n"), ("ç", "c"), ("ô", "o"), ("î", "i"), ("û", "u"),
]
# Words that stand behind a hyphen that ends a shortened word ("short- and long-form").
JOINING = {"and", "or", "to", "und", "oder", "bis", "et", "ou", "y", "e", "o", "u"}
# Words that begin a running section header.
SECTIONS = ("chapter", "part", "section", "kapitel", "teil", "abschnitt", "chapitre", "partie", "capitulo", "parte", "seccion")

_TOKEN = re.compile(r"[^\W_]+(?:[-‐¬\xad'’][^\W_]+)*")
_HYPHENS = "-‐¬\xad"
_NUMBER = r"(?:p\. ?\d{1,4}|- ?\d{1,4} ?-|\d{1,4}/\d{1,4}|\[\d{1,4}\]|Page \d{1,4} of \d{1,4})"
_ROMAN = re.compile(r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_LONE = re.compile(rf"{_NUMBER}|\d{{1,4}}|(?=[ivxlc]){_ROMAN.pattern[len('(?=[ivxlc])'):]}")
_LONE_FIRST = re.compile(rf"({_LONE.pattern})\s{{2,}}(\S.*)$")
_LONE_LAST = re.compile(rf"(.*\S)\s{{2,}}({_LONE.pattern})$")
# patterns for whole texts begin with a character class, which is searched fast, and look behind it after that
_INLINE = re.compile(r"[pP\d\[-](?<!\S.)(?:(?<=p)\. ?\d{1,4}|(?<=-) ?\d{1,4} ?-|(?<=\d)\d{0,3}/\d{1,4}|(?<=\[)\d{1,4}\]|(?<=P)age \d{1,4} of \d{1,4})(?=\s|$)")
_ID = re.compile(r"[A-Za-z]-\d+")
_SECTION = re.compile(r"(?<!\S)(?=[A-Z0-9~.])(?=(\S{4,10}?)([\s~.\dIl]{2,7})(?<=[\s~.\dIl])(?=\D)(\S{2,24}?)(?=\.?(?:\s|$)))")
_SECTION_START = re.compile(r"[A-Z0-9~.](?<!\S.)")
_BROKEN = re.compile(rf"[{_HYPHENS}](?<=[^\W\d_].) (?=[^\W\d_])")
_SOFT = re.compile(r"[‐¬\xad](?<=[^\W\d_].)(?=[^\W\d_])")
_CORE = re.compile(r"[^\W_]+(?:[-‐¬\xad\x01'’][^\W_]+)*")
_JOINED = re.compile(r"([^\W_]+)\x01")
_WIDE = re.compile(r"\s\s")
_BLANK = re.compile(r"[\s\d_]+")
_LINES = re.compile(r"\r\n|\r|\n")
# What lone numbers begin with, and what stands around a word.
_NUMERAL_STARTS = frozenset("ivxlc0123456789")
_AROUND = ".,;:!?()\"'«»“”"
#: Tokens that a repairer remembers as in order, at most.
TOKENS = 200_000


def _near(a: str, b: str, most: int) -> bool:
    """Whether two short strings are within ``most`` edits."""
    if abs(len(a) - len(b)) > most:
        return False
    # of so many pieces of one string, the edits leave one whole, which stands in the other
    cuts = [i * len(b) // (most + 1) for i in range(most + 2)]
    if not any(b[x:y] in a for x, y in zip(cuts, cuts[1:], strict=False)):
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


@lru_cache(maxsize=50_000)
def _section_word(key: str) -> bool:
    return any(_near(key, s, 1) for s in SECTIONS)


@lru_cache(maxsize=10_000)
def title_of(path: str) -> list[str]:
    """The words of a running title, from the file's name: without copy marks and number."""
    name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    words = re.split(r"[\s_\-]+", name)
    while words and (words[0].lower() in ("copy", "of") or re.fullmatch(r"split\d*|\(?\d+\)?", words[0].lower())):
        words = words[1:]
    while words and not re.search(r"[^\W\d_]", words[-1]):
        words = words[:-1]
    return words


_by_true: dict[str, list[tuple[str, str]]] = {}
for _t, _r in CONFUSIONS:
    _by_true.setdefault(_t[0], []).append((_t, _r))


def explained(true: str, read: str, most: int = CONFUSIONS_MOST) -> int:
    """Fewest confusions that turn ``true`` into ``read``; ``most`` + 1 if more or other edits are needed."""

    @lru_cache(maxsize=None)
    def go(i: int, j: int, left: int) -> int:
        if i == len(true):
            return 0 if j == len(read) else most + 1
        best = most + 1
        if j < len(read) and true[i] == read[j]:
            best = go(i + 1, j + 1, left)
        if left:
            for t, r in _by_true.get(true[i], ()):
                if true.startswith(t, i) and read.startswith(r, j):
                    best = min(best, 1 + go(i + len(t), j + len(r), left - 1))
        return best

    return go(0, 0, most)


class Repairer:
    """Repairs records one batch at a time; candidates of words are remembered between batches."""

    def __init__(self, words: dict[str, int], pairs: dict[str, int], names: set[str] = frozenset()) -> None:
        self.words, self.pairs, self.names = words, pairs, names
        self.parts = {w.split("-", 1)[0] for w in words if "-" in w}
        self.trie = Trie([w for w in words if not any(c.isdigit() for c in w)])
        self.memory: dict[str, list[tuple[int, int, str]]] = {}
        self.fine: set[str] = set()

    def learn(self, suspects: set[str]) -> None:
        """Candidates of all new suspects of a batch: fewest confusions first, then the most frequent."""
        new = [w for w in suspects if w not in self.memory]
        for w, near in self.trie.within(new, EDITS).items():
            scored = [(explained(v, w), -self.words[v], v) for v in near if v != w]
            self.memory[w] = sorted(s for s in scored if s[0] <= CONFUSIONS_MOST)

    def candidates(self, word: str) -> list[tuple[int, int, str]]:
        if word not in self.memory:
            self.learn({word})
        return self.memory[word]

    def best(self, word: str, before: str, after: str, capital: bool = False) -> str | None:
        """The candidate that fits best: fewest confusions, then neighbours seen in clean texts, then frequency.

        A word with a capital is never taken for a name: an unknown name can't be told from a misread one.
        """
        found = self.candidates(word)
        if capital and found:
            found = [f for f in found if f[2] not in self.names]
        if not found:
            return None
        if len(found) == 1:
            return found[0][2]
        seen = lambda v: (self.pairs.get(f"{before} {v}", 0) > 0) + (self.pairs.get(f"{v} {after}", 0) > 0)
        return min(found, key=lambda f: (f[0] - seen(f[2]), f[0], f[1]))[2]

    # -- page furniture -------------------------------------------------------------------------------------------

    def is_header(self, text: str, title: list[str]) -> bool:
        squeezed = "".join(text.split()).lower()
        if title and len(squeezed) >= 4:
            name = "".join(title).lower()
            if squeezed == name or (len(title) > 1 and _near(squeezed, name, max(1, len(name) // 8))):
                return True
        m = _SECTION.match(text.strip())
        return bool(m) and len(text.strip()) - m.end(3) <= 1 and self._is_section(m)

    @staticmethod
    def _is_section(m: re.Match) -> bool:
        key, last = m[1].lower(), m[3]
        return m[1] != key and last != last.lower() and any(c in "0123456789Il" for c in m[2]) and _section_word(key)

    def strip_line(self, line: str, title: list[str], running: frozenset[str] = frozenset()) -> tuple[str | None, set[str]]:
        """What is left of a line without furniture (None: all of it was), and the kinds of furniture; running: keys of the file's headers."""
        text = line.strip()
        if not text or len(text) > 90:
            return line, set()
        if _LONE.fullmatch(text):
            return None, {"page_number"}
        if running and line_key(text) in running:
            return None, {"header", "page_number"} if _LONE_FIRST.match(text) or _LONE_LAST.match(text) else {"header"}
        kinds: set[str] = set()
        wide = "  " in text
        m = _LONE_FIRST.match(text) if wide else None
        n = _LONE_LAST.match(text) if wide else None
        if m and self.is_header(m[m.lastindex], title):
            return None, {"page_number", "header"}
        if n and self.is_header(n[1], title):
            return None, {"page_number", "header"}
        if text.count(" ") < 9 and self.is_header(text, title):
            kinds.add("header")
            return None, kinds
        return line, kinds

    def _with_number(self, pair: str, word: str) -> bool:
        """Whether a word stands beside a number often enough (once in RARELY times) for one there to be content."""
        return self.pairs.get(pair, 0) * RARELY > self.words.get(word, 0)

    def strip_inline(self, text: str, title: list[str]) -> tuple[str, set[str]]:
        """A text whose line ends are lost, without the furniture that stands within it."""
        kinds: set[str] = set()
        out = _INLINE.sub("\x00", text)
        if out != text:
            kinds.add("page_number")
            text = out
        if title:
            low = text.lower()
            have = {w.lower() for w in title if len(w) > 2}
            if any(w in low for w in have):
                spans = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
                name, k, cut = "".join(title).lower(), len(title), []
                # of a misread title at least one word is whole, so only windows around such a word are compared
                for i, (a, b) in enumerate(spans):
                    if low[a:b] not in have or (cut and a < cut[-1][1]):
                        continue
                    sizes = (k, k - 1, k + 1) if k > 1 else (1,)
                    for size, first in [(n, f) for n in sizes for f in range(max(0, i - n + 1), i + 1) if n > 0]:
                        if first + size > len(spans) or (cut and spans[first][0] < cut[-1][1]):
                            continue
                        start, end = spans[first][0], spans[first + size - 1][1]
                        squeezed = "".join(low[start:end].split())
                        if abs(len(squeezed) - len(name)) > 2 or squeezed[-1] in ",;:" or any(_LONE.fullmatch(low[x:y]) for x, y in (spans[first], spans[first + size - 1])):
                            continue
                        if (squeezed == name or (k > 1 and _near(squeezed, name, max(1, len(name) // 8)))) and (text[start].isupper() or not text[start].isalpha()):
                            cut.append((start, end))
                            break
                for a, b in reversed(cut):
                    text = text[:a].rstrip() + " \x00 " + text[b:].lstrip()
                    kinds.add("header")
        for m in [_SECTION.match(text, s.start()) for s in _SECTION_START.finditer(text)][::-1]:
            if m and self._is_section(m):
                text = text[: m.start()].rstrip() + " \x00 " + text[m.end(3) :].lstrip()
                kinds.add("header")
        # numbers alone: roman ones that are no words, others whose neighbours never stand beside a number in clean texts
        words = text.split(" ")
        for i in [i for i, w in enumerate(words) if w[:1] in _NUMERAL_STARTS and len(w) <= 8]:
            w = words[i]
            if not w.isdigit() and (w in self.words or not _ROMAN.fullmatch(w)):
                continue
            before = next((words[j] for j in range(i - 1, -1, -1) if words[j]), "")
            after = next((words[j] for j in range(i + 1, len(words)) if words[j]), "")
            if w.isdigit() and len(w) <= 4:
                b, a = before.strip("\x00.,;:").lower(), after.strip("\x00.,;:").lower()
                # what stands before an end of a sentence says nothing about what follows it
                b, ends = ("", True) if before.endswith((".", "!", "?", "\x00")) or not before else (b, False)
                content = self._with_number(f"{b} 0", b) or (self._with_number(f"0 {a}", a) and not (ends and after[:1].isupper()))
                edge = ends or not before or not after or before == "\x00" or after == "\x00"
                broken = before[-1:] in tuple(_HYPHENS) and after[:1].islower()
                if broken or (not content and (edge or (b in self.words and a in self.words))):
                    words[i] = "\x00"
                    kinds.add("page_number")
            elif not w.isdigit():
                words[i] = "\x00"
                kinds.add("page_number")
        text = " ".join(words)
        return (re.sub(r"(?: *\x00 *)+", " ", text) if "\x00" in text else text).strip(), kinds

    # -- words ----------------------------------------------------------------------------------------------------

    def join(self, left: str, right: str) -> str | None:
        """How a word broken after ``left`` is spelled (as printed, misread characters kept); None: it is no broken word."""
        a, b = left.lower(), right.lower()
        if a + b in self.words:
            return left + right
        if f"{a}-{b}" in self.words:
            return f"{left}-{right}"
        if b in JOINING:
            return None
        if a in self.parts and b in self.words:
            return f"{left}-{right}"
        return left + right

    def wants(self, text: str) -> set[str]:
        """Words of a text without known spelling."""
        words, fine = self.words, self.fine
        new = {t for t in text.split() if t not in fine}
        fine |= (known := {t for t in new if t.strip(_AROUND).lower() in words})
        text = " ".join(new - known)
        if "\x01" in text:
            text = _JOINED.sub(r"\1", text)
        return {w for t in _TOKEN.findall(text) if not t.isdigit() for w in [t.lower()] if w not in words and not _ID.fullmatch(t) and len(w) > 2}

    def clean(self, path: str, text: str, lost_ends: bool, running: frozenset[str] = frozenset()) -> tuple[list[str], set[str]]:
        """Paragraphs without furniture, the hyphens at line ends marked with \\x01, and the kinds of furniture."""
        title = title_of(path)
        if lost_ends:
            body, kinds = self.strip_inline(text, title)
            return [_SOFT.sub("\x01", _BROKEN.sub("\x01", body))], kinds
        kinds: set[str] = set()
        heads: list[str] = []
        lines = _LINES.split(text)
        while lines and (lines[0].startswith("# ")):
            heads.append(lines.pop(0))
        paragraphs: list[str] = []
        current = ""
        gap = removed = False
        for line in lines:
            left, found = self.strip_line(line, title, running)
            kinds |= found
            if left is None:
                removed = True
                continue
            left = left.strip()
            if not left:
                gap = True
                continue
            broken = bool(current) and current[-1] in _HYPHENS and len(current) > 1 and current[-2].isalpha() and left[0].isalpha()
            runs_on = removed and current and current[-1] not in ".!?:" and (left[0].islower() or broken)
            if current and gap and not runs_on:
                paragraphs.append(current)
                current = left
            elif broken:
                current = current[:-1] + "\x01" + left
            else:
                current = f"{current} {left}" if current else left
            gap = removed = False
        if current:
            paragraphs.append(current)
        return heads + paragraphs if heads else paragraphs, kinds

    def repair(self, paragraphs: list[str]) -> tuple[str, list[tuple[str, str]]]:
        """The readable text and its repairs (kind, word); the candidates must have been learnt."""
        found: list[tuple[str, str]] = []
        out: list[str] = []
        known, fine = self.words, self.fine
        for p in paragraphs:
            if p.startswith("# "):
                out.append(p)
                continue
            pieces = p.split()
            if p[:1].isspace():
                pieces.insert(0, "")
            if p[-1:].isspace():
                pieces.append("")
            word = lambda i: pieces[i].strip(_AROUND).lower() if 0 <= i < len(pieces) else ""  # noqa: B023, E731
            new = {}
            for i in [i for i, t in enumerate(pieces) if t not in fine]:
                token = pieces[i]
                if not token:
                    continue
                if word(i) in known:
                    fine.add(token)
                    continue
                new[i] = self._token(token, word(i - 1), word(i + 1), found)
            for i, t in new.items():
                pieces[i] = t
            out.append(" ".join(pieces))
        if len(fine) > TOKENS:
            fine.clear()
        return "\n\n".join(out).replace("- \x02", "- "), found

    def _token(self, token: str, before: str, after: str, found: list) -> str:
        m = _CORE.search(token)
        if not m:
            self.fine.add(token)
            return token
        core = m[0]
        hyphen = False
        if "\x01" in core:
            head, *rest = core.split("\x01")
            for r in rest:
                joined = self.join(head.rsplit("-", 1)[-1], r)
                prefix = head[: len(head) - len(head.rsplit("-", 1)[-1])]
                whole = f"{prefix}{joined}" if joined else ""
                if prefix and f"{head}{r}".lower() in self.words:
                    whole = f"{head}{r}"
                if not joined:
                    head = f"{head}- {r}"
                    continue
                head, hyphen = whole, True
            core = head
            if not hyphen:
                return token[: m.start()] + core + token[m.end() :]
        low = core.lower()
        if low not in self.words and "-" in core and not hyphen and not _ID.fullmatch(core):
            # a hyphen within a word whose line end was lost
            a, b = core.rsplit("-", 1)
            if a + b and (a + b).lower() in self.words and a.isalpha() and b.isalpha():
                core, hyphen = a + b, True
            elif a.isalpha() and b.isalpha() and a.lower() not in self.words and b.lower() not in self.words:
                if self.candidates((a + b).lower()) or not self.candidates(low):
                    core, hyphen = a + b, True
            low = core.lower()
        word, best = low, None
        if low not in self.words and not low.isdigit() and not _ID.fullmatch(core) and len(low) > 2:
            best = self.best(low, before, after, core[0].isupper())
            if best:
                word = best
                found.append(("misread", best))
                core = best.capitalize() if core[0].isupper() else best
        if not best and not hyphen:
            self.fine.add(token)  # it stays as it is, whatever its neighbours are
        if hyphen:
            found.append(("hyphen", word))
        return token[: m.start()] + core + token[m.end() :]


_ready: dict[str, Repairer] = {}


def _repairer(name: str, sent) -> Repairer:
    """The worker's repairer of a run, made once; it keeps what it has learnt, up to a bound, from task to task."""
    if name not in _ready:
        _ready.clear()
        _ready[name] = Repairer(*sent.value)
    found = _ready[name]
    if len(found.memory) > 300_000:
        found.memory.clear()
    return found


def line_key(line: str) -> str:
    """What a running header has in common on all pages: without white space, numbers and case."""
    line = line.strip()
    if _WIDE.search(line):
        line = _LONE_LAST.sub(r"\1", _LONE_FIRST.sub(lambda m: m[m.lastindex], line))
    return _BLANK.sub("", line).lower()


def _short_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Short lines without an end of a sentence: file_path, key, place, and whether they stand where furniture stands."""
    for b in batches:
        out = []
        for path, text, place in zip(b["file_path"], b["text"], b["place"], strict=True):
            lines = [x.strip() for x in _LINES.split(text)]
            while lines and lines[0].startswith("# "):
                lines.pop(0)
            full = [i for i, x in enumerate(lines) if x]
            for n, i in enumerate(full):
                x = lines[i]
                if len(x) > 90 or len(x) < 4 or x.count(" ") > 9 or x[-1] in ".!?:;," or not (x[0].isupper() or x[0].isdigit()) or _LONE.fullmatch(x):
                    continue
                key = line_key(x)
                if len(key) < 4:
                    continue
                before, after = lines[full[n - 1]] if n else "", lines[full[n + 1]] if n + 1 < len(full) else ""
                broken = bool(before) and before[-1] not in ".!?:" and after[:1].islower()
                odd = broken or bool(_LONE.fullmatch(before)) or bool(_LONE.fullmatch(after)) or "  " in x
                out.append((path, key, place, odd))
        if out:
            yield pd.DataFrame(out, columns=["file_path", "key", "place", "odd"])


def running_headers(records: DataFrame) -> DataFrame:
    """``file_path, running``: keys of the lines that come back in many places of a file, where furniture stands.

    records: ``file_path, text, lost_ends, place`` (number of the chunk or page; copies and revisions of one place count once).
    """
    known = records.where("file_path IS NOT NULL AND text IS NOT NULL AND place IS NOT NULL AND NOT lost_ends").select("file_path", "text", "place")
    lines = known.mapInPandas(_short_lines, "file_path string, key string, place long, odd boolean").groupBy("file_path", "key", "place").agg(F.max("odd").alias("odd"))
    often = lines.groupBy("file_path", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("odd").alias("odd")).where((F.col("n") >= HEADER_PLACES) & (F.col("odd") >= HEADER_SHARE * F.col("n")))
    return often.groupBy("file_path").agg(F.collect_set("key").alias("running"))


def counted_words(texts: DataFrame) -> DataFrame:
    """``w, n, k``: words that stand twice in clean texts (column ``text``), in lower case, and how often in lower case; none with digits."""
    lines = texts.select(F.explode(F.split("text", r"\r\n|\r|\n")).alias("line")).where(~F.col("line").startswith("# "))
    words = lines.select(F.explode(F.expr(r"regexp_extract_all(line, '[\\p{L}\\p{N}]+(?:-[\\p{L}\\p{N}]+)*', 0)")).alias("w"))
    seen = words.groupBy(F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower("w") == F.col("w")).alias("k"))
    return seen.where("n >= 2 AND NOT w RLIKE '[0-9]'")


def counted_pairs(texts: DataFrame, close: set[str] | None = None) -> DataFrame:
    """``pair, n``: neighbours that stand together twice in clean texts, numbers as 0; close: only pairs with one of these words."""

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token, stop = re.compile(r"[^\W_]+(?:-[^\W_]+)*"), re.compile(r"[.,;:!?]|\n\s*\n")
        for b in batches:
            n: dict[str, int] = {}
            for t in b["text"]:
                for part in stop.split((t or "").lower()):
                    ws = ["0" if w.isdigit() else w for w in token.findall(part)]
                    for x, y in zip(ws, ws[1:], strict=False):
                        if close is None or x in close or y in close:
                            key = f"{x} {y}"
                            n[key] = n.get(key, 0) + 1
            if n:
                yield pd.DataFrame({"pair": list(n), "n": list(n.values())})

    return texts.select("text").mapInPandas(neighbours, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n >= 2")


def bounded_words(seen: DataFrame, texts: DataFrame, most: int) -> tuple[dict[str, int], dict[str, int], set[str]] | None:
    """Vocabulary (``seen``: :func:`counted_words`), pairs of neighbours with a confusable word or a number, and the vocabulary's words that
    never stand in lower case, all for the driver; None if there are more than ``most`` words or pairs."""
    rows = seen.limit(most + 1).collect()
    if len(rows) > most:
        return None
    vocabulary, names = {r["w"]: r["n"] for r in rows}, {r["w"] for r in rows if not r["k"]}
    rows = counted_pairs(texts, _confusable(vocabulary)).limit(most + 1).collect()
    return None if len(rows) > most else (vocabulary, {r["pair"]: r["n"] for r in rows}, names)


def clean_words(texts: DataFrame) -> tuple[dict[str, int], dict[str, int], set[str]] | None:
    """:func:`bounded_words` of clean texts (column ``text``), up to VOCABULARY."""
    return bounded_words(materialize(counted_words(texts), "vocabulary"), texts, VOCABULARY)


def read_as(word: str) -> set[str]:
    """A word and all it can be read as by one confusion."""
    forms = {word}
    for t, r in CONFUSIONS:
        i = word.find(t)
        while i >= 0:
            forms.add(word[:i] + r + word[i + len(t) :])
            i = word.find(t, i + 1)
    return forms


def _confusable(vocabulary: dict[str, int]) -> set[str]:
    """Words that share what they can be read as with another word of the vocabulary, and the sign of a number."""
    by: dict[str, list[str]] = {}
    for w in vocabulary:
        for f in read_as(w):
            by.setdefault(f, []).append(w)
    return {w for ws in by.values() if len(ws) > 1 for w in ws} | {"0"}


REPAIRED = "src string, rec_id long, text string, repairs array<struct<kind string, word string>>"


def repair_batch(r: Repairer, b: pd.DataFrame) -> pd.DataFrame:
    """The repaired records of a batch (columns of REPAIRED)."""
    cleaned, suspects = [], set()
    for path, text, lost, running in zip(b["file_path"], b["text"], b["lost_ends"], b["running"], strict=True):
        if not text:
            cleaned.append(None)
            continue
        c = r.clean(path or "", text, bool(lost), frozenset() if running is None else frozenset(running))
        cleaned.append(c)
        for p in c[0]:
            if not p.startswith("# "):
                suspects |= r.wants(p)
    r.learn(suspects)
    texts, repairs = [], []
    for text, c in zip(b["text"], cleaned, strict=True):
        if c is None:
            texts.append(text)
            repairs.append([])
            continue
        whole, found = r.repair(c[0])
        texts.append(whole)
        repairs.append([{"kind": k, "word": w} for k, w in dict.fromkeys(found + [(k, "") for k in sorted(c[1])])])
    return pd.DataFrame({"src": b["src"], "rec_id": b["rec_id"], "text": texts, "repairs": repairs})


def repair_scans(records: DataFrame, clean: DataFrame, most: int = VOCABULARY) -> DataFrame:
    """``src, rec_id, text, repairs``: the readable text of each record of (src, rec_id, file_path, text, lost_ends, place).

    ``place``: number of the record in its file (optional); lines that come back in many places of a file are running headers.
    ``lost_ends``: the record's line ends have become spaces.  ``repairs``: array of (kind, word), kind ``hyphen``, ``misread``,
    ``header`` or ``page_number`` (word empty).  ``clean`` holds the texts (column text) that can't be scans; they give the
    vocabulary: sent to the tasks if it has at most ``most`` words and pairs of neighbours, else asked by joins, with the same
    result (:func:`foliomill.llm.lexicon.repair_by_asking`).  Null texts stay null, empty ones empty, both without repairs; repeated
    records are repaired each; without clean texts only furniture and hyphens are repaired; leading lines that begin with ``# ``
    stay as they are.
    """
    from foliomill.llm.lexicon import repair_by_asking

    spark = records.sparkSession
    place = F.col("place").cast("long") if "place" in records.columns else F.lit(None).cast("long")
    given = records.select("src", F.col("rec_id").cast("long").alias("rec_id"), "file_path", "text", "lost_ends", place.alias("place"))
    running = materialize(running_headers(given), "headers")
    given = given.join(lookup_side(running), "file_path", "left").drop("place")
    seen = materialize(counted_words(clean), "vocabulary")
    words = bounded_words(seen, clean, most)
    if words is None:
        return repair_by_asking(given, seen, clean)
    sent, name = spark.sparkContext.broadcast(words), uuid.uuid4().hex

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = _repairer(name, sent)
        for b in batches:
            yield repair_batch(r, b)

    return given.mapInPandas(work, REPAIRED)


def repairs(repaired: DataFrame) -> DataFrame:
    """Distinct ``src, rec_id, kind, word`` of :func:`repair_scans`."""
    return repaired.select("src", "rec_id", F.explode("repairs").alias("x")).select("src", "rec_id", "x.kind", "x.word").distinct()
