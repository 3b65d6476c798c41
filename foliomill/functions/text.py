"""Text functions as columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends: CRLF, CR and LF only.
LINE_END = r"\r\n|\r|\n"
#: White space as Python's strip knows it.
STRIP = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"


def split_lines(text: Column | str) -> Column:
    """Array of the lines, empty ones and a last empty one kept; the empty text has one empty line, null stays null."""
    return F.split(text, LINE_END, -1)


def strip(text: Column | str) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.regexp_replace(text, STRIP, "")


def normalize_inline(text: Column | str) -> Column:
    """Tabs and no-break spaces become spaces, runs of spaces one, ends are stripped."""
    return strip(F.regexp_replace(F.translate(text, "\t\u00a0", "  "), " {2,}", " "))


def numbered(line_no: Column | str, line: Column | str) -> Column:
    """Line number from 1, left-justified to width 4, before the line; longer numbers have no separator."""
    n = F.col(line_no).cast("string") if isinstance(line_no, str) else line_no.cast("string")
    padded = F.when(F.length(n) < 4, F.rpad(n, 4, " ")).otherwise(n)
    return F.concat(padded, line)


def word_count(text: Column | str) -> Column:
    """Words between white space; null and blank texts have 0."""
    t = F.coalesce(strip(text), F.lit(""))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\s\x1c-\x1f\x85\p{Z}]+")))


def brief(text: Column | str, most: int = 160) -> Column:
    """One line: CR, LF and TAB escaped, cut behind ``most`` characters with an ellipsis."""
    t = F.replace(F.replace(F.replace(text, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def single_line(text: Column | str) -> Column:
    """Line ends become spaces, ends are stripped."""
    return strip(F.regexp_replace(text, r"\R", " "))


def header(text: Column | str) -> Column:
    """What follows ``# `` in the first line, else empty; further spaces are kept."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"^# ([^\n]*)", 1)


def short_name(path: Column | str, most: int = 80) -> Column:
    """File name, shortened in the middle to ``most`` characters; below 5 cut at the end."""
    name = F.element_at(F.split(path, "/"), -1)
    if most < 5:
        return F.substring(name, 1, most)
    left = (most - 3) // 2
    return F.when(F.length(name) <= most, name).otherwise(F.concat(F.substring(name, 1, left), F.lit("..."), F.right(name, F.lit(most - 3 - left))))


def json_name(question: Column | str, most: int = 160) -> Column:
    """A file name for a question's result: bad characters and spaces become ``_``, cut with ``[...]``, ``.json``."""
    t = F.regexp_replace(question, r'[<>:"/\\|?*]', "_")
    t = F.replace(strip(F.regexp_replace(t, r"\s+", " ")), F.lit(" "), F.lit("_"))
    return F.concat(F.when(F.length(t) > most - 5, F.concat(F.substring(t, 1, most - 10), F.lit("[...]"))).otherwise(t), F.lit(".json"))


def score_percent(score: Column | str) -> Column:
    """A score in percent, six characters wide with two decimals."""
    return F.format_string("%6.2f", (F.col(score) if isinstance(score, str) else score) * 100)


def bracketed(found: Column | str, strict: Column | bool, kind: str = "image") -> Column:
    """An image's text as it stands in its document: bare for a page read strictly, else in brackets; null: that it can't be processed."""
    found = F.col(found) if isinstance(found, str) else found
    return F.coalesce(F.when(F.lit(strict) if isinstance(strict, bool) else strict, found).otherwise(F.concat(F.lit("["), found, F.lit("]"))), F.lit(f"[Unprocessable {kind}]"))


def first_text(columns: list[str], names: tuple[str, ...] = ("chunk_text", "text", "content", "body")) -> Column:
    """The first column of text by its name; none gives null."""
    known = [F.col(n).cast("string") for n in names if n in columns]
    return F.coalesce(*known) if known else F.lit(None).cast("string")


def word_targets(target: int) -> tuple[int, int, int, int]:
    """Least, most, greatest tolerated and smallest tolerated words of a chunk."""
    return int(0.75 * target), int(1.25 * target), int(1.5 * target), int(0.5 * target)


def json_clean(text: Column | str) -> Column:
    """Without control characters other than tab and line ends."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def version_triple(version: Column | str) -> Column:
    """``vMAJOR.MINOR.PATCH`` as struct of three ints: the first three parts, what is no number counts 0."""
    parts = F.split(F.regexp_replace(F.coalesce(version, F.lit("")), "^[vV]", ""), r"[.\-+]")
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0))
    return F.struct(number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch"))
