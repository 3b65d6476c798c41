"""Lines, paragraphs, sentences and chunks of documents, with the lines they come from."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text

Chunker = Callable[[list[str]], list[tuple[int, str]]]


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no (from 1), line``; null texts have no lines, the empty text has one."""
    return docs.select("doc_id", F.posexplode(text.split_lines("text")).alias("_p", "line")).select("doc_id", (F.col("_p") + 1).alias("line_no"), "line")


def line_offsets(rows: DataFrame) -> DataFrame:
    """Where each normalised line begins when a document's lines are joined by single spaces: ``doc_id, line_no, start``."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("doc_id", "line_no", F.coalesce(F.sum(F.length(text.normalize_inline("line")) + 1).over(w), F.lit(0)).alias("start"))


def paragraphs(rows: DataFrame) -> DataFrame:
    """Islands of lines: a blank line ends a paragraph and is dropped, ``- `` begins one, a line with ``#`` is one of its own.

    Output: ``doc_id, paragraph (from 1), first_line, last_line, body`` (lines joined by LF, normalised).
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    clean = rows.select("doc_id", "line_no", text.normalize_inline("line").alias("line"))
    before = F.lag("line").over(w)
    starts = before.isNull() | (before == "") | F.col("line").startswith("- ") | F.col("line").startswith("#") | before.startswith("#")
    cut = clean.withColumn("_new", (starts & (F.col("line") != "")).cast("int")).withColumn("paragraph", F.sum("_new").over(w).cast("int"))
    return (
        cut.where("line <> ''").groupBy("doc_id", "paragraph")
        .agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
        .select("doc_id", "paragraph", "first_line", "last_line", F.array_join("_l.line", "\n").alias("body"))
    )


_STOP = re.compile(r"[.!?…]+[\"'»”’)\]]*(?=\s)")


def split_sentences(body: str) -> list[tuple[int, int]]:
    """Begin and end of the sentences of one paragraph (lines joined by single spaces).

    A sentence ends at ``.``, ``!``, ``?`` or ``…`` before white space, but not behind a single letter and not right
    behind markdown signs: a word that begins with a heading's or code mark, or a bullet at the paragraph's beginning.
    """
    out, begin = [], 0
    for m in _STOP.finditer(body):
        token = body[max(begin, body.rfind(" ", begin, m.start()) + 1) : m.end()]
        if re.fullmatch(r"[^\W\d_]\.", token) or token[:1] in ("#", "`") or (token[:1] in ("-", "*") and m.end() - len(token) == 0):
            continue
        out.append((begin, m.end()))
        begin = m.end() + 1
    if begin < len(body):
        out.append((begin, len(body)))
    return out


_WHITE = re.compile("[ \t\u00a0]+")
_LINE_END = re.compile(r"\r\n|\r|\n")
_STRIP = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def document_paragraphs(body: str) -> list[tuple[int, list[str]]]:
    """First line's number and lines of each paragraph of a whole text, as :func:`paragraphs` cuts them."""
    out: list[tuple[int, list[str]]] = []
    before: str | None = None
    for n, line in enumerate(_LINE_END.split(body), 1):
        line = _WHITE.sub(" ", line).strip(_STRIP)
        if line:
            if not before or line.startswith(("- ", "#")) or before.startswith("#"):
                out.append((n, []))
            out[-1][1].append(line)
        before = line
    return out


def document_sentences(body: str | None) -> list[tuple[str, int, int]]:
    """Text and first and last line of each sentence of a whole text; an empty one with references 0 between paragraphs."""
    out: list[tuple[str, int, int]] = []
    for first, found in document_paragraphs(body or ""):
        starts, at = [], 0
        for line in found:
            starts.append(at)
            at += len(line) + 1
        if out:
            out.append(("", 0, 0))
        joined = " ".join(found)
        line_at = lambda o, s=starts, f=first: f + bisect_right(s, o) - 1
        out += [(joined[x:y], line_at(x), line_at(max(x, y - 1))) for x, y in split_sentences(joined)]
    return out


def sentences_of(docs: DataFrame) -> DataFrame:
    """:func:`sentences` of whole texts (``doc_id, text``, one row each), in one pass without a shuffle; null texts have none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(d, k, *s) for d, t in zip(b["doc_id"], b["text"], strict=True) for k, s in enumerate(document_sentences(t))]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "sent_idx", "text", "ref_min", "ref_max"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, "doc_id long, sent_idx int, text string, ref_min int, ref_max int")


def paragraphs_of(docs: DataFrame) -> DataFrame:
    """:func:`paragraphs` of whole texts (``doc_id, text``, one row each), in one pass without a shuffle; null texts have none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(d, k, n, n + len(x) - 1, "\n".join(x)) for d, t in zip(b["doc_id"], b["text"], strict=True) for k, (n, x) in enumerate(document_paragraphs(t or ""), 1)]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "paragraph", "first_line", "last_line", "body"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, "doc_id long, paragraph int, first_line int, last_line int, body string")


def chunk_documents(docs: DataFrame, block: int = 100, chunker: Chunker | None = None) -> DataFrame:
    """:func:`chunks` of whole texts (``doc_id, text``, one row each), in one pass without a shuffle."""
    make = chunker or word_target_chunker()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, body in zip(b["doc_id"], b["text"], strict=True):
                found = fold_chunks(document_sentences(body), block, make)
                out += [(doc, i, len(found), h, f"# {h}\n\n{t}", x, y) for i, (h, t, x, y) in enumerate(found)]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "chunks_total", "header", "chunk_text", "ref_min", "ref_max"])

    schema = "doc_id long, chunk_index int, chunks_total int, header string, chunk_text string, ref_min int, ref_max int"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(fold, schema)


def sentences(paragraph_rows: DataFrame) -> DataFrame:
    """``doc_id, sent_idx (from 0), text, ref_min, ref_max``; a row with empty text and references 0 stands between paragraphs."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, paragraph, first, body in b[["doc_id", "paragraph", "first_line", "body"]].itertuples(index=False):
                starts, at = [], 0
                for line in body.split("\n"):
                    starts.append(at)
                    at += len(line) + 1
                joined = body.replace("\n", " ")
                line_at = lambda o, s=starts: bisect_right(s, o) - 1
                if paragraph > 1:
                    out.append((doc, paragraph, -1, "", 0, 0))
                out += [(doc, paragraph, k, joined[x:y], first + line_at(x), first + line_at(max(x, y - 1))) for k, (x, y) in enumerate(split_sentences(joined))]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "paragraph", "k", "text", "ref_min", "ref_max"])

    found = paragraph_rows.mapInPandas(cut, "doc_id long, paragraph int, k int, text string, ref_min int, ref_max int")
    w = Window.partitionBy("doc_id").orderBy("paragraph", "k")
    return found.select("doc_id", (F.row_number().over(w) - 1).alias("sent_idx"), "text", "ref_min", "ref_max")


def blocks(rows: DataFrame, size: int, order: str = "line_no") -> DataFrame:
    """Blocks of ``size`` rows: ``doc_id, block (from 0), n, ref_min, ref_max`` (references of 0 don't count)."""
    w = Window.partitionBy("doc_id").orderBy(order)
    cut = rows.withColumn("block", F.floor((F.row_number().over(w) - 1) / size))
    low, high = ("ref_min", "ref_max") if "ref_min" in rows.columns else (order, order)
    return cut.groupBy("doc_id", "block").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.min(F.when(F.col(low) > 0, F.col(low))), F.lit(0)).alias("ref_min"),
        F.coalesce(F.max(F.when(F.col(high) > 0, F.col(high))), F.lit(0)).alias("ref_max"),
    )


def word_target_chunker(target: int = 200) -> Chunker:
    """Offline chunker: starts a chunk when the one before has its words; breaks at paragraph ends above three quarters of them."""

    def chunk(sentences_: list[str]) -> list[tuple[int, str]]:
        starts, words = [1], 0
        for i, s in enumerate(sentences_, 1):
            n = len(s.split())
            if i > starts[-1] and n and (words + n > int(1.25 * target) or (words >= int(0.75 * target) and sentences_[i - 2] == "")):
                starts.append(i)
                words = 0
            words += n
        return [(a, " ".join(next((x for x in sentences_[a - 1 :] if x), "").split()[:8])) for a in starts]

    return chunk


def fold_chunks(sents: list[tuple[str, int, int]], block: int, chunker: Chunker) -> list[tuple[str, str, int, int]]:
    """Sequential fold with carry: each block is the carry and the next ``block`` sentences; its last chunk is carried on.

    Gives (header, body, ref_min, ref_max).  A block whose chunker fails or breaks its contract (first start 1, rising,
    within the block) is left out together with its carry; chunks without references are dropped.
    """
    out: list[tuple[str, str, int, int]] = []
    carry: list[tuple[str, int, int]] = []
    last_header = ""

    def emit(part: list[tuple[str, int, int]], header: str) -> None:
        low = min((a for _, a, _ in part if a > 0), default=0)
        high = max((b for _, _, b in part if b > 0), default=0)
        if high:
            out.append((header, "\n".join(t for t, _, _ in part).strip("\n"), low, high))

    for at in range(0, len(sents), block):
        now = carry + sents[at : at + block]
        try:
            items = chunker([t for t, _, _ in now])
        except Exception:  # a failing chunker costs this block only
            carry = []
            continue
        starts = [a for a, _ in items]
        if not starts or starts[0] != 1 or any(b <= a for a, b in zip(starts, starts[1:], strict=False)) or starts[-1] > len(now):
            carry = []
            continue
        ends = starts[1:] + [len(now) + 1]
        parts = [now[a - 1 : b - 1] for a, b in zip(starts, ends, strict=True)]
        for part, (_, header) in zip(parts[:-1], items[:-1], strict=True):
            emit(part, header)
        carry, last_header = parts[-1], items[-1][1]
    if carry:
        emit(carry, last_header)
    return out


def chunks(sentence_rows: DataFrame, block: int = 100, chunker: Chunker | None = None) -> DataFrame:
    """``doc_id, chunk_index, chunks_total, header, chunk_text, ref_min, ref_max`` by the fold above, one document at a time."""
    make = chunker or word_target_chunker()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, rows in zip(b["doc_id"], b["rows"], strict=True):
                found = fold_chunks([(r["text"], r["ref_min"], r["ref_max"]) for r in rows], block, make)
                out += [(doc, i, len(found), h, f"# {h}\n\n{t}", x, y) for i, (h, t, x, y) in enumerate(found)]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "chunks_total", "header", "chunk_text", "ref_min", "ref_max"])

    schema = "doc_id long, chunk_index int, chunks_total int, header string, chunk_text string, ref_min int, ref_max int"
    # the fold is sequential within a document, so a document's sentences travel as one row, as its text did
    whole = sentence_rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent_idx", "text", "ref_min", "ref_max"))).alias("rows"))
    return whole.mapInPandas(fold, schema)
