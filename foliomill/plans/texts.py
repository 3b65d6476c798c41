"""Queries on document texts: lines, paragraphs, blocks, sentences, chunks, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import text
from foliomill.operators import segment
from foliomill.session import table


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def _of(column, name):
    return lambda s, d: _docs(s, d).select("doc_id", column().alias(name))


def _lines(s, d):
    return segment.lines(_docs(s, d))


def _sentences(s, d):
    return segment.sentences_of(_docs(s, d))


def ocr_strategy(s, d):
    """Pages with at least 32 characters are read relaxed, others strictly."""
    return table(s, d, "documents").select("doc_id", F.when(F.length("text") >= 32, "relaxed").otherwise("strict").alias("strategy"))


def doc_kinds(s, d):
    """Decoder kind by file extension, first match."""
    path = F.lower("file_path")
    ends = lambda *e: path.rlike(r"\.(" + "|".join(e) + ")$")
    kind = (
        F.when(ends("jpg", "jpeg", "png", "gif", "webp", "bmp"), "image").when(ends("txt", "md", "markdown"), "plaintext")
        .when(ends("html", "htm"), "ascii").when(ends("odt", "docx"), "binary").when(ends("pdf"), "pdf").otherwise("none")
    )
    return table(s, d, "documents").select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "split_lines": _lines,
    "numbered_lines": lambda s, d: _lines(s, d).select("doc_id", "line_no", text.numbered("line_no", "line").alias("numbered")),
    "normalized_text": _of(lambda: F.sha2(text.normalize_inline("text"), 256), "digest"),
    "word_counts": _of(lambda: text.word_count("text"), "words"),
    "brief_texts": _of(lambda: text.brief("text"), "brief"),
    "single_lines": _of(lambda: F.sha2(text.single_line("text"), 256), "digest"),
    "json_names": _of(lambda: text.json_name("text"), "name"),
    "line_offsets": lambda s, d: segment.line_offsets(_lines(s, d)),
    "paragraphs": lambda s, d: segment.paragraphs_of(_docs(s, d)),
    "line_blocks": lambda s, d: segment.blocks(_lines(s, d), 100),
    "sentences": _sentences,
    "chunks": lambda s, d: segment.chunk_documents(_docs(s, d), 100),
    "ocr_strategy": ocr_strategy,
    "doc_kinds": doc_kinds,
}

_L = r"""
WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS a FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, CAST(i AS INT) AS line_no, a[i] AS line FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM l)),
clean AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(translate(line, chr(9) || chr(160), '  '), ' {2,}', ' ', 'g'), '^[\s\x1c-\x1f\x85\pZ]+|[\s\x1c-\x1f\x85\pZ]+$', '', 'g') AS line FROM lines)
"""
_STRIP = r"regexp_replace({}, '^[\s\x1c-\x1f\x85\pZ]+|[\s\x1c-\x1f\x85\pZ]+$', '', 'g')"

SQL = {
    "split_lines": _L + "SELECT doc_id, line_no, line FROM lines",
    "numbered_lines": _L + "SELECT doc_id, line_no, CASE WHEN line_no < 1000 THEN rpad(CAST(line_no AS VARCHAR), 4, ' ') ELSE CAST(line_no AS VARCHAR) END || line AS numbered FROM lines",
    "normalized_text": "SELECT doc_id, sha256(" + _STRIP.format("regexp_replace(translate(text, chr(9) || chr(160), '  '), ' {2,}', ' ', 'g')").replace("{{2,}}", "{2,}") + ") AS digest FROM documents",
    "word_counts": r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\s\x1c-\x1f\x85\pZ]+')) AS INT) AS words FROM documents",
    "brief_texts": r"""SELECT doc_id, CASE WHEN length(t) > 160 THEN t[1:160] || '…' ELSE t END AS brief FROM (
SELECT doc_id, replace(replace(replace(text, chr(13), '\r'), chr(10), '\n'), chr(9), '\t') AS t FROM documents)""",
    "json_names": r"""SELECT doc_id, CASE WHEN length(t) > 155 THEN t[1:150] || '[...]' ELSE t END || '.json' AS name FROM (
SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(text, '[<>:"/\\|?*]', '_', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'), '^[\s\x1c-\x1f\x85\pZ]+|[\s\x1c-\x1f\x85\pZ]+$', '', 'g'), ' ', '_') AS t FROM documents)""",
    "single_lines": "SELECT doc_id, sha256(" + _STRIP.format(r"regexp_replace(text, '\r\n|[\n\x0b\f\r\x85\x{2028}\x{2029}]', ' ', 'g')") + ") AS digest FROM documents",
    "line_offsets": _L + "SELECT doc_id, line_no, coalesce(CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM clean",
    "paragraphs": _L + """, flags AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM clean),
islands AS (SELECT *, CAST(sum(CASE WHEN line <> '' AND (before IS NULL OR before = '' OR starts_with(line, '- ') OR starts_with(line, '#') OR starts_with(before, '#')) THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY line_no) AS INT) AS paragraph FROM flags)
SELECT doc_id, paragraph, min(line_no) AS first_line, max(line_no) AS last_line, string_agg(line, chr(10) ORDER BY line_no) AS body FROM islands WHERE line <> '' GROUP BY doc_id, paragraph""",
    "line_blocks": _L + "SELECT doc_id, CAST(floor((line_no - 1) / 100) AS BIGINT) AS block, count(*) AS n, min(line_no) AS ref_min, max(line_no) AS ref_max FROM lines GROUP BY ALL",
    "ocr_strategy": "SELECT doc_id, CASE WHEN length(text) >= 32 THEN 'relaxed' ELSE 'strict' END AS strategy FROM documents",
    "doc_kinds": r"""SELECT CASE WHEN regexp_matches(p, '\.(jpg|jpeg|png|gif|webp|bmp)$') THEN 'image' WHEN regexp_matches(p, '\.(txt|md|markdown)$') THEN 'plaintext'
WHEN regexp_matches(p, '\.(html|htm)$') THEN 'ascii' WHEN regexp_matches(p, '\.(odt|docx)$') THEN 'binary' WHEN regexp_matches(p, '\.pdf$') THEN 'pdf' ELSE 'none' END AS kind, count(*) AS n
FROM (SELECT lower(file_path) AS p FROM documents) GROUP BY kind""",
}
