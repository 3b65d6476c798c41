import urllib.parse
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from foliomill.functions import refs, text
from foliomill.operators import segment


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize("value, want", [("A\r\nB\rC\n", ["A", "B", "C", ""]), ("", [""]), (None, None), ("a\x0bb", ["a\x0bb"])])
def test_split_lines(spark, value, want):
    assert one(spark, value, text.split_lines("x")) == want


@pytest.mark.parametrize("value", ["  a \t  b  ", " x ", "\x85y\x1c", "", " "])
def test_normalize_like_python(spark, value):
    import re

    want = re.sub(" {2,}", " ", value.replace("\t", " ").replace(" ", " ")).strip()
    assert one(spark, value, text.normalize_inline("x")) == want


@pytest.mark.parametrize("value, want", [("# Title\n\nBody", "Title"), ("## No", ""), ("#No", ""), ("#  Space", " Space"), ("x\n# y", ""), ("", ""), (None, ""), ("# Ünï", "Ünï")])
def test_header(spark, value, want):
    assert one(spark, value, text.header("x")) == want


def test_small_formats(spark):
    assert one(spark, "very_long_name_over_limit.txt", text.short_name("x", 20)) == "very_lon...limit.txt"
    assert one(spark, "/d/file.txt", text.short_name("x", 5)) == "f...t"
    assert one(spark, "/d/f.txt", text.short_name("x")) == "f.txt"
    assert one(spark, 7, text.numbered(F.col("x"), F.lit("abc")), "int") == "7   abc" and one(spark, 12345, text.numbered(F.col("x"), F.lit("abc")), "int") == "12345abc"
    assert one(spark, "a b?c", text.json_name("x")) == "a_b_c.json" and len(one(spark, "x" * 500, text.json_name("x"))) == 160
    assert one(spark, "a\x00b\tc", text.json_clean("x")) == "ab\tc"
    assert one(spark, "a\r\nb", text.brief("x")) == "a\\r\\nb" and len(one(spark, "y" * 999, text.brief("x"))) == 161
    assert [one(spark, v, text.word_count("x")) for v in (None, " ", "a  b\nc")] == [0, 0, 3]
    assert tuple(one(spark, "V11.2-dev", text.version_triple("x"))) == (11, 2, 0)


@pytest.mark.parametrize("value", [0.0, 1640995200.0, 1743856496.25, 0.001, -12345678.5, 123456789012345.0, 1e15, 1.5])
def test_python_float(spark, value):
    assert one(spark, value, refs.python_float(F.col("x")), "double") == str(value)


@pytest.mark.parametrize("path", ["/a b/ü~*()!'&=+%.txt", "/plain", "/a#b?c"])
def test_uri(spark, path):
    assert one(spark, path, refs.file_uri(F.col("x"))) == "file://" + urllib.parse.quote(path, safe="/")


def test_labels_time_hamming(spark):
    label = lambda p, q: spark.createDataFrame([(p, q)], "p array<int>, l array<int>").select(refs.label(F.col("p"), F.col("l")).alias("y")).first().y
    assert [label([2, 4], None), label([7], None), label(None, [15, 20]), label(None, [42]), label(None, None), label([], [])] == ["pages 2–4", "page 7", "lines 15–20", "line 42", None, None]
    assert one(spark, 1743856496.0, refs.utc_time(F.col("x")), "double") == datetime.fromtimestamp(1743856496, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    assert one(spark, "abcd", refs.hamming(F.col("x"), F.lit("abxy"))) == 2 and one(spark, "abc", refs.hamming(F.col("x"), F.lit("ab"))) is None


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts, 1)], "doc_id long, text string, line string")


@pytest.mark.parametrize("body, want", [
    ("A.\nB.\n\nC.", [("A. B.", 1, 2), ("", 0, 0), ("C.", 4, 4)]),
    ("First. Second spans\nlines.\n\nThird.", [("First.", 1, 1), ("Second spans lines.", 1, 2), ("", 0, 0), ("Third.", 4, 4)]),
    ("Para.\n\n- Item1.\n- Item2.", [("Para.", 1, 1), ("", 0, 0), ("- Item1.", 3, 3), ("", 0, 0), ("- Item2.", 4, 4)]),
    ("", []), ("\n \n", []),
])
def test_sentences(spark, body, want):
    got = segment.sentences(segment.paragraphs(segment.lines(docs(spark, body)))).orderBy("sent_idx").collect()
    assert [(r.text, r.ref_min, r.ref_max) for r in got] == want


def stub(sentences):
    return [(1, "H")]


@pytest.mark.parametrize("sents, block, want", [
    ([("S1", 1, 1), ("S2", 2, 2)], 2, [("H", "S1\nS2", 1, 2)]), ([("S1", 1, 1), ("S2", 2, 2), ("S3", 3, 3)], 2, [("H", "S1\nS2\nS3", 1, 3)]),
    ([("S1", 1, 1), ("", 0, 0), ("S2", 2, 2)], 3, [("H", "S1\n\nS2", 1, 2)]), ([], 1, []), ([("", 0, 0)], 1, []),
])
def test_fold(sents, block, want):
    assert segment.fold_chunks(sents, block, stub) == want


def test_fold_failures_cost_their_block():
    calls = []

    def chunker(s):
        calls.append(len(s))
        if len(calls) == 2:
            raise ValueError
        return [(1, "a")] + ([(2, "b")] if len(s) > 1 else [])

    sents = [(f"s{i}", i, i) for i in range(1, 7)]
    assert segment.fold_chunks(sents, 2, chunker) == [("a", "s1", 1, 1), ("a", "s5", 5, 5), ("b", "s6", 6, 6)]
    assert segment.fold_chunks(sents, 2, lambda s: [(2, "x")]) == []


def test_chunks_tile_their_sentences(spark):
    body = "\n\n".join(" ".join(f"Word{i} number {j} stands here." for j in range(12)) for i in range(30))
    s = segment.sentences(segment.paragraphs(segment.lines(docs(spark, body, None, ""))))
    cut = segment.chunks(s, 20, segment.word_target_chunker(60)).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in cut] == list(range(len(cut))) and {r.chunks_total for r in cut} == {len(cut)} and len(cut) > 5
    words = " ".join(r.chunk_text.split("\n\n", 1)[1] for r in cut).split()
    assert words == body.split()


def test_one_pass_gives_what_the_windows_give(spark):
    bodies = ["A.\nB.\n\nC.", "First. Second spans\nlines.\n\nThird.", "# H\nx y.\n- a\n- b. c d. e\n\n\n\tz\u00a0 q", "", None, "\n \n", "a\r\nb\rc"]
    d = docs(spark, *bodies)
    rows = segment.paragraphs(segment.lines(d))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(segment.paragraphs_of(d)) == key(rows)
    assert key(segment.sentences_of(d)) == key(segment.sentences(rows))
    assert key(segment.chunk_documents(d, 2)) == key(segment.chunks(segment.sentences(rows), 2))


def test_links_brackets_and_targets(spark):
    assert one(spark, "see file:///a%20b+c.txt, (file:///d) [file:///e] file:// x", refs.markdown_links(F.col("x"))) == "see [file:///a b+c.txt,](file:///a%20b+c.txt,) ([file:///d](file:///d)) [[file:///e](file:///e)] file:// x"
    assert one(spark, "no\nlink", refs.markdown_links(F.col("x"))) == "no\nlink" and one(spark, None, refs.markdown_links(F.col("x"))) is None
    assert one(spark, 0.5, text.score_percent("x"), "double") == " 50.00" and text.word_targets(200) == (150, 250, 300, 100)
    assert one(spark, "t", text.bracketed("x", False)) == "[t]" and one(spark, "t", text.bracketed("x", True)) == "t" and one(spark, None, text.bracketed("x", True, "page")) == "[Unprocessable page]"
    assert spark.range(1).select(text.first_text(["id"]).alias("y")).first().y is None
