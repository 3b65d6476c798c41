"""Files as documents: listing, dispatch by extension, decoding to lines with references."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators.watch import selected

#: Decoders by extension; the first that knows the extension takes the file.
KINDS = {
    "image": ("jpg", "jpeg", "png", "gif", "webp", "bmp"), "plaintext": ("txt", "md", "markdown"), "ascii": ("html", "htm"),
    "binary": ("odt", "docx"), "pdf": ("pdf",),
}
_LINES = re.compile(r"\r\n|\r|\n")
_BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "ul", "ol", "table", "pre", "blockquote", "title"}


def kind_of(path: str) -> str | None:
    """Decoder kind of a path (extension in any case), None if unprocessable."""
    ending = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    return next((k for k, endings in KINDS.items() if ending in endings), None)


def decode_plain(data: bytes) -> str | None:
    """Text of bytes: by byte order mark, as UTF-8, else as Windows-1252; None for what holds zero bytes."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, errors="replace")
    if b"\x00" in data:
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", errors="replace")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif tag in _BLOCKS:
            self.out.append("\n- " if tag == "li" else "\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in _BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"[ \t\r\f\v]+", " ", data))


def decode_html(data: bytes) -> str | None:
    """Visible text of a page: one line per block, at most one blank line between blocks; line breaks of the source are kept."""
    text = decode_plain(data)
    if text is None:
        return None
    reader = _Text()
    reader.feed(text)
    lines = [x.strip() for x in "".join(reader.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def decode_office(data: bytes) -> str | None:
    """Paragraphs of a DOCX or ODT file, a blank line apart; None if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            root = ElementTree.fromstring(z.read("word/document.xml" if "word/document.xml" in names else "content.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    paragraphs = ["".join(e.itertext()) for e in root.iter() if local(e) in ("p", "h") and "}" in e.tag]
    return "\n\n".join(p for p in paragraphs if p.strip())


def office_images(data: bytes) -> list[bytes]:
    """Images in a DOCX or ODT container by extension; what was read before a failure."""
    found: list[bytes] = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in sorted(z.namelist()):
                if kind_of(name) == "image":
                    found.append(z.read(name))
    except zipfile.BadZipFile:
        pass
    return found


_DECODERS = {"plaintext": decode_plain, "ascii": decode_html, "binary": decode_office}


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``: ``file_path, size, mtime`` (seconds)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    return found.select(path.alias("file_path"), F.col("length").alias("size"), F.unix_micros("modificationTime").cast("double").alias("_u")).select(
        "file_path", "size", (F.col("_u") / 1e6).alias("mtime")
    )


def decode(files: DataFrame) -> DataFrame:
    """``file_path, kind, ref_kind, lines`` of (path, content): lines as array of (text, ref from 1).

    lines is null for unprocessable files and for kinds whose reader isn't installed (images and PDF need one).
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"], strict=True):
                path = re.sub(r"^file:/+", "/", path)
                kind = kind_of(path)
                text = _DECODERS[kind](bytes(data)) if kind in _DECODERS and data is not None else None
                lines = None if text is None else [{"text": x, "ref": i} for i, x in enumerate(_LINES.split(text), 1)]
                rows.append((path, kind, "page" if kind in ("pdf", "image") else "line", lines))
            yield pd.DataFrame(rows, columns=["file_path", "kind", "ref_kind", "lines"])

    return files.select("path", "content").mapInPandas(work, "file_path string, kind string, ref_kind string, lines array<struct<text string, ref int>>")


def read_documents(spark: SparkSession, root: str, include: list[str], exclude: list[str] | None = None) -> DataFrame:
    """Decoded documents of the selected files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    chosen = selected(files.select(F.regexp_replace("path", "^file:/+", "/").alias("file_path")), include, exclude or [])
    return decode(files.withColumn("file_path", F.regexp_replace("path", "^file:/+", "/")).join(chosen, "file_path", "left_semi"))
