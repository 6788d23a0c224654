"""Files as a source: scan, filter, and text extraction by suffix.

Names and sizes are filtered before contents are read. Plain text is decoded inside the JVM; containers go through Arrow
batches with readers from the standard library. A reader that fails gives null, as does a suffix without one.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.scalar import suffix
from tessella.operators.filters import MAX_BYTES, should_index

Reader = Callable[[bytes, str], str | None]


def _shape(df: DataFrame, root: str) -> DataFrame:
    path = F.regexp_replace("path", "^[a-z]+:/+", "/")
    base = re.sub("^[a-z]+:/+", "/", root).rstrip("/") + "/"
    inside = F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)
    return df.select(inside.alias("path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, suffixes: list[str] | None = None, most: int = MAX_BYTES) -> DataFrame:
    """The files under a folder that the filter keeps: path (below root), size_bytes, mtime_ns, content. Sizes are tested by the source itself."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where((F.col("length") > 0) & (F.col("length") <= most))
    return _shape(files, root).where(should_index(F.col("path"), F.col("size_bytes"), patterns, suffixes, most))


def watch(spark: SparkSession, root: str, patterns: list[str] | None = None, suffixes: list[str] | None = None, most: int = MAX_BYTES, per_batch: int = 1000) -> DataFrame:
    """The same as a stream of new files."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    return _shape(files, root).where(should_index(F.col("path"), F.col("size_bytes"), patterns, suffixes, most))


def _xml(data: bytes) -> ElementTree.Element:
    return ElementTree.fromstring(data)


def _all(node: ElementTree.Element, tag: str) -> list[ElementTree.Element]:
    """Descendants by local name."""
    return [x for x in node.iter() if x.tag.rpartition("}")[2] == tag]


def _text(node: ElementTree.Element, tag: str = "t") -> str:
    return "".join(x.text or "" for x in _all(node, tag)).strip()


def _attr(node: ElementTree.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), "")


def _row(cells: list[ElementTree.Element]) -> str:
    return " | ".join(t for t in map(_text, cells) if t)


def read_docx(data: bytes, name: str) -> str | None:
    """Paragraphs, headings with as many # as their level, then tables."""
    body = _xml(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    tables = _all(body, "tbl")
    inside = {p for t in tables for p in _all(t, "p")}
    out = []
    for p in _all(body, "p"):
        if p not in inside and (t := _text(p)):
            style = next((_attr(s, "val") for s in _all(p, "pStyle")), "")
            level = re.fullmatch(r"Heading ?(\d+)", style)
            out.append(f"{'#' * int(level[1])} {t}" if level else t)
    out += [line for t in tables for r in _all(t, "tr") if (line := _row(_all(r, "tc")))]
    return "\n\n".join(out) or None


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def read_pptx(data: bytes, name: str) -> str | None:
    """Slides under a line with their number: paragraphs, table rows, speaker notes."""
    book, out = zipfile.ZipFile(io.BytesIO(data)), []
    names = book.namelist()
    for n, slide in enumerate(_numbered(names, r"ppt/slides/slide(\d+)\.xml"), 1):
        root = _xml(book.read(slide))
        inside = {p for t in _all(root, "tbl") for p in _all(t, "p")}
        lines = [t for p in _all(root, "p") if p not in inside and (t := _text(p))]
        lines += [line for t in _all(root, "tbl") for r in _all(t, "tr") if (line := _row(_all(r, "tc")))]
        notes = slide.replace("slides/slide", "notesSlides/notesSlide")
        if notes in names and (said := "\n".join(t for p in _all(_xml(book.read(notes)), "p") if (t := _text(p)))):
            lines.append(f"[Speaker notes: {said}]")
        if lines:
            out.append(f"--- Slide {n} ---\n" + "\n".join(lines))
    return "\n\n".join(out) or None


def read_xlsx(data: bytes, name: str, most: int = 1000) -> str | None:
    """Sheets under their names, cells of a row with bars between them, `most` rows of a sheet and then how many more."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = [_text(si) for si in _all(_xml(book.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in book.namelist() else []
    titles = [_attr(s, "name") for s in _all(_xml(book.read("xl/workbook.xml")), "sheet")]
    out = []
    for title, part in zip(titles, _numbered(book.namelist(), r"xl/worksheets/sheet(\d+)\.xml"), strict=False):
        rows, lines = _all(_xml(book.read(part)), "row"), []
        for r in rows[:most]:
            cells = []
            for c in _all(r, "c"):
                v = next((x.text or "" for x in _all(c, "v")), None)
                cells.append(shared[int(v)] if _attr(c, "t") == "s" and v else v if v is not None else _text(c))
            if line := " | ".join(cells).strip(" |"):
                lines.append(line)
        if len(rows) > most:
            lines.append(f"... ({len(rows) - most} more rows)")
        if lines:
            out.append("\n".join([f"## Sheet: {title}", *lines]))
    return "\n\n".join(out) or None


def plain(html: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html)).strip()


def read_epub(data: bytes, name: str) -> str | None:
    """Chapters of over 20 characters without tags."""
    book = zipfile.ZipFile(io.BytesIO(data))
    pages = [n for n in book.namelist() if re.search(r"\.x?html?$", n)]
    texts = [plain(book.read(n).decode("utf-8", "replace")) for n in pages]
    return "\n\n".join(t for t in texts if len(t) > 20) or None


def read_rtf(data: bytes, name: str) -> str | None:
    """Text of the main group: control words and hidden groups go, escapes become characters."""
    source = data.decode("utf-8", "replace")
    out, stack, skip = [], [], False
    token = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\(.)|([{}])|([^\\{}\r\n]+)|[\r\n]", re.I)
    hidden = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer"}
    for word, number, code, char, brace, text in token.findall(source):
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif char == "*" or word in hidden:
            skip = True
        elif not skip:
            if word in ("par", "line"):
                out.append("\n")
            elif word == "tab":
                out.append("\t")
            elif word == "u" and number:
                out.append(chr(int(number) % 65536))
            elif code:
                out.append(bytes.fromhex(code).decode("cp1252", "replace"))
            else:
                out.append(char or text)
    return "".join(out).strip() or None


def read_image(data: bytes, name: str) -> str | None:
    """Format and size from the header of PNG, GIF, BMP and JPEG files."""
    kind, size = None, None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        kind, size = "PNG", struct.unpack(">II", data[16:24])
    elif data[:6] in (b"GIF87a", b"GIF89a"):
        kind, size = "GIF", struct.unpack("<HH", data[6:10])
    elif data[:2] == b"BM":
        kind, size = "BMP", struct.unpack("<ii", data[18:26])
    elif data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                kind, size = "JPEG", (w, h)
                break
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return f"Image: {name}\nFormat: {kind}\nSize: {size[0]}x{abs(size[1])}" if kind and size else None


def read_sound(data: bytes, name: str) -> str | None:
    """Length of WAV files, and the tags that close MP3 files."""
    out = [f"Audio: {name}"]
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        import wave

        with wave.open(io.BytesIO(data)) as w:
            out += [f"Duration: {w.getnframes() / w.getframerate():.1f}s", f"Channels: {w.getnchannels()}", f"Sample rate: {w.getframerate()}"]
    elif data[-128:-125] == b"TAG":
        tag = data[-125:]
        for label, a, b in (("Title", 0, 30), ("Artist", 30, 60), ("Album", 60, 90), ("Year", 90, 94)):
            if value := tag[a:b].decode("latin-1").strip("\0 "):
                out.append(f"{label}: {value}")
    return "\n".join(out) if len(out) > 1 else None


def read_pdf(data: bytes, name: str) -> str | None:
    """Pages by whichever PDF library is installed; null without one."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages) or None


#: Readers by suffix; `register` adds to them. All other suffixes of text files are decoded as UTF-8.
READERS: dict[str, Reader] = {}


def register(suffixes: list[str], reader: Reader) -> None:
    READERS.update({s.lower(): reader for s in suffixes})


register([".docx"], read_docx)
register([".pptx"], read_pptx)
register([".xlsx"], read_xlsx)
register([".epub"], read_epub)
register([".rtf"], read_rtf)
register([".pdf"], read_pdf)
register([".png", ".jpg", ".jpeg", ".gif", ".bmp"], read_image)
register([".mp3", ".wav"], read_sound)
#: Suffixes without a reader here, whose contents aren't text.
OPAQUE = [".tiff", ".webp", ".flac", ".m4a", ".ogg", ".aac", ".mp4", ".mkv", ".avi", ".webm", ".mov"]


def _udf(readers: dict[str, Reader]):
    @F.pandas_udf(T.StringType())
    def extract(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, names, kinds in batches:
            out = []
            for data, name, kind in zip(contents, names, kinds, strict=True):
                try:
                    out.append(readers[kind](bytes(data), name))
                except Exception:  # a damaged file has no text
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return extract


def extract_text(df: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """df with `text` in place of the content; files that have none are left out."""
    kind, name = suffix(path), F.substring_index(path, "/", -1)
    readers = dict(READERS)
    decoded: Column = F.decode(F.col(content), "UTF-8")
    plain_ = df.where(~kind.isin([*readers, *OPAQUE])).withColumn("text", F.when(F.is_valid_utf8(F.col(content).cast("string")), decoded).otherwise(F.make_valid_utf8(F.col(content).cast("string"))))
    read = df.where(kind.isin(list(readers))).withColumn("text", _udf(readers)(F.col(content), name, kind))
    return plain_.unionByName(read).drop(content).where(F.regexp_replace("text", r"(?U)\s+", "") != "")
