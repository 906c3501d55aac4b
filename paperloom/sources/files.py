"""Files as rows: discovery, size guard, decoding and text of the supported formats."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions by what is done with them, and the largest file that is read.
TEXT = ("txt", "md", "json", "csv", "log", "yaml", "yml", "xml", "html", "htm")
RICH = ("rtf", "docx", "doc")
IMAGES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
MOST_BYTES = 50 * 1024 * 1024
# Encodings tried in turn where no mark tells, and RTF groups that hold no text.
ENCODINGS = ("utf-8", "cp1251", "cp866", "latin-1")
HIDDEN_GROUPS = frozenset("fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr footnote generator listtable listoverridetable themedata datastore".split())


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` but hidden ones: path, length, modified, ext and whether they are supported. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    ext = extension(F.col("path"))
    return files.where(~F.col("path").rlike(r"/\.[^/]*$")).withColumn("ext", ext).withColumn("supported", ext.isin(*TEXT, *RICH, *IMAGES))


def skipped(files: DataFrame) -> DataFrame:
    """How many files of each extension aren't supported."""
    return files.where(~F.col("supported")).groupBy("ext").agg(F.count(F.lit(1)).alias("files"))


def decoded(content: bytes) -> str:
    """Text by byte-order mark, by the zeros of UTF-16 in a sample, else by the first encoding that fits."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    sample = content[:4096]
    if len(sample) > 3:
        even, odd = sample[0::2].count(0), sample[1::2].count(0)
        if max(even, odd) > len(sample) // 5 and min(even, odd) * 4 <= max(even, odd):
            return content.decode("utf-16-le" if odd > even else "utf-16-be", "replace")
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|[\r\n]+|(.)", re.S | re.I)


def rtf_text(raw: str) -> str:
    """Text of an RTF document: code pages, escaped characters with their substitutes, no hidden groups."""
    page = re.search(r"\\ansicpg(\d+)", raw)
    encoding = f"cp{page[1]}" if page else "cp1251"
    out: list[str] = []
    pending = bytearray()
    stack: list[tuple[bool, int]] = []
    hidden, skip, wide = False, 0, 1

    def flush() -> None:
        if pending:
            out.append(pending.decode(encoding, "replace"))
            pending.clear()

    for m in _RTF.finditer(raw):
        code, word, number, symbol, brace, char = m.groups()
        if brace == "{":
            stack.append((hidden, wide))
        elif brace == "}":
            flush()
            hidden, wide = stack.pop() if stack else (False, 1)
            skip = 0
        elif symbol == "*":
            hidden = True
        elif word:
            flush()
            if word in HIDDEN_GROUPS:
                hidden = True
            elif hidden:
                continue
            elif word == "uc" and number:
                wide = int(number)
            elif word == "u" and number:
                out.append(chr(int(number) % 65536))
                skip = wide
            elif word in ("par", "line", "row"):
                out.append("\n")
            elif word in ("tab", "cell"):
                out.append("\t")
        elif hidden:
            continue
        elif skip and (code or char or symbol):
            skip -= 1
        elif code:
            pending.append(int(code, 16))
        elif symbol:
            flush()
            out.append({"~": "\u00a0", "_": "-"}.get(symbol, symbol if symbol in "\\{}" else ""))
        elif char:
            flush()
            out.append(char)
    flush()
    return "".join(out).strip()


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs, and rows of tables joined by bars; a corrupt or oversized document gives an empty text."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if z.getinfo("word/document.xml").file_size > MOST_BYTES:
                return ""
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""

    def text(node: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t"))

    lines = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            lines.append(text(node))
        elif node.tag == f"{_W}tbl":
            lines += [" | ".join(text(c).strip() for c in row.findall(f"{_W}tc")) for row in node.iter(f"{_W}tr")]
    return "\n".join(x for x in lines if x.strip())


def text_of(ext: str, content: bytes) -> str:
    """Text of a file by extension; what a .doc holds is told by its first bytes, old binary ones give an empty text."""
    if ext == "docx" or ext == "doc" and content[:2] == b"PK":
        return docx_text(content)
    if ext == "rtf" or ext == "doc" and content[:5] == b"{\\rtf":
        return rtf_text(decoded(content))
    return "" if ext == "doc" else decoded(content)


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, ext, text, error) of the text files below ``root`` within the size guard. A file that fails has its error."""
    ext = extension(F.col("path"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.where((F.col("length") <= MOST_BYTES) & ext.isin(*TEXT, *RICH)).select("path", ext.alias("ext"), "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, content in zip(batch["path"], batch["ext"], batch["content"], strict=True):
                try:
                    rows.append((path, kind, text_of(kind, bytes(content)), None))
                except Exception as e:  # one file must not end the job
                    rows.append((path, kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "ext", "text", "error"])

    return files.mapInPandas(read, "path string, ext string, text string, error string")


def page_text(native: Column, recognised: Column, least: int = 50) -> Column:
    """The text layer of a page where it is long enough, else what was recognised."""
    return F.when(F.length(F.trim(native)) >= least, native).otherwise(recognised)
