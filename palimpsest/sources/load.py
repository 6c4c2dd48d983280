"""Files of any supported kind as blocks: what a file is, its text, and its reader."""

from __future__ import annotations

import base64
import io
import quopri
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.options import DEFAULTS, CompareOptions
from ..functions.tokens import block_sig, is_blank
from ..model import Doc, dumps
from ..operators.review import block_stream
from ..storage import tune
from . import delimited, html, markdown, text

# Extensions of families of formats, and files that are told apart to be refused.
MARKDOWN = {"md", "markdown", "mdown", "mkd"}
HTML = {"html", "htm", "xhtml"}
REFUSED = {
    "pages": "an Apple Pages document", "wpd": "a WordPerfect document", "hwp": "a Hangul document", "xps": "an XPS document", "oxps": "an XPS document", "gdoc": "a shortcut to a Google Doc",
}
OTHER_ZIPS = {"spreadsheetml": "an Excel workbook", "presentationml": "a PowerPoint presentation"}
OTHER_ODF = {"opendocument.spreadsheet": "an OpenDocument spreadsheet", "opendocument.presentation": "an OpenDocument presentation"}
CFB = bytes.fromhex("d0cf11e0a1b11ae1")


class Unreadable(ValueError):
    """A file that is not a document this library reads."""


def sniff(content: bytes, ext: str = "") -> tuple[str, str]:
    """(kind, detail) from the first bytes: pdf, rtf, cfb, docx, odt, epub, zip, fodt or text."""
    head = content[:1024].decode("utf-8", "replace")
    if re.match(r"\s*%PDF-\d", head.removeprefix("﻿")) or (ext == "pdf" and re.search(r"%PDF-\d", head)):
        return "pdf", ""
    if re.match(r"\s*\{\\rtf", head):
        return "rtf", ""
    if content.startswith(CFB):
        return "cfb", ""
    if content.startswith(b"PK"):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                part = lambda n: z.read(n).decode("utf-8", "replace") if n in z.namelist() else ""
                types, mime, container = part("[Content_Types].xml"), part("mimetype").strip(), part("META-INF/container.xml")
        except (zipfile.BadZipFile, OSError, RuntimeError):
            return "zip", "damaged"
        if types:
            other = next((v for k, v in OTHER_ZIPS.items() if k in types and "wordprocessingml" not in types), None)
            return ("zip", other) if other else ("docx", "")
        if "opendocument.text" in mime:
            return "odt", ""
        if mime == "application/epub+zip" or container:
            return "epub", ""
        return "zip", next((v for k, v in OTHER_ODF.items() if k in mime), "")
    if re.match(r"\s*(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)*<office:document\b", head, re.S):
        return "fodt", ""
    return "text", ""


def decode(content: bytes) -> str:
    """UTF-16 by its byte order mark, else UTF-8, else Windows-1252."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content[2:].decode("utf-16-le" if content[0] == 0xFF else "utf-16-be", "replace")
    try:
        return content.decode("utf-8").removeprefix("﻿")
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in content) if any(b in content for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)) else content.decode("cp1252")


def web_archive(source: str) -> str | None:
    """The HTML part of a MIME archive."""
    m = re.search(r'boundary="?([^"\r\n;]+)"?', source, re.I)
    for part in source.split("--" + m[1]) if m else [source]:
        head, gap, body = part.replace("\r\n", "\n").partition("\n\n")
        if not gap or not re.search(r"content-type:\s*text/html", head, re.I):
            continue
        how = re.search(r"content-transfer-encoding:\s*([\w-]+)", head, re.I)
        if how and how[1].lower() == "quoted-printable":
            charset = re.search(r'charset="?([\w-]+)', head, re.I)
            raw = quopri.decodestring(body.encode())
            try:
                return raw.decode(charset[1] if charset else "utf-8", "replace")
            except LookupError:
                return raw.decode("utf-8", "replace")
        if how and how[1].lower() == "base64":
            return decode(base64.b64decode(re.sub(r"\s+", "", body)))
        return body
    return None


def looks_like_html(source: str) -> bool:
    return re.match(r"\s*(<!doctype html|<html|<body|<meta|<p[\s>]|<div[\s>]|<h[1-6][\s>])", source, re.I) is not None


def read(content: bytes, name: str) -> Doc:
    """The document in a file; raises ``Unreadable`` with the reason."""
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    if ext in REFUSED:
        raise Unreadable(f'"{name}" is {REFUSED[ext]}.')
    kind, detail = sniff(content, ext)
    if kind in ("docx", "odt", "fodt", "rtf", "epub"):
        from . import office

        return office.READERS[kind](content, name)
    if kind == "zip":
        raise Unreadable(f'"{name}" is damaged (it could not be unzipped).' if detail == "damaged" else f'"{name}" is {detail or "a zip archive, not a document"}.')
    if kind == "pdf":
        from . import pdf, pdf_text

        try:
            return pdf.read(content, name)
        except pdf_text.Locked as e:
            raise Unreadable(str(e)) from e
    if kind == "cfb":
        from . import word97

        try:
            return word97.read(content, name)
        except word97.Damaged as e:
            raise Unreadable(f'"{name}" is not a Word document this library can read: {e}.') from e
    source = decode(content)
    if re.search(r"^MIME-Version:", source[:2000], re.I | re.M) and re.search("multipart/related", source[:4000], re.I) and (page := web_archive(source)):
        doc = html.read(page, name)
        doc.label = "Web archive"
        return doc
    if ext in HTML or (ext in ("doc", "dot") and looks_like_html(source)):
        return html.read(source, name)
    if ext in MARKDOWN:
        return markdown.read(source, name)
    if ext in ("csv", "tsv", "tab"):
        return delimited.read(source, name, ext)
    if ext in text.FORMATS:
        return text.read(source, name, ext)
    if ext in ("doc", "dot") or "\0" in source or re.search(r"[\x01-\x08\x0e-\x1f]", source[:4000]):
        raise Unreadable(f'"{name}" is not a document this library can read.')
    return html.read(source, name) if looks_like_html(source) else text.read(source, name, ext or "txt")


def pasted(rich: str, plain: str, name: str | None = None) -> tuple[Doc, str]:
    """A document from clipboard contents, HTML first, and where it came from."""
    if rich.strip():
        source = "google-docs" if re.search('docs-internal-guid|id="docs-', rich) else "word" if re.search('urn:schemas-microsoft-com:office|class="?Mso', rich) else "web"
        names = {"google-docs": "Pasted from Google Docs", "word": "Pasted from Word"}
        doc = html.read(rich, name or names.get(source, "Pasted text"))
        if doc.blocks:
            return doc, source
    return text.read(plain, name or "Pasted text"), "text"


#: What readers raise for a file that is not as its format says. Any other error is a reader's own, and ends the job.
BAD_FILE = (ValueError, LookupError, EOFError, StopIteration, struct.error, zipfile.BadZipFile, zlib.error, ET.ParseError)

BLOCKS = "doc_id long, pos int, block_id string, type string, role string, level int, blank boolean, stream string, sig string, body string, error string"


def blocks(files: DataFrame, o: CompareOptions = DEFAULTS, columns: Iterable[str] | None = None) -> DataFrame:
    """Blocks of files (doc_id, name, content). A file that cannot be read is one row with the reason in ``error``.

    ``columns``: those to give, all if None. Signatures and bodies take longer than reading, so they are made only to be given.
    """
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    wanted = set(names if columns is None else columns)
    given = [n for n in names if n in wanted]
    sig, body = "sig" in given, "body" in given

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, name, content in zip(batch["doc_id"], batch["name"], batch["content"], strict=True):
                try:
                    found = read(bytes(content or b""), name).blocks
                except BAD_FILE as e:  # a row of its own, which does not end the others
                    out.append((doc, -1, None, None, None, None, None, None, None, None, str(e)))
                    continue
                for pos, b in enumerate(found):
                    out.append((doc, pos, f"{doc}:{pos}", b.type, b.role if b.type == "p" else None, b.level, is_blank(b), block_stream(b), block_sig(b, o) if sig else None, dumps(b) if body else None, None))
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"level": "Int32", "blank": "boolean"})[given]

    tune(files.sparkSession)
    return files.select("doc_id", "name", "content").mapInPandas(kernel, ", ".join(c for c in BLOCKS.split(", ") if c.split()[0] in given))


def files(spark, path: str) -> DataFrame:
    """Files of a folder as (doc_id, name, content)."""
    from pyspark.sql import functions as F

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")
