"""Delimited text: parsing, guessing the delimiter, writing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Block, Cell, Doc, Row, para
from ..operators.changes import block_text

# The delimiters that are tried, in order.
DELIMITERS = [",", ";", "\t", "|"]


def parse(text: str, delimiter: str = ",") -> list[list[str]]:
    """Records of delimited text. A quote opens only at the start of a field; inside, two of them are one. CR, LF and CRLF
    end a record outside quotes; what follows a closing quote belongs to the field."""
    stop = re.compile(rf"{re.escape(delimiter)}|\r\n|\r|\n|\Z")
    records, record, at = [], [], 0
    while at < len(text) or record:
        field = ""
        while not field and text.startswith('"', at):
            end = at + 1
            while True:
                close = text.find('"', end)
                if close < 0:
                    field, at = field + text[end:], len(text)
                    break
                field += text[end:close]
                if text.startswith('"', close + 1):
                    field, end = field + '"', close + 2
                    continue
                at = close + 1
                break
        m = stop.search(text, at)
        record.append(field + text[at : m.start()])
        at = m.end()
        if m[0] != delimiter:
            last = m[0] == ""
            if not (last and record == [""]):
                records.append(record)
            record = []
            if last:
                break
    return records


def guess(text: str) -> str:
    """The delimiter that splits the first 20 lines most; one that splits all alike counts double."""
    lines = [x for x in re.split(r"\r?\n", text)[:20] if x]

    def score(d: str) -> int:
        widths = [len((parse(x, d) or [[""]])[0]) for x in lines]
        return (widths[0] - 1) * (2 if len(set(widths)) == 1 else 1) if widths else -1

    best = max(DELIMITERS, key=lambda d: (score(d), -DELIMITERS.index(d)))
    return best if score(best) >= 0 else ","


def read(text: str, name: str, ext: str = "csv") -> Doc:
    """A file whose every record is a one-row table, so that records line up one by one."""
    from .text import decoded

    body, eol = decoded(text)
    delimiter = "\t" if ext in ("tsv", "tab") else guess(body)

    def cell(field: str, header: bool) -> Cell:
        return Cell([para(x) for x in re.split(r"\r?\n", field)], header=header)

    blocks = [Block("table", rows=[Row([cell(c, not i) for c in r], header=not i)], fragment=True) for i, r in enumerate(parse(body, delimiter))]
    return Doc(name, "csv", blocks, ext, "TSV" if delimiter == "\t" else "CSV", True, eol, delimiter)


def quoted(text: str, delimiter: str) -> str:
    needed = any(c in text for c in '"\r\n') or delimiter in text or text != text.strip()
    return '"' + text.replace('"', '""') + '"' if needed else text


def write(doc: Doc, delimiter: str | None = None) -> str:
    d, lines = delimiter or doc.delimiter, []
    for b in doc.blocks:
        if b.type == "table":
            cells = lambda r: ["" if c.vmerge == "continue" else quoted("\n".join(map(block_text, c.blocks)), d) for c in r.cells]
            lines += [d.join(cells(r)) for r in b.rows]
        elif b.type in ("p", "opaque"):
            lines += [quoted(block_text(x), d) for x in ([b] if b.type == "p" else b.blocks)]
    return doc.eol.join(lines) + doc.eol


def records(text: Column, delimiter: Column) -> Column:
    """Records of a column of delimited texts, as arrays of fields."""

    @F.pandas_udf("array<array<string>>")
    def parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, delimiters in batches:
            yield pd.Series([parse(t, d) for t, d in zip(texts, delimiters, strict=True)])

    return parsed(text, delimiter)
