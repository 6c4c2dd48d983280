"""Wording of counts, lists and formats on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .options import CompareOptions

# Badges of document kinds, and what the comparison options leave out.
KIND_LABELS = {
    "docx": "Word", "odt": "OpenDocument", "rtf": "RTF", "doc": "Word 97", "epub": "EPUB", "pdf": "PDF", "html": "HTML", "markdown": "Markdown", "text": "Text", "csv": "CSV", "sample": "Sample",
}
LEFT_OUT = {"ignore_formatting": "formatting", "ignore_case": "letter case", "ignore_whitespace": "extra spaces", "normalize_punctuation": "quote and dash styles"}
FILE_FORMATS = {
    "Word document": ["docx", "doc", "docm", "dotx", "dotm", "dot"],
    "OpenDocument text": ["odt", "fodt", "ott"],
    "Rich Text file": ["rtf"],
    "PDF": ["pdf"],
    "EPUB book": ["epub"],
    "web page": ["html", "htm", "xhtml", "mht", "mhtml"],
    "Markdown file": ["md", "markdown", "mdown", "mkd"],
    "CSV file": ["csv", "tsv", "tab"],
    "YAML file": ["yaml", "yml"],
    "text file": ["txt", "text"],
}


def plural(n: Column, one: str, many: str | None = None) -> Column:
    """"1 change", "1,200 changes"."""
    return F.concat(F.format_number(n.cast("long"), 0), F.when(n == 1, f" {one}").otherwise(f" {many or one + 's'}"))


def list_text(items: Column) -> Column:
    """"a", "a and b", "a, b and c"; an empty list is an empty text."""
    last = F.element_at(items, F.when(F.size(items) > 0, -1).otherwise(F.lit(None)))
    head = F.array_join(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), ", ")
    return F.when(F.size(items) < 2, F.coalesce(last, F.lit(""))).otherwise(F.concat(head, F.lit(" and "), last))


def with_article(name: Column) -> Column:
    """A name with "a", or "an" before a vowel's letter."""
    return F.concat(F.when(name.rlike("(?i)^[aeiou]"), "an ").otherwise("a "), name)


def kind_label(kind: Column, name: Column, label: Column) -> Column:
    """The badge of a document: its format's own label, if it has one."""
    pairs = [F.lit(x) for pair in KIND_LABELS.items() for x in pair]
    pasted = kind.isin("html", "text") & name.startswith("Pasted")
    return F.coalesce(F.nullif(label, F.lit("")), F.when(pasted, "Pasted").otherwise(F.create_map(*pairs)[kind]))


def base_name(name: Column) -> Column:
    """A file name without its extension."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, "(?i)\\.[a-z0-9]{1,8}$", "")), F.lit("")), F.lit("document"))


def extension(name: Column) -> Column:
    """What follows the last full stop of a file name, in lower case; empty without one."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def file_format(name: Column) -> Column:
    """What a file is called by its extension; null without one."""
    ext = extension(name)
    named = F.concat(F.lit("."), ext, F.lit(" file"))
    for words, exts in FILE_FORMATS.items():
        named = F.when(ext.isin(exts), words).otherwise(named)
    return F.when(ext != "", named)


def same_text(o: CompareOptions) -> str:
    """Words for two documents without differences, naming what the options leave out."""
    left = [words for name, words in LEFT_OUT.items() if getattr(o, name)]
    listed = left[0] if len(left) == 1 else ", ".join(left[:-1]) + f" and {left[-1]}" if left else ""
    return f"A and B match, ignoring {listed}" if left else "A and B are identical"
