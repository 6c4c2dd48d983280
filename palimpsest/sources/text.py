"""Plain text files: one paragraph per line."""

from __future__ import annotations

import json

from ..model import Doc, para

# What file extensions are, and which are shown in a monospace font. All but Text are.
FORMATS = {
    "txt": "Text", "text": "Text",
    "json": "JSON", "jsonc": "JSON", "json5": "JSON", "geojson": "JSON", "ndjson": "JSON",
    "xml": "XML", "xsd": "XML", "xsl": "XML", "xslt": "XML", "plist": "XML",
    "svg": "SVG",
    "yaml": "YAML", "yml": "YAML",
    "toml": "TOML",
    "ini": "Config", "cfg": "Config", "conf": "Config", "config": "Config", "properties": "Config", "env": "Config",
    "log": "Log",
    "tex": "LaTeX", "latex": "LaTeX", "sty": "LaTeX", "cls": "LaTeX",
    "bib": "BibTeX",
    "rst": "reStructuredText",
    "adoc": "AsciiDoc", "asciidoc": "AsciiDoc",
    "org": "Org",
    "textile": "Textile",
    "wiki": "Wiki",
    "srt": "Subtitles", "vtt": "Subtitles",
    "sql": "SQL",
    "diff": "Diff", "patch": "Diff",
    "sh": "Shell", "bash": "Shell", "zsh": "Shell", "fish": "Shell",
    "ps1": "PowerShell",
    "bat": "Batch", "cmd": "Batch",
    "css": "CSS", "scss": "CSS", "sass": "CSS", "less": "CSS",
    "js": "Code", "mjs": "Code", "cjs": "Code", "jsx": "Code", "ts": "Code", "mts": "Code", "cts": "Code", "tsx": "Code", "vue": "Code",
    "svelte": "Code", "astro": "Code", "py": "Code", "pyi": "Code", "rb": "Code", "go": "Code", "rs": "Code", "java": "Code", "kt": "Code",
    "kts": "Code", "scala": "Code", "groovy": "Code", "gradle": "Code", "c": "Code", "h": "Code", "cc": "Code", "cpp": "Code", "cxx": "Code",
    "hh": "Code", "hpp": "Code", "hxx": "Code", "cs": "Code", "fs": "Code", "fsx": "Code", "vb": "Code", "swift": "Code", "m": "Code", "mm": "Code",
    "php": "Code", "pl": "Code", "pm": "Code", "r": "Code", "lua": "Code", "dart": "Code", "ex": "Code", "exs": "Code", "erl": "Code", "hrl": "Code",
    "clj": "Code", "cljs": "Code", "elm": "Code", "hs": "Code", "ml": "Code", "mli": "Code", "nim": "Code", "zig": "Code", "jl": "Code",
    "sol": "Code", "graphql": "Code", "gql": "Code", "proto": "Code", "tf": "Code", "hcl": "Code", "cmake": "Code", "mk": "Code", "makefile": "Code",
    "dockerfile": "Code", "gitignore": "Code", "gitattributes": "Code", "editorconfig": "Code",
}
#: A JSON file of one line is spread out when it is longer than this.
LONG_JSON = 400


def decoded(text: str) -> tuple[str, str]:
    """Text with plain line ends and without a byte order mark, and the line end that most lines had."""
    text = text.removeprefix("﻿")
    crlf = text.count("\r\n")
    return text.replace("\r\n", "\n").replace("\r", "\n"), "\r\n" if crlf > text.count("\n") - crlf else "\n"


def read(text: str, name: str, ext: str = "txt") -> Doc:
    body, eol = decoded(text)
    label = FORMATS.get(ext, "Text")
    notes = []
    if ext in ("json", "geojson") and "\n" not in body.strip() and len(body) > LONG_JSON:
        try:
            body = json.dumps(json.loads(body), indent=2, ensure_ascii=False) + "\n"
            notes = ["This JSON file was on a single line, so it is shown formatted."]
        except ValueError:
            pass
    lines = body.split("\n")
    if lines[-1] == "":
        lines.pop()
    return Doc(name, "text", [para(x) for x in lines], ext, label, label != "Text", eol, notes=notes)
