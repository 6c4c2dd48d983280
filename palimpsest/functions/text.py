"""Text functions on columns, in Spark's own expressions.

Regular expressions go in as literals, in Java's dialect: white space and word boundaries are spelt out where its
classes differ from those the semantics come from.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .options import DEFAULTS, CompareOptions

# Character classes of the comparison, for Java.
INVISIBLE = "\\u00ad\\u200b\\u200c\\u200d\\u2060\\ufeff"
SPACE = "\\s\\u000b\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
LETTER = f"\\p{{L}}\\p{{M}}\\p{{N}}_{INVISIBLE}"
WORD = f"[{LETTER}]+(?:['\\u2019\\-\\u2010\\u2011][{LETTER}]+)*"
TOKEN = f"{WORD}|[{SPACE}]+|[\\s\\S]"
COUNTED = "[\\p{L}\\p{N}]+(?:['\\u2019][\\p{L}\\p{N}]+)*"
DENSE = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}"
VOLATILE_FIELDS = ["PAGE", "NUMPAGES", "SECTIONPAGES", "SECTION", "DATE", "TIME", "PRINTDATE", "SAVEDATE", "EDITTIME", "NUMWORDS", "NUMCHARS", "FILESIZE"]
ROLE_NAMES = {"h": "Heading", "title": "Title", "subtitle": "Subtitle", "quote": "Quote", "code": "Code", "caption": "Caption", "toc": "Contents"}
FNV_BASIS, FNV_PRIME, WORD32 = 0x811C9DC5, 0x01000193, 0xFFFFFFFF


def lines(text: Column) -> Column:
    """Lines of a text file: a byte order mark and one empty last line go, any line ending counts."""
    plain = F.regexp_replace(F.regexp_replace(text, "^\\ufeff", ""), "\\r\\n?", "\n")
    parts = F.split(plain, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def eol(text: Column) -> Column:
    """The line ending that most lines have; ``\\n`` in a tie."""
    crlf, lone = F.regexp_count(text, F.lit("\\r\\n")), F.regexp_count(text, F.lit("(?<!\\r)\\n"))
    return F.when(crlf > lone, F.lit("\r\n")).otherwise(F.lit("\n"))


def is_blank(text: Column) -> Column:
    """Nothing but white space and invisible characters."""
    return ~text.rlike("[^\\s\\u000b\\u00a0\\u1680\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff\\u00ad]")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(COUNTED)).cast("long")


def split_words(text: Column, granularity: str = "word") -> Column:
    """Tokens of plain text: words, runs of white space, other characters; dense scripts character by character."""
    if granularity == "char":
        return F.filter(F.split(text, ""), lambda c: c != "")
    return _undense(text, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def _undense(text: Column, found: Column) -> Column:
    """Tokens with those of dense scripts taken apart. A text without such characters is looked at once and stays."""
    parts = lambda w: F.when(w.rlike(f"[{DENSE}]"), F.regexp_extract_all(w, F.lit(f"[{DENSE}]|[^{DENSE}]+"), F.lit(0))).otherwise(F.array(w))
    return F.when(text.rlike(f"[{DENSE}]"), F.flatten(F.transform(found, parts))).otherwise(found)


def words(text: Column) -> Column:
    """The words of a text by comparison key, with the default options: its tokens with a letter or digit, normalized.

    In a text without invisible characters, words change only by their fixed spaces, of which they have none: one
    expression over the text finds them, and no word is looked at again but for its letters.
    """
    has_letter = lambda w: w.rlike("[\\p{L}\\p{N}]")
    plain = F.filter(_undense(text, F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), has_letter)
    every = F.transform(F.filter(split_words(text), has_letter), lambda w: normalize(w, DEFAULTS))
    return F.when(text.rlike(f"[{INVISIBLE}]"), every).otherwise(plain)


def normalize(text: Column, o: CompareOptions) -> Column:
    """The comparison key of a word. Composing to NFC is left to the Python tokenizer; here text counts as composed."""
    t = F.regexp_replace(text, f"[{INVISIBLE}]", "")
    t = F.regexp_replace(t, "[\\u00a0\\u2007\\u202f\\u2000-\\u200a]", " ")
    if o.normalize_punctuation:
        t = F.regexp_replace(t, "[\\u2018\\u2019\\u201a\\u201b\\u2032]", "'")
        t = F.regexp_replace(t, "[\\u201c\\u201d\\u201e\\u201f\\u2033]", '"')
        t = F.regexp_replace(t, "[\\u2010-\\u2015\\u2212]", "-")
        t = F.replace(t, F.lit("…"), F.lit("..."))
    if o.ignore_case:
        t = F.lower(t)
    if o.ignore_whitespace:
        t = F.when(t.rlike(f"^[{SPACE}]+\\z"), F.lit(" ")).otherwise(t)
    return t


def hash_text(text: Column) -> Column:
    """FNV-1a over the characters (UTF-16 units; of the basic plane), in base 36, and the length."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_PRIME).bitwiseAND(WORD32)
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(FNV_BASIS).cast("long"), step)
    return F.concat(F.lower(F.conv(h.cast("string"), 10, 36)), F.lit("."), F.lower(F.conv(F.length(text).cast("string"), 10, 36)))


def hash_bytes(data: Column) -> Column:
    """FNV-1a over bytes, in base 16, and their number."""
    octets = F.filter(F.split(F.regexp_replace(F.hex(data), "(..)", "$1 "), " "), lambda c: c != "")
    step = lambda h, c: (h.bitwiseXOR(F.conv(c, 16, 10).cast("long")) * FNV_PRIME).bitwiseAND(WORD32)
    h = F.aggregate(octets, F.lit(FNV_BASIS).cast("long"), step)
    return F.concat(F.lower(F.hex(h)), F.lit(":"), F.lower(F.hex(F.octet_length(data).cast("long"))))


def field_key(code: Column, text: Column) -> Column:
    return F.when(code.isin(VOLATILE_FIELDS), code).otherwise(F.concat(code, F.lit("|"), text))


def props_sig(role: Column, level: Column, ordered: Column, list_level: Column, align: Column, o: CompareOptions) -> Column:
    own = F.when(role.isin("h", "toc"), F.coalesce(level, F.lit(1)).cast("string")).otherwise(F.lit(""))
    listed = F.when(ordered.isNotNull(), F.concat(F.when(ordered, F.lit("|ol")).otherwise(F.lit("|ul")), list_level.cast("string"))).otherwise(F.lit(""))
    aligned = F.lit("") if o.ignore_formatting else F.coalesce(F.concat(F.lit("|"), align), F.lit(""))
    return F.concat(role, own, listed, aligned)


def describe_props(role: Column, level: Column, ordered: Column, list_level: Column, align: Column) -> Column:
    """A paragraph's style in words, like "Heading 2" or "Numbered list, level 2, centered"."""
    base = F.lit("Normal text")
    for code, name in ROLE_NAMES.items():
        named = F.concat(F.lit(name + " "), F.coalesce(level, F.lit(1)).cast("string")) if code in ("h", "toc") else F.lit(name)
        base = F.when(role == code, named).otherwise(base)
    depth = F.when(list_level > 0, F.concat(F.lit(", level "), (list_level + 1).cast("string"))).otherwise(F.lit(""))
    kind = F.when(ordered, F.lit("Numbered list")).otherwise(F.lit("Bulleted list"))
    listed = F.when(ordered.isNull(), base).when(role == "p", F.concat(kind, depth)).otherwise(F.concat(base, F.lit(", "), F.lower(kind), depth))
    how = F.when(align == "justify", F.lit(", justified")).when(align == "center", F.lit(", centered")).when(align.isNotNull(), F.lit(", right-aligned")).otherwise(F.lit(""))
    return F.concat(listed, how)


def role_from_name(name: Column) -> Column:
    """struct(role, level) of a style name; null if it says nothing."""
    n = F.lower(F.trim(name))
    digit = lambda p: F.nullif(F.regexp_extract(n, p, 1), F.lit("")).cast("int")
    head, toc = digit("^heading\\s*(\\d)\\z"), digit("^(?:toc|contents)\\s*(\\d)\\z")
    role = F.when(head.isNotNull(), "h").when(toc.isNotNull(), "toc").when(n.isin("title", "subtitle", "caption"), n)
    role = role.when(n.isin("quote", "quotations", "intense quote", "block text"), "quote")
    role = role.when(n.isin("html preformatted", "plain text", "code", "source code", "preformatted text"), "code")
    return F.when(role.isNotNull(), F.struct(role.alias("role"), F.coalesce(head, toc).alias("level")))


def _roman(n: Column) -> Column:
    """Each decimal place is a fixed word."""
    places = [["", *"i ii iii iv v vi vii viii ix".split()], ["", *"x xx xxx xl l lx lxx lxxx xc".split()], ["", *"c cc ccc cd d dc dcc dccc cm".split()], ["", "m", "mm", "mmm"]]
    digit = lambda k: (F.floor(n / 10**k) % 10).cast("int")
    words = [F.element_at(F.array(*[F.lit(w) for w in p]), digit(k) + 1) for k, p in reversed(list(enumerate(places)))]
    return F.when((n > 0) & (n < 4000), F.concat(*words)).otherwise(n.cast("string"))


def _letters(n: Column) -> Column:
    """a to z, then doubled letters, and so on."""
    return F.when(n > 0, F.repeat(F.char(97 + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))).otherwise(n.cast("string"))


def format_number(n: Column, form: str) -> Column:
    """A counter in a list's number format."""
    forms = {
        "lowerLetter": lambda: _letters(n), "upperLetter": lambda: F.upper(_letters(n)), "lowerRoman": lambda: _roman(n), "upperRoman": lambda: F.upper(_roman(n)),
        "decimalZero": lambda: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string")), "none": lambda: F.lit(""), "bullet": lambda: F.lit("•"),
    }
    return forms.get(form, lambda: n.cast("string"))()


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def clip_end(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut after a whole word where there is one, and an ellipsis."""
    head = F.substring(text, 1, most)
    whole = F.regexp_replace(head, f"[{SPACE}]+[^{SPACE}]*\\z", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(whole == "", head).otherwise(whole), F.lit("…")))


def clip_start(text: Column, most: int) -> Column:
    tail = F.substring(text, -most, most)
    whole = F.regexp_replace(tail, f"^[^{SPACE}]*[{SPACE}]+", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.lit("…"), F.when(whole == "", tail).otherwise(whole)))


def escape_html(text: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, "([\\\\`*_\\[\\]<>|])", "\\\\$1")


def google_doc_id(link: Column) -> Column:
    """The document id in a link, or the text itself if it looks like one."""
    s = F.trim(link)
    found = F.regexp_extract(s, "docs\\.google\\.com/(?:a/[^/]+/)?document/(?:u/\\d+/)?d/([\\w-]{20,})", 1)
    query = F.regexp_extract(s, "[?&]id=([\\w-]{20,})", 1)
    return F.when(found != "", found).when(query != "", query).when(s.rlike("^[\\w-]{25,}\\z"), s)


def paste_source(html: Column) -> Column:
    return F.when(html.rlike('docs-internal-guid|id="docs-'), "google-docs").when(html.rlike('urn:schemas-microsoft-com:office|class="?Mso'), "word").otherwise("web")


def quote_field(text: Column, delimiter: str) -> Column:
    """A field of delimited text, in quotes where it has to be."""
    needed = text.rlike('["\\r\\n]') | F.contains(text, F.lit(delimiter)) | text.rlike(f"^[{SPACE}]|[{SPACE}]\\z")
    return F.when(needed, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
