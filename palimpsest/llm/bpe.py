"""Exact, cached encoders for the two public BPE files, with the library itself behind every cache miss.

A text whose characters are all in a range where the file's normalizer and pre-tokenizer are known to agree with
Python's is cut by a plain regular expression and looked up piece by piece; any other text goes to the library whole.
Caches hold results of the library only and are emptied when full, so they bound memory and never change a result.

Defined results: a null or empty text has no ids and no tokens; a text of any length is encoded whole; texts do not depend
on each other, so repeated rows get equal results.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

#: Entries of each cache of a worker, about 150 bytes each: of the two of an encoder, and of the one of a counter.
CACHE = 200_000
COUNTS = 900_000

#: Characters for which Python's classes equal the library's: no control characters but ASCII space, no superscript or
#: fraction digits (numbers to the library, letters to ``\w``), no combining marks, no dotted capital I.
_SAFE = "\t\n\x0b\x0c\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba-\xbb\xbf-įı-ɏ‐-‧‰-⁞€"
_UNSAFE = re.compile(f"[^{_SAFE}]")
_CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_PIECES = re.compile(rf"{_CONTRACTIONS}| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_WORD_PIECES = re.compile(rf"{_CONTRACTIONS}|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def safe(text: str) -> bool:
    """Whether the fast path is exact for ``text``: safe characters only, and no special token's string in it."""
    return "<|" not in text and _UNSAFE.search(text) is None


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def byte_level(piece: str) -> str:
    return piece if piece.isascii() and piece.isalnum() else "".join([_LETTERS[b] for b in piece.encode()])


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Bounded(dict):
    """A cache: misses are made by ``make`` and kept until ``limit`` entries are there."""

    def __init__(self, make, fixed=(), limit: int = CACHE):
        super().__init__(fixed)
        self.make, self.fixed, self.limit = make, dict(fixed), limit + len(dict(fixed))

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
            self.update(self.fixed)
        value = self[key] = self.make(key)
        return value


#: In a piece of letters up to U+024F, each UTF-8 byte is a-z, a leading byte of two, or a following one. Word ends are
#: symbols of their own in the word-end file, so final bytes move to values that such pieces do not use.
_FINAL_OF = {b: b - 0x20 for b in range(0x61, 0x7B)} | {b: b - 0x80 for b in range(0x80, 0xC0)}
_INNER = bytes([*range(0x61, 0x7B), *range(0x80, 0xCA)])
_FINAL = bytes(_FINAL_OF.get(b, b) for b in range(256))


@lru_cache(maxsize=4)
def letter_merger(path: str):
    """The word-end file's merges over the symbols above, run by tiktoken's merge loop: its ranks are the file's ids,
    which follow the order of the merges. The tests hold it against the library's own loop."""
    import tiktoken

    back, end = {c: b for b, c in _LETTERS.items()}, "</w>"
    ranks = {}
    for token, ident in tokenizer(path).get_vocab(with_added_tokens=False).items():
        stem = token.removesuffix(end)
        raw = bytes(back[c] for c in stem)
        if not raw or raw.translate(None, _INNER):
            continue
        if stem != token and raw[-1] >= 0xC0:  # no piece ends in a leading byte
            continue
        ranks[raw[:-1] + raw[-1:].translate(_FINAL) if stem != token else raw] = ident
    return tiktoken.Encoding("letters", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


class WordEncoder:
    """Ids of the word-end BPE file, as little-endian integers of ``width`` bytes."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.pieces = _Bounded(self._piece)
        self.chunks = _Bounded(self._chunk)

        self.form = "<%d" + ("H" if self.width == 2 else "I")
        self.merge = letter_merger(path)

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        if not raw.translate(None, _INNER) and raw[-1] < 0xC0:
            ids = self.merge(raw[:-1] + raw[-1:].translate(_FINAL))
        else:
            ids = [t.id for t in self.library.model.tokenize(byte_level(piece))]
        return struct.pack(self.form % len(ids), *ids)

    def _chunk(self, chunk: str) -> bytes:
        found = _WORD_PIECES.findall(chunk)
        return self.pieces[found[0]] if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (None: none). White space never joins two pieces, so chunks between it are encoded alone."""
        if not text:
            return b""
        if not safe(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


class ByteCounter:
    """Token counts of the byte-level BPE file by the whole-token shortcut."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.counts = _Bounded(self._merged, whole_tokens(path), COUNTS)

    def _merged(self, piece: str) -> int:
        return len(self.library.model.tokenize(byte_level(piece)))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text (None: 0)."""
        if not text:
            return 0
        if not safe(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.counts.__getitem__, _BYTE_PIECES.findall(text)))


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> dict[str, int]:
    """The proof behind the shortcut: vocabulary strings that are one pre-token and that the model encodes as exactly
    their own id. A pre-token found here is one token; any other has to be merged."""
    library, back = tokenizer(path), {c: b for b, c in _LETTERS.items()}
    proved = {}
    for token, ident in library.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(back[c] for c in token).decode()
        except (UnicodeDecodeError, KeyError):
            continue
        if safe(text) and _BYTE_PIECES.findall(text) == [text]:
            got = library.model.tokenize(token)
            if len(got) == 1 and got[0].id == ident:
                proved[text] = 1
    return proved
