"""What counts as equal when documents are compared."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class CompareOptions:
    """``granularity`` is "word" or "char". Empty paragraphs are left out by default; all else is compared as it is."""

    granularity: str = "word"
    ignore_case: bool = False
    ignore_whitespace: bool = False
    ignore_formatting: bool = False
    ignore_empty: bool = True
    normalize_punctuation: bool = False

    def key(self) -> str:
        """The options as a short string: the granularity and a digit for each switch."""
        first, *rest = asdict(self).values()
        return first + "".join(str(int(x)) for x in rest)


DEFAULTS = CompareOptions()
