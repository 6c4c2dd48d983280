"""Findings of a language model about paragraphs, in batches: what is asked, who answers, and where the answers are.

Who answers is a ``Sampler``: any function from a request to a JSON value, which each worker calls for its batches. Nothing
here calls a service of its own.

Defined results: a reply that is no list gives no findings; a finding counts if it names a paragraph of the batch, quotes
words that are there and no other finding has taken, and corrects them to something else; paragraphs are asked about whole,
up to ``MOST`` characters; paragraphs without a letter, and null ones, are not asked about.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import tune
from .proof import batched

MOST = 6000
LANGUAGES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish"}
FOUND = "doc_id long, pos int, source string, rule string, start int, end int, text string, message string, suggestion string"


class Sampler(Protocol):
    def __call__(self, request: str) -> object:
        """The JSON value of the model's reply."""


def request(paragraphs: list[str], lang: str = "en") -> str:
    """What the model is asked, with the paragraphs numbered from 1."""
    asked = (
        f"Proofread the numbered paragraphs, which are in {LANGUAGES.get(lang, lang)}. Report errors of spelling, grammar, punctuation and wrong words only, not matters of taste, names or terms."
        ' Answer with a JSON array of objects {"p": paragraph number, "text": the wrong words exactly as they stand, "fix": the right ones, "why": the reason in a few words}, or [] if there is no error.'
    )
    return "\n".join([asked, "", *(f"[{k + 1}] {' '.join(p.split())}" for k, p in enumerate(paragraphs))])


def findings(paragraphs: list[str], reply: object) -> list[list[tuple[int, int, str, str, str]]]:
    """start, end, text, message and correction of what a reply finds in each paragraph, by place."""
    out: list[list[tuple[int, int, str, str, str]]] = [[] for _ in paragraphs]
    for f in reply if isinstance(reply, list) else ():
        number, text, fix, why = (f.get(k) for k in ("p", "text", "fix", "why")) if isinstance(f, dict) else (None,) * 4
        number = int(number) if isinstance(number, (int, float)) or str(number).isdigit() else 0
        if not 1 <= number <= len(paragraphs) or not isinstance(text, str) or not isinstance(fix, str) or text in ("", fix):
            continue
        own, at = out[number - 1], paragraphs[number - 1].find(text)
        while at >= 0 and any(at < e and at + len(text) > s for s, e, *_ in own):
            at = paragraphs[number - 1].find(text, at + 1)
        if at >= 0:
            own.append((at, at + len(text), text, why if isinstance(why, str) and why else "Suggested by the assistant", fix))
    return [sorted(x) for x in out]


def assistant_issues(lines: DataFrame, sampler: Sampler, lang: str = "en") -> DataFrame:
    """Findings of ``sampler`` in lines (doc_id, pos, text): a request a batch of a document's lines."""
    asked = lines.filter(F.col("text").rlike("\\p{L}")).withColumn("text", F.substring("text", 1, MOST))
    with_batch = asked.join(batched(asked), ["doc_id", "pos"])
    groups = with_batch.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, paragraphs in zip(batch["doc_id"], batch["p"], strict=True):
                texts = [x["text"] for x in paragraphs]
                for x, found in zip(paragraphs, findings(texts, sampler(request(texts, lang))), strict=True):
                    out += [(doc, x["pos"], "assistant", "assistant", s, e, text, why, fix) for s, e, text, why, fix in found]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    tune(lines.sparkSession)
    return groups.select("doc_id", "p").mapInPandas(kernel, FOUND)


def all_issues(local: DataFrame, assistant: DataFrame) -> DataFrame:
    """The rules' findings and the assistant's, as one table; ``local`` has no source column of its own."""
    return local.withColumn("source", F.lit("local")).unionByName(assistant)
