"""Sentences, words and chunks of a text with their places, as table functions.

``register`` names the functions in a session: ``segment(text)``, ``words(text)``
and ``sentence_chunks(text, size, overlap, most)`` are used after ``lateral``.
Places are code points: text[start:end] is the segment. A row is worked on alone.
Null and blank texts have no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from textloom.functions import text as T

_GAP = re.compile(r"\n[^\S\n]*\n\s*")
_ITEM = re.compile(r"[^\S\n]*(?:[-*•+]|\(?\d{1,3}[.)]|\(?[a-z][.)])[^\S\n]+\S")
_END = re.compile(r"""[.!?]["'’”)\]]{0,3}(?=\s)""")
#: The mark of a list item alone, which is no sentence.
_MARK = re.compile(r"\(?(?:\d{1,3}|[a-z])[.)]")
_LAST = re.compile(r"(\S+)\Z")
_WORD = re.compile(r"\S+")
#: Short forms with inner full stops, and those that T.ABBREVIATIONS names.
_DOTTED = re.compile(r"(?:[a-z]\.)+[a-z]\Z")


def _goes_on(before: str) -> bool:
    """Whether the full stop at the end of before ends no sentence."""
    if not before.endswith("."):
        return False
    word = _LAST.search(before)[1].lower().strip("\"'“‘([").rstrip(".")
    return word in T.ABBREVIATIONS or len(word) == 1 and word.isalpha() or bool(_DOTTED.match(word))


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    part = text[a:b]
    return a + len(part) - len(part.lstrip()), b - (len(part) - len(part.rstrip()))


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    cuts = [(0, 0), *(m.span() for m in _GAP.finditer(text)), (len(text), len(text))]
    spans = [_trimmed(text, a, b) for (_, a), (b, _) in zip(cuts, cuts[1:])]
    return [(a, b) for a, b in spans if b > a]


def _blocks(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Parts of a paragraph that sentences do not cross: a line that is a list item, or the lines between such."""
    lines, at = [], a
    while at < b:
        end = text.find("\n", at, b)
        end = b if end < 0 else end
        lines.append((at, end, bool(_ITEM.match(text, at, end))))
        at = end + 1
    start = None
    for x, y, item in lines:
        if item:
            if start is not None:
                yield start, x
                start = None
            yield x, y
        elif start is None:
            start = x
    if start is not None:
        yield start, b


def sentence_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, paragraph) in order: cut after stops that end a sentence; a list item is one of its own."""
    out = []
    for p, (a, b) in enumerate(paragraph_spans(text or "")):
        for x, y in _blocks(text, a, b):
            at = x
            for cut in [*(m.end() for m in _END.finditer(text, x, y)), y]:
                if cut == y or not (_goes_on(text[max(at, cut - 40) : cut]) or _MARK.fullmatch(text, *_trimmed(text, at, cut))):
                    i, j = _trimmed(text, at, cut)
                    if j > i:
                        out.append((i, j, p))
                    at = cut
    return out


def chunk_spans(text: str | None, size: int = 200, overlap: int = 40, most: int = 40) -> list[tuple[int, int, int, int]]:
    """(first sentence, last sentence, start, end) of chunks of whole sentences: about ``size`` words, sharing sentences of
    about ``overlap`` words; sizes grow so that at most ``most`` cover the text. A longer sentence is a chunk."""
    spans = sentence_spans(text)
    n = [len(_WORD.findall(text, a, b)) for a, b, _ in spans]
    while True:
        out, first = [], 0
        while first < len(spans):
            last, words = first, n[first]
            while last + 1 < len(spans) and words + n[last + 1] <= size:
                last += 1
                words += n[last]
            out.append((first, last, spans[first][0], spans[last][1]))
            if last + 1 == len(spans):
                break
            nxt, shared = last + 1, 0
            while nxt - 1 > first and shared + n[nxt - 1] <= overlap:
                nxt -= 1
                shared += n[nxt]
            first = nxt
        if len(out) <= most:
            return out
        size = size * 3 // 2 + 1


@udtf(returnType="start int, end int, paragraph int, sentence string")
class Segment:
    def eval(self, text: str) -> Iterator[tuple]:
        for a, b, p in sentence_spans(text):
            yield a, b, p, text[a:b]


@udtf(returnType="start int, end int, word string")
class Words:
    def eval(self, text: str) -> Iterator[tuple]:
        for m in _WORD.finditer(text or ""):
            yield m.start(), m.end(), m[0]


@udtf(returnType="chunk int, first_sentence int, last_sentence int, start int, end int")
class SentenceChunks:
    def eval(self, text: str, size: int, overlap: int, most: int) -> Iterator[tuple]:
        for k, row in enumerate(chunk_spans(text, size, overlap, most)):
            yield (k, *row)


def register(spark: SparkSession) -> None:
    for name, f in (("segment", Segment), ("words", Words), ("sentence_chunks", SentenceChunks)):
        spark.udtf.register(name, f)
