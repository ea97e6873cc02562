"""Text operators: cleaning, punctuation normalisation, segmentation. Sequential cutting runs in Arrow batches, per text."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

_PARAGRAPH, _INDENT = re.compile(r"\n\s*\n"), re.compile(r"\n(?=\s)")
_SENTENCE = re.compile(r"[.!?]+\s+")
#: Words that open a numbered section.
_HEADING = re.compile(r"\n\s*(?:chapter|capitolo|section|parte)\s+\d+", re.IGNORECASE)
MAX_SEGMENTS = 10_000


def paragraph_ends(text: str) -> list[int]:
    return sorted({m.end() for p in (_PARAGRAPH, _INDENT) for m in p.finditer(text)})


def sentence_ends(text: str) -> list[int]:
    return [m.end() for m in _SENTENCE.finditer(text)]


def _first_within(marks: list[int], low: int, high: int) -> int:
    k = bisect_left(marks, low)
    return marks[k] if k < len(marks) and marks[k] <= high else high


def segment_spans(text: str, least: int = 7500, most: int = 17_500, overlap: int = 2500, exact: bool = True) -> Iterator[tuple[int, int]]:
    """(start, end) of overlapping segments: each ends at the first paragraph end, else sentence end, from `least` to `most`
    characters on, and before the next section heading.

    exact: the overlap also applies before headings and at the end of the text, which gives short segments that repeat
    the tail before them. Without it neither repeats anything.
    """
    paragraphs, sentences, headings = paragraph_ends(text), sentence_ends(text), [m.start() for m in _HEADING.finditer(text)]
    at = count = 0
    while at < len(text) and count <= MAX_SEGMENTS:
        high = at + most
        end = _first_within(paragraphs, at + least, high)
        if end == high:
            end = _first_within(sentences, at + least, high)
        k = bisect_left(headings, at + 1)
        cut = k < len(headings) and headings[k] < end
        end = min(headings[k] if cut else end, len(text))
        if end <= at:
            end = min(high, len(text))
        if not text[at:end].strip():
            return
        yield at, end
        count += 1
        if not exact and (cut or end == len(text)):
            at = end
        else:
            at = end - overlap if end - overlap > at else end


def subsegments(text: str, window: int = 300, reach: int = 20, slack: int = 50) -> Iterator[str]:
    """Pieces of about `window` words, joined by single spaces, ending at the last full stop in reach if there is one."""
    words, at = text.split(), 0
    while at < len(words):
        end = min(at + window, len(words))
        if end < len(words):
            ahead = " ".join(words[at : end + reach])
            stop = ahead.rfind(".", 0, len(" ".join(words[at:end])) + slack)
            if stop >= 0:
                end = at + len(ahead[: stop + 1].split())
        yield " ".join(words[at:end])
        at = end


def size_blocks(text: str, limit: int = 700_000, overlap: int = 2000) -> Iterator[str]:
    """Blocks of at most `limit` characters, cut after the last blank line in their second half; each after the first is
    preceded by the last `overlap` characters before it."""
    at = 0
    while at < len(text):
        end = min(at + limit, len(text))
        if end < len(text):
            gap = text.rfind("\n\n", at + limit // 2, end)
            end = gap if gap > at else end
        yield text[max(0, at - overlap) if at else 0 : end]
        at = end


def _rows(df: DataFrame, ids: list[str], text_col: str, cut: Callable[[str], Iterator[tuple]], columns: str) -> DataFrame:
    """ids and one row for each tuple that `cut` gives for the text; null texts give none."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(*row[:-1], *piece) for row in batch.itertuples(index=False, name=None) if isinstance(row[-1], str) for piece in cut(row[-1])]
            yield pd.DataFrame(got, columns=[*ids, *names])

    return df.select(*ids, text_col).mapInPandas(run, f"{kinds}, {columns}")


def segment(df: DataFrame, ids: list[str], text_col: str = "text", least: int = 7500, most: int = 17_500, overlap: int = 2500, exact: bool = True) -> DataFrame:
    """ids, segment_index, start_index, end_index, segment_text (stripped), word_count: a row for each segment."""

    def cut(text: str) -> Iterator[tuple]:
        for k, (a, b) in enumerate(segment_spans(text, least, most, overlap, exact)):
            piece = text[a:b].strip()
            yield k, a, b, piece, len(piece.split())

    return _rows(df, ids, text_col, cut, "segment_index int, start_index int, end_index int, segment_text string, word_count int")


def subsegment(df: DataFrame, ids: list[str], text_col: str = "text", window: int = 300) -> DataFrame:
    """ids, subsegment_index, subsegment_text, word_count."""

    def cut(text: str) -> Iterator[tuple]:
        for k, piece in enumerate(subsegments(text, window)):
            yield k, piece, len(piece.split())

    return _rows(df, ids, text_col, cut, "subsegment_index int, subsegment_text string, word_count int")


def blocks(df: DataFrame, ids: list[str], text_col: str = "text", limit: int = 700_000, overlap: int = 2000) -> DataFrame:
    """ids, block_index, block_text."""
    return _rows(df, ids, text_col, lambda text: enumerate(size_blocks(text, limit, overlap)), "block_index int, block_text string")


def clean_lines(x: Column, limit: int = 800_000) -> Column:
    """Form feeds go, lines are trimmed, empty lines go; the text is cut at `limit` characters only if longer."""
    lines = F.transform(F.split(F.replace(x, F.lit("\f"), F.lit("")), "\n"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", ""))
    return F.left(F.array_join(F.filter(lines, lambda s: s != ""), "\n"), F.lit(limit))


def _quoted(s: str) -> str:
    return re.escape(s)


def _marked(x: Column, mode: str, opening: str | None, closing: str | None, token: str) -> Column:
    if not opening:
        return x
    if mode == "toggle_paragraph":
        lines = F.split(F.regexp_replace(x, "\n$", ""), "\n")
        swap = lambda s: F.when(F.startswith(F.regexp_replace(s, "^\\s+", ""), F.lit(opening)), F.replace(s, F.lit(opening), F.lit(token))).otherwise(s)
        return F.array_join(F.transform(lines, swap), "\n")
    if mode == "enclosed_pair":
        return F.regexp_replace(x, f"(?s){_quoted(opening)}(.*?){_quoted(closing or opening)}", f"{token}$1{token}")
    inner = F.regexp_replace(x, f"(\\.|\\?|!|\n)\\s*{_quoted(opening)}", f"$1 {token} ")
    return F.when(F.startswith(x, F.lit(opening)), F.concat(F.lit(f"{token} "), F.substring(inner, 2, 2_000_000_000))).otherwise(inner)


def normalize_punctuation(
    x: Column, mode: str, dialogue_open: str | None, dialogue_close: str | None = None, thought_open: str | None = None, thought_close: str | None = None
) -> Column:
    """Dialogue and thought markers as plain double and single quotes. Both pass through placeholders first, so that a marker
    equal to the other's quote is not swapped twice."""
    out = _marked(x, mode, dialogue_open, dialogue_close, "\ue000")
    out = _marked(out, mode, thought_open, thought_close, "\ue001")
    return F.replace(F.replace(out, F.lit("\ue000"), F.lit('"')), F.lit("\ue001"), F.lit("'"))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_text(html: str | None) -> str | None:
    """Text of a page without scripts and styles: lines stripped, cut at double spaces, joined by single spaces."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (line.strip() for line in "".join(parser.parts).splitlines())
    return " ".join(piece.strip() for line in lines for piece in line.split("  ") if piece.strip())


@F.pandas_udf(K.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(html_text, na_action="ignore")
