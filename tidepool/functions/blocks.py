"""Fenced code and pipe tables inside texts, found by a scan that looks at each character a bounded number of times.

Code stands between a fence of three backticks and the next one; its language is the word that ends the first line, if the fence begins one.
A table begins at the first pipe of a line that has a second one, and ends with the next run of lines that start with a pipe, hold a
second one and end in a line break; whatever stands between the two is part of it. A line of the run that just ended doesn't begin another.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

FENCE = "```"


def code_spans(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, language, code) of fenced blocks; no language is ''. A fence without another after it opens nothing."""
    start = text.find(FENCE)
    while start >= 0:
        body = at = start + len(FENCE)
        while at < len(text) and (text[at].isalnum() or text[at] == "_"):
            at += 1
        named = at > body and text[at : at + 1] == "\n"
        code = at + 1 if named else body
        close = text.find(FENCE, code)
        if close < 0:
            return
        yield start, close + len(FENCE), text[body:at] if named else "", text[code:close]
        start = text.find(FENCE, close + len(FENCE))


def table_spans(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of pipe tables."""
    line, start, rows = 0, -1, -1
    while line < len(text):
        end = text.find("\n", line)
        stop = end if end >= 0 else len(text)
        pipe = text.find("|", line, stop)
        two = pipe >= 0 and text.find("|", pipe + 1, stop) >= 0
        if start >= 0 and two and pipe == line and end >= 0:
            rows = end + 1
        else:
            if rows >= 0:
                yield start, rows
                start = rows = -1
            if start < 0 and two:
                start = pipe
        line = stop + 1
    if rows >= 0:
        yield start, rows


def cut_out(text: str, spans: Iterator[tuple]) -> str:
    """The text without spans, which come in order."""
    kept, at = [], 0
    for start, end, *_ in spans:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]])


def plain_text(text: str) -> str:
    """The text without fenced code and then without pipe tables, trimmed."""
    text = cut_out(text, code_spans(text))
    return cut_out(text, table_spans(text)).strip()


def table_texts(text: str) -> list[str]:
    return [text[a:b].strip() for a, b in table_spans(text)]


def tables(text: Column) -> Column:
    """Array of the pipe tables of a text; null for null."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(table_texts, na_action="ignore")

    return found(text)


def code(text: Column) -> Column:
    """Array of (language, code) of the fenced blocks of a text, code trimmed, no language is 'text'; null for null."""

    @F.pandas_udf("array<struct<language:string,code:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"language": x or "text", "code": c.strip()} for _, _, x, c in code_spans(t)], na_action="ignore")

    return found(text)


def without_blocks(text: Column) -> Column:
    """The text without fenced code and pipe tables, trimmed; null for null."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(plain_text, na_action="ignore")

    return plain(text)
