"""Sentences to chunks: small sequential helpers that run inside a task on one section at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Lengths in characters.
CHUNK, SNIPPET, LEAST, MERGE_BELOW, CEILING = 500, 160, 24, 160, 1000
_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+")


def _pack(pieces: list[str], limit: int) -> list[str]:
    """Join neighbours with a space as long as they fit."""
    out: list[str] = []
    for p in pieces:
        if out and len(out[-1]) + 1 + len(p) <= limit:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def sentence_chunks(text: str, limit: int = CHUNK) -> list[str]:
    """Whole sentences up to ``limit``; a longer one is cut between words, a longer word between letters, on its own."""
    out: list[str] = []
    run: list[str] = []
    for sentence in _SENTENCE_END.split(" ".join(text.split())):
        if len(sentence) <= limit:
            run += [sentence] if sentence else []
            continue
        out += _pack(run, limit)
        run = []
        for piece in _pack(sentence.split(" "), limit):
            out += [piece[i : i + limit] for i in range(0, len(piece), limit)]
    return out + _pack(run, limit)


def is_data_table(rows: list[list[str]]) -> bool:
    """Whether a table has a header of two cells with text, and a value in a row below it."""
    return len(rows) > 1 and len(rows[0]) > 1 and any(rows[0]) and any(map(any, rows[1:]))


def row_lines(rows: list[list[str]]) -> Iterator[str]:
    """A data table's body rows as ``head: value; …``, all of them; one is made at a time, as each repeats the header."""
    head = rows[0]
    for row in rows[1:]:
        if line := "; ".join(f"{head[i]}: {v}" if i < len(head) and head[i] else v for i, v in enumerate(row) if v):
            yield line


def table_lines(rows: list[list[str]]) -> list[str]:
    """The lines of a table; none unless it is a data table."""
    return list(row_lines(rows)) if is_data_table(rows) else []
