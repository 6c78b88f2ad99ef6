"""Cut oversized texts at natural boundaries, with an overlap between pieces.

Recursive bisection: a body longer than the limit less the overlap is cut at the
strongest boundary in the middle half of its span, of equally strong ones at the
nearest to the midpoint, and both halves are treated alike. Afterwards each body
but the first is preceded by about the last `overlap` characters before it.
Boundaries by strength: fence edge or heading, blank line, line break, end of
sentence, end of clause, white space, and as a last resort any place that isn't
within a combined character. All sizes are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A cut falls at the end of a match; strongest last, so that it overwrites.
_BOUNDARIES = [
    (1, re.compile(r"\s+")),
    (2, re.compile(r"[,;:)\]]\s+")),
    (3, re.compile(r"[.!?…][\"'”»)\]]*\s+")),
    (4, re.compile(r"[^\S\n]*\n")),
    (5, re.compile(r"\n[^\S\n]*\n\s*")),
    (6, re.compile(r"\n(?=#{1,6} |```)|\n```[^\n]*\n")),
]
_JOINED = re.compile(r"[̀-ͯ‍︀-️\U0001f3fb-\U0001f3ff]")


def _fenced(text: str) -> list[tuple[int, int]]:
    """Insides of fenced code, where only line breaks and white space are boundaries."""
    edges = [m.start() for m in re.finditer(r"(?m)^```", text)]
    return list(zip(edges[::2], edges[1::2], strict=False))


def bodies(text: str, size: int) -> list[tuple[int, int]]:
    """Spans of at most `size` code points that together are the text."""
    import numpy as np

    if len(text) <= size:
        return [(0, len(text))]
    strength = np.zeros(len(text) + 1, dtype=np.int8)
    for s, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            strength[m.end()] = s
    for a, b in _fenced(text):
        inside = strength[a + 1 : b]
        np.putmask(inside, (inside == 2) | (inside == 3), 1)
        np.putmask(inside, inside == 5, 4)
    for m in _JOINED.finditer(text):  # before it and after a joiner
        strength[m.start()] = -1
        if m.group() == "‍":
            strength[m.end()] = -1
    done, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= size:
            done.append((a, b))
            continue
        quarter, mid = max(1, (b - a) // 4), (a + b) // 2
        lo, hi = max(a + 1, mid - quarter), min(b - 1, mid + quarter)
        window = strength[lo : hi + 1].astype(np.int64)
        near = np.abs(np.arange(lo, hi + 1) - mid)
        cut = lo + int(np.argmax(window * (hi - lo + 2) - near))
        todo += [(cut, b), (a, cut)]
    return done


def overlap_start(text: str, start: int, overlap: int) -> int:
    """Where the overlap before `start` begins: a word's beginning near start - overlap."""
    at = start - overlap
    if at <= 0:
        return 0
    m = re.compile(r"\s+(?=\S)").search(text, max(0, at - 1), min(start, at + max(1, overlap // 5)))
    if m:
        return max(at, m.end())
    while at < start and _JOINED.match(text[at]):
        at += 1
    return at


def split_text(text: str, limit: int = 1800, overlap: int = 200) -> list[tuple[int, int, int]]:
    """Pieces as (start, body start, end); text[start:end] has at most `limit` code points."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    if len(text) <= limit:
        return [(0, 0, len(text))]
    return [(overlap_start(text, a, overlap) if a else 0, a, b) for a, b in bodies(text, limit - overlap)]


PIECES = "id string, piece_no int, n_pieces int, start_offset int, body_offset int, end_offset int, piece string"


def split_oversized(rows: DataFrame, id_col: str = "id", text_col: str = "text", limit: int = 1800, overlap: int = 200) -> DataFrame:
    """One row per piece of each text longer than `limit`; other rows give one piece.

    Bodies (body_offset to end_offset) are disjoint and join to the whole text. A
    null text gives no piece, an empty one an empty piece; rows with a null id are
    kept under a null id. Rows are treated singly: repeats give repeated pieces.
    Further columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                parts = split_text(text, limit, overlap)
                out += [(i, k, len(parts), s, a, b, text[s:b]) for k, (s, a, b) in enumerate(parts)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(",")])

    chosen = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return chosen.mapInPandas(run, PIECES)
