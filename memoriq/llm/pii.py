"""Find personal information in free text and replace it with typed placeholders.

A character-level bidirectional LSTM with CRF transitions labels every character
as outside or as part of one of five kinds. It is trained in numpy by `pii_train`
from labelled spans; its weights are a file of this package. A step of the LSTM,
whose input gate is one less the forget gate, takes STRIDE characters, each with
its own input weights, and gives each its own scores. Texts of any length are
scored in overlapping windows; where two overlap, each character's scores come
from the window in which it stands further inside,
and one best path is then decoded over the scores of the whole text, seams
included. An exact check trims the spans to whole words and drops those that
can't be of their kind. Two places of one kind have at least one character
between them, a blank or a sign, which is outside.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "phone", "id_number", "address", "name"]
TAGS = 1 + len(KINDS)  # outside, then each kind
STRIDE = 2  # characters a step
WINDOW, MARGIN = 1024, 48
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")


@functools.cache
def char_table():
    """Code point -> one of 101 character classes: ASCII as it is, accented letters as their base."""
    import numpy as np

    table = np.full(65_536, 100, np.uint8)
    for p in range(65_536):
        c = chr(p)
        base = unicodedata.normalize("NFKD", c)[:1] if p > 126 else c
        if c == "\n":
            table[p] = NEWLINE
        elif " " <= base <= "~":
            table[p] = ord(base) - 31
        elif c.isupper():
            table[p] = 97
        elif c.isalpha():
            table[p] = 98
        elif c.isdigit():
            table[p] = 99
    return table


CLASSES = 101
NEWLINE = 96


def encode(text: str):
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return char_table().take(points, mode="clip")


def squash(x, out, scratch=None):
    """x / (1 + |x|) into `out`, which may be x if there is a scratch array: S-shaped as tanh, in a fraction of its time."""
    import numpy as np

    size = out if scratch is None else scratch
    np.abs(x, out=size)
    size += 1
    np.divide(x, size, out=out)


def prepared(weights: dict) -> dict:
    """Weights laid out for `lstm`: each gate by itself, and the inputs of a step's characters added up for every pair of classes.

    Gates of 0 to 1 are computed as (squash(x / 2) + 1) / 2, and a state as twice its value.
    """
    import numpy as np

    wx, wh = weights["wx"].astype(np.float32), weights["wh"].astype(np.float32)  # (2, STRIDE, V, 3H), (2, H, 3H), gates f o g
    hidden = wh.shape[1]
    half = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), hidden)
    pairs = wx[:, 0, :, None] + wx[:, 1, None]  # (2, V, V, 3H)
    gates = lambda w: np.ascontiguousarray(np.moveaxis((w * half).reshape(*w.shape[:-1], 3, hidden), -2, 0))
    return {
        "inputs": gates(pairs.reshape(2, -1, 3 * hidden)),  # (3, 2, V * V, H)
        "wh": gates(wh) * np.float32(0.5),  # (3, 2, H, H)
        "wo": weights["wo"].astype(np.float32).reshape(2, hidden, STRIDE * TAGS) * np.float32(0.5),
        "bo": weights["bo"].astype(np.float32),
        "trans": weights["trans"].astype(np.float32),
    }


def turned(length, n: int):
    """(B, n): the steps of each text in reverse order; those after its end stay."""
    import numpy as np

    steps = np.arange(n)
    return np.where(steps < length[:, None], length[:, None] - 1 - steps, steps)


def lstm(ready: dict, x, lengths):
    """Scores (steps, 2, B, STRIDE * TAGS) of class ids x (B, T), T a multiple of STRIDE.

    Both directions run together, each over its own length; the second's steps are counted from the end.
    """
    import numpy as np

    b, t = x.shape
    n = t // STRIDE
    codes = x[:, ::STRIDE].astype(np.int64) * CLASSES + x[:, 1::STRIDE]
    length = -(-lengths // STRIDE)
    both = np.ascontiguousarray(np.stack([codes, np.take_along_axis(codes, turned(length, n), 1)]).transpose(2, 0, 1))  # (N, 2, B)
    inputs, wh, wo = ready["inputs"], ready["wh"], ready["wo"]
    hidden = wh.shape[-1]
    h = np.zeros((2, b, hidden), np.float32)
    c, kept = np.zeros_like(h), np.empty_like(h)
    gates, read = np.empty((3, 2, b, hidden), np.float32), np.empty((3, 2, b, hidden), np.float32)
    f, o, g = gates
    out = np.zeros((n, 2, b, STRIDE * TAGS), np.float32)  # scores only: states would not stay in the cache
    last = np.maximum.accumulate(length[::-1])[::-1]  # the longest from each row on
    active = np.searchsorted(-last, -np.arange(n), side="left")  # rows up to the last that still has a step
    for k in range(n):
        if (m := active[k]) < h.shape[1]:  # texts that have ended take no more steps
            h, c, kept, gates, read = (x[..., :m, :] for x in (h, c, kept, gates, read))
            f, o, g = gates
        np.matmul(h, wh, out=gates)
        for d in (0, 1):
            for gate in range(3):
                inputs[gate, d].take(both[k, d, :m], axis=0, out=read[gate, d], mode="clip")
        gates += read
        squash(gates, gates, read)
        c -= g
        np.multiply(f, c, out=kept)
        kept += c
        kept *= 0.5
        np.add(g, kept, out=c)
        squash(c, kept)
        np.multiply(o, kept, out=h)
        h += kept
        np.matmul(h, wo, out=out[k, :, :m])
    out[:, 0] += ready["bo"]
    return out


def joined(found, lengths):
    """Scores (B, T, TAGS) of both directions of `lstm` together, in the order of the text."""
    import numpy as np

    n, _, b, width = found.shape
    places = (turned(-(-lengths // STRIDE), n) * 2 + 1) * b + np.arange(b)[:, None]
    both = found.reshape(-1, width).take(places, axis=0)
    both += found[:, 0].transpose(1, 0, 2)
    return both.reshape(b, n * STRIDE, TAGS)


def sure_outside(scores, starts, trans):
    """Which characters no best path labels otherwise than outside; arguments as for `best_path`.

    Of a run of tags that aren't outside, each character adds at most `gain` to
    what outside would have scored, and its two ends add `entry` and `leave`.
    Where no run that contains a character can end above zero, every best path
    is outside.
    """
    import numpy as np

    total = scores.shape[1]
    stay = float((trans[1:, 1:]).max() - trans[0, 0])
    entry, leave = float(trans[0, 1:].max() - trans[0, 0]), float(trans[1:, 0].max() - trans[0, 0])
    gain = (functools.reduce(np.maximum, scores[1:]) - scores[0]).astype(np.float64) + stay
    first = np.zeros(total + 1, bool)
    first[starts] = True
    text = np.cumsum(first[:-1])  # number of the text
    sums = np.cumsum(gain)
    step = 4 * (np.abs(sums).max() + abs(entry) + abs(leave) + 1)  # parts the running maxima of different texts
    apart = step * text
    before = np.maximum.accumulate(np.where(first[:-1], max(entry, 0), entry) - (sums - gain) + apart) - apart
    last = step * text[-1] - apart
    after = np.maximum.accumulate((np.where(first[1:], max(leave, 0), leave) + sums + last)[::-1])[::-1] - last
    return before + after < stay - 1e-3 - 1e-14 * step * text[-1]  # less what rounding may take


def best_path(scores, starts, trans, block: int = 16_384):
    """The best tag path of each text; `scores` (TAGS, N) holds the texts one after the other, `starts` where each begins, then N.

    Exact for any text. The stretches between characters that are surely outside
    are decoded, each with outside on both sides (or the text's end). What is
    sure is found for texts of some `block` characters at a time.
    """
    import numpy as np

    total = scores.shape[1]
    path = np.zeros(total, np.int8)
    if not total:
        return path
    rows = np.ascontiguousarray(scores.T)
    first = np.zeros(total + 1, bool)
    first[starts] = True
    sure = np.empty(total, bool)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, total, block)), len(starts) - 1))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if (at := starts[lo]) < (end := starts[hi]):
            sure[at:end] = sure_outside(rows[at:end].T, starts[lo : hi + 1] - at, trans)
    begins = np.flatnonzero(~sure & (first[:-1] | np.r_[True, sure[:-1]]))
    if not len(begins):
        return path
    ends = np.flatnonzero(~sure & (first[1:] | np.r_[sure[1:], True])) + 1
    order = np.argsort(begins - ends, kind="stable")
    begins, ends = begins[order], ends[order]
    lengths = ends - begins
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # stretches longer than each step
    best = rows.take(begins, axis=0).T + np.where(first[begins], 0, trans[0][:, None])
    held = [best]
    for s in range(1, lengths[0]):
        n = active[s]
        best = (held[-1][:, None, :n] + trans[:, :, None]).max(0)
        best += rows.take(begins[:n] + s, axis=0).T
        held.append(best)
    tag = np.zeros(len(begins), np.int64)
    final = np.where(first[ends], 0, trans[:, :1])
    for s in range(lengths[0] - 1, -1, -1):
        n, m = active[s], active[s + 1] if s + 1 < lengths[0] else 0
        tag[m:n] = (held[s][:, m:n] + final[:, m:n]).argmax(0)  # stretches that end here
        if m:
            tag[:m] = (held[s][:, :m] + trans[:, tag[:m]]).argmax(0)
        path[begins[:n] + s] = tag[:n]
    return path


def label_texts(texts: list[str], ready: dict, window: int = WINDOW, margin: int = MARGIN, group: int = 256, check: bool = True) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of each text: windows are scored in groups of like length, whole texts are decoded."""
    import numpy as np

    codes = encode("".join(texts))
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    scores = np.empty((starts[-1], TAGS), np.float32)
    cuts = []  # (length, text, start): windows of all texts, each beginning at a whole step
    for i, text in enumerate(texts):
        n, start = len(text), 0
        while n:
            cuts.append((min(window, n - start), i, start))
            if start + window >= n:
                break
            start += window - 2 * margin
    cuts.sort(key=lambda c: -c[0])
    for g in range(0, len(cuts), group):
        part = cuts[g : g + group]
        lengths = np.array([c[0] for c in part])
        x = np.full((len(part), -(-lengths[0] // STRIDE) * STRIDE), NEWLINE, np.uint8)
        at = [int(starts[i]) + start for _, i, start in part]
        for r, n in enumerate(lengths):
            x[r, :n] = codes[at[r] : at[r] + n]
        both = joined(lstm(ready, x, lengths), lengths)
        for r, (n, i, start) in enumerate(part):
            lo = margin if start else 0  # each place from the window in which it lies further inside
            hi = n if start + n == len(texts[i]) else n - margin
            scores[at[r] + lo : at[r] + hi] = both[r, lo:hi]
    path = best_path(scores.T, starts, ready["trans"])
    # spans of all texts at once: a span ends where the tag changes or the text does
    change = np.diff(path, prepend=0) != 0
    change[starts[:-1][starts[:-1] < len(path)]] = True
    edges = np.flatnonzero(change)
    ends = np.append(edges, len(path))[1:]
    inside = path[edges] > 0
    edges, ends = edges[inside], ends[inside]
    found = [[] for _ in texts]
    for i, a, b in zip((np.searchsorted(starts, edges, side="right") - 1).tolist(), edges.tolist(), ends.tolist(), strict=True):
        found[i].append((a - int(starts[i]), b - int(starts[i]), KINDS[path[a] - 1]))
    return [checked(t, s) if s and check else s for t, s in zip(texts, found, strict=True)]


_WORD = re.compile(r"[^\W_]+")
_MAIL = re.compile(r"[^\s@()<>,;:/]+(?:\s?@\s?|\s?[(\[]at[)\]]\s?|\s+at\s+)[\w-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?|\s+dot\s+)[\w-]+)+", re.I)
#: Titles and words that introduce a name or a place; they don't belong to a name.
_TITLE = re.compile(r"(?:dr|prof|mr|mrs|ms|miss|herr|frau|sra?|attn|cc|met|contact|call|ring|ask|bei|mit|con|en|in|at|for|near|lake|mount|mt|saint|st|north)\b\.?:?\s+", re.I)
_POSTCODE = re.compile(r" \d{5}\b")


def checked(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Trim to whole words and drop what can't be of its kind: too few digits, no address sign, a single name."""
    out = []
    for a, b, kind in spans:
        while a > 0 and (text[a - 1].isalnum() and text[a].isalnum()):
            a -= 1
        while b < len(text) and (text[b].isalnum() and text[b - 1].isalnum()):
            b += 1
        while a < b and not (text[a].isalnum() or (kind == "phone" and text[a] in "+(")):
            a += 1
        keep = "." if kind in ("name", "address") else ""
        while a < b and not (text[b - 1].isalnum() or text[b - 1] in keep):
            b -= 1
        piece = text[a:b]
        if kind == "phone":
            if piece.count(")") > piece.count("(") and a and text[a - 1] == "(":
                a, piece = a - 1, text[a - 1 : b]
            ok = 7 <= sum(c.isdigit() for c in piece) <= 16
        elif kind == "email":
            m = _MAIL.search(text, max(0, a - 1), min(len(text), b + 40))
            ok = m is not None and m.start() < b
            if ok:
                a, b = m.start(), m.end()
        elif kind == "id_number":
            ok = 5 <= sum(c.isdigit() for c in piece) <= 14
        elif kind == "address":
            ok = any(c.isdigit() for c in piece) and len(_WORD.findall(piece)) >= 2 and not piece.lower().startswith("room ")
            if text[b : b + 1] == "." and re.search(r"(?i)\bst$", text[a:b]) and text[b + 1 : b + 2] in (",", "."):
                b += 1
            if text[max(0, a - 3) : a] == "C/ ":
                a -= 3
            if piece.endswith(".") and not re.search(r"(?i)(?:\bst|str)\.$", piece):
                b -= 1
            m = _POSTCODE.match(text, b)
            if m and "," in piece:
                b = m.end()
        else:
            while m := _TITLE.match(text[a:b]):
                a += m.end()
            piece = text[a:b]
            if piece.endswith(".") and not re.search(r"(?:^|[\s,])[^\W\d_]\.$", piece) and not re.search(r"[a-z]{3}\.$", piece):
                b -= 1
            elif piece.endswith(".") and not re.search(r"(?:^|[\s,])[^\W\d_]\.$", piece):
                b -= 1
            piece = text[a:b]
            parts = _WORD.findall(piece)
            # a name is written in one way: not one part capitalised and another in small letters
            mixed = len({p[0].isupper() for p in parts}) > 1
            ok = not mixed and (len(parts) >= 2 or re.search(r"[a-z][A-Z]", piece) is not None)
        if ok and b > a and (not out or a >= out[-1][1]):
            out.append((a, b, kind))
    return out


def load_weights(path: str = WEIGHTS) -> dict:
    import numpy as np

    with np.load(path) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def portions(texts: list[str], most: int = 2_000_000) -> Iterator[list[str]]:
    """Texts in order, in portions of at most `most` characters (or one text): many at once are of like length in their groups, all at once need not fit."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _runner(path: str):
    weights = load_weights(path)  # some 200 kB, shipped with the task
    held: list = []

    def run(texts: list) -> list[list[tuple[int, int, str]]]:
        if not held:  # once per Python worker
            held.append(prepared(weights))
        found: list = []
        for part in portions([t or "" for t in texts]):
            found += label_texts(part, held[0])
        return found

    return run


def find_personal(rows: DataFrame, id_col: str = "id", text_col: str = "text", weights: str = WEIGHTS) -> DataFrame:
    """(id, start_offset, end_offset, kind): each place, 0-based code points, end exclusive.

    Null and empty texts have none; rows are treated singly; further columns are
    not read.
    """
    run_texts = _runner(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = run_texts(b["text"].tolist())
            out = [(i, s, e, k) for i, found in zip(b["id"], spans, strict=True) for s, e, k in found]
            yield pd.DataFrame(out, columns=["id", "start_offset", "end_offset", "kind"])

    kind = rows.schema[id_col].dataType.simpleString()
    chosen = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInPandas(run, f"id {kind}, start_offset long, end_offset long, kind string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redact_personal(rows: DataFrame, id_col: str = "id", text_col: str = "text", weights: str = WEIGHTS) -> DataFrame:
    """(id, text, n_places): texts with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in place of what was found; null stays null."""
    run_texts = _runner(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            spans = run_texts(texts)
            yield pd.DataFrame({"id": b["id"], "text": [t if t is None else redact(t, s) for t, s in zip(texts, spans, strict=True)], "n_places": [len(s) for s in spans]})

    kind = rows.schema[id_col].dataType.simpleString()
    chosen = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInPandas(run, f"id {kind}, text string, n_places int")
