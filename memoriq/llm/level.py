"""Reading level by harmonic propagation over the document-word graph.

Documents are joined to the words they use (weight: share of the document's
words) and to style nodes, the neighbouring points of two scales: mean word
length and words per sentence. Graded documents are clamped to their grade; in
each round a node's difficulty becomes the weighted mean of its documents' and a
document's the weighted mean of its nodes'. Averages shrink towards the middle,
so each round stretches them by the line that maps graded documents' estimates,
each without its own grade, to their grades. Last, cuts between the levels are
placed on those estimates.

Nodes are hashed to a fixed number of places, so what a round broadcasts and
sums is of fixed size; documents stay where they are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoriq.session import written

WORD = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?]+(?=\s|$)|\n+")
NODE_BITS, PART_BITS = 18, 10
STYLE_WEIGHT = 0.25


def nodes_of(text: str, places: dict, bits: int = NODE_BITS) -> tuple[list[int], list[float], int]:
    """(places, weights, number of words) of a text's nodes."""
    import math

    import xxhash

    words = WORD.findall(text.lower())
    n = len(words)
    if not n:
        return [], [], 0
    if len(places) > 1_000_000:
        places.clear()
    weight: Counter = Counter()
    for w, k in Counter(words).items():
        at = places.get(w)
        if at is None:
            at = places[w] = xxhash.xxh64_intdigest(w) >> (64 - bits)
        weight[at] += k / n
    ends = [m.end() for m in SENTENCE_END.finditer(text)] + [len(text)]
    sentences, start = 0, 0
    for e in ends:
        sentences += WORD.search(text, start, e) is not None
        start = e
    for name, value in (("length", sum(map(len, words)) / n * 4), ("sentence", math.log(n / max(1, sentences)) * 8)):
        low = math.floor(value)
        for point, share in ((low, low + 1 - value), (low + 1, value - low)):
            weight[xxhash.xxh64_intdigest(f"{name} {point}") >> (64 - bits)] += STYLE_WEIGHT * share
    return list(weight), list(weight.values()), n


def grades(ratings: DataFrame) -> DataFrame:
    """(doc_id, grade, certain): mean of the raters' latest ratings; certain if two or more agree. Null ratings don't count."""
    one = ratings.where(F.col("reading_level").isNotNull() & F.col("doc_id").isNotNull())
    latest = one.groupBy("doc_id", "rater").agg(F.max(F.struct("rated_at", "reading_level")).alias("r"))
    level = F.col("r.reading_level").cast("double")
    return latest.groupBy("doc_id").agg(
        F.avg(level).alias("grade"), ((F.count(F.lit(1)) > 1) & (F.min(level) == F.max(level))).alias("certain")
    )


def reading_levels(docs: DataFrame, ratings: DataFrame, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, difficulty, reading_level) of every document.

    difficulty is continuous on the scale of the ratings (1 to 5), reading_level a
    level; two or more raters who agree decide it. A document without words (null
    or empty text) has the mean difficulty. Without any rating both are null.
    Repeated rows give repeated results.
    """
    import numpy as np

    size, part = 1 << NODE_BITS, 1 << PART_BITS

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places: dict = {}
        for b in batches:
            out = []
            for i, text in zip(b["doc_id"], b["text"], strict=True):
                at, weight, n = nodes_of(text, places) if text else ([], [], 0)
                out.append((i, n, np.array(at, np.uint32).tobytes(), np.array(weight, np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "at", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    graph = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        build, f"doc_id {kind}, n_words int, at binary, weight binary"
    )
    graph = written(graph.join(grades(ratings), "doc_id", "left"), "level-graph")
    context = docs.sparkSession.sparkContext

    def estimates(b: pd.DataFrame, total, mass):
        """Places, weights, documents (as positions), estimates and grades of a batch; graded documents without their own part."""
        at = np.frombuffer(b"".join(b["at"]), np.uint32)
        w = np.frombuffer(b"".join(b["weight"]), np.float32).astype(np.float64)
        doc = np.repeat(np.arange(len(b)), b["at"].str.len().to_numpy() // 4)
        grade = b["grade"].to_numpy(np.float64)
        if total is None:
            return at, w, doc, np.full(len(b), np.nan), grade
        own = np.where(np.isnan(grade), 0.0, 1.0)[doc] * w
        known = mass[at] - own
        ok = known > 1e-6
        value = (total[at] - own * np.nan_to_num(grade)[doc]) / np.where(ok, known, 1)
        num, den = np.bincount(doc, w * ok * value, len(b)), np.bincount(doc, w * ok, len(b))
        return at, w, doc, np.where(den > 0, num / np.where(den > 0, den, 1), np.nan), grade

    def round_sums(model):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, mass = model.value if model is not None else (None, None)
            sums, line = np.zeros((4, size)), np.zeros(5)
            for b in batches:
                at, w, doc, e, grade = estimates(b, total, mass)
                graded, guessed = ~np.isnan(grade), np.isnan(grade) & ~np.isnan(e)
                for k, v in enumerate((graded * np.nan_to_num(grade), graded, guessed * np.nan_to_num(e), guessed)):
                    sums[k] += np.bincount(at, w * v[doc], size)
                x, y = e[graded & ~np.isnan(e)], grade[graded & ~np.isnan(e)]
                line += (len(x), x.sum(), y.sum(), (x * x).sum(), (x * y).sum()) if len(x) else (graded.sum(), 0, np.nansum(grade), 0, 0)
            blocks = sums.reshape(4, -1, part)
            used = [p for p in range(size // part) if blocks[:, p].any()]
            yield pd.DataFrame({"part": used, "sums": [zlib.compress(blocks[:, p].astype(np.float32).tobytes(), 1) for p in used]}).astype({"part": "int32"})
            yield pd.DataFrame({"part": pd.Series([-1], dtype="int32"), "sums": [zlib.compress(line.tobytes(), 1)]})

        def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            kind = np.float64 if key[0] < 0 else np.float32
            total = sum(np.frombuffer(zlib.decompress(s), kind).astype(np.float64) for s in rows["sums"])
            return pd.DataFrame({"part": [key[0]], "sums": [zlib.compress(total.astype(kind).tobytes(), 1)]})

        columns = graph.select("at", "weight", "grade")
        parts = columns.mapInPandas(run, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary")
        sums, line = np.zeros((4, size // part, part)), np.zeros(5)
        for r in parts.toLocalIterator():  # one row for each slice of the fixed table
            if r["part"] < 0:
                line = np.frombuffer(zlib.decompress(r["sums"]), np.float64)
            else:
                sums[:, r["part"]] = np.frombuffer(zlib.decompress(r["sums"]), np.float32).reshape(4, part)
        return sums.reshape(4, size), line

    sums, line = round_sums(None)
    if not line[0]:
        return graph.select("doc_id", "n_words", F.lit(None).cast("double").alias("difficulty"), F.lit(None).cast("int").alias("reading_level"))
    mean = line[2] / line[0]
    total, mass = sums[0], sums[1]
    stretch = (1.0, 0.0)
    for k in range(rounds):
        model = context.broadcast((total, mass))
        if k == rounds - 1:
            break
        sums, line = round_sums(model)
        n, sx, sy, sxx, sxy = line
        slope = (n * sxy - sx * sy) / (n * sxx - sx * sx) if n * sxx - sx * sx > 1e-9 else 1.0
        stretch = (slope, (sy - slope * sx) / n if n else 0.0)
        total = sums[0] + stretch[0] * sums[2] + stretch[1] * sums[3]
        mass = sums[1] + sums[3]

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            *_, e, _ = estimates(b, *model.value)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": b["n_words"], "grade": b["grade"], "certain": b["certain"], "e": e})

    done = written(graph.mapInPandas(finish, f"doc_id {kind}, n_words int, grade double, certain boolean, e double"), "level-estimates")
    cuts, (slope, base) = _cuts(done)
    level = F.lit(1)
    for c in cuts:
        level = level + F.when(F.col("e") > c, 1).otherwise(0)
    plain = F.coalesce(F.col("e") * slope + base, F.lit(float(mean)))
    return done.select(
        "doc_id",
        "n_words",
        F.least(F.lit(5.0), F.greatest(F.lit(1.0), plain)).alias("difficulty"),
        F.when(F.col("certain"), F.col("grade").cast("int"))
        .when(F.col("e").isNull() | F.isnan("e"), F.lit(round(float(mean))))
        .otherwise(level)
        .alias("reading_level"),
    )


def _cuts(done: DataFrame, steps: int = 2000) -> tuple[list[float], tuple[float, float]]:
    """Four cuts with the fewest misplaced graded documents, and the line from estimates to grades, from a histogram of fixed size."""
    import numpy as np

    graded = done.where(F.col("grade").isNotNull() & F.col("e").isNotNull() & ~F.isnan("e"))
    bounds = graded.agg(F.min("e"), F.max("e"), F.regr_slope("grade", "e"), F.regr_intercept("grade", "e")).first()
    if bounds[0] is None:
        return [1.5, 2.5, 3.5, 4.5], (1.0, 0.0)
    low, high = bounds[0], max(bounds[1], bounds[0] + 1e-9)
    cell = F.least(F.lit(steps - 1), F.floor((F.col("e") - low) / (high - low) * steps)).cast("int")
    table = np.zeros((steps, 6))
    for r in graded.groupBy(cell.alias("cell"), F.round("grade").cast("int").alias("g")).count().collect():
        table[r["cell"], min(5, max(1, r["g"]))] = r["count"]
    below = np.vstack([np.zeros(6), table.cumsum(0)])  # graded documents under each edge
    edges = low + (high - low) * np.arange(steps + 1) / steps
    cuts = []
    for c in range(1, 5):
        wrong = below[:, c + 1 :].sum(1) + (below[-1, : c + 1] - below[:, : c + 1]).sum(1)
        best = np.flatnonzero(wrong == wrong.min())
        cuts.append(float(edges[int(np.median(best))]))
    slope = bounds[2] if bounds[2] is not None else 1.0
    return cuts, (slope, bounds[3] if bounds[3] is not None else 0.0)
