"""Quality classifier: random Fourier features over document statistics, ridge scores from
partition-summed normal equations, isotonic calibration.

1. One pass over the whole texts turns each into ``len(NAMES)`` statistics (character classes,
   word shapes, repetition of words and lines). Mean and spread are taken over all documents.
2. A fixed random cosine map approximates a Gaussian kernel on the standardised statistics. Every
   partition of the labelled rows sums its part of the normal equations, for two folds apart;
   the sums are added up in two levels, so the driver sees a few matrices of fixed size however
   many partitions there are.
3. Each fold is scored by the ridge weights of the other. Those scores, counted on a grid,
   calibrate by isotonic regression; between the centres of its steps the curve is linear.
4. All documents are scored from their statistics by the weights of both folds together.

Defined results: a null text counts as empty and an empty text has statistics of zero; ids with
several labels count as bad if any label says so; without labels every score is 0.5, with labels
of one class that class; statistics that are equal in all documents are left out by a spread of
one; repeated rows are scored each for itself; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm.common import byte_values, cut, per_batch, schema, table

NAMES = ("bytes", "lower", "upper", "digits", "spaces", "lines", "commas_stops", "marks", "symbols", "pipes", "beyond_ascii",
         "words", "word_bytes", "spread_of_word_bytes", "long_words", "different_words", "most_common_word", "capital_words",
         "words_ending_in_symbols", "repeated_lines", "line_bytes", "entropy")
WAVES, RIDGE, GRID = 256, 1e-3, 1000

_CLASS = np.full(256, 7)  # symbols
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".,;:", b"!?", b"", b"|", range(128, 256))):
    _CLASS[np.array(list(_bytes), int)] = _k


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one text, in the order of NAMES."""
    if not text:
        return [0.0] * len(NAMES)
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = np.bincount(_CLASS, counts, 10) / n
    words = text.split()
    total = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    capital = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    ends = sum(c for w, c in seen.items() if w[-1] < 128 and _CLASS[w[-1]] in (6, 7, 8))
    lines = [x for x in text.split(b"\n") if x]
    p = counts[counts > 0] / n
    return [math.log1p(n), *share[:4], math.log1p(share[4] * 1000), *share[5:],
            math.log1p(len(words)), float(sizes.mean()), float(sizes.std()), float((sizes > 15).mean()), len(seen) / total,
            max(seen.values(), default=0) / total, capital / total, ends / total,
            1 - len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))), float(-(p * np.log(p)).sum())]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every document."""
    def make():
        return lambda b: [b.column(0), pa.array([statistics(t) for t in byte_values(b.column(1))], pa.list_(pa.float64()))]

    return per_batch(docs.select(id_col, text_col), make, schema(docs, id_col, "x array<double>"))


class Waves:
    """Standardises statistics and maps them to cosines; the first column is constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.omega = rng.normal(0, 1 / math.sqrt(len(mean)), (len(mean), WAVES))
        self.phase = rng.uniform(0, 2 * math.pi, WAVES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.omega + self.phase
        return np.concatenate([np.ones((len(x), 1)), math.sqrt(2 / WAVES) * np.cos(z)], axis=1)


def _sum_equations(rows: DataFrame, waves: Waves, ways: int = 8) -> dict[int, np.ndarray]:
    """Per fold the sum of [z, y]' [z, y] over rows (x, y, fold)."""
    def partial(batches):
        sums = {}
        for b in batches:
            x = np.array(b.column("x").to_pylist()).reshape(b.num_rows, -1)
            both = np.concatenate([waves(x), np.asarray(b.column("y"))[:, None]], axis=1)
            for fold in (0, 1):
                mine = both[np.asarray(b.column("fold")) == fold]
                sums[fold] = sums.get(fold, 0) + mine.T @ mine
        yield from _rows(sums)

    def add(batches):
        sums = {}
        for b in batches:
            for fold, packed in zip(b.column("fold").to_pylist(), b.column("packed").to_pylist(), strict=True):
                sums[fold] = sums.get(fold, 0) + np.frombuffer(packed).reshape(WAVES + 2, WAVES + 2)
        yield from _rows(sums)

    def _rows(sums):
        if sums:
            yield pa.RecordBatch.from_pydict({"fold": pa.array(list(sums), pa.int32()), "packed": [s.tobytes() for s in sums.values()]})

    parts = rows.mapInArrow(partial, "fold int, packed binary").repartition(ways).mapInArrow(add, "fold int, packed binary")
    out = {0: np.zeros((WAVES + 2, WAVES + 2)), 1: np.zeros((WAVES + 2, WAVES + 2))}
    for r in parts.collect():  # at most 2 * ways matrices
        out[r["fold"]] += np.frombuffer(r["packed"]).reshape(WAVES + 2, WAVES + 2)
    return out


def _ridge(sums: np.ndarray) -> np.ndarray:
    left, right = sums[:-1, :-1], sums[:-1, -1]
    penalty = np.full(len(left), RIDGE * max(1.0, left[0, 0]) + 0.1)
    penalty[0] = 1e-9
    return np.linalg.solve(left + np.diag(penalty), right)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by x: centres and values of the steps."""
    steps: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        steps.append([a, b, w])
        while len(steps) > 1 and steps[-2][1] >= steps[-1][1]:
            a2, b2, w2 = steps.pop()
            a1, b1, w1 = steps.pop()
            w = w1 + w2
            steps.append([(a1 * w1 + a2 * w2) / w, (b1 * w1 + b2 * w2) / w, w])
    return np.array([s[0] for s in steps]), np.array([s[1] for s in steps])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", usable: Column | None = None) -> DataFrame:
    """One row per document: the id and ``score``, the calibrated probability of label 1."""
    spark = docs.sparkSession
    facts = cut(document_statistics(docs, id_col, text_col), "statistics")
    d = len(NAMES)
    row = facts.agg(*[F.avg(F.col("x")[k]) for k in range(d)], *[F.stddev_pop(F.col("x")[k]) for k in range(d)]).first()
    mean = np.array([v or 0.0 for v in row[:d]])
    spread = np.array([v if v and v > 1e-9 else 1.0 for v in row[d:]])
    waves = Waves(mean, spread)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(id_col).agg(F.min(label_col).cast("double").alias("y"))
    fold = F.pmod(F.xxhash64(F.concat(F.lit("fold"), F.col(id_col).cast("string"))), F.lit(2)).cast("int").alias("fold")
    rows = cut(facts.join(known, id_col).select("x", "y", fold), "labelled")
    sums = _sum_equations(rows, waves)
    total = sums[0] + sums[1]
    n, good = total[0, 0], total[0, -1]
    curve: tuple[np.ndarray, np.ndarray]
    if n == 0:
        weights, curve = np.zeros(WAVES + 1), (np.array([0.0]), np.array([0.5]))
    elif good in (0, n):
        weights, curve = np.zeros(WAVES + 1), (np.array([0.0]), np.array([good / n]))
    else:
        weights = _ridge(total)
        other = {k: _ridge(sums[1 - k] if sums[1 - k][0, 0] else total) for k in (0, 1)}

        def check(batches):
            for b in batches:
                z, folds = waves(np.array(b.column("x").to_pylist()).reshape(b.num_rows, -1)), np.asarray(b.column("fold"))
                s = np.where(folds == 0, z @ other[0], z @ other[1])
                yield pa.RecordBatch.from_pydict({"s": pa.array(np.clip(np.round(s * GRID), -GRID, 2 * GRID).astype(np.int32)),
                                                  "y": b.column("y")})

        grid = (rows.mapInArrow(check, "s int, y double").groupBy("s").agg(F.avg("y").alias("y"), F.count("*").alias("n"))
                .orderBy("s").collect())  # at most 3 * GRID + 1 rows
        curve = isotonic(*[np.array([r[k] for r in grid], float) for k in ("s", "y", "n")])
        curve = (curve[0] / GRID, curve[1])

    def make():
        def fn(batch):
            z = waves(np.array(batch.column(1).to_pylist()).reshape(batch.num_rows, -1))
            return [batch.column(0), np.clip(np.interp(z @ weights, *curve), 0, 1)]
        return fn

    return per_batch(facts, make, schema(docs, id_col, "score double"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    found = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
