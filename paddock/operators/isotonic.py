"""Isotonic regression whose blocks stay distributed.

The fit is the slope of the lower convex hull of the points (rows so far, sum of labels so far) in the order
of the scores. Ties are summed first; the distinct scores are range-partitioned, and each partition
pools adjacent violators in one pass, which leaves the hull of its own points: one row of arrays of at most
about ``rows_per_part`` blocks. What remains are the bridges, the edges of the whole hull that
cross a border between two partitions. All borders are solved together: a bridge is guessed as the line
through a vertex on either side, each partition names its vertex furthest below a parallel of that
line (a binary search, as slopes ascend), the lowest on either side make the next guess,
and a border is settled when no vertex lies below its line. The line falls at the border in every round and there are
finitely many vertices, so this ends; a handful of rounds is usual. Blocks between the bridges are
kept, those under a bridge become one. The driver holds totals, one bridge and the range of kept
blocks per partition, never a list of blocks.

Scoring interpolates linearly between blocks and is constant outside of them. The distinct scores
are dealt to the partitions' ranges, a range with many scores to several groups, and joined back, so a score that
a third of all rows share is looked up once.

Defined results: rows whose score is null or not finite or whose label is null or NaN take no part in the fit; a null or
NaN score is calibrated to null; a fit without rows calibrates everything to null; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators.common import forget, written

ROWS_PER_PART = 200_000
BROADCAST_SCORES = 1_000_000  # distinct scores, 16 bytes each
EPS = 1e-13  # relative: a vertex this little below a line is on it

_HULL = "part int, w array<double>, s array<double>, lo array<double>, hi array<double>"
_KNOTS = "part int, lo array<double>, hi array<double>, value array<double>"


class Hull:
    """Pool-adjacent-violators over ascending scores; blocks as (weight, sum, lowest and highest score)."""

    def __init__(self):
        self.w: list[float] = []
        self.s: list[float] = []
        self.lo: list[float] = []
        self.hi: list[float] = []

    def add(self, w: float, s: float, lo: float, hi: float) -> None:
        ws, ss = self.w, self.s
        while ws and ss[-1] * w >= s * ws[-1]:  # the mean before is not below this one
            w, s, lo = w + ws.pop(), s + ss.pop(), self.lo.pop()
            self.hi.pop()
        ws.append(w)
        ss.append(s)
        self.lo.append(lo)
        self.hi.append(hi)


@dataclass(frozen=True)
class IsotonicFit:
    knots: DataFrame  # one row per partition: its number and the arrays of its blocks, possibly empty
    parts: tuple[int, ...]  # the partitions that have blocks
    starts: tuple[float, ...]  # lowest score and value of the first block of each
    values: tuple[float, ...]

    @property
    def blocks(self) -> DataFrame:
        """(lo, hi, value): the steps, one row each."""
        return self.knots.select(F.explode(F.arrays_zip("lo", "hi", "value")).alias("b")).select("b.*")


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    for k in range(batch.num_rows):
        yield batch.column(0)[k].as_py(), [np.asarray(batch.column(j)[k].values, float) for j in range(1, batch.num_columns)]


def _hulls(points: DataFrame) -> DataFrame:
    out = _arrow(_HULL)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hull = Hull()
        for batch in batches:
            x, w, s = (np.asarray(batch.column(k), float).tolist() for k in range(3))
            for a, b, c in zip(x, w, s, strict=True):
                hull.add(b, c, a, a)
        if hull.w:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"part": part, "w": hull.w, "s": hull.s, "lo": hull.lo, "hi": hull.hi}], schema=out)

    return points.mapInArrow(pool, _HULL)


def _lowest(hulls: DataFrame, base: dict, lines: list[tuple]) -> dict:
    """For each line (border, slope, W, S of a vertex on it) and either side of its border the vertex furthest below
    it, with the lowest score after it in its partition (NaN at the end) and the highest one before it."""
    first = min(base)
    border, slope, w_on, s_on = (np.array(c) for c in zip(*lines, strict=True))
    ddl = "line int, side int, height double, w double, s double, part int, at int, next double, last double"
    out = _arrow(ddl)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            for part, (w, s, lo, hi) in _arrays(batch):
                w0, s0 = base[part]
                cw, cs = w0 + np.cumsum(w), s0 + np.cumsum(s)
                at = np.maximum(np.searchsorted(s / w, slope, "left") - 1, 0)  # the last block of a smaller slope
                height = (cs[at] - s_on) - slope * (cw[at] - w_on)
                origin = slope * w_on - s_on
                for k, (i, h) in enumerate(zip(at.tolist(), height.tolist(), strict=True)):
                    key = k, int(part > border[k])
                    row = (h, cw[i], cs[i], part, i, lo[i + 1] if i + 1 < len(lo) else float("nan"), hi[i])
                    if part == first and origin[k] < h:  # the origin is a vertex, too
                        row = (origin[k], 0.0, 0.0, part, -1, lo[0], float("nan"))
                    if key not in best or row[:2] < best[key][:2]:
                        best[key] = row
        if best:
            rows = [(*key, *row) for key, row in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    # a task sends one row per line and side, whatever the number of its blocks
    found = hulls.mapInArrow(search, ddl).groupBy("line", "side").agg(
        F.min_by(F.struct("height", "w", "s", "part", "at", "next", "last"), F.struct("height", "w")).alias("v"))
    return {(r["line"], r["side"]): r["v"] for r in found.collect()}


def _below(v, slope: float, w_on: float, s_on: float) -> bool:
    return v["height"] < -EPS * (abs(v["s"] - s_on) + abs(slope * (v["w"] - w_on)))


def _bridges(hulls: DataFrame, parts: list[int], base: dict, ends: dict) -> list[tuple]:
    """The edges (left vertex, right vertex) of the whole hull that cross borders, from left to right."""
    after = dict(zip(parts, parts[1:], strict=False))
    guess = {p: (ends[p], ends[after[p]]) for p in after}
    found: dict[int, tuple] = {}
    while guess:
        lines = [(p, (b[1] - a[1]) / (b[0] - a[0]), *a) for p, (a, b) in sorted(guess.items())]
        lowest = _lowest(hulls, base, lines)
        for k, (p, *line) in enumerate(lines):
            left, right = lowest[k, 0], lowest[k, 1]
            if _below(left, *line) or _below(right, *line):
                guess[p] = ((left["w"], left["s"]), (right["w"], right["s"]))
            else:
                found[p] = left, right
                del guess[p]
    edges: list[tuple] = []
    for _, (left, right) in sorted(found.items()):
        if edges and left["w"] < edges[-1][1]["w"]:  # one edge over several borders, or several on one line
            before = edges.pop()
            left = min(before[0], left, key=lambda v: v["w"])
            right = max(before[1], right, key=lambda v: v["w"])
        edges.append((left, right))
    return edges


def fit_isotonic(scored: DataFrame, prob: str, label: str, rows_per_part: int = ROWS_PER_PART) -> IsotonicFit:
    """Isotonic map from scores to outcomes; ties are pooled."""
    x, y = F.col(prob).cast("double"), F.col(label).cast("double")
    rows = scored.select(x.alias("x"), y.alias("y")).where("abs(x) < double('inf') and not isnan(x) and not isnan(y)")
    points = written(rows.groupBy("x").agg(F.count("y").cast("double").alias("w"), F.sum("y").alias("s")).where("w > 0"), "scores")
    n = max(1, -(-points.count() // rows_per_part))
    hulls = written(_hulls(points.repartitionByRange(n, "x").sortWithinPartitions("x").select("x", "w", "s")), "hulls")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    totals = sorted(hulls.select("part", add("w").alias("w"), add("s").alias("s"), F.col("lo")[0].alias("lo")).collect())
    parts, base, ends, cw, cs = [r["part"] for r in totals], {}, {}, 0.0, 0.0
    for r in totals:
        base[r["part"]] = (cw, cs)
        cw, cs = cw + r["w"], cs + r["s"]
        ends[r["part"]] = (cw, cs)
    first = {r["part"]: r["lo"] for r in totals}
    edges = _bridges(hulls, parts, base, ends)

    # a partition keeps its blocks between the bridges at its ends, and gets the bridge that starts in it
    after = dict(zip(parts, parts[1:], strict=False))
    kept: dict[int, list] = {p: [0, None] for p in parts}
    starting: dict[int, tuple] = {}
    for left, right in edges:
        p, q = left["part"], right["part"]
        for between in parts[parts.index(p) + 1:parts.index(q)]:
            kept[between] = [0, 0]
        kept[p][1], kept[q][0] = left["at"] + 1, right["at"] + 1
        lo = first[after[p]] if np.isnan(left["next"]) else left["next"]
        starting[p] = (lo, right["last"], (right["s"] - left["s"]) / (right["w"] - left["w"]))
    out = _arrow(_KNOTS)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, (w, s, lo, hi) in _arrays(batch):
                a, b = kept[part]
                cols = [c[a:b].tolist() for c in (lo, hi, s / w)]
                for c, v in zip(cols, starting.get(part, ()), strict=False):
                    c.append(v)
                yield pa.RecordBatch.from_pylist([dict(zip(out.names, (part, *cols), strict=True))], schema=out)

    knots = written(hulls.mapInArrow(settle, _KNOTS), "knots")
    for table in (points, hulls):
        forget(table)
    return of(knots)


def of(knots: DataFrame) -> IsotonicFit:
    """The fit whose steps are the table ``knots``."""
    heads = sorted(knots.where(F.size("lo") > 0).select(
        "part", F.col("lo")[0].alias("lo"), F.col("value")[0].alias("value")).collect())
    return IsotonicFit(knots, tuple(r["part"] for r in heads), tuple(r["lo"] for r in heads), tuple(r["value"] for r in heads))


def calibrate(fit: IsotonicFit, df: DataFrame, prob: str, out: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``df`` with the calibrated score ``out``, at most 1; a column of that name is replaced."""
    df = df.drop(out) if out in df.columns and out != prob else df
    if not fit.parts:
        return df.withColumn(out, F.lit(None).cast("double"))
    x = F.col(prob).cast("double")
    scores = df.select(x.alias("x")).where("x is not null and not isnan(x)").distinct()
    scores = written(_dealt(scores, fit), "asked")
    asked = {r["part"]: r["n"] for r in scores.groupBy("part").agg(F.count("*").alias("n")).collect()}
    many = {p: -(-n // rows_per_part) for p, n in asked.items()}
    groups = df.sparkSession.createDataFrame([(int(p), g) for p, n in many.items() for g in range(n)], "part int, salt int")
    sizes = df.sparkSession.createDataFrame([(int(p), n) for p, n in many.items()], "part int, n int")
    left = scores.join(F.broadcast(sizes), "part").select("part", F.pmod(F.xxhash64("x"), F.col("n")).cast("int").alias("salt"), "x")
    right = fit.knots.join(F.broadcast(groups), "part")  # a range's blocks go to each of its groups
    # up to the first block of the next partition scores are interpolated
    bound = dict(zip(fit.parts, zip(fit.starts[1:], fit.values[1:], strict=True), strict=False))
    ddl = "x double, y double"
    target = _arrow(ddl)

    def look_up(asked: pa.Table, there: pa.Table) -> pa.Table:
        at = np.asarray(asked.column("x").combine_chunks(), float)
        part = there.column("part")[0].as_py()
        lo, hi, value = (np.asarray(there.column(c)[0].values, float) for c in ("lo", "hi", "value"))
        at_x, at_y = np.stack([lo, hi], 1).ravel(), np.repeat(value, 2)
        if part in bound:
            at_x, at_y = np.append(at_x, bound[part][0]), np.append(at_y, bound[part][1])
        return pa.Table.from_arrays([pa.array(at), pa.array(np.interp(at, at_x, at_y))], schema=target)

    known = left.groupBy("part", "salt").cogroup(right.groupBy("part", "salt")).applyInArrow(look_up, ddl)
    known = known.select(F.col("x").alias("_score"), F.least(F.lit(1.0), F.col("y")).alias("_calibrated"))
    if sum(asked.values()) <= BROADCAST_SCORES:
        known = F.broadcast(known)  # few scores over many rows: dealt by score, most rows would meet in a task
    joined = df.join(known, x == F.col("_score"), "left").drop("_score")
    return joined.drop(out).withColumnRenamed("_calibrated", out)


def _dealt(scores: DataFrame, fit: IsotonicFit) -> DataFrame:
    """(x, part): the partition with the last first block that does not start above the score."""
    starts, parts = np.array(fit.starts), np.array(fit.parts)
    ddl = "x double, part int"
    out = _arrow(ddl)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.maximum(np.searchsorted(starts, np.asarray(batch.column(0), float), "right") - 1, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts[k], pa.int32())], schema=out)

    return scores.mapInArrow(deal, ddl)
