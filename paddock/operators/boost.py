"""Gradient-boosted trees from mergeable histograms, several models grown in lockstep.

Rows with equal binned features behave alike in every tree, so training starts with one
aggregation to (bins, n, sum y); what follows reads that table only. A pass sums, per task, the
gradient and the Hessian of the logistic loss per (model, open node, feature, bin) in numpy; the sums of all
tasks are added in two levels, and the driver, which gets arrays whose size depends on models, nodes,
features and bins but not on rows, splits every open node of every model. With few features, sums per
pair of (feature, bin) give the sums of both children of whatever split is chosen. So a pass moves each
model one or two levels down, whatever its depth and rate, and a model of n trees contains those of
fewer: a grid over depth, rate and number of trees costs as many passes as its largest model.

Splits maximise the regularised second-order gain GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l); leaves are
-G/(H+l). Gains that agree to 1e-9 count as ties, which go to the first feature and cut, so the order in
which tasks are added does not decide a split.

Scores of finished trees are carried as a column, rewritten every ``KEEP`` trees to the checkpoint folder.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.operators.common import written

LAMBDA, MIN_CHILD, MIN_GAIN = 1.0, 1.0, 1e-6  # fixed values: the usual defaults of this loss
MAX_BINS = 32
KEEP = 5
PAIR_CELLS = 200_000  # sums of a model in a pass that looks two levels ahead
_FLAT = 16  # tasks whose sums the driver adds itself


@dataclass
class Tree:
    """Nodes in heap order: the feature and the last bin that goes left (-1: a leaf), and the leaf's value."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def stump(cls, depth: int, value: float) -> "Tree":
        size = 2 ** (depth + 1) - 1
        tree = cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size))
        tree.value[0] = value
        return tree

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            f = self.feature[node]
            on = f >= 0
            if not on.any():
                return node
            node[on] = 2 * node[on] + 1 + (bins[rows[on], f[on]] > self.cut[node[on]])

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.walk(bins)]


@dataclass
class BoostedTrees:
    """An additive model on the log-odds scale."""
    cuts: list[list[float]]  # per feature; a value's bin is the number of cuts below it
    base: float
    rate: float
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def first(self, n: int) -> "BoostedTrees":
        return BoostedTrees(self.cuts, self.base, self.rate, self.depth, self.trees[:n])

    def state(self) -> dict:
        return {**self.__dict__, "trees": [[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in self.trees]}

    @classmethod
    def of(cls, state: dict) -> "BoostedTrees":
        trees = [Tree(np.array(f, np.int32), np.array(c, np.int32), np.array(v, float)) for f, c, v in state["trees"]]
        return cls(**{**state, "trees": trees})

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for tree in self.trees:
            out += self.rate * tree.scores(bins)
        return out

    def predict_proba(self, df: DataFrame, features: str, out: str) -> DataFrame:
        """``df`` with P(class 1); Arrow batches are scored in numpy."""
        model, k, to = self, len(self.cuts), T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
        binned = df.withColumn("_bins", bin_features(features, self.cuts))

        def run(batches):
            for b in batches:
                p = _sigmoid(model.margins(_matrix(b.column("_bins"), k)))
                rest = b.drop_columns(["_bins"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(p)], names=[*rest.schema.names, out])

        return binned.mapInArrow(run, to)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


def _matrix(column, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k) if k else np.zeros((len(column), 0), np.int32)


def feature_cuts(df: DataFrame, features: str, max_bins: int = MAX_BINS) -> list[list[float]]:
    """At most ``max_bins`` - 1 cuts per feature of an array column: its quantiles, but the largest value."""
    probs = [(k + 1) / max_bins for k in range(max_bins - 1)]
    x = df.select(F.posexplode(features).alias("j", "x")).select("j", F.col("x").cast("double").alias("x")).where("x is not null")
    rows = x.groupBy("j").agg(F.percentile_approx("x", probs, 10_000).alias("q"), F.max("x").alias("top")).collect()
    width = df.agg(F.max(F.size(features)).alias("k")).first()["k"] or 0
    found = {r["j"]: sorted(set(q for q in r["q"] if q < r["top"])) for r in rows}
    return [found.get(j, []) for j in range(max(width, 0))]


def bin_features(features: str, cuts: list[list[float]]) -> Column:
    """The bins of an array column as array<int>; a missing value is in the first bin."""
    if not cuts:
        return F.array().cast("array<int>")
    edges = F.array(*[F.array(*[F.lit(float(c)) for c in own]).cast("array<double>") for own in cuts])
    return F.zip_with(features, edges, lambda x, own: F.coalesce(
        F.aggregate(own, F.lit(0), lambda n, c: n + F.when(x > c, 1).otherwise(0)), F.lit(0)))


def patterns(df: DataFrame, features: str, label: str, cuts: list[list[float]]) -> DataFrame:
    """(bins, n, sy): equal rows summed. Rows without a label are left out."""
    return (df.where(F.col(label).isNotNull()).select(bin_features(features, cuts).alias("bins"), F.col(label).cast("double").alias("y"))
            .groupBy("bins").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("sy")))


@dataclass
class _Growing:
    model: BoostedTrees
    wanted: int
    tree: Tree | None = None
    open: list[int] = field(default_factory=list)
    saved: int = 0  # trees whose scores are in the column

    @property
    def done(self) -> bool:
        return self.tree is None and len(self.model.trees) >= self.wanted

    def pairs(self, width: int) -> bool:
        """Whether the next pass counts pairs of (feature, bin), of ``width`` each, and so splits two levels."""
        return bool(self.open) and 4 * max(self.open) + 6 < len(self.tree.feature) and len(self.open) * width ** 2 <= PAIR_CELLS


def _recent(growing: list[_Growing]) -> list[tuple[float, list[Tree]]]:
    """Per model its rate and the trees that the column lacks: all that a task needs of finished trees."""
    return [(g.model.rate, g.model.trees[g.saved:]) for g in growing]


def _add(scores: np.ndarray, recent: tuple[float, list[Tree]], bins: np.ndarray) -> np.ndarray:
    rate, trees = recent
    return sum((rate * tree.scores(bins) for tree in trees), scores)


def _histograms(rows: DataFrame, growing: list[_Growing], k: int, bins: int, tasks: int) -> list[np.ndarray]:
    """Per model the gradient and Hessian sums of its open nodes, per feature and bin, or per pair of them."""
    width = max(k, 1) * bins
    pairs = [g.pairs(width) for g in growing]
    shapes = [(len(g.open), width, width, 2) if two else (len(g.open), width, 2) for g, two in zip(growing, pairs)]
    edges = np.cumsum([0, *[math.prod(s) for s in shapes]])
    recent, current = _recent(growing), [(g.tree, g.open) for g in growing]

    def run(batches):
        out = np.zeros(edges[-1])
        for b in batches:
            x = _matrix(b.column("bins"), k)
            n, sy = (b.column(c).to_numpy() for c in ("n", "sy"))
            scores = b.column("scores").flatten().to_numpy().reshape(len(n), -1)
            at = (np.arange(max(k, 1)) * bins + x) if k else np.zeros((len(n), 1), np.int64)
            one = np.zeros((len(n), width)) if any(pairs) else None
            if one is not None:
                np.put_along_axis(one, at, 1.0, axis=1)
            for m, (tree, nodes) in enumerate(current):
                if not nodes:
                    continue
                p = _sigmoid(_add(scores[:, m], recent[m], x))
                slot = np.full(len(tree.feature), -1)
                slot[nodes] = np.arange(len(nodes))
                node = slot[tree.walk(x)]
                part = out[edges[m]:edges[m + 1]].reshape(shapes[m])
                for c, v in enumerate((n * p - sy, n * p * (1 - p))):
                    if pairs[m]:
                        for k_ in range(len(nodes)):
                            mine = one[node == k_]
                            part[k_, :, :, c] += mine.T @ (mine * v[node == k_, None])
                    else:
                        on = node >= 0
                        flat = (node[on, None] * width + at[on]).ravel()
                        part[..., c] += np.bincount(flat, np.repeat(v[on], at.shape[1]), len(nodes) * width).reshape(len(nodes), width)
        yield pa.RecordBatch.from_pydict({"sums": [out.tobytes()]})

    def add(batches):
        out = np.zeros(edges[-1])
        for b in batches:
            for s in b.column(0).to_pylist():
                out += np.frombuffer(s)
        yield pa.RecordBatch.from_pydict({"sums": [out.tobytes()]})

    sums = rows.mapInArrow(run, "sums binary")
    if tasks > _FLAT:
        sums = sums.repartition(math.isqrt(tasks)).mapInArrow(add, "sums binary")
    total = np.zeros(edges[-1])
    for r in sums.collect():
        total += np.frombuffer(r["sums"])
    return [total[a:b].reshape(s) for a, b, s in zip(edges, edges[1:], shapes)]


@dataclass(frozen=True)
class _Rule:
    lam: float
    min_child: float
    min_gain: float

    def leaf(self, s: np.ndarray) -> float:
        return float(-s[0] / (s[1] + self.lam)) if s[1] + self.lam > 0 else 0.0

    def split(self, tree: Tree, node: int, h: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Split a node by its sums (features, bins, 2) if that gains enough: the children that may be
        split in turn, each with the (feature, bins) flags of the rows that went there."""
        total = h[0].sum(axis=0)
        if node == 0:
            tree.value[0] = self.leaf(total)
        left = h.cumsum(axis=1)[:, :-1]
        right = total - left
        score = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + self.lam, 1e-300)
        enough = (left[..., 1] >= self.min_child) & (right[..., 1] >= self.min_child)
        gain = np.where(enough, score(left) + score(right) - score(total), -np.inf)
        if not gain.size or gain.max() <= self.min_gain:
            return []
        top = gain.max()
        f, cut = np.unravel_index(int(np.flatnonzero(gain.ravel() >= top - 1e-9 * abs(top))[0]), gain.shape)
        tree.feature[node], tree.cut[node] = f, cut
        out = []
        for child, s, side in ((2 * node + 1, left[f, cut], slice(0, cut + 1)), (2 * node + 2, right[f, cut], slice(cut + 1, None))):
            tree.value[child] = self.leaf(s)
            if 2 * child + 2 < len(tree.feature) and s[1] >= 2 * self.min_child:
                flags = np.zeros(h.shape[:2], bool)
                flags[f, side] = True
                out.append((child, flags))
        return out


def _split(g: _Growing, hist: np.ndarray, k: int, bins: int, rule: _Rule) -> None:
    """Split the open nodes of a tree, and, where pairs were counted, the nodes below them."""
    shape = (max(k, 1), bins, 2)
    opened = []
    for node, h in zip(g.open, hist):
        if h.ndim == 2:
            opened += [child for child, _ in rule.split(g.tree, node, h.reshape(shape))]
            continue
        own = h[np.arange(len(h)), np.arange(len(h))].reshape(shape)
        for child, flags in rule.split(g.tree, node, own):
            opened += [c for c, _ in rule.split(g.tree, child, h[flags.ravel()].sum(axis=0).reshape(shape))]
    g.open = opened


def fit_boosted(df: DataFrame, features: str, label: str, models: Sequence[tuple[int, int, float]], lam: float = LAMBDA,
                min_child: float = MIN_CHILD, min_gain: float = MIN_GAIN, max_bins: int = MAX_BINS) -> list[BoostedTrees]:
    """One model per (trees, depth, rate), all grown in the same passes."""
    cuts = feature_cuts(df, features, max_bins)
    k, bins = len(cuts), max([len(c) + 1 for c in cuts], default=1)
    table = patterns(df, features, label, cuts)
    table = written(table.withColumn("scores", F.array(*[F.lit(0.0)] * len(models))), "patterns")
    sums = table.agg(F.sum("n").alias("n"), F.sum("sy").alias("sy")).first()
    n, sy = sums["n"] or 0.0, sums["sy"] or 0.0
    if not 0 < sy < n:
        raise ValueError("both classes must be present")
    base, rule = math.log(sy / (n - sy)), _Rule(lam, min_child, min_gain)
    table = table.withColumn("scores", F.array(*[F.lit(base)] * len(models)))
    tasks = table.rdd.getNumPartitions()
    growing = [_Growing(BoostedTrees(cuts, base, rate, depth), trees) for trees, depth, rate in models]
    while not all(g.done for g in growing):
        for g in growing:
            if g.tree is None and not g.done:
                g.tree, g.open = Tree.stump(g.model.depth, 0.0), [0]
        for g, hist in zip(growing, _histograms(table, growing, k, bins, tasks)):
            if g.tree is None:
                continue
            _split(g, hist, k, bins, rule)
            if not g.open:
                g.model.trees.append(g.tree)
                g.tree = None
        if any(len(g.model.trees) - g.saved >= KEEP for g in growing):
            table = _saved(table, growing, k)
            for g in growing:
                g.saved = len(g.model.trees)
    return [g.model for g in growing]


def _saved(table: DataFrame, growing: list[_Growing], k: int) -> DataFrame:
    """The table with the scores of all finished trees, cut."""
    recent = _recent(growing)

    def run(batches):
        for b in batches:
            x, scores = _matrix(b.column("bins"), k), b.column("scores").flatten().to_numpy().reshape(b.num_rows, -1)
            new = np.stack([_add(scores[:, m], r, x) for m, r in enumerate(recent)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, new.size + 1, new.shape[1]), pa.int32()), pa.array(new.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("bins"), b.column("n"), b.column("sy"), lists], names=["bins", "n", "sy", "scores"])

    return written(table.mapInArrow(run, table.schema), "scores")


def prefix_losses(df: DataFrame, features: str, label: str, models: Sequence[BoostedTrees], prefixes: Sequence[int],
                  eps: float = 1e-15) -> dict[tuple[int, int], float]:
    """Mean log-loss per (model, number of trees), all in one pass over different rows."""
    cuts = models[0].cuts
    k, last = len(cuts), max(prefixes)
    cells = [(m, n) for m in range(len(models)) for n in sorted(set(prefixes))]

    def run(batches):
        sums, rows = np.zeros(len(cells)), 0.0
        for b in batches:
            x = _matrix(b.column("bins"), k)
            n, sy = (b.column(c).to_numpy() for c in ("n", "sy"))
            rows += n.sum()
            for m, model in enumerate(models):
                score = np.full(len(n), model.base)
                for t, tree in enumerate(model.trees[:last], 1):
                    score += model.rate * tree.scores(x)
                    if (m, t) in at:
                        p = np.clip(_sigmoid(score), eps, 1 - eps)
                        sums[at[m, t]] -= (sy * np.log(p) + (n - sy) * np.log(1 - p)).sum()
        yield pa.RecordBatch.from_pydict({"i": pa.array([*range(len(cells)), len(cells)], pa.int32()), "v": [*sums.tolist(), float(rows)]})

    at = {c: i for i, c in enumerate(cells)}
    got = patterns(df, features, label, cuts).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = {r["i"]: r["v"] for r in got}
    return {c: total[i] / total[len(cells)] for c, i in at.items()}


def grid_search(train: DataFrame, val: DataFrame, features: str, label: str, grid: dict[str, list], refit_on_union: bool = False
                ) -> tuple[BoostedTrees, dict, list[tuple[dict, float]]]:
    """(best model, its parameters, validation log-loss per point) of a grid over maxIter, maxDepth and stepSize.

    The best model is the fitted one, so validation rows stay unseen; ``refit_on_union`` fits it again on both."""
    shapes = [(d, r) for d in grid["maxDepth"] for r in grid["stepSize"]]
    models = fit_boosted(train, features, label, [(max(grid["maxIter"]), d, r) for d, r in shapes])
    losses = prefix_losses(val, features, label, models, grid["maxIter"])
    results = [({"maxDepth": d, "maxIter": n, "stepSize": r}, losses[m, n]) for n in grid["maxIter"] for m, (d, r) in enumerate(shapes)]
    best = min(results, key=lambda x: (round(x[1], 12), x[0]["maxIter"], x[0]["maxDepth"], x[0]["stepSize"]))[0]
    if refit_on_union:
        fitted = fit_boosted(train.unionByName(val), features, label, [(best["maxIter"], best["maxDepth"], best["stepSize"])])[0]
    else:
        fitted = models[shapes.index((best["maxDepth"], best["stepSize"]))].first(best["maxIter"])
    return fitted, best, results
