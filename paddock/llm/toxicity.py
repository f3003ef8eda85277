"""Toxicity: a convolutional text classifier with hashed word embeddings.

A word is the sum of three hashed embeddings (itself, its first four and its first five
characters), so that inflected words share weight. Filters of width 1, 2 and 3 run over the
words of the whole text, max pooling keeps the best position of each, and a logistic layer
turns the maxima into a score. The network is trained on every labelled row: the rows are dealt by a
hash of their ids into parts of about ``PART_DOCS`` documents, in each epoch every part descends from
the same network, and the mean of their moves gives the next one (of an embedding, over the parts that
moved it). Moves are added up as integers, so their order does not count. A fifth of the ids is held
back to place the score's 0.5 and to calibrate one threshold per language, from counts of
all their scores to 1 / ``GRID`` of a logit.

Only texts that may have a label move, and each of them once, straight to its part: a Bloom filter of the labelled
ids, of bounded size, leaves out the others where they are read. What decides on the parts (id, label,
number of words, mark of the words) is joined and written without the texts.

A caller may bound the rows by ``max_docs`` documents and ``max_words`` words, half of either for each class, both
taken in the order of a hash of the id; a document of more than ``max_words / LONGEST`` words is then not learnt from
(but scored whole like any other), so that none takes the place of many; a class all of whose documents are that long
is an error, not an empty sample. The registered queries set no such bound.

Scoring is one map over the texts: per vocabulary word the products of its embedding with all
filters are added up once, so a convolution is a gather and a sum. The model is broadcast; its
size is bounded by the number of buckets.

Defined results: a null text counts as empty; an empty text scores what the bias gives; ids with
several labels count as toxic if any label says so; without labels of both classes every score
is 0; repeated rows are scored each for itself; a null or unknown language has the threshold
0.5; other columns are ignored.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm.common import bounded_batches, cut, per_batch, schema, slices, table
from paddock.operators.text import FILTER_HASHES, phrase_filter

DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
BLOCKS = sum(WIDTHS)  # one block of filter weights per word of each width
WORD_BITS, FOUR_BITS, FIVE_BITS = 19, 17, 18
EPOCHS = 4
PART_DOCS, PART_WORDS = 4000, 3_000_000  # of a part that descends by itself
GRID, STEPS = 4096, float(1 << 32)  # parts of a logit that are told apart; parts of a unit in the sums of moves
LONGEST = 8  # with a bound on words, a document that is learnt from has at most this part of them
_MEMO = 60_000

#: Turns every ASCII byte that is no letter into a space.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def tokens(text: str | None) -> list[str]:
    return text.lower().encode("utf-8", "replace").translate(_LETTERS).decode().split() if text else []


def buckets(word: str) -> tuple[int, int, int]:
    """The hash buckets of a word, its first four and its first five characters, in one range."""
    return tuple(all_buckets([word])[0].tolist())


def all_buckets(words: list[str]) -> np.ndarray:
    """(words, 3): the ``buckets`` of many words."""
    out, start = np.empty((len(words), 3), np.int64), 0
    for k, (part, bits) in enumerate(((words, WORD_BITS), ([w[:4] for w in words], FOUR_BITS), ([w[:5] for w in words], FIVE_BITS))):
        out[:, k] = np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(words)) >> np.uint64(64 - bits)
        out[:, k] += start
        start += 1 << bits
    return out


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Embeddings for the buckets of the sample (all others are zero), filters and output layer."""

    def __init__(self, rows: np.ndarray, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.rows = rows  # sorted buckets
        self.embed = rng.normal(0, 0.05, (len(rows) + 1, DIM)).astype(np.float32)
        self.embed[-1] = 0
        # filters: (word of the window, over all widths; dimension; filter)
        self.filters = rng.normal(0, 0.1, (BLOCKS, DIM, FILTERS)).astype(np.float32)
        self.bias = np.full(len(WIDTHS) * FILTERS, -0.5, np.float32)
        self.out = rng.normal(0.2, 0.05, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base, self.shift = -1.0, 0.0

    def place(self, ids: np.ndarray) -> np.ndarray:
        """Rows of the embedding table for buckets; the last row stands for all unknown ones."""
        k = np.searchsorted(self.rows, ids)
        k[k == len(self.rows)] = 0
        return np.where(self.rows[k] == ids, k, len(self.rows)) if len(self.rows) else np.zeros_like(k)

    def products(self) -> np.ndarray:
        """Every embedding times every block of filter weights."""
        return np.concatenate([self.embed @ f for f in self.filters], axis=1)

    def pooled(self, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of the responses of one text and where they lie; two empty words follow the text."""
        best, at, block = [], [], 0
        n = len(product) - 2
        for width in WIDTHS:
            total = product[:n, block * FILTERS:(block + 1) * FILTERS]
            for k in range(1, width):
                total = total + product[k:n + k, (block + k) * FILTERS:(block + k + 1) * FILTERS]
            where = total.argmax(axis=0)
            best.append(total[where, np.arange(FILTERS)])
            at.append(where)
            block += width
        return np.concatenate(best), np.concatenate(at)

    def best(self, product: np.ndarray) -> np.ndarray:
        """The maxima of ``pooled`` alone."""
        best, block, n = [], 0, len(product) - 2
        for width in WIDTHS:
            total = product[:n, block * FILTERS:(block + 1) * FILTERS]
            for k in range(1, width):
                total = total + product[k:n + k, (block + k) * FILTERS:(block + k + 1) * FILTERS]
            best.append(total.max(axis=0))
            block += width
        return np.concatenate(best)

    def logit(self, best: np.ndarray) -> float:
        return float(self.base + np.maximum(best + self.bias, 0) @ self.out)

    def score(self, logit: float) -> float:
        return float(_logistic(logit - self.shift))


def _start(rows: np.ndarray, count: np.ndarray, n: np.ndarray) -> Network:
    """The network before training. First dimension of an embedding: log-odds of its bucket, from the documents of either
    class that hold it, smoothed and shrunk where few do."""
    net = Network(rows)
    odds = np.log((count[1] + 0.5) / (n[1] + 1)) - np.log((count[0] + 0.5) / (n[0] + 1))
    held = count.sum(axis=0)
    net.embed[:-1, 0] = np.where(held > 1, odds / 4 * held / (held + 4), 0)
    net.filters[:, 0, :] += 0.5
    return net


def _descend(net: Network, moved: np.ndarray, placed: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray,
             rate: float, order: np.ndarray) -> None:
    """One epoch of stochastic gradient descent over some texts (places in ``placed``), in place; only the words that won a maximum receive a
    gradient. ``moved``: sums of squares per row, for the step size."""
    for k in order:
        ids = placed[np.concatenate([texts[k], np.full(3 - min(len(texts[k]), 1), len(placed) - 1)])]  # empty words follow it
        y = labels[k]
        x = net.embed[ids[:, 0]] + net.embed[ids[:, 1]] + net.embed[ids[:, 2]]
        best, at = net.pooled(x @ net.filters.transpose(1, 0, 2).reshape(DIM, -1))
        active = best + net.bias > 0
        wrong = (_logistic(net.logit(best)) - y) * weight[y]
        back = (wrong * net.out * active).astype(np.float32)
        net.out -= rate * wrong * np.maximum(best + net.bias, 0)
        net.base -= rate * wrong
        net.bias -= rate * back
        block = 0
        for w, width in enumerate(WIDTHS):
            g, where = back[w * FILTERS:(w + 1) * FILTERS], at[w * FILTERS:(w + 1) * FILTERS]
            some = np.flatnonzero(g)  # the others move nothing
            for step in range(width if len(some) else 0):
                old = net.filters[block + step]
                rows = ids[where[some] + step].ravel()  # (filters, 3)
                grad = old.T * g[:, None]  # (filters, dim)
                net.filters[block + step] = old - rate * (x[where + step] * g[:, None]).T
                np.add.at(moved, rows, np.repeat((grad**2).sum(axis=1)[some], 3))
                np.add.at(net.embed, rows, -rate * np.repeat(grad[some], 3, axis=0) / np.sqrt(1 + moved[rows])[:, None])
            block += width
        net.embed[-1] = 0


def _dense(net: Network) -> np.ndarray:
    return np.concatenate([net.filters.ravel(), net.bias, net.out, [net.base]]).astype(float)


def _next(net: Network, moved: np.ndarray, moves: pa.Table, parts: int) -> tuple[Network, np.ndarray]:
    """The network after the mean of the parts' moves, given as (row, v0 ..., n): whole numbers summed over n parts."""
    row, n = moves.column("row").to_numpy(), moves.column("n").to_numpy()
    values = np.stack([np.asarray(moves.column(f"v{k}").fill_null(0)) for k in range(DIM + 1)], axis=1) / STEPS
    few = row < 0
    dense = values[few, 0][::-1] / parts  # rows -1, -2, ... are the dense parameters
    size = net.filters.size
    net.filters = (net.filters + dense[:size].reshape(net.filters.shape)).astype(np.float32)
    net.bias = (net.bias + dense[size:size + net.bias.size]).astype(np.float32)
    net.out = (net.out + dense[size + net.bias.size:-1]).astype(np.float32)
    net.base += float(dense[-1])
    mean = values[~few] / n[~few][:, None]
    net.embed[row[~few]] += mean[:, :DIM].astype(np.float32)
    moved[row[~few]] += mean[:, DIM].astype(np.float32)
    return net, moved


def _summed(moves: DataFrame) -> pa.Table:
    """(row, v0 ..., n): the sums of the parts' moves per row; the dense parameters are rows -1, -2, ... with a value each."""
    cells = F.when(F.col("row") < 0, F.transform("values", lambda v, k: F.struct((-1 - k).cast("bigint").alias("row"), F.array(v).alias("values")))).otherwise(
        F.array(F.struct("row", "values")))
    one = moves.select(F.explode(cells).alias("c")).select("c.row", "c.values")
    sums = one.groupBy("row").agg(*[F.sum(F.get("values", F.lit(k))).alias(f"v{k}") for k in range(DIM + 1)], F.count("*").alias("n"))
    return sums.toArrow().sort_by("row")


def _parts(batch: pa.RecordBatch):
    """(buckets of its words, texts as places there, labels, number, held back) of the parts of a batch."""
    for k in range(batch.num_rows):
        row = {c: batch.column(c)[k].as_py() for c in ("part", "words", "texts", "labels", "back")}
        yield (np.frombuffer(row["words"], np.int32).reshape(-1, 3), [np.frombuffer(t, np.int32) for t in row["texts"]],
               np.array(row["labels"], int), row["part"], np.array(row["back"], bool))


def _fit(packed: DataFrame, parts: int, epochs: int) -> Network:
    """The network after ``epochs`` over all texts that are not held back, from a row per part."""
    spark = packed.sparkSession

    def count(batches):
        for batch in batches:
            for words, texts, labels, _, back in _parts(batch):
                seen = {0: [], 1: []}
                for t, y, b in zip(texts, labels, back, strict=True):
                    if not b:
                        seen[y].append(np.unique(words[np.unique(t)]))
                for y, found in seen.items():
                    rows, n = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(rows, -1)), pa.array(np.full(len(rows) + 1, y), pa.int32()),
                                                      pa.array(np.append(n, len(found)))], names=["row", "label", "n"])

    # a row per bucket at most, and -1 for the documents
    got = packed.mapInArrow(count, "row bigint, label int, n bigint").groupBy("row").agg(
        *[F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)]).orderBy("row").toArrow()
    held = np.array([got.column("n0").to_numpy(), got.column("n1").to_numpy()])
    n, net = held[:, 0], _start(got.column("row").to_numpy()[1:], held[:, 1:], held[:, 0])
    weight = np.array([0.5 / max(1, n[0]), 0.5 / max(1, n[1])]) * n.sum()
    moved = np.zeros(len(net.embed), np.float32)
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast((net, moved))

        def descend(batches, epoch=epoch, shared=shared):
            start, squares = shared.value
            for batch in batches:
                for words, texts, labels, part, back in _parts(batch):
                    mine, own, learnt = copy.deepcopy(start), squares.copy(), np.flatnonzero(~back)
                    placed = np.concatenate([mine.place(words.ravel()).reshape(-1, 3), np.full((1, 3), len(mine.rows))])
                    _descend(mine, own, placed, [texts[k] for k in learnt], labels[learnt], weight, 0.05 / (1 + epoch), np.random.default_rng((80, epoch, part)).permutation(len(learnt)))
                    rows = np.flatnonzero((own != squares) | (mine.embed != start.embed).any(axis=1))
                    moves = np.concatenate([mine.embed[rows].astype(float) - start.embed[rows], (own[rows].astype(float) - squares[rows])[:, None]], axis=1)
                    moves, dense = (np.rint(m * STEPS).astype(np.int64) for m in (moves, _dense(mine) - _dense(start)))
                    for a in range(0, len(rows), 50_000):
                        some = moves[a:a + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array(rows[a:a + 50_000]), pa.ListArray.from_arrays(
                            pa.array(np.arange(0, some.size + 1, DIM + 1), pa.int32()), pa.array(some.ravel()))], names=["row", "values"])
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([dense], pa.list_(pa.int64()))], names=["row", "values"])

        moves = packed.mapInArrow(descend, "row bigint, values array<bigint>")
        net, moved = _next(net, moved, _summed(moves), parts)
        shared.unpersist()
    return net


def threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Where the balanced error is least; the middle of the widest such gap."""
    s, at = np.unique(scores, return_inverse=True)
    return _gap(s, np.bincount(at, labels == 0), np.bincount(at, labels == 1))


def _gap(s: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> float:
    """``threshold`` from ascending scores and how many of either class have them."""
    wrong = np.concatenate(([0], np.cumsum(ones / max(1, ones.sum())))) + np.concatenate(
        ((zeros / max(1, zeros.sum()))[::-1].cumsum()[::-1], [0]))
    edges = np.concatenate(([s[0] - 1], s, [s[-1] + 1]))
    gap = np.where(wrong <= wrong.min() + 1e-12, np.diff(edges), -1)
    k = int(gap.argmax())
    return float((edges[k] + edges[k + 1]) / 2)


def _known(labels: DataFrame, id_col: str, label_col: str, usable: Column | None, max_docs: int | None) -> DataFrame:
    """(id, label): one row per id whose label may be learnt from."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    if max_docs is not None:
        order = F.xxhash64(F.col(id_col), F.lit(8))
        sides = [known.where(F.col("label") == side).orderBy(order, id_col).limit(max_docs // 2) for side in (0, 1)]
        known = sides[0].unionByName(sides[1])
    return cut(known.where("label in (0, 1)"), "known")


def _found(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, lang_col: str) -> Callable[[bool], DataFrame]:
    """A function that gives (id, words, mark), or (id, mark, lang, tokens), of the rows whose id may be in ``known``."""
    like = docs.schema[id_col].dataType == known.schema[id_col].dataType  # else equal ids may hash apart, and all rows pass
    bits = phrase_filter(known.select(F.col(id_col).alias("a"), F.lit(None).cast("int").alias("b"))) if like else np.array([2**64 - 1], np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    places = F.array(*[F.pmod(F.xxhash64(F.lit(k), F.col(id_col)), F.lit(64 * len(bits))) for k in range(FILTER_HASHES)])  # a null is not hashed

    def found(whole: bool) -> DataFrame:
        def make():
            words = shared.value

            def fn(batch):
                at = batch.column(3).flatten().to_numpy().reshape(-1, FILTER_HASHES)
                batch = batch.filter(pa.array(((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)))
                split = [tokens(t) for t in batch.column(1).to_pylist()]
                joined = [" ".join(f) for f in split]
                mark = [xxhash.xxh3_64_intdigest(t) >> 1 for t in joined]
                return [batch.column(0), mark, batch.column(2), joined] if whole else [batch.column(0), [len(f) for f in split], mark]
            return fn

        return per_batch(docs.where(F.col(id_col).isNotNull()).select(id_col, text_col, F.col(lang_col).cast("string"), places.alias("at")), make,
                         schema(docs, id_col, "mark bigint, lang string, tokens string" if whole else "words bigint, mark bigint"))

    return found


def _labelled(found: DataFrame, known: DataFrame, id_col: str, max_words: int | None) -> DataFrame:
    """(id, words, mark, label) of the rows to learn from."""
    sample = cut(found.join(known, id_col), "toxic")
    if max_words is None:
        return sample
    longest = max_words // LONGEST
    so_far = (f"sum(greatest(words, 1)) OVER (PARTITION BY label ORDER BY xxhash64(`{id_col}`, 8), `{id_col}`, mark "
              "ROWS UNBOUNDED PRECEDING) AS total")
    kept = cut(sample.where(F.col("words") <= longest).selectExpr("*", so_far).where(F.col("total") <= max_words // 2).drop("total"), "toxic")
    if kept.select("label").distinct().count() < 2 and sample.select("label").distinct().count() == 2:
        raise ValueError(f"every labelled document of a class has more than {longest} words: raise max_words")
    return kept


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          label_col: str = "toxic", usable: Column | None = None, max_docs: int | None = None, max_words: int | None = None,
          epochs: int = EPOCHS) -> tuple[Network | None, dict[str, float]]:
    """The network and one threshold per language; (None, {}) without labels of both classes.
    ``usable``, a condition on the id, names the rows whose labels may be learnt from."""
    held = F.pmod(F.xxhash64(F.col(id_col), F.lit(88)), F.lit(5)) == 0  # held back to calibrate
    known = _known(labels, id_col, label_col, usable, max_docs)
    found = _found(docs, known, id_col, text_col, lang_col)
    kept = _labelled(found(False), known, id_col, max_words).withColumn("back", held)
    sizes = {(r["label"], r["back"]): r for r in kept.groupBy("label", "back").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect()}
    if {y for y, _ in sizes} != {0, 1}:
        return None, {}
    none_back = len(sizes) < 4
    parts = max(1, -(-sum(r["n"] for r in sizes.values()) // PART_DOCS), -(-sum(r["words"] for r in sizes.values()) // PART_WORDS))
    if none_back:
        kept = kept.withColumn("back", F.lit(False))

    def pack(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        facts = list(zip(*[wanted.column(c).to_pylist() for c in ("id", "mark", "label", "back")], strict=True))
        left, of = Counter((i, mark) for i, mark, _, _ in facts), {(i, mark): (label, back) for i, mark, label, back in facts}
        rows = rows.sort_by([("place", "ascending"), ("mark", "ascending")])
        own, mine = [], []
        for key in zip(rows.column("id").to_pylist(), rows.column("mark").to_pylist(), strict=True):
            own.append(left[key] > 0)  # of equal rows as many as are wanted
            if own[-1]:
                left[key] -= 1
                mine.append(of[key])
        rows = rows.filter(pa.array(own, pa.bool_()))
        at: dict[str, int] = {}
        texts = [np.array([at.setdefault(w, len(at)) for w in t.split()], np.int32).tobytes() for t in rows.column("tokens").to_pylist()]
        words = all_buckets(list(at)).astype(np.int32).tobytes()
        return pa.table({"part": pa.array([wanted.column("part")[0].as_py() if mine else 0], pa.int32()), "words": [words],
                         "texts": pa.array([texts], pa.list_(pa.binary())),
                         "langs": pa.array([rows.column("lang").to_pylist()], pa.list_(pa.string())),
                         "labels": pa.array([[label for label, _ in mine]], pa.list_(pa.int32())),
                         "back": pa.array([[back for _, back in mine]], pa.list_(pa.bool_()))})[:min(1, len(mine))]

    place = F.xxhash64(F.col(id_col), F.lit(8))
    part = F.pmod(place, F.lit(parts)).cast("int").alias("part")
    packed = cut(found(True).select(part, place.alias("place"), F.col(id_col).alias("id"), "mark", "lang", "tokens").groupBy("part").cogroup(
        kept.select(part, F.col(id_col).alias("id"), "mark", "label", "back").groupBy("part")).applyInArrow(
        pack, "part int, words binary, texts array<binary>, langs array<string>, labels array<int>, back array<boolean>"), "parts")
    net = _fit(packed, parts, epochs)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def judge(batches):
        own = shared.value
        product = own.products()
        for batch in batches:
            for k, (words, texts, labels, _, back) in enumerate(_parts(batch)):
                judged, placed = np.flatnonzero(back | none_back), own.place(words.ravel()).reshape(-1, 3)
                logits = [own.logit(own.best(_sums(product, placed[texts[d]]))) for d in judged]
                langs = batch.column("langs")[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([langs[d] for d in judged], pa.string()), pa.array(labels[judged], pa.int32()),
                                                  pa.array(np.rint(np.clip(logits, -64, 64) * GRID), pa.int32())], names=["lang", "label", "bin"])

    both = [F.sum(F.when(F.col("label") == y, 1).otherwise(0)).alias(f"n{y}") for y in (0, 1)]
    judged = cut(packed.mapInArrow(judge, "lang string, label int, bin int").groupBy("lang", "bin").agg(*both), "judged")
    every = judged.groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).orderBy("bin").toArrow()  # at most 128 * GRID rows
    net.shift = _gap(every.column("bin").to_numpy() / GRID, every.column("n0").to_numpy(), every.column("n1").to_numpy())
    shift = net.shift

    def limit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bin")
        n0, n1 = rows.column("n0").to_numpy(), rows.column("n1").to_numpy()
        enough = int(min(n0.sum(), n1.sum()) >= 10)
        scores = _logistic(rows.column("bin").to_numpy() / GRID - shift)
        return pa.table({"lang": rows.column("lang")[:enough], "bar": pa.array([_gap(scores, n0, n1)] if enough else [], pa.float64())})

    net_bars = judged.where("lang <> ''").groupBy("lang").applyInArrow(limit, "lang string, bar double").collect()
    return net, {r["lang"]: r["bar"] for r in net_bars}


def _sums(product: np.ndarray, placed: np.ndarray) -> np.ndarray:
    """Products of the words of a text, with the empty words that follow it."""
    out = np.zeros((max(1, len(placed)) + 2, product.shape[1]), np.float32)
    out[:len(placed)] = product[placed].sum(axis=1)
    return out


def scorer(net: Network) -> Callable[[str | None], float]:
    """Scores texts; remembers the summed products of up to ``_MEMO`` words."""
    product = net.products().astype(np.float32)
    memo: dict[str, int] = {}
    table_ = np.zeros((_MEMO + 1, product.shape[1]), np.float32)
    row = net.place(np.arange((1 << WORD_BITS) + (1 << FOUR_BITS) + (1 << FIVE_BITS))).astype(np.int32)  # of every bucket

    def score(text: str | None) -> float:
        found = tokens(text)
        n = len(found)
        if len(memo) + n > _MEMO:
            memo.clear()
        if n > _MEMO // 2:  # a very long text: no use of the memory
            return net.score(net.logit(net.best(_sums(product, row[all_buckets(found)]))))
        at = np.fromiter(map(memo.get, found, repeat(-1)), np.int64, n)
        gaps = np.flatnonzero(at < 0)
        if len(gaps):
            missed = [found[k] for k in gaps.tolist()]
            fresh = list(dict.fromkeys(missed))
            start = len(memo)
            table_[start:start + len(fresh)] = product[row[all_buckets(fresh)]].sum(axis=1)
            memo.update(zip(fresh, range(start, start + len(fresh)), strict=True))
            at[gaps] = np.fromiter(map(memo.__getitem__, missed), np.int64, len(missed))
        sums = np.zeros((max(1, n) + 2, product.shape[1]), np.float32)
        np.take(table_, at, axis=0, out=sums[:n])
        return net.score(net.logit(net.best(sums)))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang", **options) -> DataFrame:
    """One row per document: the id, ``score``, ``threshold`` of its language and ``rejected``."""
    net, limits = train(docs, labels, id_col, text_col, lang_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        score = scorer(shared.value) if shared.value is not None else lambda text: 0.0

        def fn(batch):
            scores = [score(t) for t in batch.column(1).to_pylist()]
            bars = [limits.get(x, 0.5) for x in batch.column(2).to_pylist()]
            return [batch.column(0), scores, bars, [s >= b for s, b in zip(scores, bars, strict=True)]]
        return fn

    return per_batch(docs.select(id_col, text_col, F.col(lang_col).cast("string")), make,
                     schema(docs, id_col, "score double, threshold double, rejected boolean"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               **options) -> DataFrame:
    """The documents that are not rejected, judged row by row within one pass."""
    net, limits = train(docs, labels, id_col, text_col, lang_col, **options)
    if net is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        score = scorer(shared.value)
        for batch in (part for whole in batches for part in slices(whole, 4 << 20)):
            texts, langs = batch.column(text_col).to_pylist(), batch.column(lang_col).to_pylist()
            yield batch.filter(pa.array([score(t) < limits.get(x, 0.5) for t, x in zip(texts, langs, strict=True)], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def remainder(id_col: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                        "threshold", "rejected")
