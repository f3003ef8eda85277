"""SimHash near-duplicate detection by the general pigeonhole principle.

1. One pass over the texts gives a 64-bit fingerprint per document: a bit is 1 if it is set in
   over half of the XXH64 values of the text's word shingles, repeats included.
2. Equal fingerprints are one node from here on, so a group of exact copies is one row.
3. One pass over the nodes sums how often two bits are both set. Bits are grouped into partitions of
   about equal width, each grown from the bits that correlate most, so that what is
   skewed together is tested together.
4. Two fingerprints that differ in at most ``distance`` bits agree, in some partition k, up to t_k bits,
   for any thresholds t_k >= -1 (-1: not looked at) with sum(t_k + 1) = distance + 1. For 2, 3
   and 4 partitions a dynamic program allots the distance + 1 units at the least estimated cost
   of probes and candidates; the cheapest number of partitions is taken. Candidates with equal parts
   are counted exactly over all nodes; those that differ in some bits follow from the odds of each bit.
5. A node has one row per partition under its own value and, for t_k > 0, one under each larger value
   within t_k bits. Rows under one value form a bucket; a bucket without at least one own row and another
   row is left out. Buckets are dealt into bounded blocks, and pairs of blocks are compared in numpy,
   so no task holds a bucket and a pair is never a row: what leaves a block is a spanning forest of its
   verified links, which keeps every component.
6. Components run over the links by alternating large-star and small-star.

The result is exact: no link within ``distance`` bits is lost, whatever the thresholds.

Defined results: null and empty texts, and texts without words, have fingerprint zero and are linked like
any other; rows that repeat an id are compared each by its own text; a null id never names a component
unless all ids in it are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm.common import bounded_batches, byte_values, cut, per_batch, schema, table
from paddock.llm.components import components

BITS, WIDTH, DISTANCE, SEED = 64, 3, 3, 42
PARTITIONS = (2, 3, 4)
BLOCK = 2048
ROW_COST, PAIR_COST = 1000.0, 1.0  # a shuffled row costs about as much as comparing 1000 pairs
_STEP = 1 << 15


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The fingerprint as a signed 64-bit integer; ASCII white space separates words."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and exactly \x20 and \x09-\x0D
    n = len(words)
    if not n:
        return 0
    size = min(width, n)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n - size + 1].tolist()
    spans = zip(starts, ends[size - 1:].tolist(), strict=True)
    h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), _STEP):
        part = h[k:k + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, fp) of every document."""
    def make():
        return lambda batch: [batch.column(0), [fingerprint(t, width) for t in byte_values(batch.column(1))]]

    return per_batch(docs.select(id_col, text_col), make, schema(docs, id_col, "fp bigint"))


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes, and how many have both bits set, per pair of bits."""
    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            n, both = n + len(bits), both + bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([both.ravel().astype(np.int64)], pa.list_(pa.int64()))],
                                         names=["n", "both"])

    sums = nodes.select("fp").mapInArrow(run, "n bigint, both array<bigint>")
    rows = (sums.select(F.posexplode(F.concat(F.array("n"), "both")).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect())
    found = dict((r["k"], r["v"]) for r in rows)
    return int(found.get(0, 0)), np.array([found.get(k + 1, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` lists of bits of about equal length; each grows by the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    var = np.maximum(p * (1 - p), 1e-12)
    link = np.abs(both / max(n, 1) - np.outer(p, p)) / np.sqrt(np.outer(var, var))
    np.fill_diagonal(link, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        rest = sorted(free)
        own = [max(rest, key=lambda b: (link[b, rest].sum(), -b))]
        free.discard(own[0])
        while len(own) < width:
            best = max(sorted(free), key=lambda b: (link[b, own].sum(), -b))
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def estimates(n: int, both: np.ndarray, bits: list[int], equal: float, distance: int) -> list[float]:
    """Cost of probing a partition with threshold -1, 0, ... ``distance``: rows and candidate pairs.

    ``equal`` pairs agree in all its bits; that a pair differs in one bit instead has the odds
    2p(1-p) : p^2 + (1-p)^2, so those that differ in s bits are elementary symmetric sums of the odds."""
    p = np.diag(both)[bits] / max(n, 1)
    same = p * p + (1 - p) * (1 - p)
    odds = (1 - same) / same
    sums = np.zeros(distance + 1)
    sums[0] = 1
    for o in odds:
        sums[1:] += o * sums[:-1].copy()
    least = n * n / 2 * float(np.prod(same))  # what independent bits would give
    out = [0.0]
    for t in range(distance + 1):
        rows = n * (1 + sum(comb(len(bits), s) for s in range(1, t + 1)) / 2)
        out.append(ROW_COST * rows + PAIR_COST * max(equal, least) * float(sums[:t + 1].sum()))
    return out


def allot(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """The cheapest way to deal ``units`` to partitions, where u units cost costs[k][u] and mean threshold u - 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for u in range(units - used + 1):
                new = (total + cost[u], [*chosen, u - 1])
                if used + u not in step or new < step[used + u]:
                    step[used + u] = new
        best = step
    return best[units]


def _gather(fp: Column, bits: list[int]) -> Column:
    """The value of some bits as a number of len(bits) bits."""
    return reduce(lambda a, b: a.bitwiseOR(b), [
        F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), k) for k, b in enumerate(bits)])


def plan(nodes: DataFrame, distance: int = DISTANCE, partitions: tuple[int, ...] = PARTITIONS) -> list[tuple[list[int], int]]:
    """The partitions that are looked at: (bits, threshold) each. Fixed numbers of sums reach the driver."""
    n, both = bit_counts(nodes)
    if n < 2:
        return []
    groups = [(m, bits) for m in partitions for bits in group_bits(n, both, m)]
    values = F.array(*[F.struct(F.lit(k).alias("part"), _gather(F.col("fp"), bits).alias("value")) for k, (_, bits) in enumerate(groups)])
    counts = nodes.select(F.inline(values)).groupBy("part", "value").agg(F.count("*").alias("c"))
    equal = {r["part"]: r["pairs"] for r in counts.groupBy("part").agg(
        F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs")).collect()}
    ways = []
    for m in partitions:
        own = [k for k, (of, _) in enumerate(groups) if of == m]
        total, thresholds = allot([estimates(n, both, groups[k][1], equal[k], distance) for k in own], distance + 1)
        ways.append((total, m, [(groups[k][1], t) for k, t in zip(own, thresholds, strict=True) if t >= 0]))
    return min(ways)[2]


def _rows(nodes: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(bucket, fp, own): a node under its own value, and as a probe under the larger values within the threshold."""
    def under(k: int, bits: list[int], threshold: int) -> list[Column]:
        value, head = _gather(F.col("fp"), bits), F.lit(k << BITS // 2).cast("long")
        masks = [sum(1 << b for b in flips) for s in range(1, threshold + 1) for flips in combinations(range(len(bits)), s)]
        out = [F.array(F.struct(head.bitwiseOR(value).alias("bucket"), F.lit(True).alias("own")))]
        if masks:
            flipped = F.transform(F.array(*[F.lit(x).cast("long") for x in masks]), lambda x: value.bitwiseXOR(x))
            out.append(F.transform(F.filter(flipped, lambda y: y > value),
                                   lambda y: F.struct(head.bitwiseOR(y).alias("bucket"), F.lit(False).alias("own"))))
        return out

    parts = [c for k, (bits, threshold) in enumerate(chosen) for c in under(k, bits, threshold)]
    return nodes.select("fp", F.inline(F.concat(*parts)))


def forest(fp: np.ndarray, own: np.ndarray, block: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of an own row with any row; with two blocks, links across them."""
    label = np.arange(len(fp))
    across = len(block) and block.min() != block.max()
    out = []
    for x in np.flatnonzero(own):
        near = np.bitwise_count(fp ^ fp[x]) <= distance
        if across:
            near &= block != block[x]
        near &= label != label[x]
        for root in np.unique(label[near]):
            out.append((int(fp[x]), int(fp[np.flatnonzero(near & (label == root))[0]])))
            label[label == root] = label[x]
    return out


def links(nodes: DataFrame, distance: int = DISTANCE, partitions: tuple[int, ...] = PARTITIONS, block: int | None = None) -> DataFrame:
    """(a, b): pairs of fingerprints within ``distance`` bits that connect all that such pairs connect."""
    block = block or BLOCK
    chosen = plan(nodes, distance, partitions)
    if not chosen:
        return nodes.sparkSession.createDataFrame([], "a bigint, b bigint")
    rows = _rows(nodes, chosen)
    sizes = (rows.groupBy("bucket").agg(F.count("*").alias("size"), F.max("own").alias("own")).where("size > 1 and own").select("bucket", "size"))
    blocks = F.ceil(F.col("size") / block)
    dealt = (rows.join(sizes, "bucket").withColumn("at", F.pmod(F.xxhash64("fp", F.lit(-1)), blocks))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
             .select("bucket", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), F.struct("fp", "own", "at").alias("m")))
    groups = dealt.groupBy("bucket", "i", "j").agg(F.collect_list("m").alias("m")).where("size(m) > 1").select("i", "j", "m")

    def compare(batches):
        for batch in batches:
            m = batch.column("m")
            ends = np.asarray(m.offsets)
            flat = m.values.slice(ends[0], ends[-1] - ends[0])
            ends = ends - ends[0]
            fp = flat.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            own, at = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("own", "at"))
            two = np.asarray(batch.column("i")) != np.asarray(batch.column("j"))
            size = np.diff(ends)
            found: list[tuple[int, int]] = []
            # the pairs of small groups, for all of them at once by their distance in the list
            small = np.repeat(size <= 32, size)
            group = np.repeat(np.arange(len(size)), size)
            for d in range(1, min(32, int(size.max(initial=0)))):
                ok = small[:-d] & (group[:-d] == group[d:]) & (own[:-d] | own[d:])
                ok &= ~np.repeat(two, size)[:-d] | (at[:-d] != at[d:])
                k = np.flatnonzero(ok)
                k = k[np.bitwise_count(fp[k] ^ fp[k + d]) <= distance]
                found += zip(fp[k].tolist(), fp[k + d].tolist(), strict=True)
            for g in np.flatnonzero(size > 32):
                s = slice(ends[g], ends[g + 1])
                found += forest(fp[s], own[s], at[s] if two[g] else np.zeros(size[g], np.int64), distance)
            root: dict[int, int] = {}

            def find(x, root=root):
                while root.get(x, x) != x:
                    root[x] = root.get(root[x], root[x])
                    x = root[x]
                return x

            kept = []
            for a, b in found:
                a_, b_ = find(a), find(b)
                if a_ != b_:
                    root[a_] = b_
                    kept.append((a, b))
            both = np.array(kept, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return groups.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, distance: int = DISTANCE,
                    partitions: tuple[int, ...] = PARTITIONS, block: int | None = None) -> DataFrame:
    """One row per document: (id, fp, component_id), where ``component_id`` is the smallest id reachable
    over pairs of fingerprints that differ in at most ``distance`` bits."""
    bounded_batches(docs.sparkSession)
    marks = cut(fingerprints(docs, id_col, text_col, width), "fingerprints").withColumnRenamed(id_col, "doc")
    nodes = cut(marks.groupBy("fp").agg(F.min("doc").alias("least")), "nodes")
    united = components(cut(links(nodes, distance, partitions, block), "links"))
    named = nodes.join(united.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = cut(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return (marks.join(named.join(least, "component").select("fp", "component_id"), "fp")
            .select(F.col("doc").alias(id_col), "fp", "component_id"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
