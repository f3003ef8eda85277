"""Benchmark decontamination by token n-grams.

The words of the benchmark become small integers and its windows (``n``
consecutive words; a shorter item is one window of its own length) a hash set
of bounded size, which is broadcast. A document is translated with the same
vocabulary in one pass; a rolling combination of ``n`` word ids is looked up
for every position, and each hit is verified word by word, so a hash collision
never counts.

The broadcast is bounded by ``block_windows``: a larger benchmark is dealt into
several blocks by a hash of item and part (a long item has several parts), which are
built, broadcast, scanned and given up one after the other; the hit intervals of a
document are then united. Documents are never shuffled in the scan, and a hot source
or group of copies costs nothing extra.

Words: ASCII letters are lower-cased; a word is a run of ASCII letters, digits
and characters beyond ASCII. All bytes beyond ASCII are word bytes, so working
on UTF-8 bytes gives the same words.

Defined results: a null or empty text has no words and no hit; items without
words are no items, nor, unless documents are only removed, are those with a null id; rows that repeat an item id
count as one item with the windows of all of them; repeated documents are each
scanned; an empty benchmark hits nothing.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm.common import bounded_batches, byte_values, cut, per_batch, schema, table

N = 10
BLOCK_WINDOWS = 2_000_000

#: Lower-cases A-Z and turns every byte that is no word byte into a space.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
                    for b in range(256))
_BITS = 20


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class Windows:
    """The windows of some items: vocabulary, and per window length a hash set with
    the exact word ids behind every hash, in flat arrays that are built once and broadcast."""

    def __init__(self, items: list[tuple[object, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.items)}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int32)
            if len(ids):
                by_length.setdefault(min(n, len(ids)), []).append((ids, number[item]))
        rng = np.random.default_rng(20)
        self.codes = rng.integers(1, 2**63, len(self.vocabulary) + 1, dtype=np.uint64) | np.uint64(1)
        self.codes[0] = 0
        self.lengths = []
        for size, found in sorted(by_length.items()):
            keys = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, size) for ids, _ in found])
            owner = np.repeat(np.array([k for _, k in found], np.int32), [len(ids) - size + 1 for ids, _ in found])
            hashes = self._combine([self.codes[column] for column in keys.T])
            order = np.argsort(hashes, kind="stable")
            hashes, keys, owner = hashes[order], keys[order], owner[order]
            new = np.ones(len(hashes), bool)  # the first of equal windows that follow one another
            new[1:] = (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1]).any(axis=1)
            first = np.append(np.flatnonzero(new), len(hashes))
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[hashes >> np.uint64(64 - _BITS)] = True
            self.lengths.append((size, hashes[new], keys[new], first, owner, seen))

    @staticmethod
    def _combine(columns) -> np.ndarray:
        """The hash of windows whose k-th words have the codes columns[k]."""
        total = np.zeros(len(columns[0]), dtype=np.uint64)
        for column in columns:
            total = total * np.uint64(0x9E3779B97F4A7C15) + column
        total ^= total >> np.uint64(29)
        return total * np.uint64(0xBF58476D1CE4E5B9)

    def hits(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list]:
        """Number of words; united hit intervals in words; ids of the items found."""
        found = words(text)
        n = len(found)
        if not n or not self.vocabulary:
            return n, [], []
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int64, n)
        codes, spans, items = self.codes[ids], [], set()
        known = np.cumsum(ids == 0)
        for size, hashes, keys, first, owner, seen in self.lengths:
            if n < size:
                continue
            # windows without a word that is unknown to the benchmark
            gaps = known[size - 1:] - np.concatenate(([0], known[:n - size]))
            at = np.flatnonzero(gaps == 0)
            if not len(at):
                continue
            mixed = self._combine([codes[at + k] for k in range(size)])
            maybe = seen[mixed >> np.uint64(64 - _BITS)]
            at, mixed = at[maybe], mixed[maybe]
            k = np.searchsorted(hashes, mixed)
            k[k == len(hashes)] = 0
            while len(at):  # once, but for different windows that share a hash
                real = (ids[at[:, None] + np.arange(size)] == keys[k]).all(axis=1)
                spans += [(int(a), int(a) + size) for a in at[real]]
                for w in np.unique(k[real]):
                    items.update(owner[first[w]:first[w + 1]].tolist())
                after = np.minimum(k + 1, len(hashes) - 1)
                again = (after > k) & (hashes[after] == mixed)
                at, mixed, k = at[again], mixed[again], after[again]
        return n, unite(spans), [self.items[i] for i in sorted(items)]


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _parts(test: DataFrame, n: int, most: int) -> DataFrame:
    """(item, part, body): items in parts of at most ``most`` windows; a part repeats the n - 1 words that its
    windows need, so every window of an item is in one part."""
    def run(batches):
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for item, text in zip(b.column("item").to_pylist(), byte_values(b.column("body")), strict=True):
                found = words(text)
                for k in range(0, max(1, len(found) - n + 1), most):
                    for column, value in zip(out, (item, k // most, b" ".join(found[k:k + most + n - 1]).decode()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (b.schema.field("item").type, pa.int64(), pa.string()), strict=True)],
                                             names=["item", "part", "body"])

    return test.mapInArrow(run, schema(test, "item", "part bigint, body string"))


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, n: int, block_windows: int):
    """The windows of the benchmark in tables of bounded size, one after the other: each is built once on the
    driver, broadcast, and given up when the next is asked for. Yields (number of tables, table)."""
    test = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("body")).dropna()
    # a window needs a word and a word a byte and a separator: an upper bound of the windows
    bound = test.agg(F.sum(F.ceil((F.octet_length("body") + 1) / 2))).first()[0] or 0
    blocks = max(1, -(-int(bound) // block_windows))
    parts = test.withColumn("part", F.lit(0))
    if blocks > 1:  # parts of a sixteenth of a table even out over twice as many tables
        blocks *= 2
        parts = cut(_parts(test, n, max(1, block_windows // 16)), "benchmark")
    for k in range(blocks):
        rows = parts.where(F.pmod(F.xxhash64("item", "part"), F.lit(blocks)) == k).select("item", "body").collect()
        shared = benchmark.sparkSession.sparkContext.broadcast(Windows([(r["item"], r["body"].encode()) for r in rows], n))
        del rows
        yield blocks, shared
        if blocks > 1:
            shared.destroy()


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", n: int = N,
                       block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: the id, ``n_words``, ``hits`` (united intervals of words, end
    exclusive) and ``items`` (ids of the items of which a window occurs, sorted)."""
    item_type = benchmark.schema[item_col].dataType.simpleString()
    out = schema(docs, id_col, f"row bigint, n_words bigint, hits array<struct<start:bigint,end:bigint>>, items array<{item_type}>")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    rows = docs.select(id_col, F.lit(0).cast("long").alias("row"), F.col(text_col).alias("body"))

    def scan(rows: DataFrame, shared) -> DataFrame:
        def make():
            windows = shared.value

            def fn(batch):
                found = [windows.hits(t) for t in byte_values(batch.column(2))]
                return [batch.column(0), batch.column(1), [f[0] for f in found],
                        pa.array([[{"start": s, "end": e} for s, e in f[1]] for f in found], span_type), [f[2] for f in found]]
            return fn

        return per_batch(rows, make, out)

    found = None
    for blocks, shared in _blocks(benchmark, item_col, item_text, n, block_windows):
        if blocks == 1:
            return scan(rows, shared).drop("row")
        if found is None:  # a stable name for each row, to unite what the blocks find
            rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
        own = cut(scan(rows, shared), "hits")
        found = own if found is None else found.unionByName(own)
    return (found.groupBy(id_col, "row")
            .agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
                 F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            .mapInArrow(_united, out).drop("row"))


def _united(batches):
    """The hit intervals of all blocks, united per document (columns in the order of the scan's)."""
    for b in batches:
        spans = [[{"start": s, "end": e} for s, e in unite([(x["start"], x["end"]) for x in row])]
                 for row in b.column("hits").to_pylist()]
        names = b.schema.names
        yield pa.RecordBatch.from_arrays(
            [pa.array(spans, b.column(k).type) if n == "hits" else b.column(k) for k, n in enumerate(names)], names=names)


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                     item_text: str = "text", n: int = N, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows without any hit, with all their columns, judged row by row in one pass per block."""
    texts = benchmark.select(F.xxhash64(item_text).alias(item_col), F.col(item_text).alias("body"))  # rows without an id count too
    for blocks, shared in _blocks(texts, item_col, "body", n, block_windows):
        docs = _without_hits(docs, shared, text_col)
        if blocks > 1:
            docs = cut(docs, "documents")
    return docs


def _without_hits(docs: DataFrame, shared, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches):
        windows = shared.value
        for batch in batches:
            yield batch.filter(pa.array([not windows.hits(t)[1] for t in byte_values(batch.column(text_col))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    names = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
