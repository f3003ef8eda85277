"""MinHash near-duplicate detection with banding, signature verification and connected components.

1. One pass over the texts gives, per document, the size of its set of word shingles,
   a 64-bit key of the set, ``BANDS`` band hashes over ``BANDS * ROWS`` universal hash
   minima, and a signature of one byte per minimum.
2. Documents with the same set are one class from here on, named by the set's key.
   A group of exact copies, however large, is one aggregated row.
3. Classes that share a band are candidates. A bucket is first linked as a star: every
   member is compared with one centre, picked by a keyed hash, and what is confirmed is
   united by connected components. Then all pairs of a bucket whose members are in different
   components are compared, in bounded blocks, so no candidate is left out, while a
   large group of near copies costs a few confirmations per member.
4. A pair passes if its sizes and its signature allow the wanted similarity (the
   signature test leaves room for six standard deviations) and if the full sets do.
5. Components run over confirmed links by alternating large-star and small-star.

With 40 bands of 6 rows, two documents of similarity 0.8 share no band with a probability of
(1 - 0.8**6)**40 = 5e-6; that is the only loss.

Defined results: a null or empty text, and one without words, has the empty set and is linked
with nothing; rows that repeat an id are compared each by its own text; a null id never names
a component unless all ids in it are null, and is never kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.common import bounded_batches, byte_values, cut, per_batch, schema, table
from paddock.llm.components import components

BANDS, ROWS = 40, 6
MINIMA = BANDS * ROWS
WIDTH = 4  # words of a shingle in the registered query
PERCENT = 80
BLOCK = 256
_STEP = 256


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted, distinct 64-bit hashes of the word shingles; ASCII white space separates words."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and exactly \x20 and \x09-\x0D
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(width, n)
    mixed = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ codes[k:n - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    mixed.sort()
    return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def _key(found: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(found.tobytes()), "big", signed=True)


class Hashes:
    """Universal hashing by multiply and shift: the top half of a * x + b modulo 2**64."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**64, MINIMA, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**64, MINIMA, dtype=np.uint64)
        self.salt = rng.integers(0, 2**64, BANDS, dtype=np.uint64)

    def minima(self, found: np.ndarray) -> np.ndarray:
        x = (found >> np.uint64(32))[:, None]
        least = np.full(MINIMA, 2**64 - 1, np.uint64)
        for k in range(0, len(x), _STEP):
            part = x[k:k + _STEP] * self.a
            part += self.b
            np.minimum(least, part.min(axis=0), out=least)
        return least >> np.uint64(32)

    def bands(self, minima: np.ndarray) -> np.ndarray:
        mixed = self.salt.copy()
        for row in minima.reshape(BANDS, ROWS).T:
            mixed = (mixed ^ row) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
        return mixed.view(np.int64)


def features(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n_shingles, node, bands, signature); the last three, of which node is the key of the set,
    are null for an empty set."""
    def make():
        hashes = Hashes()

        def fn(batch):
            sizes, keys, bands, marks = [], [], [], []
            for text in byte_values(batch.column(1)):
                found = shingles(text, width)
                sizes.append(len(found))
                if len(found):
                    minima = hashes.minima(found)
                    keys.append(_key(found))
                    bands.append(hashes.bands(minima))
                    marks.append(minima.astype(np.uint8).tobytes())
                else:
                    keys.append(None), bands.append(None), marks.append(None)
            return [batch.column(0), sizes, keys, pa.array(bands, pa.list_(pa.int64())), marks]
        return fn

    return per_batch(docs.select(id_col, text_col), make,
                     schema(docs, id_col, "n_shingles bigint, node bigint, bands array<bigint>, signature binary"))


def _least_agreement(percent: int) -> float:
    """Agreeing minima that a pair of the wanted similarity falls below by chance once in 1e9."""
    p = percent / 100
    return MINIMA * (p - 6 * np.sqrt(p * (1 - p) / MINIMA))


def _similar(x: bytes, y: bytes, percent: int) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the similarity and whose full sets have it."""
    least = _least_agreement(percent)

    def run(batches):
        for batch in batches:
            s, t = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, MINIMA) for k in ("s_a", "s_b"))
            n, m = (np.asarray(batch.column(k)) for k in ("n_a", "n_b"))
            good = ((s == t).sum(axis=1) >= least) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            for k in np.flatnonzero(good):
                good[k] = _similar(batch.column("w_a")[k].as_buffer(), batch.column("w_b")[k].as_buffer(), percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))

    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"),
                                 F.col("words").alias(f"w_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint")


def _rest(members: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links between members that share a bucket and belong to different components.

    A bucket is dealt into blocks of about ``block`` members, and every pair of blocks is one row
    of at most two blocks, compared in numpy: no task holds a bucket, and a pair is never a
    row. A pair is looked at in the first band that it shares. First signatures are compared; then the
    full sets of the members with candidates left come to the same row."""
    wide = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                         F.count("*").alias("size")).where("lo <> hi")
    blocks = F.ceil(F.col("size") / block)
    facts = sets.select("node", "n", "signature", "bands")
    dealt = (members.join(wide.select("bucket", "size"), "bucket").join(facts, "node")
             .withColumn("own", F.pmod(F.xxhash64("node", F.lit(-1)), blocks))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
             .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     F.struct("node", "component", "n", "signature", "bands", "own").alias("m")))
    groups = dealt.groupBy("bucket", "i", "j").agg(F.collect_list("m").alias("m")).where("size(m) > 1")
    least = _least_agreement(percent)

    def look(batches):
        for batch in batches:
            out = {"bucket": [], "i": [], "j": [], "left": [], "right": []}
            columns = [batch.column(k).to_pylist() for k in ("bucket", "i", "j")]
            for bucket, i, j, m in zip(*columns, batch.column("m"), strict=True):
                m = m.values
                nodes, part, n, own = (m.field(k).to_numpy() for k in ("node", "component", "n", "own"))
                mark = np.frombuffer(b"".join(m.field("signature").to_pylist()), np.uint8).reshape(-1, MINIMA)
                bands = m.field("bands").flatten().to_numpy().reshape(-1, BANDS)
                band = int(np.flatnonzero(bands[0] == bucket)[0])
                left, right = [], []
                for x in range(len(nodes) - 1):
                    y = np.arange(x + 1, len(nodes))
                    ok = (part[y] != part[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))
                    if i != j:  # pairs within one block have a row of their own
                        ok &= own[y] != own[x]
                    y = y[ok]
                    y = y[(mark[y] == mark[x]).sum(axis=1) >= least]
                    y = y[(bands[y] == bands[x]).argmax(axis=1) == band] if len(y) else y
                    left += [nodes[x]] * len(y)
                    right += nodes[y].tolist()
                if left:
                    for key, value in zip(out, (bucket, i, j, left, right), strict=True):
                        out[key].append(value)
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(),) * 3 + (many,) * 2, strict=True)],
                                             names=list(out))

    found = cut(groups.mapInArrow(look, "bucket bigint, i bigint, j bigint, left array<bigint>, right array<bigint>"), "candidates")
    key = ["bucket", "i", "j"]
    whole = (found.select(*key, F.explode(F.array_distinct(F.concat("left", "right"))).alias("node"))
             .join(sets.select("node", "words"), "node").groupBy(*key).agg(F.collect_list(F.struct("node", "words")).alias("w")))

    def confirm(batches):
        for batch in batches:
            out: list[tuple[int, int]] = []
            for lefts, rights, w in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), batch.column("w"), strict=True):
                words = dict(zip(w.values.field("node").to_pylist(), w.values.field("words").to_pylist(), strict=True))
                root: dict[int, int] = {}

                def find(x, root=root):
                    while root.get(x, x) != x:
                        x = root[x]
                    return x

                for a, b in zip(lefts, rights, strict=True):
                    if find(a) != find(b) and _similar(words[a], words[b], percent):  # else united already
                        root[find(a)] = find(b)
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return found.join(whole, key).select("left", "right", "w").mapInArrow(confirm, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = PERCENT) -> DataFrame:
    """One row per document: (id, n_shingles, component_id, kept).

    Documents are linked if 100 * |A and B| >= ``percent`` * |A or B| over their shingle sets;
    ``component_id`` is the smallest id reachable over links, ``kept`` whether it is the row's own."""
    bounded_batches(docs.sparkSession)
    marks = cut(features(docs, id_col, text_col, width), "features").withColumnRenamed(id_col, "doc")
    nodes = cut(marks.where("node is not null").groupBy("node").agg(
        F.min("doc").alias("doc"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"),
        F.first("bands").alias("bands")), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    # buckets with several classes
    members = cut(rows.join(shared, "bucket").select("bucket", "node"), "members")
    sets = cut(_sets(docs, id_col, text_col, width, nodes.join(members.select("node").distinct(), "node")), "sets")
    # in every bucket a star around one member
    centres = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(3)).alias("by"), "node")).alias("c"))
    star = (members.join(centres.select("bucket", F.col("c.node").alias("b")), "bucket").where("node <> b")
            .select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct())
    links = cut(_confirmed(star, sets, percent), "links")
    united = cut(components(links), "components")
    # then whatever pairs of a bucket are in different components
    parts = members.select("bucket", "node").join(united, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = cut(_rest(cut(parts, "members"), sets, percent), "links")
    if not more.isEmpty():
        side = lambda x: united.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
        joined = (more.join(side("a"), "a", "left").join(side("b"), "b", "left")
                  .select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
        later = cut(components(joined), "components")  # of components
        united = (united.unionByName(joined.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                                     .select("node", F.col("node").alias("component")))
                  .join(later.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
                  .groupBy("node").agg(F.min(F.coalesce("top", "component")).alias("component")))
    named = nodes.select("node", F.col("doc").alias("least"))
    named = named.join(united, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("least"))
    named = named.select("node", "component").join(least, "component").select("node", "least")
    return (marks.select("doc", "n_shingles", "node").join(named, "node", "left")
            .select(F.col("doc").alias(id_col), "n_shingles",
                    F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("least")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, nodes: DataFrame) -> DataFrame:
    """(node, words): the full sets of some classes, from the text of one document each."""
    def make():
        def fn(batch):
            found = [shingles(t, width) for t in byte_values(batch.column(0))]
            return [[_key(x) if len(x) else None for x in found], [x.tobytes() for x in found]]
        return fn

    wanted = nodes.select(F.col("doc").alias("__doc")).distinct()
    texts = docs.select(id_col, text_col).join(wanted, F.col(id_col).eqNullSafe(F.col("__doc")), "left_semi").select(text_col)
    whole = T.StructType.fromDDL("node bigint, words binary")
    # rows that repeat an id may bring other sets and repeated ones
    return (per_batch(texts, make, whole).dropDuplicates(["node"])
            .join(nodes.select("node", "n", "signature", "bands"), "node"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that stand for their group. Rows that repeat an id are one document and share
    its fate, to stay if any of them does; rows without an id stay."""
    fate = near_duplicates(docs, id_col, **options).where(F.col(id_col).isNotNull())
    gone = fate.groupBy(id_col).agg(F.max("kept").alias("kept")).where("not kept").select(id_col)
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=WIDTH)


OP3_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) END AS sh FROM d),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b
  WHERE 100 * p.n >= {PERCENT} * (len(x.sh) + len(y.sh) - p.n)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN m ON m.v = s.doc_id"""
