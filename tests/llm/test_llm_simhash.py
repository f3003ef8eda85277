import random
from itertools import product

import numpy as np
import pytest
import xxhash

from paddock.llm import simhash


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c
                                for c in text or "").split(" ") if w]
    n = len(words)
    h = [xxhash.xxh64_intdigest(" ".join(words[k:k + min(3, n)]).encode(), 42) for k in range(max(1, n - 2))] if n else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(rows, distance=3):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, f"{prints[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id bigint, text string, fp int, node string")
    out = simhash.near_duplicates(df.repartition(3), **options).collect()
    return sorted(((r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in out), key=repr)


def corpus(seed, n=250):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(40))
    base = [[word() for _ in range(rng.randint(1, 60))] for _ in range(25)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = word()
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "One two"), (504, "one TWO"), (505, "one"), (507, "É a b c d"), (508, "é a b c d"),
             (None, rows[0][1]), (None, "all alone here with nobody else"), (3, rows[3][1]), (3, "another text for id three"),
             (509, "one two three four " * 9000), (510, "one two three four")]
    return rows + [(600 + k, "the very same text in every row of a large group of copies") for k in range(60)]


def test_matches_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("partitions,distance", [((2,), 3), ((3,), 3), ((5,), 3), ((2, 3), 6)])
def test_no_link_is_lost_in_any_plan_or_block(spark, partitions, distance):
    rows = corpus(2, 120)
    assert run(spark, rows, partitions=partitions, distance=distance, block=3) == brute(rows, distance)


def test_large_group_of_near_fingerprints(spark, monkeypatch):
    """Fingerprints around one centre: large buckets, links that need a chain."""
    rng = random.Random(7)
    near = [sum(1 << b for b in rng.sample(range(64), rng.choice([2, 3, 4, 5]))) for _ in range(700)]
    nodes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, k) for k, x in enumerate(sorted(set(near)))], "fp bigint, least int")
    for block in (64, 4096):
        got = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, block=block)).collect()}
        root = {x: x for x in near}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in product(root, root):
            if i < j and (i ^ j).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        sign = lambda x: x - 2**64 if x >= 2**63 else x
        groups, want = {}, {}
        for x, c in got.items():
            groups.setdefault(c, set()).add(x)
        for x in root:
            want.setdefault(find(x), set()).add(sign(x))
        assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_allotment_is_the_cheapest():
    rng = random.Random(3)
    for parts in (2, 3, 4, 5):
        costs = [[0.0, *sorted(rng.random() * 10 for _ in range(4))] for _ in range(parts)]
        total, thresholds = simhash.allot(costs, 4)
        ways = [w for w in product(range(5), repeat=parts) if sum(w) == 4]
        assert sum(t + 1 for t in thresholds) == 4
        assert total == pytest.approx(min(sum(c[u] for c, u in zip(costs, w)) for w in ways))


def test_correlated_bits_share_a_partition(spark):
    rng = np.random.default_rng(4)
    heads = rng.integers(0, 2, (4000, 4))
    bits = np.repeat(heads, 16, axis=1) ^ (rng.random((4000, 64)) < 0.05)
    order = rng.permutation(64)
    fp = np.ascontiguousarray(np.packbits(bits[:, order].astype(bool), axis=1, bitorder="little")).view("<i8").ravel()
    nodes = spark.createDataFrame([(int(x),) for x in set(fp.tolist())], "fp bigint")
    n, both = simhash.bit_counts(nodes)
    assert n == len(set(fp.tolist()))
    groups = simhash.group_bits(n, both, 4)
    assert sorted({frozenset(order[b] // 16 for b in g) for g in groups}, key=sorted) == [frozenset({k}) for k in range(4)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(df).collect() == []
    alone = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(alone).collect()] == [1]
