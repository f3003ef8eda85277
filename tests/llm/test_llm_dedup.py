import random

import pytest

from paddock.llm import dedup
from paddock.llm.components import components


def sets_of(text, width):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c
                                for c in text or "").split(" ") if w]
    n = len(words)
    return {tuple(words[k:k + min(width, n)]) for k in range(max(1, n - width + 1))} if n else set()


def brute(rows, width, percent=80):
    """Per row (id, size, component): links over full sets, then a search."""
    found = [sets_of(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if found[i] and found[j] and 100 * len(found[i] & found[j]) >= percent * len(found[i] | found[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = find(k)
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(found[k]), i if not found[k] else least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def run(spark, rows, width, **options):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id bigint, text string, component_id int, node string")
    out = dedup.near_duplicates(df.repartition(3), width=width, **options).collect()
    for r in out:
        assert r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"])
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=repr)


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(40))
    base = [[word() for _ in range(rng.randint(30, 90))] for _ in range(12)]
    passage = [word() for _ in range(50)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.3:  # a long shared passage: similar, but not enough
            words = passage + [word() for _ in range(rng.randint(5, 30))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows


def test_matches_brute_force(spark):
    rows = corpus(1)
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "One two"), (504, "one TWO"), (505, "one"), (506, "one two"), (507, "É a b c d"),
             (508, "é a b c d"), (None, rows[0][1]), (None, "all alone here with nobody else"), (3, rows[3][1]), (3, "another text for id three")]
    rows += [(600 + k, "the very same text in every row of a large group of copies") for k in range(60)]
    assert run(spark, rows, 4) == brute(rows, 4)


def test_no_link_is_lost_within_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 3)
    monkeypatch.setattr(dedup._rest, "__defaults__", (3,))
    rows = corpus(2, 90)
    assert run(spark, rows, 3) == brute(rows, 3)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert dedup.near_duplicates(df).collect() == []
    alone = spark.createDataFrame([(1, "x"), (2, None)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in dedup.near_duplicates(alone).collect()) == [(1, 1, 1, True), (2, 0, 2, True)]
    assert dedup.drop_near_duplicates(alone).count() == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_search(spark, seed):
    rng = random.Random(seed)
    n = 120
    edges = [(k, k + 1) for k in range(0, 40)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(60)] + [(90, 90)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
