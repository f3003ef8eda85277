import hashlib
import random
import time
import re

from paddock.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for k in range(max(1, len(w) - n + 1)):
                windows.setdefault(tuple(w[k:k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k:k + size])]
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, hits int, items string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_contamination(d, b, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["hits"]), tuple(r["items"])) for r in got), key=repr)


def data():
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "Beta", "gämma", "дельта", "e5", "z"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 4, 6, 9])))) for k in range(12)]
    items += [(3, "z z z z z z"), (None, "alpha beta"), (50, None), (51, " ?! "), (52, "")]
    docs = [(k, rng.choice([" ", ", ", "\n", "_"]).join(word() for _ in range(rng.randint(0, 60)))) for k in range(60)]
    return docs + [(100, None), (101, ""), (102, "..."), (1, docs[1][1]), (None, docs[2][1]), (103, "filler " * 30000 + "z z z z z z")], items


def test_matches_brute_force(spark):
    docs, items = data()
    for n in (4, 10):
        assert run(spark, docs, items, n=n) == brute(docs, items, n)


def test_several_blocks_give_the_same(spark):
    docs, items = data()
    assert run(spark, docs, items, n=4, block_windows=20) == brute(docs, items, 4)


def test_empty_tables_and_removal(spark):
    docs, items = data()
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == brute(docs, [], 10)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, extra int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    for options in ({}, {"block_windows": 20}):
        kept = decontaminate.remove_documents(d, b, n=4, **options)
        assert kept.columns == d.columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((x[0] for x in brute(docs, items, 4) if not x[2]), key=repr)


def test_query(spark, sf_dir):
    got = decontaminate.op10_decontamination(spark, sf_dir).collect()
    pick = lambda t, c: [(r[c], r["text"]) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()]
    want = brute(pick("documents", "doc_id"), pick("benchmark", "item_id"), 10)
    sha = lambda ids: hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == sorted(
        (d, n, h, len(i), sha(i), h > 0) for d, n, h, i in want)


def test_documents_with_a_passage_of_an_item_without_id_go(spark):
    passage = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(1, passage), (2, "something else " * 30)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, passage), (7, None)], "item_id string, text string")
    assert [r["doc_id"] for r in decontaminate.remove_documents(docs, bench).collect()] == [2]


def test_many_windows_are_built_in_linear_time():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=100)).encode()) for k in range(4000)]
    began = time.perf_counter()
    windows = decontaminate.Windows(items, 10)
    assert time.perf_counter() - began < 15
    assert sum(len(x[1]) for x in windows.lengths) == 4000 * 91
    n, spans, found = windows.hits(b"x y " + items[77][1][:300].rsplit(b" ", 1)[0] + b" z")
    assert found == [77] and spans == [(2, n - 1)]


def test_a_repeated_window_names_all_its_items():
    text = b"a b c d e"
    windows = decontaminate.Windows([(3, text), (1, b"x " + text), (2, b"b c d"), (9, b"d")], 3)
    assert windows.hits(b"q a b c d")[1:] == ([(1, 5)], [1, 2, 3, 9])


def test_an_item_longer_than_a_table(spark):
    rng = random.Random(4)
    passage = [f"p{rng.randrange(300)}" for _ in range(900)]
    items = [(1, " ".join(passage)), (2, "short one"), (3, " ".join(passage[100:140]))]
    docs = [(k, " ".join(["out"] * 3 + passage[k * 7:k * 7 + 15] + ["out"])) for k in range(120)] + [(500, "a short one here"), (501, "clean")]
    want = brute(docs, items, 10)
    assert run(spark, docs, items, n=10, block_windows=600) == want
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    kept = decontaminate.remove_documents(d, b, block_windows=600)
    assert [r["doc_id"] for r in kept.collect()] == [x[0] for x in want if not x[2]]
