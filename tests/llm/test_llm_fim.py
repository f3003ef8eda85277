import hashlib
import random
import re

import duckdb
import pytest

from paddock.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    x = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = [None, "", "a", "é", "a<P>b", "<", "<<P", "S>", "<P", ">", "a\nb\r\n\n", "日本 \U0001f600 éx", "\x00\x01", "word " * 40000,
         "\U0001f600" * 3000, "<S", "x<M>"]


def rows():
    rng = random.Random(5)
    some = ["".join(rng.choice("abZ <>PSM\né日😀-1") for _ in range(rng.randrange(60))) for _ in range(400)]
    return [(k, t) for k, t in enumerate(TEXTS * 6 + some)] + [(3, "another text of a repeated id"), (3, "a")]


def test_brute_force_and_round_trip(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id bigint, text string, output string, form int")
    got = fim.restore(fim.fill_in_middle(df.repartition(3))).collect()
    key = lambda r: (r[0], r[1] or "")
    got = sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key)
    assert got == sorted(((i, t or "", *brute(i, t)) for i, t in data), key=key)
    assert {g[3] for g in got} == {"plain", "psm", "spm"}


def test_digests_stream_the_pieces(spark):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string")
    for r in fim.restore(fim.fill_in_middle(df)).collect():
        assert r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_piece_table():
    t = fim.PieceTable(b"abcdef")
    t.cut(4)
    t.cut(0)
    t.cut(6)
    assert t.join() == b"abcdef" and [p[2] for p in t.pieces] == [0, 4, 2, 0]
    assert t.arrange((2, 1, fim._M)).join() == b"efabcd<M>"
    with pytest.raises(IndexError):
        t.cut(7)


def test_empty_table_and_null_id(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert fim.restore(fim.fill_in_middle(df)).collect() == []
    one = spark.createDataFrame([(None, "some words here")], "doc_id bigint, text string")
    r = fim.restore(fim.fill_in_middle(one)).first()
    assert (r["text"], r["output"]) == ("some words here", brute("", "some words here")[4])


def test_twin_on_odd_rows(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(fim.OP13_SQL).fetchall()
    got = [tuple(r) for r in fim.op13_fill_in_middle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
