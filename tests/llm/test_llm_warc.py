import base64
import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from paddock.llm import warc


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


ROWS = [("r1", "response", "http://a.example.com/", None, b"<html>one</html>"), ("r2", "response", "http://b.example.com/x y\r\nz", None, b""),
        ("r3", "revisit", "http://a.example.com/", "r1", b"<html>one</html>"), ("r4", "response", None, None, os.urandom(300000)),
        ("r5", "response", "http://c.example.com/é", None, None)]


def written(spark, tmp_path, **options):
    df = spark.createDataFrame(ROWS, warc.WRITE_SCHEMA).repartition(2)
    warc.write_warc(df, str(tmp_path), **options)
    return str(tmp_path)


@pytest.mark.parametrize("options", [{}, {"compression": "none"}, {"filebytes": 1}])
def test_round_trip(spark, tmp_path, options):
    path = written(spark, tmp_path, **options)
    got = {r["record_id"]: r for r in warc.read_warc(spark, path).where("record_type <> 'warcinfo'").collect()}
    assert set(got) == {r[0] for r in ROWS}
    for name, kind, uri, refers, payload in ROWS:
        r, payload = got[name], payload or b""
        assert (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) == (kind, refers, len(payload), sha(payload))
        assert r["payload"] == (None if kind == "revisit" else payload)
    assert got["r2"]["target_uri"] == "http://b.example.com/x%20y%0D%0Az" and got["r4"]["target_uri"] is None
    assert warc.read_warc(spark, path, payload="none").where("payload IS NOT NULL").count() == 0


def test_filters_are_pushed_and_payloads_skipped(spark, tmp_path, monkeypatch):
    path = written(spark, tmp_path)
    for condition, want in [("record_type = 'revisit'", {"r3"}), ("record_type in ('response', 'revisit') and target_uri like 'http://a%'", {"r1", "r3"}),
                            ("target_uri is null and record_type = 'response'", {"r4"}), ("refers_to is not null", {"r3"}),
                            ("not (record_type = 'response') and record_type <> 'warcinfo'", {"r3"}), ("payload_bytes > 1000", {"r4"}),
                            ("target_uri like '%é' or record_id = 'r1'", {"r1", "r5"})]:
        assert {r["record_id"] for r in warc.read_warc(spark, path).where(condition).collect()} == want, condition
    # a skipped record's payload is never inflated: with its bytes damaged the others still read
    big = max((os.path.join(path, f) for f in os.listdir(path) if ".warc" in f), key=os.path.getsize)
    data = bytearray(open(big, "rb").read())
    data[-5000:-4000] = bytes(1000)
    open(big, "wb").write(data)
    assert {r["record_id"] for r in warc.read_warc(spark, path).where("target_uri like 'http://a%'").collect()} == {"r1", "r3"}
    with pytest.raises(Exception, match="before byte"):
        warc.read_warc(spark, path).collect()


def test_uncommitted_files_are_not_read(spark, tmp_path):
    path = written(spark, tmp_path)
    with open(f"{path}/part-lost.warc.gz", "wb") as f:
        f.write(warc.member(warc.record("response", "ghost", None, None, b"x")))
    assert "ghost" not in {r["record_id"] for r in warc.read_warc(spark, path).collect()}


def test_archives_of_others(spark, tmp_path):
    records = [warc.record("request", "q", "http://a/", None, b"GET /"), warc.record("response", "a", "http://a/", None, b"body" * 2000),
               warc.record("response", "b", "http://b/", None, b"")]
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole/x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))  # no length in the header
    (tmp_path / "whole/y.warc").write_bytes(b"".join(records))
    got = warc.read_warc(spark, str(tmp_path / "whole")).where("record_type = 'response'").collect()
    assert sorted((r["record_id"], r["payload_bytes"]) for r in got) == [("a", 8000), ("a", 8000), ("b", 0), ("b", 0)]
    seen = [h["warc-record-id"] for h, b in warc.read_records(io.BytesIO(b"".join(gzip.compress(r) for r in records)),
                                                           lambda h: None if h["warc-type"] == "request" else False)]
    assert seen == ["<a>", "<b>"]


def test_pages_with_copies_and_odd_rows(spark, tmp_path):
    rows = [(1, "u", "same"), (7, "u", "same"), (4, None, "same"), (2, "u", None), (3, "u", ""), (5, "u", "é" * 200000), (6, "u", "alone"), (6, "u", "alone"),
            (None, "u", "alone")]
    pages = spark.createDataFrame([(*r, b"x") for r in rows], "page_id bigint, url string, html string, payload binary")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                  for r in warc.op9_warc(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        top = max(j for j, _, x in rows if (x or "") == (h or "") and j is not None)
        want.append((i, len(b), sha(b), "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want, key=repr)
    small = warc.page_records(pages, min_bytes=5).where(F.col("record_type") == "revisit").collect()
    assert {r["record_id"] for r in small} == {"urn:page:"}
    empty = tmp_path / "none"
    pages.limit(0).write.parquet(f"{empty}/pages.parquet")
    assert warc.op9_warc(spark, str(empty)).collect() == []
