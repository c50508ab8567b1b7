import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panelspark.llm import warc


def brute(rows):
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        best = max((j for j, _, g in rows if (g or "").encode() == p and j is not None), default=None)
        revisit = best is not None and i != best
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=repr)


COLS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_query_equals_brute_force(spark, data):
    from panelspark.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in QUERIES["op3_warc_round_trip"](spark, data).select(COLS).collect()), key=repr) == brute(rows)


def test_edges(spark, tmp_path):
    r = random.Random(1)
    big = "".join(r.choices("abcdé\r\n", k=1_500_000))
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (2, None, "same"), (None, "u", "same"), (None, None, "alone"), (4, "u", None), (5, "u", ""), (6, "u", big), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (8, "ü", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit("clash")).withColumn("body", F.lit(1))
    assert sorted((tuple(x) for x in warc.round_trip(df).select(COLS).collect()), key=repr) == brute(rows)
    assert warc.round_trip(df.limit(0)).count() == 0
    archives = warc.write_warc(df, f"file://{tmp_path}/w", at_least=5, roll=1000)
    assert archives.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_warc(archives).collect()
    assert sum(x.record_type == "revisit" for x in got) == 0  # below the least size all are responses
    assert {bytes(x.payload).decode() for x in got} == {h or "" for *_, h in rows}


def test_a_payload_of_many_pages(spark):
    """Half of all pages share one; it never meets them in one task."""
    rows = [(i, f"u{i}", None if i % 2 else f"page {i % 100}") for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.round_trip(df).select(COLS).collect()), key=repr) == brute(rows)


def test_framing():
    recs = [warc.record(i, "http://x/", bytes([i]) * n, None) for i, n in enumerate((0, 1, 70_000, 300_000))]
    data = b"".join(recs) + warc.record(9, None, b"\x03" * 300_000, 3)
    for step in (1 << 20, 977, 61):
        got = list(warc.read_records(iter([data[i : i + step] for i in range(0, len(data), step)])))
        assert [g["payload_bytes"] for g in got] == [0, 1, 70_000, 300_000, 300_000] and got[-1]["refers_to"] == 3 and got[-1]["payload"] is None
    with pytest.raises(warc.WarcError):
        list(warc.read_records(iter([data[:-5]])))
    import zlib

    plain = zlib.decompress(recs[1], 31)
    for bad in (plain.replace(b"\x01", b"\x02"), plain.replace(b"Content-Length: 1\r\n\r\n\x01", b"Content-Length: 2\r\n\r\n\x01"), plain[:-2], b"x" + plain):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(warc.WarcError):
            list(warc.read_records(iter([z.compress(bad) + z.flush()])))
