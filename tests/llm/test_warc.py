import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternscore.llm.warc import candidates, page_records, reached, read_archives, write_archives

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def brute(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        rev = len(b) >= 100 and b in first and p != first[b]
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if rev else "response", first[b] if rev else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    long, at_99, at_100 = "é" * 80_000, "x" * 99, "x" * 100
    rows = [(1, "http://a/\r\nX: y", long), (2, None, None), (3, "u", ""), (4, "u", at_99), (5, "u", at_99), (6, "u", at_100), (7, "u", at_100), (8, "u", FAKE), (9, "u", FAKE * 50), (10, "u", FAKE * 50), (11, "u", long), (None, "u", long), (12, "u", "a\nb\r\n\r\nc\n"), (6, "u", at_100), (13, "u", "WARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    for n, kw in enumerate(({}, {"records_per_file": 2}, {"hot_rows": 2})):
        path = f"file://{tmp_path}/w{n}"
        write_archives(df, path, **kw)
        assert sorted((tuple(r) for r in page_records(read_archives(spark, path)).collect()), key=repr) == brute(rows)


def test_long_urls_and_archives_cut_by_bytes(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"page {i} " * 20) for i in range(40)] + [(100, "data:" + "u" * 100_000, "long url"), (101, "http://a/WARC/1.1", "x"), (102, "u", "y" * 60_000), (103, "u", "WARC/1.1\r\n" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/long"
    write_archives(df, path, records_per_file=20, most_bytes=50_000)
    got = read_archives(spark, path)
    assert sorted((tuple(r) for r in page_records(got).collect()), key=repr) == brute(rows)
    sizes = got.groupBy("file").agg(F.first("size").alias("size"), F.count("*").alias("n")).collect()
    assert all(r["n"] <= 20 and (r["size"] <= 50_000 or r["n"] == 1) for r in sizes)


def test_a_chain_that_ends_early_is_an_error(spark, tmp_path):
    for i, tail in enumerate((FAKE + "?" + FAKE, "?")):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "part-0.gz").write_bytes(gzip.compress(tail.encode()))
        with pytest.raises(Exception, match="records end at byte|no record in"):
            read_archives(spark, f"file://{tmp_path}/d{i}").collect()


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert read_archives(spark, path).collect() == []


def test_chain_rejects_records_inside_payloads_and_stops_at_damage():
    inner = FAKE.encode()
    record = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(inner), inner)
    found = candidates(record * 3)
    start, nxt = np.array([x[0] for x in found]), np.array([x[1] for x in found])
    assert len(found) == 6 and start[reached(start, nxt)].tolist() == [0, len(record), 2 * len(record)]
    found = candidates(record + b"?" + record)
    start, nxt = np.array([x[0] for x in found]), np.array([x[1] for x in found])
    assert start[reached(start, nxt)].tolist() == [0]
    assert not reached(np.array([5]), np.array([9])).any()
