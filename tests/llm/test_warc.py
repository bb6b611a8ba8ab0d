"""Archives: exact round trip, predicates, foreign files, revisits."""

import base64
import gzip
import hashlib
import io
import random
import time
import tracemalloc

from pyspark.sql import functions as F

from rungwise.llm.warc import archived_pages, format_record, page_records, read_archives, read_records, write_archives

SCHEMA = "page_id long, url string, html string, keep string, key int, payload string"


def made():
    rng = random.Random(8)
    bodies = ["", None, "é😀\r\n\r\nWARC/1.1\r\n", "x" * 300_000] + ["".join(rng.choice("ab\r\n") for _ in range(n)) for n in (1, 7, 500, 20_000)]
    rows = [(i, f"http://h/{i}", rng.choice(bodies)) for i in range(80)] + [(100 + i, "http://only/\nx", f"only {i}") for i in range(20)]
    return rows + [(3, "http://h/3", rows[3][2]), (None, None, "only 5"), (None, "u", "nobody else"), (None, "u", "nobody else")]


def brute(rows):
    best = {}
    for p, _, h in rows:
        if p is not None:
            best[h or ""] = max(best.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        keep = best.get(h or "")
        again = keep is not None and keep != p
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((p, len(data), digest, "revisit" if again else "response", keep if again else None))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "p") for r in rows], SCHEMA).repartition(3)


def test_round_trip(spark):
    rows = made()
    got = archived_pages(pages(spark, rows)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
    assert archived_pages(pages(spark, rows).limit(0)).count() == 0


def test_payloads_and_predicates(spark, tmp_path):
    rows = made()
    records = page_records(pages(spark, rows))
    write_archives(records, f"file://{tmp_path}/w", file_bytes=50_000)
    whole = read_archives(spark, f"file://{tmp_path}/w")
    want = sorted(repr((r.record_id, bytes(r.payload or b""))) for r in records.collect())
    assert sorted(repr((r.record_id, bytes(r.payload))) for r in whole.collect()) == want
    assert whole.rdd.getNumPartitions() > 3
    some = whole.filter((F.col("record_type") == "revisit") & F.col("record_id").isin("<urn:x-page:1>", "<urn:x-page:2>"))
    assert "revisit" not in some._jdf.queryExecution().executedPlan().toString().split("Filter")[0] or some.count() <= 2
    assert {r.record_id for r in some.collect()} <= {"<urn:x-page:1>", "<urn:x-page:2>"}
    assert read_archives(spark, f"file://{tmp_path}/w", payload=False).filter("payload is not null").count() == 0
    assert read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_foreign_archives():
    blocks = [b"a" * 5, b"", b"\r\n\r\nWARC/1.0\r\n\r\n", bytes(range(256)) * 300]
    plain = b"".join(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n" % (i, len(b)) + b + b"\r\n\r\n" for i, b in enumerate(blocks))
    parts = [b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n" % (i, len(b)) + b + b"\r\n\r\n" for i, b in enumerate(blocks)]
    packed = gzip.compress
    in_one = [packed(plain), packed(parts[0] + parts[1]) + packed(parts[2] + parts[3]), packed(parts[0]) + packed(parts[1] + parts[2] + b"\r\n") + packed(parts[3])]
    for data in (plain, b"".join(map(packed, parts)), *in_one):
        got = list(read_records(io.BytesIO(data), lambda r: True, True))
        assert [r[-1] for r in got] == blocks and [r[0] for r in got] == ["<0>", "<1>", "<2>", "<3>"]
        assert [r[0] for r in read_records(io.BytesIO(data), lambda r: r["record_id"] == "<2>", False)] == ["<2>"]


def test_header_lines_stay_lines():
    record = format_record({"record_type": "response", "target_uri": "a\r\nWARC-Type: revisit"}, b"x")
    assert next(read_records(io.BytesIO(record), lambda r: True, True))[1] == "response"


def test_unwanted_members_are_passed_over_in_flat_memory():
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n"
    body = random.Random(1).randbytes(1 << 20) * 64
    record = lambda i, b: head % (i, len(b)) + b + b"\r\n\r\n"
    data = gzip.compress(record(1, body), 1) + gzip.compress(record(2, body[:9]) + record(3, b"x"))
    file = io.BytesIO(data)
    tracemalloc.start()
    start = time.process_time()
    got = [(r[0], r[-1]) for r in read_records(file, lambda r: r["record_id"] != "<1>", True)]
    spent, most = time.process_time() - start, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [("<2>", body[:9]), ("<3>", b"x")]
    assert spent < 4 and most < 8 << 20
