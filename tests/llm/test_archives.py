"""ARC to WARC: exact round trips, both header versions, broken input."""

import base64
import gzip
import hashlib
import random

from lexeval.llm import archives as A
from lexeval.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(pages):
    """pages: distinct (page_id, html); no repeated rows."""
    first = {}
    for p, html in pages:
        first.setdefault(html or "", []).append(p)
    out = []
    for p, html in pages:
        data, low = (html or "").encode(), min(first[html or ""], key=lambda x: (x is None, x))
        out.append((p, len(data), digest(data), "response" if p == low else "revisit", None if p == low else low))
    return sorted(out, key=repr)


def got(df):
    rows = df.collect()
    assert all(r.digest_ok for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=repr)


def fixture():
    rng = random.Random(8)
    pages = [(0, None), (1, ""), (7, "WARC/1.1\r\nWARC-Type: response\r\n\r\n x"), (3, "a\r\n\r\n\r\n\r\nb"), (4, "\n\nhttp://x 0.0.0.0 2001 text/html 5\n"),
             (5, "é\U0001f600\x00\x85"), (None, "lonely"), (8, "y" * 3_000_000)]
    pages += [(10 + i, rng.choice(["same", "Same", "<html>\n", str(i)])) for i in range(200)]
    return pages


def test_pages_round_trip(spark):
    pages = fixture()
    df = spark.createDataFrame([(p, ["http://a.b/c d\n", None, ""][i % 3], h, 1) for i, (p, h) in enumerate(pages)],
                               "page_id long, url string, html string, rid int").repartition(5)
    assert got(A.pages_round_trip(df)) == brute(pages)
    assert A.pages_round_trip(df.limit(0)).collect() == []
    twice = A.pages_round_trip(df.where("page_id = 3").union(df.where("page_id = 3"))).collect()
    assert sorted((r.record_type, r.refers_to) for r in twice) == [("response", None), ("revisit", 3)]
    least = A.pages_round_trip(df, least=5).collect()
    assert {r.record_type for r in least if r.payload_bytes < 5} == {"response"}


def test_query_on_the_given_pages(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    assert got(QUERIES["op4_warc"](spark, SF)) == brute(pages)


def arc(version, records, broken=b""):
    body = f"{version} 0 org\n{A.FIELDS[version]}\n".encode()
    tail = "" if version == 1 else "200 - - 0 f "
    out = f"filedesc://f 0.0.0.0 20010101000000 text/plain {tail}{len(body)}\n".encode() + body + b"\n"
    for url, date, block in records:
        out += f"{url} 1.2.3.4 {date} text/html {tail}{len(block)}\n".encode() + block + b"\n" + broken
    return out


def test_legacy_files_of_both_versions(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\npayload"
    records = [("http://x/with space", "1999", http), ("dns:x", "19990102030405", b"1 IN A"), ("http://z/", "99999999999999", b"\n\n")]
    src = tmp_path / "arc"
    src.mkdir()
    (src / "one.arc").write_bytes(arc(1, records))
    (src / "two.arc.gz").write_bytes(gzip.compress(arc(2, records[:1])) + gzip.compress(arc(2, records[1:])))
    (src / "bad.arc").write_bytes(arc(1, records, b"not a header line\n") + b"http://t/ 1.2.3.4 20010101000000 text/html 99\nshort")
    (src / "empty.arc").write_bytes(b"")
    rows = A.read_arc(spark, str(src)).collect()
    assert sorted(r.url for r in rows if not r.url.startswith("filedesc")) == sorted([u for u, _, _ in records] * 3 + ["http://t/"])
    by_url = {r.url: r for r in rows}
    assert by_url["http://x/with space"].date == "1999-01-01T00:00:00Z" and by_url["dns:x"].date == "1999-01-02T03:04:05Z"
    assert by_url["http://z/"].date == "1970-01-01T00:00:00Z" and by_url["http://z/"].block == b"\n\n"
    assert [r.truncated for r in rows if r.url == "http://t/"] == [True]
    assert {r.arc_version for r in rows} == {1, 2}
    A.convert(spark, str(src), str(tmp_path / "warc"), least=1)
    back = A.read_warc(spark, str(tmp_path / "warc")).collect()
    assert len(back) == len(rows) and all(r.digest_ok for r in back)
    kinds = sorted(r.record_type for r in back)
    assert kinds.count("warcinfo") == 4 and kinds.count("response") == 1 and kinds.count("revisit") == 2 and kinds.count("resource") == 7
    assert len({r.record_id for r in back}) == len(back)
    keeper = next(r for r in back if r.record_type == "response")
    assert all(r.refers_to_id == keeper.record_id and r.payload_digest == digest(b"payload") for r in back if r.record_type == "revisit")
