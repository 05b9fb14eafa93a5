"""Archives: exact round trip through the index."""

import hashlib
import random

from pyspark.sql import functions as F

from veilgraph.llm import warc


def pages(spark):
    rng = random.Random(4)
    body = ["x" * 99, "y" * 100, "é" * 60, "z" * 5000, "", None]
    hosts = ["http://www.a.example.com", "https://u@b.example.org:8080", "HTTP://A.EXAMPLE.COM", "notaurl", None]
    rows = []
    for i in range(3000):
        h = hosts[0] if i % 3 == 0 else rng.choice(hosts)
        url = h if h in (None, "notaurl") else f"{h}/p{'' if i % 3 == 0 else rng.randint(0, 50)}?q=é b#f"
        rows.append((5000 - i, url, rng.choice(body) if i % 2 else f"<p>{i}</p>" * 20))
    rows += [(None, "http://c.example/", "only one " * 30), (1, "http://c.example/x\r\nEvil: 1", "only one " * 30), (7777, "http://d.example/", "q" * 200), (7777, "http://d.example/", "q" * 200)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 50)
    rows, d = pages(spark)
    got = warc.round_trip(d).collect()
    assert len(got) == len(rows)
    least = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            least[raw] = min(i, least.get(raw, i))
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = least.get(raw) if len(raw) >= 100 else None
        revisit = first is not None and first != i
        want.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(str, want)) == sorted(str((str(r["page_id"]), *r[1:])) for r in got)


def test_keys(spark):
    urls = ["http://www.A.example.com/x?y#z", "https://u:p@b.org:8080", "ftp://h/", "plain", None, "http:///x"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u"))).collect()]
    assert got == ["com,example,a,www)/x?y", "org,b:8080)/", "h)/", "plain", "", "http:///x"]


def test_record_parses_back():
    raw = warc.record(3, "http://a/ b\r\nX: y", "<é>\r\n\r\n".encode(), "ab", None, warc.DATE)
    fields, http, payload = warc.parse(raw)
    assert payload == "<é>\r\n\r\n".encode() and fields["WARC-Target-URI"] == "http://a/%20b%0D%0AX:%20y" and raw.endswith(b"\r\n\r\n")
    fields, http, payload = warc.parse(warc.record(None, None, b"abc", "ab", 9, warc.DATE))
    assert payload == b"" and http["Content-Length"] == "3" and fields["WARC-Refers-To"] == "<urn:x-capture:9>"


def test_empty_table(spark):
    _, d = pages(spark)
    assert warc.round_trip(d.limit(0)).collect() == []
