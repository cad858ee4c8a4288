"""Operators over pages against plain Python."""

import gzip
import hashlib
import random
import re
from collections import Counter

import pytest
from skeinframe.llm import url_filter, warc

PAGES = "page_id long, url string, html string, key string, digest string, offset long"


def pages():
    r = random.Random(5)
    big = ["<p>" + "x" * n + "é</p>" for n in (93, 94, 120, 5000)]
    hosts = ["a.example.org", "EXAMPLE.com", "b.example.com:8080", "x.net"]
    rows = [(i, f"http://{r.choice(hosts)}/{r.choice(['en', 'es', 'fr', 'de'])}/{r.randint(1, 12)}?q={r.randint(1, 3)}#f", r.choice([*big, f"unique {i}", None, ""])) for i in range(80)]
    rows += [(-3, "ftp://x", big[2]), (None, None, big[3]), (None, "http://only/null", "n" * 200), (7, rows[7][1], rows[7][2]), (90, "no scheme", "a" * 99), (91, "http://x.net", "a" * 99), (92, "http://h w.com/a b\nc", "a" * 100), (93, "", "a" * 100)]
    return [(*x, "k", "d", 1) for x in rows]


def test_warc_round_trip(spark):
    rows = pages()
    table = spark.createDataFrame(rows, PAGES).repartition(3)
    found = warc.archive_pages(spark, table, payload=True, shards=3).collect()
    first = {}
    for i, _, h, *_ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        lead = first.get(h or "")
        revisits = len(data) >= 100 and lead is not None and lead != i
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisits else "response", lead if revisits else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want
    for r in found:
        assert r.payload is None if r.record_type == "revisit" else hashlib.sha256(r.payload).hexdigest() == r.payload_digest


def test_warc_lookup_of_some_keys(spark, tmp_path):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(i, f"http://h{i % 7}.org/p{i % 5}", f"page {i}") for i in range(300)], "page_id long, url string, html string").repartition(4)
    folder = f"file://{tmp_path}/w"
    captures = warc.write_archives(table, folder).persist()
    index = warc.write_index(captures, folder, 5, block_lines=8).persist()
    assert index.agg(F.sum("lines")).first()[0] == 300
    keys = table.where("page_id % 11 = 0").select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    keys = keys.unionByName(spark.createDataFrame([("zzz)/ 000",), ("",), ("org,h3)/p1",)], "key string"))
    found = warc.read_records(warc.lookup(keys, folder, index, 3), folder)
    assert sorted((r.page_id, bytes(r.payload)) for r in found.collect()) == [(i, f"page {i}".encode()) for i in range(0, 300, 11)]
    archive = next(tmp_path.glob("w/part-*.warc.gz"))
    assert gzip.decompress(archive.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_warc_empty_table(spark):
    assert warc.archive_pages(spark, spark.createDataFrame([], PAGES)).count() == 0


def plain_judge(url, rules, default):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group().translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest).group()) :]).group()
    fits = [(h.count("."), len(p), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3], best[4]) if best else (host, path, None, default)


@pytest.mark.parametrize("default", ["allow", "block"])
def test_url_filter(spark, default):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "b.example.com:8080", "/"), ("allow", "net", "/x"), ("block", "net", "/x"), ("block", "paths", "/")]
    urls = [u for _, u, *_ in pages()] + ["http://org", "http://org/", "https://ORG/x", "x://example.org/en/1", "x://a.example.org/en/12/3", "x://example.org/en/2", "x://notexample.org/es/", "x://.org/a", "http://a.net/xyz", "http://e.com/fr", "http://e.com/fr/?a=/de/", "http://e.com?/de/", "://com/de/#", "http://rules.paths/a", "http:///de/"]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)]
    found = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, rule string"), rules, default).collect()
    assert {r.page_id: tuple(r)[1:] for r in found} == {i: plain_judge(u, rules, default) for i, u, *_ in rows}
    assert url_filter.judge(spark.createDataFrame([], PAGES), rules).count() == 0
