"""URL filters and WARC archives: plain Python versions, odd rows and broken files."""

import hashlib
import random
import struct

import numpy as np
import pytest

from snapledger.llm import bloom, queries, urls, warc

# urls


def judged(url, rules, exact, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), False, v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    fits += [(len(h + p), True, v, h + p) for h, p, v in exact if (host, path) == (h, p)]
    if not fits:
        return host, path, None, default, False
    n, is_exact, verdict, entry = max(fits)
    return host, path, None if is_exact else entry, verdict, is_exact


@pytest.mark.parametrize("max_bytes", [bloom.MAX_BYTES, 2048])
def test_judge(spark, max_bytes):
    r = random.Random(1)
    hosts = ["com", "x.com", "EXAMPLE.com", "a.example.com", "notexample.com", "example.net", "b.example.net:80", "org.", "", ".com", "é.org", "u@x.org"]
    given = ["/", "", "/en/", "/en/7", "/en/70?x=/de/", "/de/8#a", "/es", "/es/é", "/a\nb"]
    rows = [(i, f"{r.choice(['http', 'https', ''])}://{r.choice(hosts)}{r.choice(given)}{r.choice(['', '?q=1://z', '#://f'])}") for i in range(400)]
    rows += [(900, None), (901, ""), (902, "no scheme/en/"), (903, "a://b://com/en/"), (3, rows[5][1]), (3, rows[5][1])] + [(1000 + i, "http://x.com/en/1") for i in range(200)]
    rules = [*urls.RULES, ("com", "", "allow"), ("x.com", "/", "block"), ("example.com", "/en/7", "block")]
    exact = [("x.com", "/en/7", "allow"), ("example.net", "", "block")]
    df = spark.createDataFrame([(k, u, "clash", "clash") for k, u in rows], "page_id long, url string, host string, _best string").repartition(3)
    got = urls.judge(df, urls.entries(spark, rules, exact), max_bytes=max_bytes)
    wanted = sorted(((k, u, *judged(u, rules, exact)) for k, u in rows), key=str)
    assert sorted((tuple(x) for x in got.select("page_id", "url", "host", "path", "rule", "verdict", "listed").collect()), key=str) == wanted


def test_very_long_urls(spark):
    """A megabyte of labels, of path, of both: judged in seconds, against rules of many lengths."""
    many = "http://" + "a." * 500_000 + "example.com" + "/en/7" + "x/" * 250_000
    rows = [(1, many), (2, many + "?q"), (3, "http://" + "é." * 200_000 + "net"), (4, "http://com/" + "y" * 1_000_000), (5, "://" + "." * 300_000)]
    rules = [*urls.RULES, ("a.a.example.com", "/en", "block"), *[("com", "/" + "y" * n, "block") for n in range(300)]]
    exact = [("com", "/" + "y" * 1_000_000, "allow")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge(df, urls.entries(spark, rules, exact)).select("page_id", "url", "host", "path", "rule", "verdict", "listed").collect()
    assert sorted(map(tuple, got)) == sorted((k, u, *judged(u, rules, exact)) for k, u in rows)


def test_pages_meet_listed_urls(spark):
    got = queries.op1_url_filter(spark, "/root/testdata/sf0.1").filter("listed").collect()
    assert got and all(x["rule"] is None and x["verdict"] == "block" for x in got)


def test_empty_list_and_no_pages(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string, exact boolean")
    assert [(x["host"], x["verdict"], x["rule"]) for x in urls.judge(df, none).collect()] == [("a.com", "allow", None)]
    assert urls.judge(df.limit(0), urls.entries(spark)).collect() == []


def test_bloom_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    blocks = bloom.blocks_for(10_000)
    filter_ = np.zeros((blocks, bloom.WORDS), np.uint32)
    bloom.add(filter_, h[:10_000], 0, blocks)
    assert bloom.contains(filter_, h[:10_000]).all() and bloom.contains(filter_, h[10_000:]).mean() < 0.01


# archives

PAGES = "page_id long, url string, html string, payload string, digest string, refers_to string"


def test_archives_round_trip(spark):
    r = random.Random(5)
    long_ = "ü" * 500
    rows = [(i, f"http://x/{i}", "".join(r.choices("abc <>\n\r é", k=r.choice([0, 10, 999, 1000, 5000])))) for i in range(120)]
    rows += [(i, "http://copy/%20 \r\nHost: evil", long_) for i in range(300, 340)] + [(i, None, "short copy") for i in range(400, 410)]
    rows += [(500, "u", None), (501, "u", ""), (None, "n", long_), (7, "again", long_), (339, "twice", long_), (502, "big", "x" * 3_000_000)]
    df = spark.createDataFrame([(*x, "c", "c", "c") for x in rows], PAGES).repartition(4)
    archives = warc.archived(df, archive_bytes=20_000)
    assert archives.count() > 4 and archives.agg({"n_records": "sum"}).first()[0] == len(rows)
    wanted = []
    for k, u, t in rows:
        data = (t or "").encode()
        last = max(x[0] for x in rows if x[2] == t and x[0] is not None)
        again = len(data) >= 1000 and k != last
        wanted.append((k, u, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None, None if again else data))
    got = [(*x[:6], None if x[6] is None else bytes(x[6])) for x in warc.read(archives, payload=True).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert warc.read(warc.archived(df.limit(0))).collect() == []


def test_large_ids_stay_exact_beside_nulls(spark):
    """Ids above 2^53 have no float of their own."""
    a = 9007199254740993
    rows = [(a, "u", "é" * 600), (a + 2, "u", "é" * 600), (None, "u", "é" * 600), (a + 4, None, None), (None, None, "x"), (a + 6, "u", "y" * 2000)]
    df = spark.createDataFrame([(*x, "c", "c", "c") for x in rows], PAGES).coalesce(1)
    got = sorted(((x["page_id"], x["refers_to"], x["record_type"]) for x in warc.read(warc.archived(df)).collect()), key=str)
    assert got == sorted([(a, a + 2, "revisit"), (a + 2, None, "response"), (None, a + 2, "revisit"), (a + 4, None, "response"), (None, None, "response"), (a + 6, None, "response")], key=str)


def test_compressed_dictionaries_are_read():
    samples = [b"<html><body>page %d of many pages</body></html>" % i * 20 for i in range(60)]
    for dictionary in (warc.train(samples, 4096), b"raw <html><body>page", b"\x28\xb5\x2f\xfd looks like a frame"):
        w = warc.Writer(dictionary, pack=True)
        for s in samples:
            w.add(s)
        data = w.finish()
        assert struct.unpack("<I", data[8:12])[0] == warc.FRAME and list(warc.read_archive(data)) == samples
    w = warc.Writer(b"\x28\xb5\x2f\xfd looks like a frame")
    w.add(samples[0])
    assert list(warc.read_archive(w.finish())) == samples[:1]
    with pytest.raises(warc.WarcError):
        warc.dictionary_of(b"\x28\xb5\x2f\xfd broken")


def test_broken_archives_are_refused():
    samples = [warc.page_record(i, "http://x/", b"<html>body %d</html>" % i * 40, hashlib.sha1(b"<html>body %d</html>" % i * 40).hexdigest(), None) for i in range(50)]
    for dictionary in (warc.train(samples, 4096), b"raw <html>body", b""):
        w = warc.Writer(dictionary)
        for s in samples:
            assert w.add(s) is None
        data = w.finish()
        assert list(warc.read_archive(data)) == samples and w.finish() is None
        assert struct.unpack("<II", data[:8]) == (0x184D2A5D, len(dictionary)) and data[8 : 8 + len(dictionary)] == dictionary
        for bad in (data[:-1], data[:-5], data[1:], b"", data[: 8 + len(dictionary) - 1] if dictionary else b"x", data + b"junk"):
            with pytest.raises(warc.WarcError):
                list(warc.read_archive(bad))
        if dictionary:
            flipped = bytearray(data)
            flipped[len(data) - 20] ^= 0xFF
            with pytest.raises(warc.WarcError):
                list(warc.read_archive(bytes(flipped)))


def test_bad_records_are_refused():
    good = warc.page_record(1, "u", b"body", hashlib.sha1(b"body").hexdigest(), None)
    assert warc.read_page(good)["payload"] == b"body"
    for bad in (
        good.replace(b"WARC/1.1", b"WARC/0.9"), good.replace(b"Content-Length: 4", b"Content-Length: 5"), good.replace(b"Content-Length: 4", b"Content-Length: -4"), good[:-1], good.replace(b"body", b"bodz"),
        good.replace(b"WARC-Date", b"WARC Date:"), good.replace(b"WARC-Type: response", b"WARC-Type: revisit"), good.replace(b"WARC-Payload-Length: 4", b"WARC-Payload-Length: 3"), good.replace(b"\r\n\r\n", b"\r\n", 1),
    ):
        with pytest.raises(warc.WarcError):
            warc.read_page(bad)
    with pytest.raises(warc.WarcError):
        warc.record([("X", "a\r\nY: b")], b"")


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from snapledger.llm import common

    class Session:
        def __init__(self, master, named=None):
            self.sparkContext = type("C", (), {"master": master})
            self.conf = type("F", (), {"get": staticmethod(lambda k, d: named if k == "spark.checkpoint.dir" else "file:///own"), "set": staticmethod(lambda k, v: None)})

    assert common.shared_dir(Session("local[4]")) == "file:///own" and common.shared_dir(Session("spark://x", "hdfs://shared")) == "hdfs://shared"
    for master in ("spark://x", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            common.shared_dir(Session(master))
