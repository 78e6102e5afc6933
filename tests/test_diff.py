"""The diff, the shield and retention against small models in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from snapledger.functions import domain as D
from snapledger.functions import formatting, paths
from snapledger.operators import diff, history, reuse, shield

OLD = "relative_path binary, file_id long, presence string, size_bytes long, mtime_ns long, mime_type string, content_hash binary, hash_algorithm string, metadata_from_scan_id long, deleted_in_scan_id long"
NEW = "relative_path binary, size_bytes long, mtime_ns long, mime_type string, content_hash binary, hash_algorithm string"
PATHS = [b"a", b"a/b", b"a/bc", b"ab", b"ab/c", b"\xff", b"\xff/x", b"a/b/c/d", b"q/r", b"/odd", b"a//b", b"q/"]


def above(path, errors):
    return any(e and (path == e or path.startswith(e + b"/")) for e in errors)


def model(old, new, errors):
    out = {}
    for p in {*old, *new}:
        o, n = old.get(p), new.get(p)
        bits = sum(bit for bit, k in ((1, 1), (2, 2), (4, 3), (8, 4)) if o and n and o[k] != n[k])
        if n and (not o or o[0] == "deleted"):
            out[p] = ("added", 31)
        elif n:
            out[p] = ("updated", bits) if bits else ("unchanged", 0)
        elif o[0] == "deleted":
            out[p] = ("tombstone", 0)
        else:
            out[p] = ("unreadable", 0) if above(p, errors) else ("deleted", 16)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_snapshots(spark, seed):
    r = random.Random(seed)
    pool = PATHS + [f"dir{i % 7}/f{i}".encode() for i in range(60)]
    row = lambda: (r.randrange(2), r.randrange(2), r.choice([None, "x", "y"]), bytes([r.randrange(2)]) * 32)
    old = {p: (r.choice(["present", "present", "unreadable", "deleted"]), *row()) for p in r.sample(pool, 45)}
    new = {p: (None, *(old[p][1:] if p in old and r.random() < 0.5 else row())) for p in r.sample(pool, 45)}
    said = [(p, r.choice([*D.UNREADABLE_CODES, D.NOT_FOUND, D.MOVED])) for p in r.sample([*pool, b"dir1", b"dir2", b"q", b"a/b", b""], 12)]
    bad = {p for p, c in said if c in D.UNREADABLE_CODES}
    a = spark.createDataFrame([(bytearray(p), i, v[0], *v[1:4], bytearray(v[4]), "sha256", 1, 1 if v[0] == "deleted" else None) for i, (p, v) in enumerate(old.items())], OLD)
    b = spark.createDataFrame([(bytearray(p), *v[1:4], bytearray(v[4]), "sha256") for p, v in new.items()], NEW)
    e = spark.createDataFrame([(bytearray(p), c) for p, c in said] + [(None, D.IO_ERROR)], "relative_path binary, error_code string")
    rows = diff.classified(a, b, e).cache()
    assert {bytes(x["relative_path"]): (x["class"], x["field_mask"]) for x in rows.collect()} == model(old, new, bad)
    direct = {bytes(x[0]) for x in shield.shielded_directly(a.select("relative_path"), e).collect()}
    assert direct == {bytes(x[0]) for x in shield.shielded(a.select("relative_path"), e).collect()} == {p for p in old if above(p, bad)}
    files = diff.numbered(diff.next_files(rows, 2), 1000).collect()
    assert len({x["file_id"] for x in files}) == len(files) == len({*old, *new})
    for x in files:
        kind = model(old, new, bad)[bytes(x["relative_path"])][0]
        assert x["presence"] == {"tombstone": "deleted", "deleted": "deleted", "unreadable": "unreadable"}.get(kind, "present")
        assert (x["deleted_in_scan_id"] is not None) == (x["presence"] == "deleted")
    s = diff.summary(rows).first()
    assert s["added_count"] + s["updated_count"] + s["unchanged_count"] == s["staged_files"] == len(new)


def test_path_columns(spark):
    cases = {
        b"a/b/c.txt": ("a/b", "c.txt", "txt"), b"c.txt": (None, "c.txt", "txt"), b".bashrc": (None, ".bashrc", None), b"trailing.": (None, "trailing.", None), b"none": (None, "none", None), b"a.TXT": (None, "a.TXT", "txt"),
        b"a.tar.gz": (None, "a.tar.gz", "gz"), b"x/y.png": ("x", "y.png", "png"), b"x/y.\xc3\x89X": ("x", "y.ÉX", "Éx"), b"dir/bad\xff.txt": ("dir", "bad�.txt", "txt"), b"n\nl/x.y\nz": ("n\nl", "x.y\nz", "y\nz"),
    }
    df = spark.createDataFrame([(bytearray(p),) for p in cases], "relative_path binary")
    got = {bytes(r["relative_path"]): (r["parent_path"], r["name"], r["extension"]) for r in paths.described(df).collect()}
    assert got == cases
    mime = {bytes(r["relative_path"]): (r["mime_type"], r["mime_source"]) for r in paths.described(df).collect()}
    assert mime[b"x/y.png"] == ("image/png", "extension") and mime[b"none"] == (None, "unknown")


def test_formatting(spark):
    sizes = [0, 1, 1023, 1024, 1536, 1280, 1792, 10**6, 10**9, 10**12, 10**15, 2**62]
    df = spark.createDataFrame([(s,) for s in sizes], "n long")
    assert [r[0] for r in df.select(formatting.human(F.col("n"))).collect()] == [formatting.human_text(s) for s in sizes]
    assert [formatting.human_text(s) for s in (1280, 1792, 1023, 1 << 40)] == ["1.2 KiB", "1.8 KiB", "1023 B", "1.0 TiB"]
    ages = [-5, 0, 89 * 10**9, 90 * 10**9, 5399 * 10**9, 5400 * 10**9, 172_799 * 10**9, 172_800 * 10**9, 10**17]
    df = spark.createDataFrame([(10**18 - a,) for a in ages], "t long")
    assert [r[0] for r in df.select(formatting.ago(F.col("t"), F.lit(10**18))).collect()] == [formatting.ago_text(10**18 - a, 10**18) for a in ages]


def test_retention(spark):
    scans = spark.createDataFrame([(i, i % 2, "complete" if i % 3 else "partial") for i in range(20)], "scan_id long, base_id long, status string")
    bases = spark.createDataFrame([(0, 16), (1, 19), (2, None)], "base_id long, last_complete_scan_id long")
    assert sorted(map(tuple, history.cutoffs(scans, bases, 3).collect())) == [(0, 10), (1, 13), (2, None)]
    assert [r["cutoff"] for r in history.cutoffs(scans, bases, 0).collect()] == [None] * 3
    assert [r["cutoff"] for r in history.cutoffs(scans, bases, 50).collect()] == [None] * 3


def test_latest_chunk_wins(spark):
    df = spark.createDataFrame([(bytearray(b"a"), 1, 0), (bytearray(b"a"), 2, 3), (bytearray(b"b"), 5, 1)], "relative_path binary, size_bytes long, k int")
    assert {bytes(r["relative_path"]): r["size_bytes"] for r in reuse.latest_staged(df, "k").collect()} == {b"a": 2, b"b": 5}
