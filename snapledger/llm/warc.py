"""WARC records in Zstandard archives with a shared dictionary.

An archive is a skippable frame that holds the dictionary, then one frame for each record, so any record can be
decoded by itself. Pages with equal payloads are stored once: the record with the largest id is the response, the
others are revisits that refer to it. Archives are rows of bytes: Spark writes and reads them as tables in whatever
store it reaches, and ``data`` of a row is a complete .warc.zst file.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, kept, least_hashed

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
DICTIONARY = 0xEC30A437
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of fewer bytes are always stored.
LEAST = 1000
#: An archive is closed when it holds so many bytes.
ARCHIVE_BYTES = 8 << 20
#: Pages, those with the least hashes, on which the dictionary is trained, bytes of each, and the dictionary's size.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 16 << 10, 32 << 10
#: A compressed dictionary without a stated size may have so many bytes.
MAX_DICTIONARY_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or record that isn't well formed."""


def record(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """One record; Content-Length is added."""
    lines = [VERSION]
    for name, value in [*headers, ("Content-Length", str(len(block)))]:
        if any(c in name + value for c in "\r\n\x00"):
            raise WarcError(f"a line break in header {name}")
        lines.append(f"{name}: {value}".encode())
    return b"\r\n".join([*lines, b"", block, b"", b""])


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, with lower-cased names, and block of one record; all that it says of itself is checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("the headers don't end")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise WarcError(f"not a {VERSION.decode()} record")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip() or name.lower() in headers:
            raise WarcError(f"a bad header line: {line[:80]!r}")
        headers[name.lower()] = value.strip(" \t")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    length = headers["content-length"]
    if not length.isascii() or not length.isdigit():
        raise WarcError("Content-Length isn't a number")
    if len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}, but the block has {len(rest) - 4} bytes")
    return headers, rest[:-4]


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary; where there is too little to train on, the samples themselves serve as one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionary_of(content: bytes, limit: int = MAX_DICTIONARY_BYTES) -> bytes:
    """The dictionary that a leading skippable frame holds, as it is or as a Zstandard frame of its own."""
    if len(content) < 4 or struct.unpack_from("<I", content)[0] != FRAME:
        return content
    try:
        return zstandard.ZstdDecompressor().decompress(content, max_output_size=limit)
    except zstandard.ZstdError as e:
        raise WarcError(f"the dictionary's frame: {e}") from e


def _loaded(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    if not dictionary:
        return None
    full = len(dictionary) >= 8 and struct.unpack("<I", dictionary[:4])[0] == DICTIONARY
    return zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Builds archives of about ``limit`` bytes."""

    def __init__(self, dictionary: bytes, limit: int = ARCHIVE_BYTES, level: int = 3, pack: bool = False):
        """pack: the dictionary is compressed too; so is one that would be taken for a frame otherwise."""
        pack = pack or dictionary[:4] == struct.pack("<I", FRAME)
        content = zstandard.ZstdCompressor(level=level).compress(dictionary) if pack else dictionary
        self.lead = struct.pack("<II", SKIPPABLE, len(content)) + content
        self.limit = limit
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=_loaded(dictionary), write_checksum=True, write_content_size=True)
        self.parts, self.size = [self.lead], 0

    def add(self, data: bytes) -> bytes | None:
        """Add a record; gives the finished archive when this fills it."""
        frame = self.compressor.compress(data)
        self.parts.append(frame)
        self.size += len(frame)
        return self.finish() if self.size >= self.limit else None

    def finish(self) -> bytes | None:
        """The archive, or None if it has no record."""
        out = b"".join(self.parts) if self.size else None
        self.parts, self.size = [self.lead], 0
        return out


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, by the headers of its blocks."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise WarcError("not a Zstandard frame")
    checksum = data[at + 4] & 4
    end = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    last = 0
    while not last:
        if end + 3 > len(data):
            raise WarcError("a frame is cut off")
        block = data[end] | data[end + 1] << 8 | data[end + 2] << 16
        last, kind = block & 1, block >> 1 & 3
        end += 3 + (1 if kind == 1 else block >> 3)
    end += 4 if checksum else 0
    if end > len(data):
        raise WarcError("a frame is cut off")
    return end


def read_archive(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, in order. The dictionary comes from the leading skippable frame."""
    data = memoryview(archive)
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        raise WarcError("no leading skippable frame")
    at = 8 + struct.unpack_from("<I", data, 4)[0]
    if at > len(data):
        raise WarcError("the dictionary is cut off")
    decompressor = zstandard.ZstdDecompressor(dict_data=_loaded(dictionary_of(bytes(data[8:at]))))
    while at < len(data):
        end = frame_end(data, at)
        try:
            yield decompressor.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(str(e)) from e
        at = end


def _uri(url: str) -> str:
    return "".join(f"%{b:02X}" if b <= 0x20 or b == 0x25 or b == 0x7F else chr(b) for b in url.encode()).encode("latin-1").decode()


def _url(uri: str) -> str:
    from urllib.parse import unquote

    return unquote(uri, errors="strict")


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = lambda i: f"<urn:page:{i}>"
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name("" if page_id is None else page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", _uri(url)))
    if refers_to is not None:
        headers += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    return record(headers, payload if refers_to is None else b"")


def read_page(data: bytes) -> dict:
    """A page's record as a row; a response's payload must have the length and digest that its headers give."""
    headers, block = parse(data)
    number = lambda s: int(s[len("<urn:page:") : -1]) if s and s != "<urn:page:>" else None
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    length = int(headers.get("warc-payload-length", -1))
    if kind == "response":
        if length != len(block) or hashlib.sha1(block).hexdigest() != digest:
            raise WarcError(f"the payload of {headers['warc-record-id']} isn't what its headers say")
    elif kind != "revisit" or block or "warc-refers-to" not in headers:
        raise WarcError(f"{headers['warc-record-id']} is neither a response nor a well-formed revisit")
    url = headers.get("warc-target-uri")
    return {
        "page_id": number(headers["warc-record-id"]), "url": None if url is None else _url(url), "payload_bytes": length, "payload_digest": digest,
        "record_type": kind, "refers_to": number(headers.get("warc-refers-to", "")), "payload": block if kind == "response" else None,
    }


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all pages, as a table in the shared folder: ``n_records``, ``data``.

    Null html is an empty payload; null urls have no URI. Of rows with equal payloads of at least ``least`` bytes, those
    with the largest id are responses (repeated rows all are), the others refer to that id. Only ids and digests are shuffled to find
    them; html stays where it was read. Other columns are ignored; no pages give no archives.
    """
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= least).select("page_id", "digest")
    last = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    pair = F.concat_ws(":", "digest", F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("_pair")
    again = large.join(last, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
    again = kept(again.select(pair, "refers_to").distinct(), "revisits")
    marked = join_small(rows.withColumn("_pair", pair), again, "_pair", salts=1)
    sample = least_hashed(rows.select("page_id", F.substring("payload", 1, SAMPLE_BYTES).alias("payload")), "page_id", SAMPLE).select("payload").collect()
    dictionary = train(sorted(bytes(r[0]) for r in sample if r[0]))

    def write(batches):
        archive = lambda n, data: pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["n_records", "data"])
        writer, n = Writer(dictionary, archive_bytes), 0
        for batch in batches:
            for k in range(batch.num_rows):  # one page at a time; ids stay whole numbers beside nulls
                page, url_, payload_, digest, to = (column[k].as_py() for column in batch.columns)
                n += 1
                if data := writer.add(page_record(page, url_, payload_, digest, to)):
                    yield archive(n, data)
                    n = 0
        if data := writer.finish():
            yield archive(n, data)

    chosen = marked.select(F.col("page_id"), "url", "payload", "digest", "refers_to")
    return kept(chosen.mapInArrow(write, "n_records long, data binary"), "warc")


def read(archives: DataFrame, payload: bool = False) -> DataFrame:
    """All records of archives (column ``data``), checked: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for (null for revisits)."""
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    block = 500

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload

    def rows(batches):
        def out(some: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([page[c] for page in some], t) for c, t in zip(columns, types, strict=True)], columns)

        for batch in batches:
            for data in batch.column(0):
                some: list[dict] = []
                for item in read_archive(data.as_py()):
                    page = read_page(item)
                    some.append({c: page[c] for c in columns})
                    if len(some) == block:
                        yield out(some)
                        some = []
                if some:
                    yield out(some)

    return archives.select("data").mapInArrow(rows, schema)


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(strlen(html) as bigint) as n, sha1(html) as h from p),
m as (select *, max(page_id) over (partition by h) as last from d)
select page_id, n as payload_bytes, h as payload_digest, case when n >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
 case when n >= 1000 and page_id <> last then last end as refers_to from m
"""
