"""Two snapshots of rows as a catalogue sees them, made from the tables: what the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domain as D

#: The scan whose result is the baseline, and the one that is staged.
BASELINE_SCAN, SCAN, BASE = 1, 2, 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, hidden: bool = False) -> DataFrame:
    """Documents as files: path, text, time, type, and the class of mutation they undergo."""
    i = F.col("doc_id")
    fifth = i % 5
    end = F.when(fifth == 0, ".txt").when(fifth == 1, ".html").when(fifth == 2, ".PNG").when(fifth == 3, ".zzzzz").otherwise("")
    name = F.concat(F.when((i % 17 == 0) & F.lit(hidden), ".").otherwise(""), i.cast("string"), end)
    path = F.concat(F.when((i % 23 == 0) & F.lit(hidden), ".").otherwise(""), "source", F.lit("/"), "lang", F.lit("/"), name)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr("(doc_id div 20) % 10").alias("c"),
        path.cast("binary").alias("relative_path"),
        "text",
        (F.lit(1_700_000_000_000_000_000) + i * 1_000_003).alias("mtime_ns"),
        F.when(fifth == 0, "text/plain").when(fifth == 1, "text/html").when(fifth == 2, "image/png").alias("mime_type"),
    )


def _content(text, mtime, mime) -> list:
    return [
        F.octet_length(text).cast("long").alias("size_bytes"), mtime.alias("mtime_ns"), F.lit(None).cast("long").alias("created_ns"), mime.alias("mime_type"),
        F.when(mime.isNotNull(), "extension").otherwise("unknown").alias("mime_source"), F.lit(D.HASH_ALGORITHM).alias("hash_algorithm"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("content_hash"), F.lit(D.HASH_COMPLETE).alias("hash_status"),
    ]


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last complete scan left: present, unreadable and deleted rows."""
    d, c = documents(spark, sf_dir).filter("c <> 0"), F.col("c")
    presence = F.when(c.isin(6, 7), D.DELETED).when(c.isin(5, 8), D.UNREADABLE).otherwise(D.PRESENT)
    return d.select(
        F.col("doc_id").alias("file_id"), F.lit(BASE).cast("long").alias("base_id"), "relative_path", presence.alias("presence"), *_content(F.col("text"), F.col("mtime_ns"), F.col("mime_type")),
        F.lit(BASELINE_SCAN).cast("long").alias("metadata_from_scan_id"), F.when(c.isin(6, 7), F.lit(BASELINE_SCAN)).cast("long").alias("deleted_in_scan_id"),
    )


def staged(spark: SparkSession, sf_dir: str, hidden: bool = False) -> DataFrame:
    """What the next scan sees."""
    d, c = documents(spark, sf_dir, hidden).filter(~F.col("c").isin(3, 7, 8)), F.col("c")
    text = F.when(c == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    mtime = F.when(c == 2, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns"))
    return d.select("relative_path", *_content(text, mtime, F.when(c != 4, F.col("mime_type"))))


def errors(spark: SparkSession, sf_dir: str, base: bool = False) -> DataFrame:
    """Two unreadable directories, one that vanished, one unreadable file; and, if asked for, the base."""
    said = [("src1", D.NO_PERMISSION), ("src2/en", D.IO_ERROR), ("src4", D.NOT_FOUND)] + [("", D.NOT_FOUND)] * base
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(p).cast("binary").alias("relative_path"), F.lit(c).alias("error_code")) for p, c in said])).alias("e")).select("e.*")
    one = documents(spark, sf_dir).filter("doc_id = 67").select("relative_path", F.lit(D.NO_PERMISSION).alias("error_code"))
    return rows.unionByName(one)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scans of one base for each user."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", D.COMPLETE).when(kind == "click", D.CANCELLED).when(kind == "view", D.PARTIAL).when(kind == "error", D.FAILED).otherwise(D.RUNNING)
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("scan_id"), F.col("user_id").alias("base_id"), status.alias("status"), start.alias("started_at_ns"), (start + 1_000_000).alias("finished_at_ns"), (F.col("event_id") % 1000).alias("present_count")
    )


def ledger_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max(F.when(F.col("status") == D.COMPLETE, F.col("scan_id")))
    bases = ledger(spark, sf_dir).groupBy("base_id").agg(last.alias("last_complete_scan_id"))
    return bases.withColumn("base_path", F.concat(F.lit("/data/"), F.col("base_id").cast("string")))


def ledger_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file row for each scan: every third deleted in it, every fifth of the rest unreadable."""
    i = F.col("scan_id")
    presence = F.when(i % 3 == 0, D.DELETED).when(i % 5 == 0, D.UNREADABLE).otherwise(D.PRESENT)
    return ledger(spark, sf_dir).select("base_id", i.alias("file_id"), presence.alias("presence"), F.when(i % 3 == 0, i).alias("deleted_in_scan_id"))


def orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as a baseline and a scan on a wide space of keys."""
    m = F.col("o_orderkey") % 10
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").cast("binary").alias("relative_path"), m.alias("m"), (F.col("o_totalprice") * 100).cast("long").alias("size_bytes"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("mtime_ns"), F.col("o_orderpriority").alias("mime_type"), F.unhex(F.sha2(F.col("o_orderstatus").cast("binary"), 256)).alias("content_hash"),
    )
    old = rows.filter("m <> 0").select("relative_path", F.lit(D.PRESENT).alias("presence"), "size_bytes", "mtime_ns", "mime_type", "content_hash")
    new = rows.filter("m <> 3").select(
        "relative_path", (F.col("size_bytes") + F.when(F.col("m") == 1, 1).otherwise(0)).alias("size_bytes"), (F.col("mtime_ns") + F.when(F.col("m") == 2, 1).otherwise(0)).alias("mtime_ns"), F.when(F.col("m") != 4, F.col("mime_type")).alias("mime_type"), "content_hash"
    )
    return old, new


#: The same in DuckDB: d documents, b baseline, s scan, e errors, u shielded baseline paths, j classified paths.
SQL = """with d as (select doc_id, (doc_id // 20) % 10 as c, source || '/' || lang || '/' || doc_id || case doc_id % 5 when 0 then '.txt' when 1 then '.html' when 2 then '.PNG' when 3 then '.zzzzz' else '' end as p, text,
 1700000000000000000 + doc_id * 1000003 as mt, case doc_id % 5 when 0 then 'text/plain' when 1 then 'text/html' when 2 then 'image/png' end as mime from documents),
b as (select doc_id as file_id, p, cast(strlen(text) as bigint) as sz, mt, mime, upper(sha256(text)) as h, case when c in (6, 7) then 'deleted' when c in (5, 8) then 'unreadable' else 'present' end as presence, c from d where c <> 0),
s as (select p, cast(strlen(t) as bigint) as sz, mt, mime, upper(sha256(t)) as h from (select p, case when c = 1 then text || '!' else text end as t, case when c = 2 then mt + 1 else mt end as mt, case when c <> 4 then mime end as mime from d where c not in (3, 7, 8))),
e as (select 'src1' as p, 'permission_denied' as code union all select 'src2/en', 'io_error' union all select 'src4', 'not_found' union all select p, 'permission_denied' from d where doc_id = 67),
u as (select p from b where exists (select 1 from e where code in ('permission_denied', 'io_error', 'invalid_data', 'resource_exhausted') and (b.p = e.p or starts_with(b.p, e.p || '/')))),
j as (select coalesce(s.p, b.p) as p, b.file_id, b.sz as osz, s.sz as nsz, b.mt as omt, s.mt as nmt, b.mime as omime, s.mime as nmime, b.h as oh, s.h as nh, b.presence, s.p is not null as here, b.p is not null as known,
 case when s.p is not null and b.p is not null and b.presence <> 'deleted' then (case when b.sz <> s.sz then 1 else 0 end) + (case when b.mt <> s.mt then 2 else 0 end) + (case when b.mime is distinct from s.mime then 4 else 0 end) + (case when b.h <> s.h then 8 else 0 end) end as m,
 u.p is not null as held from b full outer join s on b.p = s.p left join u on b.p = u.p),
k as (select *, case when here and (not known or presence = 'deleted') then 'added' when here and m <> 0 then 'updated' when here then 'unchanged' when presence = 'deleted' then 'tombstone' when held then 'unreadable' else 'deleted' end as class from j),
l as (select *, cast(case class when 'added' then 31 when 'deleted' then 16 else coalesce(m, 0) end as bigint) as mask from k)
"""
LEDGER_SQL = """with l as (select event_id as scan_id, user_id as base_id, case event_type when 'purchase' then 'complete' when 'click' then 'cancelled' when 'view' then 'partial' when 'error' then 'failed' else 'running' end as status,
 epoch_us(ts) * 1000 as started_at_ns, epoch_us(ts) * 1000 + 1000000 as finished_at_ns, event_id % 1000 as present_count from events),
ba as (select base_id, max(case when status = 'complete' then scan_id end) as last_complete_scan_id, '/data/' || base_id as base_path from l group by base_id),
kth as (select base_id, scan_id as k from l where status = 'complete' qualify row_number() over (partition by base_id order by scan_id desc) = 3),
cut as (select ba.base_id, case when k is not null then least(k, last_complete_scan_id) end as cutoff from ba left join kth using (base_id)),
fi as (select base_id, scan_id as file_id, case when scan_id % 3 = 0 then 'deleted' when scan_id % 5 = 0 then 'unreadable' else 'present' end as presence, case when scan_id % 3 = 0 then scan_id end as deleted_in_scan_id from l)
"""
