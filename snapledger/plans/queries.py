"""The catalogue's queries over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions import formatting, paths
from ..operators import diff, history, reuse, shield, status
from . import snapshots as S
from . import trees as T

KEEP = 3
COUNTS = "discovered_files staged_files hashed_files added_count updated_count deleted_count unchanged_count present_count error_count excluded_hidden excluded_symlink unreadable_dirs".split()
POLICY = {"skip_hidden": True, "skip_mount_boundaries": True, "follow_symlinks": False}
NOW_NS = 1_800_000_000_000_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def _longs(sql: str, *columns: str) -> str:
    """SQL with these columns as bigint."""
    return f"select * replace ({', '.join(f'cast({c} as bigint) as {c}' for c in columns)}) from ({sql})"


def _text(c: str = "relative_path"):
    return F.col(c).cast("string").alias("path")


def _classified(spark, d) -> DataFrame:
    return diff.classified(S.baseline(spark, d), S.staged(spark, d), S.errors(spark, d))


def _changes(spark, d) -> DataFrame:
    return diff.change_log(_classified(spark, d))


@query(S.SQL + "select p as path, mask as field_mask, nsz as new_size_bytes, known as over_tombstone from l where class = 'added'")
def q01_added(spark, d):
    rows = _classified(spark, d).filter(F.col("class") == D.ADDED)
    return rows.select(_text(), "field_mask", F.col("new.size_bytes").alias("new_size_bytes"), F.col("old").isNotNull().alias("over_tombstone"))


@query(S.SQL + "select p as path, mask as field_mask from l where class = 'updated'")
def q02_updated_mask(spark, d):
    return _changes(spark, d).filter(F.col("change_kind") == D.UPDATED).select(_text(), "field_mask")


@query(S.SQL + "select p as path, mask as field_mask, osz as old_size_bytes from l where class = 'deleted'")
def q03_deleted(spark, d):
    return _changes(spark, d).filter(F.col("change_kind") == D.REMOVED).select(_text(), "field_mask", "old_size_bytes")


@query(S.SQL + """select p as path, class as change_kind, mask as field_mask, osz as old_size_bytes, nsz as new_size_bytes, omt as old_mtime_ns, nmt as new_mtime_ns, omime as old_mime_type, nmime as new_mime_type,
 oh as old_content_hash, nh as new_content_hash from l where class in ('added', 'updated', 'deleted')""")
def q04_change_log(spark, d):
    rows = _changes(spark, d)
    plain = [c for c in rows.columns if c not in ("relative_path", "old_content_hash", "new_content_hash")]
    return rows.select(_text(), *plain, *[F.hex(c).alias(c) for c in ("old_content_hash", "new_content_hash")])


@query(S.SQL + """, w as (select *, class in ('added', 'updated') or (class = 'unchanged' and presence = 'unreadable') as written from l),
 x as (select file_id, p as path, case when written then nsz else osz end as size_bytes, case when written then nmt else omt end as mtime_ns, case when written then nmime else omime end as mime_type, case when written then nh else oh end as content_hash,
 case when here then 'present' when class = 'unreadable' then 'unreadable' else 'deleted' end as presence, cast(case when written then 2 else 1 end as bigint) as metadata_from_scan_id,
 cast(case when class = 'deleted' then 2 when class = 'tombstone' then 1 end as bigint) as deleted_in_scan_id from w)
select coalesce(file_id, (select max(file_id) from x) + row_number() over (partition by file_id is null order by substr(md5(path), 1, 2), path)) as file_id, path, size_bytes, mtime_ns, mime_type, content_hash, presence, metadata_from_scan_id, deleted_in_scan_id from x""")
def q05_next_files(spark, d):
    files = diff.next_files(_classified(spark, d), S.SCAN)
    last = S.baseline(spark, d).agg(F.max("file_id")).first()[0]
    out = diff.numbered(files, last)
    return out.select("file_id", _text(), "size_bytes", "mtime_ns", "mime_type", F.hex("content_hash").alias("content_hash"), "presence", "metadata_from_scan_id", "deleted_in_scan_id")


@query(S.SQL + """select count(*) filter (where here) as staged_files, cast(coalesce(sum(nsz), 0) as bigint) as staged_bytes, count(*) filter (where class = 'added') as added_count, count(*) filter (where class = 'updated') as updated_count,
 count(*) filter (where class = 'deleted') as deleted_count, count(*) filter (where here) as present_count, count(*) filter (where class = 'unreadable') as unreadable_count, count(*) filter (where class = 'unchanged') as unchanged_count from l""")
def q06_scan_summary(spark, d):
    return diff.summary(_classified(spark, d))


_SHIELDED = S.SQL + "select b.p as path from b where p in (select p from u)"


@query(_SHIELDED)
def q07_shielded(spark, d):
    return shield.shielded_directly(S.baseline(spark, d).select("relative_path"), S.errors(spark, d)).select(_text())


@query(S.SQL + "select b.p as path from b where p not in (select p from u)")
def q08_not_shielded(spark, d):
    return shield.not_shielded(S.baseline(spark, d).select("relative_path"), S.errors(spark, d)).select(_text())


@query(_SHIELDED)
def q09_shield_exploded(spark, d):
    return shield.shielded(S.baseline(spark, d).select("relative_path"), S.errors(spark, d)).select(_text())


@query(S.SQL + "select count(distinct p) as n from e where code in ('permission_denied', 'io_error', 'invalid_data', 'resource_exhausted')")
def q10_unreadable_paths(spark, d):
    return shield.unreadable_count(S.errors(spark, d))


@query("select false as with_base, false as blocked union all select true, true")
def q11_base_unreadable(spark, d):
    def asked(base: bool) -> DataFrame:
        return shield.base_unread(S.errors(spark, d, base)).agg((F.count(F.lit(1)) > 0).alias("blocked")).select(F.lit(base).alias("with_base"), "blocked")

    return asked(False).unionByName(asked(True))


_STAGED_BEFORE = "st as (select p, case when file % 15 = 0 then sz + 1 else sz end as sz, mt from (select s.*, d.doc_id as file from s join d using (p)) where file % 3 = 0)"


@query(S.SQL + f""", {_STAGED_BEFORE}, r as (select s.p, s.sz, case when st.sz = s.sz and st.mt = s.mt then 'stage' when b.sz = s.sz and b.mt = s.mt then 'baseline' else 'hash' end as decision from s left join st on s.p = st.p left join b on s.p = b.p and b.presence = 'present')
select decision, count(*) as files, cast(sum(sz) as bigint) as bytes from r group by decision""")
def q12_reuse_decision(spark, d):
    seen = S.staged(spark, d)
    before = seen.join(S.documents(spark, d).select("relative_path", "doc_id"), "relative_path").filter("doc_id % 3 = 0")
    before = before.withColumn("size_bytes", F.col("size_bytes") + F.when(F.col("doc_id") % 15 == 0, 1).otherwise(0)).drop("doc_id")
    rows = reuse.decided(seen.drop("content_hash", "hash_algorithm", "hash_status"), before, S.baseline(spark, d))
    return rows.groupBy("decision").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


@query(S.SQL + "select s.p as path from s join d using (p) where d.doc_id % 7 <> 0")
def q13_drop_vanished(spark, d):
    seen = S.documents(spark, d).filter("doc_id % 7 <> 0").select("relative_path")
    return reuse.still_seen(S.staged(spark, d), seen.unionByName(seen)).select(_text())


_HELPERS = """case when strpos(p, '/') > 0 then regexp_extract(p, '(?s)^(.*)/[^/]*$', 1) end as parent_path, regexp_extract(p, '(?s)([^/]*)$', 1) as name,
 nullif(lower(regexp_extract(regexp_extract(p, '(?s)([^/]*)$', 1), '(?s)^.+[.]([^.]+)$', 1)), '') as extension"""


@query(S.SQL + f", v as (select p from d union all select url from pages) select p as path, {_HELPERS} from v")
def q14_path_helpers(spark, d):
    every = S.documents(spark, d).select("relative_path").unionByName(S.table(spark, d, "pages").select(F.col("url").cast("binary").alias("relative_path")))
    return paths.described(every).select(_text(), "parent_path", "name", "extension")


@query(S.SQL + "select p as path, case doc_id % 5 when 0 then 'text/plain' when 1 then 'text/html' when 2 then 'image/png' end as mime_type, case when doc_id % 5 < 3 then 'extension' else 'unknown' end as mime_source from d")
def q15_mime_types(spark, d):
    return paths.described(S.documents(spark, d).select("relative_path")).select(_text(), "mime_type", "mime_source")


@query(S.SQL + "select '/data/' || c || '/' || p as absolute_path from d")
def q16_absolute_path(spark, d):
    return S.documents(spark, d).select(paths.absolute(F.concat(F.lit("/data/"), F.col("c").cast("string")), F.col("relative_path")).alias("absolute_path"))


@query("select doc_id, upper(sha256(text)) as content_hash, cast(32 as integer) as hash_bytes from documents")
def q17_content_hash(spark, d):
    hashed = S.table(spark, d, "documents").select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("h"))
    return hashed.select("doc_id", F.hex("h").alias("content_hash"), F.octet_length("h").alias("hash_bytes"))


@query(S.SQL + "select file_id, '/data/1/' || p as absolute_path, sz as size_bytes, h as content_hash_hex from b where presence = 'present'")
def q18_current_files(spark, d):
    bases = spark.range(1).select(F.lit(S.BASE).cast("long").alias("base_id"), F.lit("/data/1").alias("base_path"))
    return status.current_files(paths.described(S.baseline(spark, d).drop("mime_type", "mime_source")), bases).select("file_id", "absolute_path", "size_bytes", "content_hash_hex")


@query(S.SQL + """, o as (select p, h from b where presence = 'present'), n as (select case when c = 9 then p || '.moved' else p end as p from b where presence = 'present')
select coalesce(n.p, o.p) as path, case when o.p is null then 'added' else 'deleted' end as change_kind from n full outer join o on n.p = o.p where n.p is null or o.p is null""")
def q19_rename_is_delete_and_add(spark, d):
    old = S.baseline(spark, d).filter(F.col("presence") == D.PRESENT)
    ninth = S.documents(spark, d).filter("c = 9").select("relative_path", F.lit(True).alias("m"))
    moved = F.when(F.col("m"), F.concat("relative_path", F.lit(b".moved"))).otherwise(F.col("relative_path"))
    new = old.join(ninth, "relative_path", "left").withColumn("relative_path", moved).drop("m", "presence", "file_id", "base_id", "metadata_from_scan_id", "deleted_in_scan_id")
    return diff.change_log(diff.classified(old, new)).select(_text(), "change_kind")


@query("""with d as (select (case when doc_id % 23 = 0 then '.' else '' end) || source || '/' || lang || '/' || (case when doc_id % 17 = 0 then '.' else '' end) || doc_id || case doc_id % 5 when 0 then '.txt' when 1 then '.html' when 2 then '.PNG' when 3 then '.zzzzz' else '' end as path from documents)
select path from d where not (starts_with(path, '.') or contains(path, '/.'))""")
def q20_hidden_filter(spark, d):
    return S.documents(spark, d, hidden=True).select(_text()).filter(~paths.hidden(F.col("path")))


def _limits(spark, d) -> DataFrame:
    return history.cutoffs(S.ledger(spark, d), S.ledger_bases(spark, d), KEEP)


@query(S.LEDGER_SQL + "select base_id, cutoff from cut")
def q21_cutoff(spark, d):
    return _limits(spark, d)


@query(S.LEDGER_SQL + """select cut.base_id, cutoff, (select count(*) from l where l.base_id = cut.base_id and l.scan_id < cutoff) as changes,
 (select count(*) from fi where fi.base_id = cut.base_id and presence = 'deleted' and deleted_in_scan_id < cutoff) as files from cut""")
def q22_prune_preview(spark, d):
    return history.preview(S.ledger(spark, d), S.ledger_files(spark, d), _limits(spark, d))


@query(S.LEDGER_SQL + """select 'change' as kind, l.base_id, scan_id as id from l join cut using (base_id) where cutoff is null or scan_id >= cutoff
 union all select 'file', fi.base_id, file_id from fi join cut using (base_id) where not coalesce(presence = 'deleted' and deleted_in_scan_id < cutoff, false)""")
def q23_after_prune(spark, d):
    limits = _limits(spark, d)
    changes = history.kept_changes(S.ledger(spark, d), limits).select(F.lit("change").alias("kind"), "base_id", F.col("scan_id").alias("id"))
    return changes.unionByName(history.kept_files(S.ledger_files(spark, d), limits).select(F.lit("file").alias("kind"), "base_id", F.col("file_id").alias("id")))


@query(S.LEDGER_SQL + "select base_id, scan_id, status, started_at_ns from l where status in ('running', 'cancelled', 'failed', 'partial') qualify row_number() over (partition by base_id order by scan_id desc) = 1")
def q24_resumable(spark, d):
    return status.resumable(S.ledger(spark, d))


@query(S.LEDGER_SQL + "select ba.base_id, base_path, l.scan_id as baseline_scan_id, finished_at_ns, present_count from ba left join l on l.scan_id = ba.last_complete_scan_id")
def q25_base_status(spark, d):
    return status.baselines(S.ledger_bases(spark, d), S.ledger(spark, d))


@query("""with b as (select c_custkey as base_id, c_custkey % 2 = 0 as h, c_custkey % 3 = 0 as m, c_custkey % 5 = 0 as f from customer)
select base_id, concat_ws(', ', case when not h then 'skip_hidden' end, case when not m then 'skip_mount_boundaries' end, case when f then 'follow_symlinks' end) as differs from b where not h or not m or f""")
def q26_policy_diff(spark, d):
    key = F.col("c_custkey")
    bases = S.table(spark, d, "customer").select(key.alias("base_id"), (key % 2 == 0).alias("skip_hidden"), (key % 3 == 0).alias("skip_mount_boundaries"), (key % 5 == 0).alias("follow_symlinks"))
    return status.policy_differences(bases, POLICY)


@query(S.SQL + """, f as (select p, case when here then 'present' when class = 'unreadable' then 'unreadable' else 'deleted' end as presence from l), ch as (select p, class from l where class in ('added', 'updated', 'deleted') and p not like 'src3/%')
select ch.p as path, ch.class as change_kind, f.presence from ch left join (select * from f where p not like 'src5/%') f on ch.p = f.p""")
def q27_changes_with_files(spark, d):
    rows = _classified(spark, d)
    under = lambda p: F.substring("relative_path", 1, len(p)) == F.lit(p)
    changes = diff.change_log(rows).filter(~under(b"src3/"))
    files = diff.next_files(rows, S.SCAN).filter(~under(b"src5/")).select("relative_path", "presence")
    return changes.join(files, "relative_path", "left").select(_text(), "change_kind", "presence")


_N = "n_chars * (case doc_id % 5 when 0 then 1 when 1 then 1000 when 2 then 1000000 when 3 then 1000000000 else 1000000000000 end)"


@query(f"""with n as (select doc_id, cast({_N} as bigint) as n from documents) select doc_id, n as bytes, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KiB', n / 1024.0::double)
 when n < 1073741824 then printf('%.1f MiB', n / 1048576.0::double) when n < 1099511627776 then printf('%.1f GiB', n / 1073741824.0::double) else printf('%.1f TiB', n / 1099511627776.0::double) end as human from n""")
def q28_human_bytes(spark, d):
    rows = S.table(spark, d, "documents").select("doc_id", F.expr(_N).cast("long").alias("bytes"))
    return rows.withColumn("human", formatting.human(F.col("bytes")))


@query(f"""with t as (select event_id, case event_id % 4 when 0 then epoch_us(ts) * 1000 when 1 then {NOW_NS} - event_id * 1000000000 when 2 then {NOW_NS} - event_id * 17000000000 else {NOW_NS} + event_id end as then_ns from events),
 a as (select event_id, then_ns, greatest({NOW_NS} - then_ns, 0) / 1e9 as s from t)
select event_id, case when s < 90 then printf('%.0fs', s) when s < 5400 then printf('%.0fm', s / 60) when s < 172800 then printf('%.1fh', s / 3600) else printf('%.1fd', s / 86400) end as ago from a""")
def q29_ago(spark, d):
    i = F.col("event_id")
    then = F.when(i % 4 == 0, F.unix_micros(F.col("ts").cast("timestamp")) * 1000).when(i % 4 == 1, F.lit(NOW_NS) - i * 1_000_000_000).when(i % 4 == 2, F.lit(NOW_NS) - i * 17_000_000_000).otherwise(F.lit(NOW_NS) + i)
    return S.table(spark, d, "events").select("event_id", formatting.ago(then, F.lit(NOW_NS)).alias("ago"))


@query("""with r as (select o_orderkey as k, o_orderkey % 10 as m, o_orderpriority as p from orders) select case when m = 0 then 'added' when m = 3 then 'deleted' when m in (1, 2) or (m = 4 and p is not null) then 'updated' else 'unchanged' end as class,
 cast(case when m = 0 then 31 when m = 3 then 16 when m = 1 then 1 when m = 2 then 2 when m = 4 and p is not null then 4 else 0 end as bigint) as field_mask, count(*) as n from r group by 1, 2""")
def q30_orders_diff(spark, d):
    old, new = S.orders(spark, d)
    return diff.classified(old, new).groupBy("class", "field_mask").agg(F.count(F.lit(1)).alias("n"))


# A real tree and its catalogue: see trees.


def _file(kind="file"):
    return F.col("kind") == kind


@query(T.SQL + "select path, cast(strlen(text) as bigint) as size_bytes, mtime as mtime_ns, case when c = 1 then 'changed' else 'same' end as later from v where c <> 2")
def q31_tree_listing(spark, d):
    """The tree as it is in the end, without hidden files and links: sizes are those before the change, less the mark that was added."""
    rows = T.listed(spark, T.world(spark, d).tree).filter(_file())
    changed = F.regexp_extract(F.col("relative_path").cast("string"), r"(\d+)\.txt$", 1).cast("long") % 7 == 1
    return rows.select(_text(), (F.col("size_bytes") - F.when(changed, 1).otherwise(0)).alias("size_bytes"), "mtime_ns", F.when(changed, "changed").otherwise("same").alias("later"))


@query(T.SQL + """select reason, cast(sum(n) as bigint) as n from (select 'hidden' as reason, count(*) as n from t where doc_id % 10 = 0 and c <> 2 union all
 select 'symlink', count(*) from t where doc_id % 10 = 1) group by reason having sum(n) > 0""")
def q32_left_out(spark, d):
    return T.listed(spark, T.world(spark, d).tree).filter(_file("skip")).groupBy("reason").agg(F.sum("n").alias("n"))


@query(T.SQL + "select path from t where c <> 2 union all select path || '.link' from t where doc_id % 10 = 1 and c <> 2")
def q33_followed_links_and_hidden(spark, d):
    """Links are files of their own; those whose file is gone are errors."""
    return T.listed(spark, T.world(spark, d).tree, follow_symlinks="true", skip_hidden="false").filter(_file()).select(_text())


@query(T.SQL + """select path || '.link' as path, 'not_found' as code, false as whole_folder from t where doc_id % 10 = 1 and c = 2 and src not in ('src2', 'src4')
 union all select distinct src, case src when 'src2' then 'io_error' else 'not_found' end, true from t where src in ('src2', 'src4')""")
def q34_listing_errors(spark, d):
    rows = T.listed(spark, T.world(spark, d).tree, follow_symlinks="true", faults='{"src2": "EIO", "src4": "ENOENT"}').filter(_file("error"))
    return rows.select(_text(), "code", F.col("listing").alias("whole_folder"))


@query(T.SQL + "select path, cast(null as varchar) as reason from v where c <> 2 and src <> 'src3' union all select distinct cast(null as varchar), 'mount' from t where src = 'src3'")
def q35_other_device(spark, d):
    """A folder on another device is one skip; nothing in it is listed."""
    rows = T.listed(spark, T.world(spark, d).tree, devices='{"src3": 1}')
    return rows.filter(_file() | (F.col("reason") == "mount")).select(_text(), "reason")


@query(T.SQL + "select path, src || '/' || split_part(path, '/', 2) as parent_path, doc_id || '.txt' as name, 'txt' as extension, cast(strlen(text) as bigint) as size_bytes, mtime as mtime_ns, sha256(text) as content_hash, 'text/plain' as mime_type, 'present' as presence from v")
def q36_files_after_first_scan(spark, d):
    return T.world(spark, d).read(0, "files").select(_text(), "parent_path", "name", "extension", "size_bytes", "mtime_ns", F.lower(F.hex("content_hash")).alias("content_hash"), "mime_type", "presence")


@query(_longs(T.SQL + """select path, case when shut or (c = 1 and bad) then 'unreadable' when c = 2 then 'deleted' else 'present' end as presence, sha256(case when shut or bad or c = 2 then text else later end) as content_hash,
 case when c = 2 and not shut then 2 end as deleted_in_scan_id, case when c = 1 and not shut and not bad then 2 else 1 end as metadata_from_scan_id from v""", "deleted_in_scan_id", "metadata_from_scan_id"))
def q37_files_after_second_scan(spark, d):
    """What lies in an unreadable folder, and what couldn't be hashed, is held; what is gone leaves a tombstone."""
    rows = T.world(spark, d).read(2, "files")
    return rows.select(_text(), "presence", F.lower(F.hex("content_hash")).alias("content_hash"), "deleted_in_scan_id", "metadata_from_scan_id")


@query(_longs(T.SQL + """select path, case when c = 2 then 'deleted' else 'present' end as presence, sha256(case when c = 2 then text else later end) as content_hash, case when c = 2 then case when shut then 3 else 2 end end as deleted_in_scan_id from v""", "deleted_in_scan_id"))
def q38_files_after_third_scan(spark, d):
    return T.world(spark, d).read(3, "files").select(_text(), "presence", F.lower(F.hex("content_hash")).alias("content_hash"), "deleted_in_scan_id")


@query(_longs(T.SQL + """select case when shut or (c = 1 and bad) then 3 else 2 end as scan_id, path, case c when 1 then 'updated' else 'deleted' end as change_kind, case c when 1 then 9 else 16 end as field_mask,
 cast(strlen(text) as bigint) as old_size_bytes, case when c = 1 then cast(strlen(later) as bigint) end as new_size_bytes from v where c in (1, 2)""", "scan_id", "field_mask"))
def q39_changes_kept(spark, d):
    """The first scan's changes have aged out; the folder that was unreadable changes only in the third."""
    return T.world(spark, d).read(3, "changes").select("scan_id", _text(), "change_kind", "field_mask", "old_size_bytes", "new_size_bytes")


@query(_longs(T.SQL + "select 2 as scan_id, 'walk' as stage, 'src1' as path, 'permission_denied' as error_code where exists (select 1 from t where src = 'src1') union all select 2, 'hash', path, 'permission_denied' from v where c = 1 and bad and not shut", "scan_id"))
def q40_errors(spark, d):
    return T.world(spark, d).read(3, "errors").select("scan_id", "stage", _text(), "error_code")


@query(_longs(T.SQL + """, n as (select count(*) as every, count_if(c <> 2) as left_, count_if(c <> 2 and not shut) as seen, count_if(c = 1 and not shut) as changed, count_if(c = 1 and not shut and not bad) as updated, count_if(c = 2 and not shut) as gone,
 count_if(shut or (c = 1 and bad)) as held, count_if(c = 1 and (shut or bad)) as late, count_if(c = 2 and shut) as late_gone from v), h as (select count_if(doc_id % 10 = 0) as all_hidden, count_if(doc_id % 10 = 0 and c <> 2) as hidden, count_if(doc_id % 10 = 1) as links from t),
 w as (select count_if(doc_id % 10 = 0 and c <> 2 and src <> 'src1') as hidden, count_if(doc_id % 10 = 1 and src <> 'src1') as links, max(case when src = 'src1' then 1 else 0 end) as shut from t)
select 1 as scan_id, 'complete' as status, every as discovered_files, every as staged_files, every as hashed_files, every as added_count, 0 as updated_count, 0 as deleted_count, 0 as unchanged_count, every as present_count, 0 as error_count, h.all_hidden as excluded_hidden, h.links as excluded_symlink, 0 as unreadable_dirs from n, h
union all select 2, 'complete', seen, seen - (changed - updated), updated, 0, updated, gone, seen - changed, seen - (changed - updated), w.shut + changed - updated, w.hidden, w.links, w.shut from n, w
union all select 3, 'complete', left_, left_, hashed, 0, late, late_gone, left_ - late, left_, 0, h.hidden, h.links, 0 from n, h, (select count_if(c <> 2 and (shut or (c = 1 and bad))) as hashed from v)""", "scan_id", *COUNTS))
def q41_scans(spark, d):
    return T.world(spark, d).read(3, "scans").select("scan_id", "status", *COUNTS)


@query(T.SQL + """select * from (values (0, 'complete', false, 0), (1, 'cancelled', false, 130), (2, 'complete', true, case when exists (select 1 from t where src = 'src1') then 7 else 0 end), (3, 'complete', false, 0)) as x(attempt, status, carried_on, exit_code)""")
def q42_attempts(spark, d):
    """A scan that was stopped is carried on under its number; an unreadable folder shows in the exit code."""
    rows = [(k, o.status, o.resumed, o.exit_code) for k, o in enumerate(T.world(spark, d).outcomes)]
    return spark.createDataFrame(rows, "attempt int, status string, carried_on boolean, exit_code int")


@query(_longs(T.SQL + "select 1 as base_id, 3 as last_complete_scan_id, true as skip_hidden, true as skip_mount_boundaries, false as follow_symlinks, true as no_error, 0 as staged_rows", "base_id", "last_complete_scan_id", "staged_rows"))
def q43_base_and_stage(spark, d):
    w = T.world(spark, d)
    stage = w.store.read(w.after[3]["stage"], D.STAGE).agg(F.count(F.lit(1)).alias("staged_rows"))
    rows = w.read(3, "bases").select("base_id", "last_complete_scan_id", *D.POLICY, F.col("last_error").isNull().alias("no_error"))
    return rows.join(F.broadcast(stage.withColumn("base_id", F.lit(1).cast("long"))), "base_id")
