"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams is held against every window of words.

Every window of a document is tried by a hash of its first words against a hash set that travels with the plan; the few
that pass are spelled out and joined exactly with the benchmark's windows. The set is made of slices of bounded size. A benchmark
with more windows than one slice holds is first cut down to those that occur: hashes of all windows of all documents, eight
bytes each, are held against hashes of the benchmark's, so the set grows with what documents and benchmark share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_small, kept, packed, unpacked

#: What lies between words, after A-Z are lower-cased: ASCII but for digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Words of a window's start that are hashed.
START = 4
#: Windows of the benchmark whose starts make one slice of the set that is sent with the plan.
MAX_WINDOWS = 200_000
#: Hashes of windows that are broadcast, by count; more are joined by shuffling distinct hashes.
MAX_HASHES = 4_000_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN), ""), F.array().cast("array<string>"))


def _positions(n: Column, length: int) -> Column:
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _start(words: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(n)])


def _started(words: Column, at: Column, n: int, starts: list[int]) -> Column:
    """Positions whose first n words hash to one of starts."""
    return F.filter(at, lambda i: _start(words, i, n).isin(starts))


def _spelled(words: Column, n: Column, at: Column, length: int) -> Column:
    """The windows of that length at those positions, as structs."""
    fits = F.filter(at, lambda i: i + length <= n)
    return F.transform(fits, lambda i: F.struct(i.alias("at"), F.lit(length).alias("len"), F.array_join(F.slice(words, i + 1, length), " ").alias("window")))


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The benchmark's windows: ``_len``, ``_window`` and ``_items``, the items (as text) that hold it. An item of fewer words than a window is one window; one without words has none."""
    items = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("_item"), words_of(F.col(f"`{text}`")).alias("_words")).filter(F.size("_words") > 0)
    n = F.size("_words")
    length = F.least(n, F.lit(window))
    each = items.select("_item", "_words", length.alias("_len"), F.explode(F.sequence(F.lit(0), n - length)).alias("_at"))
    return each.groupBy("_len", F.array_join(F.slice("_words", F.col("_at") + 1, F.col("_len")), " ").alias("_window")).agg(F.collect_set("_item").alias("_items"))


def _hash(words: Column, i: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(words, i + k) for k in range(length)])


def _hashes(words: Column, length: int) -> Column:
    return F.transform(_positions(F.size(words), length), lambda i: _hash(words, i, length))


def _occurring(words: DataFrame, grams: DataFrame, max_hashes: int) -> DataFrame:
    """Those of the benchmark's windows whose hash some window of words(_words) has. Nothing of the documents moves but hashes."""
    lengths = sorted(r[0] for r in grams.select("_len").distinct().collect())  # as many as a window has words, at most
    hashes = F.concat(*[_hashes(F.col("_words"), length) for length in lengths])
    seen = words.select(F.explode(hashes).alias("_h"))
    split = F.split("_window", " ")
    of_gram = F.lit(None).cast("long")
    for length in lengths:
        of_gram = F.when(F.col("_len") == length, _hash(split, F.lit(0), length)).otherwise(of_gram)
    keyed = grams.withColumn("_h", of_gram)
    listed = keyed.select("_h").distinct()
    if listed.count() <= max_hashes:
        met = seen.join(F.broadcast(listed), "_h", "left_semi").distinct()
    else:
        met = seen.distinct().join(listed, "_h", "left_semi")  # distinct before they are shuffled: a hot window is one row of each task
    return keyed.join(met, "_h", "left_semi").drop("_h")


def _candidates(grams: DataFrame, max_windows: int) -> Column:
    """Of a document's ``_words``: the windows whose start is in the benchmark, as structs."""
    n, words = F.size("_words"), F.col("_words")
    lengths = sorted(r[0] for r in grams.select("_len").distinct().collect())  # as many as a window has words, at most
    by_start: dict[int, list[int]] = {}
    for length in lengths:
        by_start.setdefault(min(length, START), []).append(length)
    found = []
    for k, group in by_start.items():
        split = F.split("_window", " ")
        starts = grams.filter(F.col("_len").isin(group)).select(F.xxhash64(*[F.get(split, F.lit(j)) for j in range(k)])).distinct()
        starts = sorted(r[0] for r in starts.toLocalIterator())
        for i in range(0, len(starts), max_windows):
            at = _started(words, _positions(n, k), k, starts[i : i + max_windows])
            found += [_spelled(words, n, at, length) for length in group]
    return F.concat(*found) if found else F.array().cast("array<struct<at:int,len:int,window:string>>")


def _islands(spans: Column) -> Column:
    """Merge sorted, overlapping [at, at + len) structs into disjoint ones."""
    zero = F.array().cast("array<struct<at:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        end = s["at"] + s["len"]
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["at"].alias("at"), F.greatest(last["end"], end).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["at"]), joined).otherwise(F.concat(acc, F.array(F.struct(s["at"].alias("at"), end.alias("end")))))

    return F.aggregate(spans, zero, step)


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS, max_hashes: int = MAX_HASHES) -> DataFrame:
    """For each row of docs: key, ``text_md5``, ``n_words``, ``n_hit``, ``spans`` (of hit words, disjoint, as [at, end)), ``items`` (sorted as text) and ``contaminated``.

    A document is contaminated when any word is hit and hits are a twentieth of its words or more. Null and empty
    texts have no words and no hits. Repeated rows each get their row. Null keys stay null; null items count as empty text. Other columns
    are ignored. An empty benchmark hits nothing, an empty table gives no rows. A text of any length is one row and its windows are
    tried in place.
    """
    grams = kept(windows(benchmark, item, item_text, window), "benchmark-windows")
    if grams.count() > max_windows:
        grams = kept(_occurring(docs.select(words_of(F.col(f"`{text}`")).alias("_words")), grams, max_hashes), "occurring-windows")
    found = _candidates(grams, max_windows)
    read = docs.select(F.col(f"`{key}`").alias("_key"), row_digest(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("text_md5"), words_of(F.col(f"`{text}`")).alias("_words"))
    base = kept(read.select(F.monotonically_increasing_id().alias("_row"), "_key", "text_md5", F.size("_words").cast("long").alias("n_words"), found.alias("_found")), "windows")
    each = base.filter(F.size("_found") > 0).select("_row", F.explode("_found").alias("_f")).select("_row", F.col("_f.at").alias("_at"), F.col("_f.len").alias("_len"), F.col("_f.window").alias("_window"))
    sure = join_small(each.withColumn("_gram", F.concat_ws(":", "_len", "_window")), grams.select(F.concat_ws(":", "_len", "_window").alias("_gram"), "_items"), "_gram", "inner", max_windows)
    per = sure.groupBy("_row").agg(F.collect_set(F.struct(F.col("_at").alias("at"), F.col("_len").alias("len"))).alias("_spans"), F.collect_set("_items").alias("_items"))
    per = per.select("_row", _islands(F.array_sort("_spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten("_items"))).alias("items"))
    out = base.drop("_found").join(per, "_row", "left")
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<at:int,end:int>>"))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["at"]))
    out = out.select(F.col("_key").alias(key), "text_md5", "n_words", n_hit.alias("n_hit"), spans.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def row_digest(key: Column, text: Column) -> Column:
    """Tells rows apart by key and text, nulls included."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("-")), F.lit("\x00"), F.coalesce(F.concat(F.lit("t"), text), F.lit("-"))).cast("binary"))


def without_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of docs that aren't contaminated, unchanged, with all their columns whatever their names; repeated rows share their fate. Text isn't shuffled while the
    contaminated rows are few enough to be broadcast, by count; more are joined by salt. Null texts stay; an empty benchmark takes nothing, an empty table gives none."""
    bad = hits(docs, benchmark, key, text, **options).filter("contaminated").select(F.col("text_md5").alias("_md5")).distinct()
    bad = kept(bad, "contaminated")
    rows = packed(docs).withColumn("_md5", row_digest(F.col("_row").getField(key), F.col("_row").getField(text)))
    left = join_small(rows, bad.withColumn("_bad", F.lit(True)), "_md5", "left").filter(F.col("_bad").isNull())
    return left.select(*unpacked(left, docs.columns))


def without_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All rows of docs, with hit words and what follows them up to the next word removed from the text. Rows without hits keep their text exactly, null texts
    stay null, repeated rows are cut alike, other columns are unchanged whatever their names; an empty benchmark cuts nothing, an empty table gives none."""
    found = hits(docs, benchmark, key, text, **options).filter("n_hit > 0").groupBy(F.col("text_md5").alias("_md5")).agg(F.first("spans").alias("_spans"))
    found = kept(found, "spans")
    t = F.col("_row").getField(text)
    rows = join_small(packed(docs).withColumn("_md5", row_digest(F.col("_row").getField(key), t)), found, "_md5")
    word, gap = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(t, F.lit(f"{word}+{gap}*"), F.lit(0))
    left = F.filter(pieces, lambda p, i: ~F.exists(F.col("_spans"), lambda s: (i >= s["at"]) & (i < s["end"])))
    cut = F.concat(F.regexp_extract(t, f"^{gap}*", 0), F.array_join(left, ""))
    new = F.when(F.col("_spans").isNull(), t).otherwise(cut).alias(text)
    return rows.select(*[new if name == text else c for name, c in zip(docs.columns, unpacked(rows, docs.columns), strict=True)])


ORACLE_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
g as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[i + 1 : i + least(len(w), 13)], ' ') as gram from (select item_id, w, unnest(range(len(w) - least(len(w), 13) + 1)) as i from b where len(w) > 0)),
s as (select doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') as gram from (select doc_id, w, n, unnest(range(len(w) - n + 1)) as i from d, (select distinct n from g) where len(w) >= n)),
h as (select s.doc_id, s.i, s.n, g.item_id from s join g on s.n = g.n and s.gram = g.gram),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as items from (select distinct doc_id, cast(item_id as varchar) as x from h) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit, cast(coalesce(t.n_items, 0) as bigint) as n_items,
 sha256(coalesce(t.items, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) as contaminated
from d left join c on d.doc_id = c.doc_id left join t on d.doc_id = t.doc_id
"""
