"""Mixing sources to target weights by capped water-filling.

A budget, a share of all words, is dealt to the sources in proportion to their weights. No source may be repeated more
than ``epochs`` times: one that would be is clamped there and its excess goes to the others by weight, until none is
above. With sources in order of capacity per unit of weight, the clamped ones are a prefix of that order; so the fixed
point of that loop is found with running sums over the table of sources, without iterating.

Each source's target is then met with whole and fractional repetitions of its documents: all are taken
floor(target / size) times, and once more those first in a seeded order of hashes, as far as the rest of the target
reaches. The order is cut without sorting a source: sums by hash prefix find the prefix in which the cut falls, and only
that prefix is looked at closely.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_small, kept, packed, unpacked, word_count


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in order of code points, null last, repeating. share: of all words. epochs: most repetitions. prefix: hex digits by which a source's documents are summed."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    epochs: float = 2.0
    seed: int = 42
    prefix: int = 3


MIX = Mix()


def _order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def _source_key(source: Column) -> Column:
    """Text that sorts as sources do, null last, and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def fill(sources: DataFrame, mix: Mix = MIX) -> DataFrame:
    """Targets of sources(_source, source_size), one row each: the capped water-filling. Adds ``target``, ``whole``, ``rest``.

    The windows run over the table of sources alone. Where even all capacities fall short of the budget, all sources
    are clamped; a source without words has target 0.
    """
    weights = F.array(*[F.lit(w).cast("double") for w in mix.weights])
    n = len(mix.weights)
    ranked = sources.withColumn("_w", weights[(F.row_number().over(W.orderBy("_source")) - 1) % n])
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(mix.epochs))
    everything = W.partitionBy()
    by_need = W.orderBy(F.col("_cap") / F.col("_w"), "_source").rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(mix.share) - F.coalesce(F.sum("_cap").over(by_need), F.lit(0.0))).alias("_left"),
        (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(by_need), F.lit(0.0))).alias("_weight_left"),
    )
    above = F.col("_cap") * F.col("_weight_left") > F.col("_w") * F.col("_left")
    first = F.min(F.when(above, F.struct(F.col("_cap") / F.col("_w"), F.col("_source"), F.col("_left"), F.col("_weight_left")))).over(everything)
    ranked = ranked.withColumn("_first", first)
    clamped = F.col("_first").isNull() | (F.struct(F.col("_cap") / F.col("_w"), F.col("_source")) < F.struct(F.col("_first")["col1"], F.col("_first")["_source"]))
    target = F.when(clamped, F.col("_cap")).otherwise(F.col("_w") * F.col("_first")["_left"] / F.col("_first")["_weight_left"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    out = ranked.withColumn("target", target).withColumn("whole", whole.cast("long"))
    return out.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).select("_source", "source_size", "target", "whole", "rest")


def _sized(docs: DataFrame, key: str, source: str, text: str, mix: Mix) -> DataFrame:
    return docs.select(
        F.col(f"`{key}`").alias("_key"), _source_key(F.col(f"`{source}`")).alias("_source"), word_count(F.col(f"`{text}`")).alias("_size"), _order(F.col(f"`{key}`"), mix.seed).alias("_hash")
    )


def plan(sized: DataFrame, mix: Mix = MIX) -> DataFrame:
    """One row for each source: its target, whole repetitions, and the last hash that is taken once more (``cut``)."""
    bucket = F.substring("_hash", 1, mix.prefix).alias("_bucket")
    sums = kept(sized.groupBy("_source", bucket).agg(F.sum("_size").alias("_size")), "mix-sums")
    targets = fill(sums.groupBy("_source").agg(F.sum("_size").alias("source_size")), mix)
    running = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = sums.withColumn("_upto", F.sum("_size").over(running)).join(targets.select("_source", "rest"), "_source")
    edge = steps.filter((F.col("_upto") - F.col("_size") < F.col("rest")) & (F.col("_upto") >= F.col("rest")) & (F.col("_size") > 0))
    edge = edge.select("_source", "_bucket", "rest", (F.col("_upto") - F.col("_size")).alias("_before"))
    near = sized.withColumn("_bucket", bucket).join(edge, ["_source", "_bucket"]).groupBy("_source", "_bucket", "rest", "_before", "_hash").agg(F.sum("_size").alias("_size"))
    upto = F.col("_before") + F.sum("_size").over(W.partitionBy("_source").orderBy("_hash").rowsBetween(W.unboundedPreceding, W.currentRow))
    near = near.withColumn("_upto", upto)
    taken = F.when(F.col("_upto") - F.col("_size") / F.lit(2.0) <= F.col("rest"), F.col("_hash"))
    cut = near.groupBy("_source").agg(F.coalesce(F.max(taken), F.min("_bucket")).alias("cut"))
    return kept(targets.join(cut, "_source", "left").withColumn("cut", F.coalesce("cut", F.lit(""))), "mix-plan")


def _repeats() -> Column:
    return F.col("whole") + F.when(F.col("_hash") <= F.col("cut"), 1).otherwise(0)


def takings(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", mix: Mix = MIX) -> DataFrame:
    """For each row of docs: key, ``size``, ``source_size``, ``target``, ``repeats`` and ``taken`` (words, repeats counted).

    Text is scanned once. Null text has no words; a null source is a source of its own, the last. Rows that share a key
    are taken together, so repeated rows count as one document in the cut. A source's words miss its target by half a
    document at most. An empty table gives no rows.
    """
    sized = kept(_sized(docs, key, source, text, mix), "mix-sizes")
    out = join_small(sized, plan(sized, mix), "_source", "inner")
    return out.select(F.col("_key").alias(key), F.col("_size").alias("size"), "source_size", "target", _repeats().alias("repeats"), (F.col("_size") * _repeats()).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", mix: Mix = MIX) -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as it is taken. Only the table of sources meets the text, so no text is shuffled."""
    sized = kept(_sized(docs, key, source, text, mix), "mix-sizes")
    row = F.col("_row")
    rows = packed(docs).select("_row", _source_key(row.getField(source)).alias("_source"), _order(row.getField(key), mix.seed).alias("_hash"))
    chosen = join_small(rows, plan(sized, mix).select("_source", "whole", "cut"), "_source", "inner")
    copies = chosen.select("_row", F.explode(F.array_repeat(F.lit(0), _repeats().cast("int"))))
    return copies.select(*unpacked(copies, docs.columns))


ORACLE_SQL = r"""
with d as (select doc_id, case when source is null then '1' else '0' || source end as s, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
 md5('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
t as (select s, cast(sum(size) as bigint) as source_size from d group by s),
w as (select *, source_size * cast(2 as double) as cap, cast(([3, 1, 2])[cast((row_number() over (order by s) - 1) % 3 + 1 as integer)] as double) as w from t),
r as (select *, (select sum(source_size) from t) * cast(1.5 as double) - coalesce(sum(cap) over (order by cap / w, s rows between unbounded preceding and 1 preceding), 0) as room,
 (select sum(w) from w) - coalesce(sum(w) over (order by cap / w, s rows between unbounded preceding and 1 preceding), 0) as wroom from w),
f as (select room, wroom, cap / w as need, s as first_s from r where cap * wroom > w * room order by cap / w, s limit 1),
g as (select r.s, source_size, case when f.need is null or r.cap / r.w < f.need or (r.cap / r.w = f.need and r.s < f.first_s) then cap else w * f.room / f.wroom end as target from r left join f on true),
p as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from g),
c as (select d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size as rest, sum(size) over (partition by d.s order by h rows unbounded preceding) as upto from d join p on d.s = p.s)
select doc_id, size, source_size, target, cast(whole + case when rest > 0 and upto - size / 2.0 <= rest then 1 else 0 end as bigint) as repeats,
 cast(size * (whole + case when rest > 0 and upto - size / 2.0 <= rest then 1 else 0 end) as bigint) as taken from c
"""
