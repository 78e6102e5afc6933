"""Similarity join of documents on their sets of word shingles, by T-occurrence search.

1. Documents with equal sets form a class; from here on a class is one set, however many copies it has.
2. A set's shingles are dealt by hash into parts, as many for all sets of a band of sizes. Two sets that reach the similarity differ in
   few parts, so of those parts that hold a shingle they share a number that is known before; as with prefixes of sets, they then share one
   of the first few of each, in any order that all sets follow. A part is one signature, of all shingles in it: unrelated sets share a shingle
   here and there, the more so the more documents there are, but hardly ever all shingles of a part. Parts with many shingles
   that aren't frequent come first. Classes that share no signature drop out, and with them most documents.
3. What is left falls into components of sets that may be linked. Components are packed into blocks of bounded size, a component
   that exceeds a block into pairs of blocks of compatible sizes, and each block is searched with DivideSkip for links.
4. Links, a spanning forest of them, join classes into groups; a document's group is named by its smallest id.

Every step is exact but for collisions of 64-bit hashes. Pairs are never listed: what moves is linear in the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import columns, frequent, join_few, join_hot, kept, packed, unpacked
from .components import components
from .occurrence import forest, least_size


@dataclass(frozen=True)
class Join:
    """shingle: words. percent: least similarity. block: shingles that a task searches at once. pending: shingles between counts in a task. frequent: most shingles that count as frequent; that only orders signatures, it drops none. filter_bytes: most bytes of the filter that keeps texts out of a shuffle."""

    shingle: int = 5
    percent: int = 80
    block: int = 2_000_000
    pending: int = 6_000_000
    frequent: int = 1 << 19
    filter_bytes: int = 16 << 20


#: Of the query, by its contract.
CONTRACT = Join(shingle=4, percent=85)
#: A null id sorts last.
NULL_ID = (1 << 63) - 1


def _class_of(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for each set, from a sum over its elements; for empty sets 0."""
    if not len(s):
        return np.zeros(len(at) - 1, np.int64)
    sums = np.r_[np.uint64(0), np.cumsum(words.mix(s ^ np.uint64(0x5851F42D4C957F2D)))]
    n = np.diff(at)
    out = words.mix((sums[at[1:]] - sums[at[:-1]]) + n.astype(np.uint64) * np.uint64(0x14057B7EF767814F))
    out[n == 0] = 0
    return out.view(np.int64)


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _described(docs: DataFrame, join: Join) -> DataFrame:
    """Rows of two kinds: documents (id, class, number of shingles, digest of the text), and shingles that recur within a partition (shingle, count, 0 as kind)."""

    def run(batches):
        pending, size, seen = [], 0, set()

        def recurring():
            token, count = np.unique(np.concatenate(pending), return_counts=True)
            own = count >= 2
            return _rows(kind=np.ones(int(own.sum()), np.int8), a=token[own].view(np.int64), b=count[own].astype(np.int64), n=np.zeros(int(own.sum()), np.int64), t=np.zeros(int(own.sum()), np.int64))

        for batch in batches:
            ids, digests = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2))
            for begin, end, found in words.blocks(batch.column(1)):
                s, at = words.shingles(found.hashes(), found.first, join.shingle)
                of, n = _class_of(s, at), np.diff(at)
                yield _rows(kind=np.zeros(end - begin, np.int8), a=ids[begin:end], b=of, n=n, t=digests[begin:end])
                fresh = []
                for i, c in enumerate(of.tolist()):
                    if c not in seen:
                        seen.add(c)
                        fresh.append(s[at[i] : at[i + 1]])
                pending += fresh
                size += sum(map(len, fresh))
                if size >= join.pending:
                    yield recurring()
                    pending, size = [], 0
        if size:
            yield recurring()

    return docs.select("id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, "kind tinyint, a long, b long, n long, t long")


class _Frequent:
    """The most frequent shingles."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = np.sort(tokens)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[tokens & np.uint64(0xFFFFF)] = True

    def holds(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), bool)
        if len(self.tokens):
            some = np.flatnonzero(self.maybe[s & np.uint64(0xFFFFF)])
            out[some] = self.tokens[np.minimum(np.searchsorted(self.tokens, s[some]), len(self.tokens) - 1)] == s[some]
        return out


def parts_of(band: np.ndarray, percent: int) -> np.ndarray:
    """Into how many parts the sets of a band (sizes from 2 ** band up to its double) are dealt: more than can differ, with a fifth to spare, of those that a set of the largest size fills."""
    least = min(0.9, 1.2 * (100 - percent) / percent)
    share = least
    for _ in range(200):
        share = least / (1 - np.exp(-1 / share)) if share else 0.0
    return np.maximum(8, np.ceil(share * 2.0 ** (band + 1))).astype(np.uint64)


def signatures(s: np.ndarray, at: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets that lie one after another, each sorted, such that different sets which reach the similarity share one: sets' numbers, and tokens. ``common``: which elements are frequent.

    Sets meet in the band of the larger one's size, so a set has signatures in its own band and in those that larger sets it could be linked with
    fall in. Sets of a and b elements that are linked differ in at most (100 - percent) * (a + b) / (100 + percent) elements, so in as many parts at most, ``most``
    over all partners in the band: of each set's parts that hold anything, all but ``most`` are the other's, too, and its first most + 1 share
    one with the other's. Where so few parts are filled that this says nothing for either set, both have the band's own token.
    """
    n = np.diff(at)
    largest = 100 * n // percent
    exponent = lambda x: np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    low, high = exponent(n), exponent(largest)
    owners, tokens = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for step in range(int((high - low).max()) + 1 if len(n) else 0):
        band = low + step
        most = (100 - percent) * (n + np.minimum(largest, 2 ** (band + 1) - 1)) // (100 + percent)
        own = np.flatnonzero((n > 0) & (band <= high) & (most > 0))  # sets that differ in nothing are one class
        if not len(own):
            continue
        size, k = n[own], band[own].astype(np.uint64)
        of = np.repeat(np.arange(len(own)), size)
        place = np.repeat(at[own] - (np.cumsum(size) - size), size) + np.arange(len(of))
        x, count = s[place], parts_of(band[own], percent)
        part = ((x >> np.uint64(32)) * count[of]) >> np.uint64(32)
        begin = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (of[1:] != of[:-1])])
        held = np.diff(np.r_[begin, len(x)])
        rare = np.add.reduceat(~common[place], begin, dtype=np.int64)
        owner = of[begin]
        token = words.mix(np.add.reduceat(words.mix(x ^ np.uint64(0x5851F42D4C957F2D)), begin) + words.mix(part[begin] * np.uint64(64) + k[owner]))
        order = np.lexsort((token, -held, -rare, owner))
        filled = np.bincount(owner, minlength=len(own))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(filled) - filled, filled)
        first = order[rank <= most[own][owner[order]]]
        few = np.flatnonzero(filled <= most[own])
        owners += [own[owner[first]], own[few]]
        tokens += [token[first], words.mix(k[few] + np.uint64(1 << 40))]
    return np.concatenate(owners), np.concatenate(tokens)


def _postings(docs: DataFrame, frequent, join: Join) -> DataFrame:
    """(token, size, node) for the signatures of each class, once in a partition."""

    def run(batches):
        seen = set()
        for batch in batches:
            for _, _, found in words.blocks(batch.column(1)):
                s, at = words.shingles(found.hashes(), found.first, join.shingle)
                of, fresh = _class_of(s, at), []
                for i, c in enumerate(of.tolist()):
                    if c not in seen and at[i + 1] > at[i]:
                        seen.add(c)
                        fresh.append(i)
                if fresh:
                    size = np.diff(at)[fresh]
                    place = np.repeat(at[fresh] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    own = s[place]
                    owner, token = signatures(own, np.r_[0, np.cumsum(size)], frequent.value.holds(own), join.percent)
                    if len(owner):
                        yield _rows(token=token.view(np.int64), size=size[owner].astype(np.int32), node=of[fresh][owner])

    return docs.mapInArrow(run, "token long, size int, node long")


def _neighbours(postings: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join classes which share a signature and have compatible sizes: on each list, in order of size, neighbours.

    If two neighbours' sizes are too far apart, so are those of all before and all after them; so the edges join what pairs would.
    """

    def run(batches):
        token = size = node = None
        for batch in batches:
            t, n, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if token is not None:
                t, n, c = np.r_[token, t], np.r_[size, n], np.r_[node, c]
            if not len(t):
                continue
            token, size, node = t[-1:], n[-1:], c[-1:]
            n = n.astype(np.int64)
            near = (t[1:] == t[:-1]) & (c[1:] != c[:-1]) & (100 * n[:-1] >= percent * n[1:])
            if near.any():
                pairs = np.unique(np.sort(np.stack([c[:-1][near], c[1:][near]], 1), 1), axis=0)
                yield _rows(a=pairs[:, 0].copy(), b=pairs[:, 1].copy())

    return postings.repartition("token").sortWithinPartitions("token", "size", "node").mapInArrow(run, "a long, b long")


def _blocks(nodes: DataFrame, join: Join) -> DataFrame:
    """(node, task, side) for nodes(node, component, n): which blocks a class is searched in, and on which side.

    Small components are packed, each whole, into blocks of about ``join.block`` shingles. The classes of a large one are put into bands
    by size, such that compatible sizes lie in one band or in neighbouring ones, and bands into parts; every part meets itself, the
    other parts of its band, and the parts of the next band.
    """
    sums = nodes.groupBy("component").agg(F.sum("n").alias("total"))
    total = sums.filter(F.col("total") <= join.block).agg(F.sum("total")).first()[0] or 0
    packs = max(1, -(-2 * total // join.block))
    known = nodes.join(sums, "component")
    small = known.filter(F.col("total") <= join.block).select("node", F.concat(F.lit("p"), F.pmod(F.xxhash64("component"), F.lit(packs))).alias("task"), F.lit(-1).alias("side"))

    width = float(np.log(100 / join.percent)) * 1.0001
    large = known.filter(F.col("total") > join.block).withColumn("band", F.floor(F.log("n") / F.lit(width)).cast("int"))
    parts = kept(large.groupBy("component", "band").agg(F.ceil(F.sum("n") * 2 / F.lit(join.block)).cast("int").alias("parts")), "parts")
    large = large.join(parts, ["component", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    for name, shift in (("above", 1), ("below", -1)):
        other = parts.select("component", (F.col("band") - shift).alias("band"), F.col("parts").alias(name))
        large = large.join(other, ["component", "band"], "left")
    name = lambda band, i, j: F.concat_ws(":", "component", band, i, j)
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    band, part = F.col("band"), F.col("part")
    met = lambda task, side: F.struct(task.alias("task"), side.cast("int").alias("side"))
    same = F.transform(every(F.col("parts")), lambda j: met(name(band, F.least(part, j), F.greatest(part, j)), F.when(j == part, -1).otherwise((part > j).cast("int"))))
    up = F.transform(every(F.coalesce(F.col("above"), F.lit(0))), lambda j: met(F.concat(F.lit("u"), name(band, part, j)), F.lit(0)))
    down = F.transform(every(F.coalesce(F.col("below"), F.lit(0))), lambda j: met(F.concat(F.lit("u"), name(band - 1, j, part)), F.lit(1)))
    large = large.select("node", F.explode(F.concat(same, up, down)).alias("_m")).select("node", F.col("_m.task").alias("task"), F.col("_m.side").alias("side"))
    return small.unionByName(large)


def _links(texts: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) found in blocks, from texts(task, side, node, text)."""

    def search(group: pa.Table) -> pa.Table:
        sets, nodes, sides, seen = [], [], [], set()
        for batch in group.to_batches():
            node, side = batch.column("node").to_numpy(), batch.column("side").to_numpy()
            for begin, _, found in words.blocks(batch.column("text")):
                s, at = words.shingles(found.hashes(), found.first, join.shingle)
                for i, c in enumerate(_class_of(s, at).tolist()):
                    k = begin + i
                    if c == node[k] and c not in seen:  # an id can stand for several rows
                        seen.add(c)
                        sets.append(s[at[i] : at[i + 1]].copy())
                        nodes.append(c)
                        sides.append(side[k])
        halves = np.array(sides)
        pairs = forest(sets, join.percent, halves if len(halves) and (halves >= 0).all() else None)
        return pa.table({"a": pa.array([nodes[i] for i, _ in pairs], pa.int64()), "b": pa.array([nodes[j] for _, j in pairs], pa.int64())})

    return texts.groupBy("task").applyInArrow(search, "a long, b long")


def _named(docs: DataFrame, key: str, text: str, join: Join) -> DataFrame:
    """(id, t, n, component, component_id) for each row of docs: its key, the digest of its text, how many shingles it has, and its group, by a class in it and by its smallest key."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL_ID)).alias("id"), F.col(f"`{text}`").alias("text"))
    described = kept(_described(rows, join), "described")
    documents = described.filter("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("node"), "n", "t")
    recurring = described.filter("kind = 1").groupBy(F.col("a").alias("token")).agg(F.sum("b").alias("count"))
    top = columns(frequent(kept(recurring.filter("count >= 3"), "counts"), "count", join.frequent).select("token"))
    most = spark.sparkContext.broadcast(_Frequent(top["token"].astype(np.int64).view(np.uint64)))

    classes = kept(documents.filter("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")), "classes")
    candidates = components(_neighbours(_postings(rows, most, join), join.percent))
    nodes = kept(candidates.join(classes, "node"), "candidates")
    wanted = kept(nodes.select("node", "id").join(_blocks(nodes, join), "node").select("id", "node", "task", "side"), "blocks")
    links = kept(_links(join_few(rows, wanted, "id", "inner", join.filter_bytes), join), "links")
    linked = components(links)

    named = linked.join(classes, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    named = linked.join(named, "component")
    named = classes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "id").alias("component_id"), "copies")
    named = kept(named, "groups")
    some = join_hot(documents.filter("n > 0"), named, "node", "copies", documents.count()).drop("copies", "node")
    none = documents.filter("n = 0").select("t", "id", "n", F.lit(0).cast("long").alias("component"), F.col("id").alias("component_id"))
    return some.unionByName(none)


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", join: Join = Join()) -> DataFrame:
    """For each row of docs: key, ``n_shingles`` and ``component_id``, the smallest key reachable by links, its own included.

    Documents without words, null texts among them, have no shingles and no links. Documents with equal sets are linked. Rows that share a
    key are linked only if their texts are. A null key sorts after all others and stays null. Other columns are ignored; an empty table gives no rows.
    """
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return _named(docs, key, text, join).select(null("id").alias(key), F.col("n").alias("n_shingles"), null("component_id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", join: Join = Join()) -> DataFrame:
    """One row of each group, unchanged: one with the smallest key, null keys last, and among those one with the least digest of its text.

    Documents without words are in no group and stay, every row. Of repeated rows one stays. Rows are told apart by key and text, so other
    texts under the key of a copy stay. Text is shuffled only where key and text are repeated, one row of each task, and where more rows than can
    be broadcast belong to copies, for those that a filter takes for one.
    """
    named = kept(_named(docs, key, text, join).filter("n > 0"), "named")
    first = named.groupBy("component").agg(F.min(F.struct("id", "t")).alias("first"), F.count(F.lit(1)).alias("copies"))
    name = F.concat_ws(":", "id", "t")
    many = join_hot(named, kept(first.filter("copies > 1"), "firsts"), "component", "copies", named.count())
    marked = many.groupBy(name.alias("_name")).agg(F.first((F.col("first.id") == F.col("id")) & (F.col("first.t") == F.col("t"))).alias("_stays"), F.count(F.lit(1)).alias("_n"))
    marked = kept(marked.filter("not _stays or _n > 1"), "near-copies")
    row = F.col("_row")
    own = F.concat_ws(":", F.coalesce(row.getField(key).cast("long"), F.lit(NULL_ID)), F.xxhash64(row.getField(text)))
    rows = join_few(packed(docs).withColumn("_name", own), marked.select("_name", "_stays"), "_name", "left", join.filter_bytes)
    once = rows.filter(F.col("_stays").isNull()).select("_row")
    left = once.unionByName(rows.filter("_stays").groupBy("_name").agg(F.first("_row").alias("_row")).select("_row"))
    return left.select(*unpacked(left, docs.columns))
