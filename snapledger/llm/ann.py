"""Approximate nearest neighbours by balanced posting lists.

Centroids come from halving a bounded sample again and again, so all lists start equal. Every vector goes to the list
of its nearest centroid and, if it lies near a boundary, to further lists whose centroids are nearly as near and not
closer to a chosen one than to the vector. Centroids are found by best-first search in an in-memory graph. A query reads the lists whose
centroids are within a ratio of the nearest one's distance, the nearest of them only: about as many as the number of lists to the
power of two thirds, which is what recall was measured to need while the number of lists grows with the table. A query that finds fewer neighbours than it asked for
in these reads all lists. Long lists, and lists that many queries read, are dealt over cells of bounded size, so a vector that holds a
third of all rows is no task's burden; scores are exact, in double precision, on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns, kept, least_hashed


@dataclass(frozen=True)
class Index:
    """sample: vectors the centroids are fitted on, those with the least hashes, and their ``components`` in all, at most. rows: a list should hold. centroids: at
    most, an eighth of the sample. copies, spread: a vector goes to at most so many lists, within so many times the nearest distance. ratio: the same distance for
    a query's lists, of which it reads at most ``probes`` times the lists' number to the ``power``. degree, beam: of the graph and its search. chunk: rows of a list, and queries, that meet in one cell."""

    sample: int = 65_536
    components: int = 1 << 24
    rows: int = 64
    centroids: int = 8_192
    copies: int = 4
    spread: float = 1.2
    probes: float = 1.4
    power: float = 2 / 3
    ratio: float = 1.6
    degree: int = 24
    beam: int = 96
    chunk: int = 4_096


INDEX = Index()


def halved(x: np.ndarray, leaves: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of ``leaves`` (a power of two) equal parts of x: parts are halved by how much nearer their rows are to one of two means."""
    parts = [np.arange(len(x))]
    while len(parts) < leaves:
        halves = []
        for part in parts:
            own = x[part]
            a, b = own[rng.integers(len(own))], own[rng.integers(len(own))]
            for _ in range(8):
                side = own @ (a - b)
                order = np.argsort(-side, kind="stable")
                left, right = order[: len(own) // 2], order[len(own) // 2 :]
                a, b = own[left].mean(0), own[right].mean(0)
            halves += [part[left], part[right]]
        parts = halves
    return unit(np.stack([x[p].mean(0) for p in parts]))


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


class Graph:
    """Centroids with edges to their nearest ones and a few far ones; searched for many points at once."""

    def __init__(self, centroids: np.ndarray, degree: int, beam: int, seed: int = 7):
        self.c, n = centroids.astype(np.float32), len(centroids)
        near = min(degree, n - 1)
        edges = np.empty((n, near), np.int64)
        for i in range(0, n, 1024):
            sims = self.c[i : i + 1024] @ self.c.T
            sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -np.inf
            edges[i : i + 1024] = np.argpartition(-sims, near - 1, axis=1)[:, :near] if near else 0
        rng = np.random.default_rng(seed)
        self.edges = np.concatenate([edges, rng.integers(n, size=(n, 4))], 1)
        self.entries = rng.permutation(n)[: min(n, 32)]
        self.beam = beam

    def every(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` nearest centroids of each row of x and their distances on the unit sphere, nearest first; all centroids are compared."""
        sims = x.astype(np.float32) @ self.c.T
        ids = np.argsort(-sims, axis=1, kind="stable")[:, :most]
        return ids, np.sqrt(np.maximum(2 - 2 * np.take_along_axis(sims, ids, 1), 0))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best centroids found for each row of x and their distances on the unit sphere, nearest first."""
        x, n = x.astype(np.float32), len(self.c)
        m = len(x)
        seen = np.zeros((m, n), bool)
        ids = np.broadcast_to(self.entries, (m, len(self.entries))).copy()
        seen[:, self.entries] = True
        sims = x @ self.c[self.entries].T
        done = np.zeros(ids.shape, bool)
        rows = np.arange(m)[:, None]
        for _ in range(4 * beam):
            open_ = np.where(done, -np.inf, sims)
            best = np.argsort(-open_, axis=1)[:, :4]
            alive = np.isfinite(open_[rows, best])
            if not alive.any():
                break
            done[rows, best] = True
            fresh = self.edges[ids[rows, best]].reshape(m, -1)
            fresh_ok = np.repeat(alive, self.edges.shape[1], axis=1) & ~seen[rows, fresh]
            order = np.argsort(fresh, axis=1, kind="stable")  # a centroid counts once
            ranked = np.take_along_axis(fresh, order, 1)
            twice = np.zeros(fresh.shape, bool)
            twice[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
            fresh, fresh_ok = ranked, np.take_along_axis(fresh_ok, order, 1)
            first_ok = fresh_ok & ~twice
            first_ok[:, 1:] |= fresh_ok[:, 1:] & twice[:, 1:] & ~fresh_ok[:, :-1]
            fresh_ok = first_ok
            r, c = np.nonzero(fresh_ok)
            seen[r, fresh[r, c]] = True
            near = np.where(fresh_ok, np.einsum("mkd,md->mk", self.c[fresh], x), -np.inf)
            ids, sims, done = np.concatenate([ids, fresh], 1), np.concatenate([sims, near], 1), np.concatenate([done, ~fresh_ok], 1)
            keep = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, done = (np.take_along_axis(a, keep, 1) for a in (ids, sims, done))
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return ids, np.sqrt(np.maximum(2 - 2 * sims, 0)) + np.where(np.isfinite(sims), 0, np.inf)

    def lists(self, x: np.ndarray, most: int, ratio: float, apart: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and the lists they go to: those within ``ratio`` of the nearest distance; ``apart`` leaves out centroids that lie nearer to a chosen one than to the row."""
        of, to = [], []
        for i in range(0, len(x), 512):
            beam = max(self.beam, 3 * most // 2)
            ids, far = self.search(x[i : i + 512], beam) if beam < len(self.c) else self.every(x[i : i + 512], len(self.c))
            m, k = ids.shape
            chosen = np.zeros((m, k), bool)
            chosen[:, 0] = True
            for j in range(1, k):
                ok = (far[:, j] <= ratio * far[:, 0] + 1e-9) & (chosen.sum(1) < most)
                if apart:
                    gap = np.sqrt(np.maximum(2 - 2 * np.einsum("mkd,md->mk", self.c[ids[:, :j]], self.c[ids[:, j]]), 0))
                    ok &= ~(chosen[:, :j] & (gap < far[:, j, None])).any(1)
                chosen[:, j] = ok
                if not ok.any() and not apart:
                    break
            r, c = np.nonzero(chosen)
            of.append(r + i)
            to.append(ids[r, c])
        return (np.concatenate(of), np.concatenate(to)) if of else (np.empty(0, int), np.empty(0, int))


def usable(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows that take part. Left out: null ids, vectors that are null, empty, zero, hold null or non-finite components, or differ in length from the most frequent length."""
    v = F.col("v")
    rows = embeddings.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter(F.col("id").isNotNull())
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = rows.filter(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (usual[0]["n"] if usual else -1))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k nearest of x but for itself: row of the query, id, cosine. Ties go to the smaller id.

    A product of matrices finds who can be among the k; their cosines are then computed pair by pair, so they don't depend on the block.
    """
    norm = lambda a: np.sqrt((a * a).sum(1))
    near = unit(q) @ unit(x).T
    near[q_ids[:, None] == ids[None, :]] = -np.inf
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
    of_id = near if len(first) == len(ids) else np.maximum.reduceat(near[:, order], first, axis=1)  # an id's nearest row stands for it
    kth = np.partition(of_id, max(0, of_id.shape[1] - k), axis=1)[:, max(0, of_id.shape[1] - k)]
    r, c = np.nonzero((near >= kth[:, None] - 1e-9) & np.isfinite(near))
    score = np.empty(len(r))
    for i in range(0, len(r), 65_536):
        a, b = q[r[i : i + 65_536]], x[c[i : i + 65_536]]
        a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
        score[i : i + 65_536] = (a * b).sum(1) / (norm(a) * norm(b))
    order = np.lexsort((ids[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    first = np.r_[True, (r[1:] != r[:-1]) | (ids[c[1:]] != ids[c[:-1]])] if len(r) else np.empty(0, bool)  # repeated rows of one id count once
    r, c, score = r[first], c[first], score[first]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], ids[c[place < k]], score[place < k]


def nearest(embeddings: DataFrame, queries: str, key: str = "vec_id", vector: str = "embedding", k: int = 5, index: Index = INDEX) -> DataFrame:
    """Each query's k nearest found: ``query_id``, ``rank`` (from 1), key, ``score`` (cosine).

    ``queries``: SQL condition on ``id`` that says which rows are queries. All usable rows are indexed and searched; a
    row isn't a candidate of queries with its own id, and repeated rows of one id count once. Equal scores go to the smaller id. Fewer usable rows give fewer neighbours; an empty
    table gives none. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = kept(usable(embeddings, key, vector).distinct(), "ann-rows")
    one = rows.select(F.size("v")).first()
    if one is None:
        return spark.range(0).selectExpr("id as query_id", "cast(0 as int) as rank", f"id as `{key}`", "cast(0 as double) as score")
    size = min(index.sample, max(1, index.components // one[0]))
    sample = columns(least_hashed(rows, "id", size).select(F.explode("v").alias("v")))["v"].reshape(-1, one[0])
    total = rows.count() if len(sample) == size else len(sample)
    x = unit(sample)
    want = min(index.centroids, len(x) // 8, total // index.rows)
    leaves = 1 << max(0, want.bit_length() - 1) if want > 0 else 1
    graph = spark.sparkContext.broadcast(Graph(halved(x, leaves, np.random.default_rng(7)), index.degree, index.beam))
    most = min(leaves, int(np.ceil(index.probes * leaves**index.power)))

    def assign(most: int, ratio: float, apart: bool):
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    of, to = graph.value.lists(unit(_matrix(pdf["v"])), most, ratio, apart)
                    yield pd.DataFrame({"list": to, "id": pdf["id"].to_numpy()[of], "v": pdf["v"].to_numpy()[of]})

        return run

    lists = kept(rows.mapInPandas(assign(index.copies, index.spread, True), POSTING), "ann-lists")
    queries_ = rows.filter(queries)
    found = kept(_found(lists, kept(queries_.mapInPandas(assign(most, index.ratio, False), POSTING), "ann-asked"), k, index.chunk), "ann-found")
    if leaves > 1:
        enough = found.groupBy("query_id").agg(F.count_distinct("id").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"))
        short = kept(queries_.join(enough, "id", "left_anti"), "ann-short")
        if not short.isEmpty():
            every = short.withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(leaves - 1).cast("long")))).select("list", "id", "v")
            found = found.unionByName(_found(lists, every, k, index.chunk))
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


POSTING = "list long, id long, v array<double>"


def _found(lists: DataFrame, asked: DataFrame, k: int, chunk: int) -> DataFrame:
    """(query_id, id, score): for each query asked of a list, its k nearest there. A list's rows and queries are dealt over chunks, and each chunk of rows meets each chunk of queries in a cell of its own."""
    chunks = lambda df, name: F.broadcast(df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias(name)))  # noqa: E731  a row for each centroid at most
    rows, queries = chunks(lists, "_rows"), chunks(asked, "_queries")
    part = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lists.join(queries, "list").join(rows, "list").withColumn("row", part("_rows")).withColumn("query", every("_queries")).drop("_rows", "_queries")
    spread = asked.join(rows, "list").join(queries, "list").withColumn("query", part("_queries")).withColumn("row", every("_rows")).drop("_rows", "_queries")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [np.empty(0, np.int64)], "id": [np.empty(0, np.int64)], "score": [np.empty(0)]}
        if len(left) and len(right):
            ids, v = left["id"].to_numpy(np.int64), _matrix(left["v"])
            for i in range(0, len(right), 256):
                part = right.iloc[i : i + 256]
                q_ids = part["id"].to_numpy(np.int64)
                r, found, score = best(q_ids, _matrix(part["v"]), ids, v, k)
                for name, a in (("query_id", q_ids[r]), ("id", found), ("score", score)):
                    out[name].append(a)
        return pd.DataFrame({name: np.concatenate(a) for name, a in out.items()})

    cell = ("list", "row", "query")
    return dealt.groupBy(*cell).cogroup(spread.groupBy(*cell)).applyInPandas(search, "query_id long, id long, score double")
