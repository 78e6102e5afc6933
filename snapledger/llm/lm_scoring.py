"""Language-model scores of all documents, beside a smoothed unigram base; see lm for the model.

Training texts are cut into subwords once, counted in full, and every window of them trains the net. Words that are frequent, at most ``frequent`` of them, are sent to all workers with
their counts; the others meet their counts in a join, a row for each document and word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lm, words
from .common import columns, frequent, kept

#: Stands for the end among hashes of words.
END_WORD = np.uint64(0x2545F4914F6CDD1D)
#: Bytes of text whose subwords are one row.
BLOCK = 1 << 20
#: Weights in a piece, and pieces that are averaged at once.
PIECE, FAN = 1 << 18, 8
WEIGHTS = "part long, piece long, n long, data binary"


@dataclass(frozen=True)
class Scoring:
    """vocabulary: file of a public vocabulary; none for that of the installed package. folds, held_out: of crc32 of the key. frequent: most words that are sent. start: documents, chosen by hash, on
    which first weights are fitted, about; fewer, but one at least, if their texts, never cut, have more ``characters``; rounds: of that fit. From there on every partition trains on all its training texts."""

    vocabulary: str | None = None
    folds: int = 7
    held_out: int = 2
    frequent: int = 500_000
    start: int = 1_200
    characters: int = 16_000_000
    rounds: int = 4


def _path(scoring: Scoring) -> str:
    if scoring.vocabulary:
        return scoring.vocabulary
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _ids(found: words.Words, subwords: lm.Subwords, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of a block's texts, each text closed by an end: ids, and where texts begin."""
    cut, first = subwords.cut(h, found.spelled)
    at = first[found.first]
    first = np.r_[0, np.cumsum(np.diff(at) + 1)]
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    ids = np.full(len(inside), lm.END, np.int64)
    ids[inside] = cut
    return ids, first


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _tokens(rows: DataFrame, scoring: Scoring) -> DataFrame:
    """Of training texts, rows of three kinds: 0 counts of words (hash), 1 counts of subwords (id), 2 blocks of whole texts in subwords, each text closed by an end (``data``: 16 bits each)."""

    def run(batches):
        subwords = lm.Subwords(_path(scoring))
        alone, ends = np.zeros(lm.SIZE, np.int64), 0
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def merged():
            h, back = np.unique(np.concatenate(hashes), return_inverse=True)
            return h, np.bincount(back, np.concatenate(counts), len(h)).astype(np.int64)

        def out(kind, a, n):
            for i in range(0, len(a), 500_000):
                m = len(a[i : i + 500_000])
                yield _rows(kind=np.full(m, kind, np.int8), a=a[i : i + 500_000].view(np.int64), n=n[i : i + 500_000], data=pa.nulls(m, pa.binary()))

        for batch in batches:
            for begin, end, found in words.blocks(batch.column(0), BLOCK):
                h = found.hashes()
                own, n = np.unique(h, return_counts=True)
                hashes.append(own)
                counts.append(n)
                ends += end - begin
                ids, _ = _ids(found, subwords, h)
                alone += np.bincount(ids, minlength=lm.SIZE)
                yield _rows(kind=np.array([2], np.int8), a=np.array([len(ids)]), n=np.array([end - begin]), data=pa.array([ids.astype(np.uint16).tobytes()], pa.binary()))
                if sum(map(len, hashes)) > 2_000_000:
                    h, n = merged()
                    if len(h) > 1_200_000:
                        yield from out(0, h, n)
                        hashes, counts = [], []
                    else:
                        hashes, counts = [h], [n]
        if ends:
            hashes.append(np.array([END_WORD]))
            counts.append(np.array([ends]))
            yield from out(0, *merged())
            own = np.flatnonzero(alone)
            yield from out(1, own, alone[own])

    return rows.select("text").mapInArrow(run, "kind tinyint, a long, n long, data binary")


def _blocks(batches):
    """Blocks that _tokens wrote: ids, and where texts begin."""
    for batch in batches:
        for data in batch.column(0):
            ids = np.frombuffer(data.as_py(), np.uint16).astype(np.int64)
            yield ids, np.r_[0, np.flatnonzero(ids == lm.END) + 1]


def _paired(tokens: DataFrame, rank: np.ndarray, row: np.ndarray, rows: int) -> DataFrame:
    """Counts n of cells a of the prior's table, over all training texts."""

    def run(batches):
        total = None
        for ids, first in _blocks(batches):
            own = lm.pairs(rank, row, rows, ids, first).astype(np.int32)
            total = own if total is None else np.add(total, own, out=total)
        if total is not None:
            cells = np.flatnonzero(total)
            yield _rows(a=cells, n=total[cells].astype(np.int64))

    return tokens.select("data").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def _started(rows: DataFrame, total: int, model: lm.Model, scoring: Scoring) -> None:
    """First weights, from a bounded sample of distinct training texts."""
    part = int(min(1.0, scoring.start / max(1, total)) * (1 << 30))
    h = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30))
    some = rows.select("text", h.alias("h")).filter(F.col("h") < part)
    room, last = scoring.characters, -1
    for r in some.groupBy("h").agg(F.max(F.length("text")).alias("n")).orderBy("h").limit(2 * scoring.start).collect():
        room -= r["n"]
        if room < 0 <= last:
            break
        last = r["h"]
    texts = sorted(r["text"] for r in some.filter(F.col("h") <= last).select("text").distinct().collect())
    subwords, parts, at = lm.Subwords(_path(scoring)), [np.empty(0, np.int64)], [0]
    for _, _, found in words.blocks(pa.array(texts, pa.string())):
        ids, first = _ids(found, subwords, found.hashes())
        parts.append(ids)
        at += (first[1:] + at[-1]).tolist()
    lm.Trainer(model).train(np.concatenate(parts), np.array(at), lambda step, share: 0.008 * min(1, step / 50) * (1 - 0.9 * share), scoring.rounds)


def _trained(tokens: DataFrame, sent) -> DataFrame:
    """Pieces of the weights that all training texts of a partition, each window once, have trained further: partition, piece, windows' subwords as weight, bytes."""

    def run(batches):
        model = sent.value
        own = lm.Model(model.lex, lm.Net(*[p.copy() for p in model.net.parts()]), model.prior, model.of_class)
        trainer, trained = lm.Trainer(own), 0
        for ids, first in _blocks(batches):
            trainer.train(ids, first, lambda step, _: 0.004 * min(1, step / 20) / (1 + step / 200) ** 0.5, batch=256)
            trained += len(ids)
        if trained:
            flat = np.concatenate([p.ravel() for p in own.net.parts()])
            for k in range(0, len(flat), PIECE):
                yield _rows(part=np.array([TaskContext.get().partitionId()], np.int64), piece=np.array([k // PIECE]), n=np.array([trained]), data=pa.array([flat[k : k + PIECE].tobytes()], pa.binary()))

    return tokens.select("data").mapInArrow(run, WEIGHTS)


def _averaged(weights: DataFrame, net: lm.Net) -> lm.Net:
    """The mean of the partitions' weights, by subwords trained on, up a tree: a task reads FAN pieces of bounded size, however many partitions there are."""

    def mean(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total, n = 0.0, pdf["n"].sum()
        for own, data in pdf.sort_values("part")[["n", "data"]].itertuples(index=False):
            total = total + np.frombuffer(data, np.float32).astype(np.float64) * (own / n)
        return pd.DataFrame({"part": [key[0]], "piece": [key[1]], "n": [n], "data": [total.astype(np.float32).tobytes()]})

    last = weights.agg(F.max("part")).first()[0]
    if last is None:
        return net
    while True:
        weights = kept(weights.groupBy(F.floor(F.col("part") / FAN).alias("up"), "piece").applyInPandas(mean, WEIGHTS), "lm-means")
        last //= FAN
        if not last:
            break
    flat, at, parts = np.concatenate([np.frombuffer(r["data"], np.float32) for r in weights.orderBy("piece").collect()]), 0, []
    for p in net.parts():
        parts.append(flat[at : at + p.size].reshape(p.shape).copy())
        at += p.size
    return lm.Net(*parts)


def _model(tokens: DataFrame, training: DataFrame, scoring: Scoring) -> lm.Model:
    """Fitted on all training texts: the prior by counting, the net by gradients, every partition from the same first weights, which are then averaged."""
    alone = columns(tokens.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")))  # a row for each subword at most
    counts = np.zeros(lm.SIZE, np.int64)
    counts[alone["a"]] = alone["n"]
    rank, row, rows = lm.ranked(counts)
    blocks = tokens.filter("kind = 2")
    cells = columns(_paired(blocks, rank, row, rows))  # as many as the table has, at most
    table = np.zeros(rows * len(row), np.float32)
    table[cells["a"]] = cells["n"]
    model = lm.Model.start(*lm.lexicon(rank, row, table.reshape(rows, len(row))))
    _started(training, int(blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), model, scoring)
    weights = kept(_trained(blocks, training.sparkSession.sparkContext.broadcast(model)), "lm-weights")
    return lm.Model(model.lex, _averaged(weights, model.net), model.prior, model.of_class)


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", scoring: Scoring = Scoring()) -> DataFrame:
    """For each row of docs: key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``; scores are log10 probabilities.

    Null text is empty and still has its end. Rows whose crc32 of the key (null: of empty text) falls in the held-out fold train nothing. Repeated rows
    are counted and scored each. Other columns are ignored; an empty table gives no rows, and without training rows nothing is known.
    """
    spark = docs.sparkSession
    text_key = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    fold = F.crc32(text_key.cast("binary")) % scoring.folds
    rows = docs.select(F.col(f"`{key}`").alias("id"), text_key.alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), (fold == scoring.held_out).alias("held_out"))
    training = rows.filter(~F.col("held_out"))
    tokens = kept(_tokens(training, scoring), "lm-tokens")
    counts = kept(tokens.filter("kind = 0").groupBy(F.col("a").alias("h")).agg(F.sum("n").alias("c")), "lm-words")
    known, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    top = columns(frequent(counts, "c", scoring.frequent))
    model = _model(tokens, training, scoring)
    logs = np.log10((top["c"].astype(np.float64) + 1) / (total + known + 1.0))
    sent = spark.sparkContext.broadcast((model, top["h"].astype(np.int64).view(np.uint64), logs))

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")
    every = kept(_scores(numbered, sent, scoring), "lm-scores")
    whole = every.filter(F.col("h").isNull()).drop("h")
    c = F.coalesce("c", F.lit(0))
    rare = every.filter(F.col("h").isNotNull()).select("row", "h", "n").join(counts, "h", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10((c + 1) / F.lit(total + known + 1.0))).alias("_base"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("_known"))
    out = whole.join(rare, "row", "left")
    return out.select(
        F.col("id").alias(key), "held_out", F.col("n").alias("n_tokens"), (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), "score",
    )


def _scores(numbered: DataFrame, sent, scoring: Scoring) -> DataFrame:
    """For each row of numbered(row, id, held_out, text) a row with null ``h``: tokens, and what the sent words and the model give. Beside it a row for each of its words that isn't sent: its hash ``h`` and how often it stands there."""

    def run(batches):
        model, frequent, logs = sent.value
        subwords, places, logs = lm.Subwords(_path(scoring)), words.Places(frequent), np.r_[logs, 0.0]

        def look(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = places.find(h)
            return at >= 0, logs[at]

        end_hit, end_log = look(np.array([END_WORD]))
        for batch in batches:
            row, ids_of, held = batch.column("row").to_numpy(zero_copy_only=False), batch.column("id"), batch.column("held_out")

            def out(at, h, n, n_known, base, score, row=row, ids_of=ids_of, held=held):
                at_ = pa.array(at, pa.int64())
                return _rows(row=row[at], h=h, n=n.astype(np.int64), n_known=n_known.astype(np.int64), base=base, score=score, id=ids_of.take(at_), held_out=held.take(at_))

            for begin, end, found in words.blocks(batch.column("text"), 1 << 20):
                h, count = found.hashes(), end - begin
                text_of = np.repeat(np.arange(count), np.diff(found.first))
                hit, log = look(h)
                base = np.bincount(text_of[hit], log[hit], count) + (end_log[0] if end_hit[0] else 0.0)
                n_known = np.bincount(text_of[hit], minlength=count) + int(end_hit[0])
                ids, first = _ids(found, subwords, h)
                score = np.add.reduceat(model.score(ids, first), first[:-1])
                yield out(np.arange(begin, end), pa.nulls(count, pa.int64()), np.diff(found.first) + 1, n_known, base, score)
                rare_of, rare_h = text_of[~hit], h[~hit]
                if not end_hit[0]:
                    rare_of, rare_h = np.r_[rare_of, np.arange(count)], np.r_[rare_h, np.full(count, END_WORD)]
                if len(rare_h):
                    order = np.lexsort((rare_h, rare_of))
                    o, w = rare_of[order], rare_h[order]
                    new = np.r_[True, (o[1:] != o[:-1]) | (w[1:] != w[:-1])]
                    times, m = np.diff(np.r_[np.flatnonzero(new), len(o)]), int(new.sum())
                    yield out(begin + o[new], pa.array(w[new].view(np.int64)), times, np.zeros(m), np.zeros(m), np.zeros(m))

    kind = dict(numbered.dtypes)["id"]
    return numbered.mapInArrow(run, f"row long, h long, n long, n_known long, base double, score double, id {kind}, held_out boolean")
