"""Quality classifier from weak labels.

Heuristic labellers look at a document's words and vote good, junk or nothing. Expectation-maximisation over the counts
of all patterns of votes estimates the share of junk and how each labeller votes on good and on junk documents; that
gives every pattern a posterior. The posteriors label a sample, on which a linear scorer over hashed features is
trained. The scorer decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import columns, packed, released, unpacked

GOOD, JUNK, NOTHING = 2, 1, 0
#: Labellers: statistic, votes junk from or up to (by the sign of the comparison), votes good within.
LABELLERS = (
    ("bars", ">=", 0.10, (0.0, 0.01)),
    ("stutter", ">=", 0.15, (0.0, 0.03)),
    ("runs", ">=", 0.08, (0.0, 0.01)),
    ("shouting", ">=", 0.50, (0.0, 0.20)),
    ("exclaims", ">=", 0.30, (0.0, 0.03)),
    ("marks", ">=", 0.70, (0.01, 0.45)),
    ("symbols", ">=", 0.15, (0.0, 0.03)),
    ("trebles", ">=", 0.10, (0.0, 0.01)),
    ("length", "<=", 2.5, (3.5, 9.0)),
    ("stops", "<=", 0.0, (0.02, 0.40)),
)
STATISTICS = ("bars", "stutter", "runs", "shouting", "exclaims", "marks", "symbols", "trebles", "length", "stops", "digits", "count")
#: In texts of fewer words these labellers' shares say little; they vote good.
SHORT, UNSURE = 8, ("marks", "length", "stops")
#: Steps of a statistic's value for the hashed features.
STEPS = np.array([0.0, 1e-9, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1, 2, 3, 4, 5, 6, 8, 10, 15, 30, 100, 300, 1000, 3000, 10_000])
BUCKETS = 1 << 10


@dataclass(frozen=True)
class Fit:
    """sample: documents on which the scorer is fitted, about, chosen by hash. rounds, steps: of EM and of gradient descent. threshold: least score of a document that stays."""

    sample: int = 10_000
    rounds: int = 100
    steps: int = 400
    rate: float = 4.0
    decay: float = 1e-5
    threshold: float = 0.5
    seed: int = 11


def _class_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_UPPER = _class_table(bytes(range(0x41, 0x5B)))
_LETTER = _class_table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
_DIGIT = _class_table(b"0123456789")
_MARK = _class_table(bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum()))
_STOP = _class_table(b".?!")
_SYMBOL = _class_table(b"#$%&*+<=>@^_|~\\{}")


def statistics(found: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each text in a block: the STATISTICS, by column; and the codes of its words' shapes."""
    n = np.diff(found.first)
    texts = len(n)
    upto = lambda table: np.r_[0, np.cumsum(table[found.raw])]
    sums = {k: upto(t) for k, t in (("upper", _UPPER), ("letter", _LETTER), ("digit", _DIGIT), ("mark", _MARK), ("stop", _STOP))}
    word = {k: c[found.ends] - c[found.starts] for k, c in sums.items()}
    size = found.ends - found.starts
    h = found.hashes()
    of = np.repeat(np.arange(texts), n)
    again = np.r_[False, h[1:] == h[:-1]] if len(h) else np.empty(0, bool)
    again[found.first[:-1][n > 0]] = False
    third = np.r_[False, again[1:] & again[:-1]] if len(h) else again
    last_two = np.maximum(found.ends - 2, found.starts)
    single = found.raw[found.starts] if len(h) else np.empty(0, np.uint8)
    last = found.raw[found.ends - 1] if len(h) else np.empty(0, np.uint8)
    total = lambda x: np.bincount(of, x, texts)
    safe = np.maximum(n, 1)
    letters = total(word["letter"])
    columns = {
        "bars": total((size == 1) & (single == ord("|"))) / safe,
        "stutter": total(again) / safe,
        "runs": total(third) / safe,
        "shouting": total(word["upper"]) / np.maximum(letters, 1),
        "exclaims": total(last == ord("!")) / safe,
        "marks": total(word["mark"]) / safe,
        "symbols": total(_SYMBOL[last]) / safe,
        "trebles": total((_MARK[last] > 0) & (found.raw[last_two] == last) & (size > 2)) / safe,
        "length": total(size) / safe,
        "stops": total(_STOP[last]) / safe,
        "digits": total(word["digit"]) / safe,
        "count": n.astype(float),
    }
    first_upper = _UPPER[single] if len(h) else np.empty(0, np.int64)
    shape = np.minimum(size, 15) * 64 + first_upper * 32 + (word["upper"] > 1) * 16 + (word["digit"] > 0) * 8 + np.minimum(word["mark"], 3) * 2 + again
    return np.stack([columns[k] for k in STATISTICS], 1), shape


def votes(stats: np.ndarray) -> np.ndarray:
    """Votes by text and labeller; texts without words get none."""
    out = np.zeros((len(stats), len(LABELLERS)), np.int64)
    for k, (name, way, bound, (low, high)) in enumerate(LABELLERS):
        x = stats[:, STATISTICS.index(name)]
        out[(x >= low) & (x <= high), k] = GOOD
        out[x >= bound if way == ">=" else x <= bound, k] = JUNK
        if name in UNSURE:
            out[stats[:, STATISTICS.index("count")] < SHORT, k] = GOOD
    out[stats[:, STATISTICS.index("count")] == 0] = NOTHING
    return out


def codes(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[float, np.ndarray, np.ndarray]:
    """EM: the share of good documents, P(vote | class) by labeller, class (junk, good) and vote, and the posterior of good for each pattern."""
    v = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good = np.where((v == JUNK).any(1), 0.1, np.where((v == GOOD).any(1), 0.95, 0.5))
    share, table = 0.5, np.zeros((len(LABELLERS), 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        for k in range(len(LABELLERS)):
            for c in range(2):
                table[k, c] = np.bincount(v[:, k], weight[c], 3) + 1
        table /= table.sum(2, keepdims=True)
        logs = [np.log(p) + sum(np.log(table[k, c, v[:, k]]) for k in range(len(LABELLERS))) for c, p in ((0, 1 - share), (1, share))]
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return float(share), table, good


def features(stats: np.ndarray, shape: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashed features of texts, a row each: where each statistic lies among the steps, and the shares of word shapes."""
    n = len(stats)
    out = np.zeros((n, BUCKETS), np.float32)
    step = np.searchsorted(STEPS, stats, "right")
    bucket = lambda x: (words.mix(x.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    for k in range(len(STATISTICS)):
        for low in range(len(STEPS)):  # one feature for each step that is passed
            on = step[:, k] > low
            out[on, bucket(np.array([1_000_000 + k * 1000 + low]))[0]] += 0.2
    of = np.repeat(np.arange(n), np.diff(first))
    counts = np.bincount(of * BUCKETS + bucket(shape), minlength=n * BUCKETS).reshape(n, BUCKETS)
    return out + (counts / np.maximum(np.diff(first), 1)[:, None]).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, fit: Fit) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer, by gradient descent with momentum on soft labels."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    speed, speed_b = np.zeros_like(w), 0.0
    for _ in range(fit.steps if len(x) else 0):
        err = (1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) - y).astype(np.float32)
        speed = 0.9 * speed - fit.rate * (err @ x / len(x) + fit.decay * w)
        speed_b = 0.9 * speed_b - fit.rate * float(err.mean())
        w, b = w + speed.astype(np.float32), b + speed_b
    return w, b


@dataclass(frozen=True)
class Model:
    share: float
    table: np.ndarray
    posterior: dict[int, float]
    weights: np.ndarray
    bias: float
    fit: Fit


def _each(texts: pa.Array):
    for begin, end, found in words.blocks(texts, 1 << 20):
        stats, shape = statistics(found)
        yield begin, end, found.first, stats, shape


def fitted(docs: DataFrame, text: str = "text", fit: Fit = Fit()) -> Model:
    """The model of docs. Votes of all documents are counted; about ``fit.sample`` distinct texts, chosen by hash, train the scorer. No documents give a model that keeps everything with words."""
    rows = docs.select(F.col(f"`{text}`").alias("text"))

    def vote(batches):
        counts = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, _, _, stats, _ in _each(batch.column(0)):
                counts += np.bincount(codes(votes(stats)), minlength=len(counts))
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own])], ["pattern", "n"])

    counted = columns(rows.mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")))  # a row for each pattern at most
    patterns, counts = counted["pattern"].astype(np.int64), counted["n"].astype(np.int64)
    order = np.argsort(patterns)
    patterns, counts = patterns[order], counts[order]
    share, table, good = estimate(patterns, counts.astype(float), fit.rounds)
    posterior = dict(zip(patterns.tolist(), good.tolist(), strict=True))

    def sampled(batches):
        for batch in batches:
            for _, _, first, stats, shape in _each(batch.column(0)):
                x = features(stats, shape, first)
                yield pa.RecordBatch.from_arrays([pa.array(codes(votes(stats))), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["pattern", "x"])

    total = int(counts.sum())
    part = min(1.0, fit.sample / max(1, total))
    h = F.pmod(F.xxhash64("text", F.lit(fit.seed)), F.lit(1 << 30))
    some = rows.select("text", h.alias("h")).filter(F.col("h") < F.lit(int(part * (1 << 30)))).distinct()  # a text counts once, however many rows hold it
    some = some.orderBy("h", "text").limit(2 * fit.sample).select("text").repartition(rows.sparkSession.sparkContext.defaultParallelism)
    got = some.mapInArrow(sampled, "pattern long, x binary").toArrow().combine_chunks()
    order = pc.sort_indices(got, [("pattern", "ascending"), ("x", "ascending")]).to_numpy()
    x = np.empty((len(got), BUCKETS), np.float32)
    if len(got):
        data = got["x"].chunk(0)
        x[:] = np.frombuffer(data.buffers()[2], np.float16, len(got) * BUCKETS, 2 * BUCKETS * data.offset).reshape(-1, BUCKETS)[order]
    y = np.array([posterior[p] for p in got["pattern"].to_numpy()[order].tolist()], np.float32)
    del got
    released()
    weights, bias = train(x, y, fit)
    return Model(share, table, posterior, weights, bias, fit)


def judged(text: Column, model: Model, spark) -> Column:
    """Struct of ``score``, ``votes`` (a letter for each labeller: g, j or -), ``posterior`` and ``keep``. Texts without words, null ones among them, score 0 and don't stay."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,votes:string,posterior:double,keep:boolean>")
    def judge(texts: pa.Array) -> pa.Array:
        m = sent.value
        score, cast, posterior = [np.empty(0)], [], [np.empty(0)]
        for _, _, first, stats, shape in _each(texts):
            v = votes(stats)
            s = 1 / (1 + np.exp(-np.clip(features(stats, shape, first).astype(np.float64) @ m.weights.astype(np.float64) + m.bias, -50, 50)))
            s[np.diff(first) == 0] = 0
            score.append(s)
            cast += ["".join("-jg"[k] for k in row) for row in v]
            posterior.append(np.array([m.posterior.get(p, m.share) for p in codes(v).tolist()]))
        s = np.concatenate(score)
        return pa.StructArray.from_arrays([pa.array(s), pa.array(cast, pa.string()), pa.array(np.concatenate(posterior)), pa.array(s >= m.fit.threshold)], ["score", "votes", "posterior", "keep"])

    return judge(text)


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", fit: Fit = Fit()) -> DataFrame:
    """For each row of docs, repeated ones too: key, ``score`` (of being good), ``votes``, ``posterior``, ``keep``. Other columns are ignored; an empty table gives no rows."""
    model = fitted(docs, text, fit)
    out = docs.select(F.col(f"`{key}`").alias("_key"), judged(F.col(f"`{text}`"), model, docs.sparkSession).alias("_j"))
    return out.select(F.col("_key").alias(key), "_j.score", "_j.votes", "_j.posterior", "_j.keep")


def kept_documents(docs: DataFrame, text: str = "text", fit: Fit = Fit()) -> DataFrame:
    """Rows of docs that the scorer keeps, unchanged. Nothing is shuffled but counts of votes."""
    model = fitted(docs, text, fit)
    out = packed(docs).withColumn("_j", judged(F.col("_row").getField(text), model, docs.sparkSession)).filter("_j.keep")
    return out.select(*unpacked(out, docs.columns))
