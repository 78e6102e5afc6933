"""The quality classifier and the language model: accuracy, exact parts, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapledger.llm import lm, lm_scoring, quality, words
from snapledger.llm.lm_scoring import Scoring

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score string, n string"


def test_quality_against_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.scored(docs).join(labels, "doc_id").select("quality", "keep").toPandas()
    assert ((got["quality"] == 1) == got["keep"]).mean() > 0.97
    assert (got["keep"][got["quality"] == 1]).mean() > 0.98
    left = quality.kept_documents(docs)
    assert left.columns == docs.columns and left.count() == quality.scored(docs).filter("keep").count()


def test_quality_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Word."), (5, "a fine day. " * 40_000), (6, "x x x x x x x x x x x x x x"), (6, "x x x x x x x x x x x x x x"), (None, "Quite good words here.")]
    df = spark.createDataFrame([(k, t, "clash", "clash") for k, t in rows], DOCS)
    got = quality.scored(df).collect()
    assert len(got) == len(rows) and all(not x["keep"] and x["score"] == 0 for x in got if x["doc_id"] in (1, 2, 3))
    assert quality.scored(df.limit(0)).collect() == []


def test_copies_of_a_text_dont_crowd_others_out(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality, "train", lambda x, y, fit: (sizes.append(len(x)), (np.zeros(x.shape[1], np.float32), 0.0))[1])
    texts = ["the same text again"] * 300 + [f"other{i} words stand{i * 7} here" for i in range(30)]
    quality.fitted(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), fit=quality.Fit(sample=330))
    hot = next(s for s in range(1000) if _hash(spark, "the same text again", s) < 0.05)
    quality.fitted(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), fit=quality.Fit(sample=100, seed=hot))
    others = sum(_hash(spark, t, hot) < 100 / 330 for t in texts[300:])
    assert sizes == [31, 1 + others]


def test_sample_reaches_the_driver_as_one_matrix(spark, monkeypatch):
    """No Python object for each row of the sample, and rows in one order, however they were dealt."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    monkeypatch.setattr(type(df), "toPandas", lambda self: pytest.fail("rows as objects"))
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, y, fit: (seen.append((x, y)), (np.zeros(x.shape[1], np.float32), 0.0))[1])
    for parts in (1, 5):
        quality.fitted(df.repartition(parts))
    assert seen[0][0].shape[1] == quality.BUCKETS and len(seen[0][0]) == df.distinct().count()
    assert all(np.array_equal(a, b) for a, b in zip(*seen, strict=True))


def _hash(spark, text, seed):
    return spark.range(1).select(F.pmod(F.xxhash64(F.lit(text), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)).first()[0]


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    right = rng.random((20_000, len(quality.LABELLERS))) < 0.9
    votes = np.where(right == good[:, None], quality.GOOD, quality.JUNK)
    votes[rng.random(votes.shape) < 0.3] = quality.NOTHING
    patterns, counts = np.unique(quality.codes(votes), return_counts=True)
    share, table, posterior = quality.estimate(patterns, counts.astype(float), 100)
    assert abs(share - 0.8) < 0.02 and np.abs(table[:, 1, quality.GOOD] - 0.63).max() < 0.03
    by = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    assert np.mean([(by[c] > 0.5) == g for c, g in zip(quality.codes(votes).tolist(), good, strict=True)]) > 0.97


def base(rows):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    c = Counter(w for k, t in rows if not held(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted(((k, held(k), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for k, t in rows), key=str)


@pytest.mark.parametrize("frequent", [500_000, 20, 0])
def test_base_scores(spark, frequent):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 60").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs] + [(100, None), (101, ""), (None, "The the"), (102, "one"), (102, "one"), (103, "É é\x0bx\x1cy Ωω " * 2000)]
    df = spark.createDataFrame([(k, t, "clash", "clash") for k, t in rows], DOCS).repartition(3)
    got = lm_scoring.scored(df, scoring=Scoring(frequent=frequent, start=30)).collect()
    assert sorted(((x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got), key=str) == base(rows)
    assert all(math.isfinite(x["score"]) and x["score"] < 0 for x in got)


def test_no_rows_and_no_training_rows(spark):
    df = spark.createDataFrame([], DOCS)
    assert lm_scoring.scored(df).collect() == []
    k = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = lm_scoring.scored(spark.createDataFrame([(k, "a b", "c", "c")], DOCS)).first()
    assert (got["train_tokens"], got["n_known"], got["base_score"], got["held_out"]) == (0, 0, 0.0, True)


def test_windows_score_each_place_once():
    for sizes in ([1], [31, 32, 33], [56, 57, 100, 1, 200]):
        first = np.r_[0, np.cumsum(sizes)]
        ids = np.arange(first[-1]) % 1000
        for stride in (lm.STRIDE, lm.WINDOW):
            x, target = lm.windows(ids, first, stride)
            assert sorted(target[target >= 0].tolist()) == list(range(first[-1]))
            for w, t in zip(x, target, strict=True):
                for place, to in enumerate(t):
                    if to >= 0:
                        assert w[place] == (lm.END if to in first else ids[to - 1])


def test_later_windows_see_what_stands_before():
    """The first scored place of every window after the first has 9 ids before it at least."""
    x, target = lm.windows(np.arange(500) % 400, np.array([0, 500]))
    assert all(np.flatnonzero(t >= 0)[0] >= 8 for t in target[1:])


def _ids(texts):
    subwords = lm.Subwords(lm_scoring._path(Scoring()))
    (found,) = [w for _, _, w in words.blocks(pa.array(texts))]
    return lm_scoring._ids(found, subwords, found.hashes())


def _model(texts, table=lm.TABLE, seed=1):
    """A model whose prior is counted over texts, with random weights."""
    ids, first = _ids(texts)
    old, lm.TABLE = lm.TABLE, table
    try:
        rank, row, rows = lm.ranked(np.bincount(ids, minlength=lm.SIZE))
    finally:
        lm.TABLE = old
    model = lm.Model.start(*lm.lexicon(rank, row, lm.pairs(rank, row, rows, ids, first).reshape(rows, len(row)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    for p in model.net.parts():
        p += rng.normal(size=p.shape).astype(np.float32) * 0.3
    return model


def plain_distribution(model, before):
    """P of every id after the ids before it (a window's, the first an END), spelled out place by place."""
    lex, net = model.lex, model.net
    e = [net.e[lex.place[i]].astype(float) + net.p[k] for k, i in enumerate(before)]
    q, k, v = ([x @ net.a[:, i * lm.WIDTH : (i + 1) * lm.WIDTH] for x in e] for i in range(3))
    weights = [math.exp(float(q[-1] @ y) / math.sqrt(lm.WIDTH)) for y in k]
    seen = sum(w * y for w, y in zip(weights, v, strict=True)) / sum(weights)
    z = np.maximum(np.concatenate([e[-1], e[-2] if len(e) > 1 else np.zeros(lm.WIDTH), seen]) @ net.w + net.c, 0)
    row = lex.row[lex.place[before[-1]]]
    of_class = [float(model.of_class[row, c]) * math.exp(float(z @ net.o[:, c])) for c in range(len(lex.begin) - 1)]
    out = np.zeros(lm.SIZE)
    by_place = np.zeros(lex.size)
    for c in range(len(of_class)):
        a, b = lex.begin[c], lex.begin[c + 1]
        own = [float(model.prior[c][row, k - a]) * math.exp(float(z @ net.r[k])) for k in range(a, b)]
        by_place[a:b] = np.array(own) / sum(own) * of_class[c] / sum(of_class)
    for i in range(lm.SIZE):
        out[i] = by_place[lex.place[i]] / lex.lacking[lex.place[i]]
    return out


CORPUS = ["The cat sat on the mat.", "", "A dog, a cat and a mat " * 9, "quartz", "the " * 31]


@pytest.mark.parametrize("table", [lm.TABLE, 120])
def test_scores_against_plain_distributions(table):
    """Every subword's score, its windows cut by hand, against a distribution that is spelled out and sums to one."""
    model = _model(CORPUS, table)
    ids, first = _ids(["the mat sat on a dog and Xylophones " * 6, "", "cat"])
    got = model.score(ids, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        for i in range(a, b):
            at = i - a
            begin = 0 if at < lm.WINDOW else -(-(at - lm.WINDOW + 1) // lm.STRIDE) * lm.STRIDE
            own = [lm.END, *ids[a:i].tolist()][begin : at + 1]
            every = plain_distribution(model, own)
            assert abs(every.sum() - 1) < 1e-4
            assert abs(got[i] - math.log10(every[ids[i]])) < 1e-4


def test_nothing_ahead_is_seen():
    model = _model(CORPUS)
    ids, first = _ids(["the cat and the dog sat on the mat and on the quartz " * 3])
    changed = ids.copy()
    changed[20:-1] = ids[5]
    assert np.allclose(model.score(ids, first)[:20], model.score(changed, first)[:20])


def test_gradients():
    model = _model(CORPUS)
    model.net = lm.Net(*[p.astype(np.float64) for p in model.net.parts()])
    model.prior = [p.astype(np.float64) for p in model.prior]
    model.of_class = model.of_class.astype(np.float64)
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, model.lex.size, (3, lm.WINDOW)), rng.integers(0, model.lex.size, (3, lm.WINDOW))
    on = rng.random((3, lm.WINDOW)) < 0.7
    places, grads, _ = model.gradients(x, y, on)
    for k, p in enumerate(model.net.parts()):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in (p.shape if k else (len(places), lm.WIDTH)))
            own = at if k else (places[at[0]], at[1])
            p[own] += 1e-6
            up = model.gradients(x, y, on)[2]
            p[own] -= 2e-6
            down = model.gradients(x, y, on)[2]
            p[own] += 1e-6
            assert abs((up - down) / 2e-6 - grads[k][at]) < 1e-5 * max(1, abs(grads[k][at])), k


def test_scoring_computes_only_places_it_scores(monkeypatch):
    """What later windows share with the one before is context: no hidden layer is computed there, and what is computed is forward's."""
    model = _model(CORPUS)
    x = model.lex.place[np.random.default_rng(6).choice(_ids(CORPUS)[0], (5, lm.WINDOW))]
    whole = model.net.forward(x)[-1].reshape(5, lm.WINDOW, lm.HIDDEN)
    for skip in (0, 1, lm.WINDOW - lm.STRIDE):
        assert np.allclose(lm.Known(model.net).hidden(x, skip), whole[:, skip:].reshape(-1, lm.HIDDEN), atol=1e-4)
    rows, real = [], lm.Known.hidden
    monkeypatch.setattr(lm.Known, "hidden", lambda self, x, skip=0: rows.append(len(x) * (lm.WINDOW - skip)) or real(self, x, skip))
    ids, first = _ids(["the mat sat on a dog " * 60, "cat"])
    model.score(ids, first)
    later = -(-(first[1] - lm.WINDOW) // lm.STRIDE)
    assert sum(rows) == 2 * lm.WINDOW + later * lm.STRIDE


def test_gradients_in_chunks(monkeypatch):
    model, rng = _model(CORPUS), np.random.default_rng(8)
    x, y = rng.integers(0, model.lex.size, (7, lm.WINDOW)), rng.integers(0, model.lex.size, (7, lm.WINDOW))
    on = rng.random((7, lm.WINDOW)) < 0.7
    places, whole, loss = model.gradients(x, y, on)
    passed, real = [], lm.Net.forward
    monkeypatch.setattr(lm.Net, "forward", lambda self, x: passed.append(len(x)) or real(self, x))
    monkeypatch.setattr(lm, "BACKWARD", 3)
    got = model.gradients(x, y, on)
    assert passed == [3, 3, 1] and (got[0] == places).all() and abs(got[2] - loss) < 1e-5
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(got[1], whole, strict=True))


def test_words_are_remembered(monkeypatch):
    """Words known, new or forgotten are cut as they are alone, and no word is cut twice while it is known."""
    subwords, learnt, real = lm.Subwords(lm_scoring._path(Scoring())), [], lm.Subwords._learn
    monkeypatch.setattr(lm.Subwords, "_learn", lambda self, spelled: learnt.append(len(spelled)) or real(self, spelled))
    for text in ("the mat sat", "mat, sat the mat", "the mat sat mat,", "quartz a\u00a0b the " * 3):
        (found,) = [w for _, _, w in words.blocks(pa.array([text]))]
        got, first = lm_scoring._ids(found, subwords, found.hashes())
        alone = [subwords.encode(" " + w) for w in text.split(" ") if w]
        assert got.tolist() == [*sum(alone, []), lm.END] and first.tolist() == [0, len(got)]
    assert learnt == [3, 1, 2]
    monkeypatch.setattr(lm, "KNOWN", 2)
    (found,) = [w for _, _, w in words.blocks(pa.array(["sat the"]))]
    assert lm_scoring._ids(found, subwords, found.hashes())[0].tolist() == [*subwords.encode(" sat"), *subwords.encode(" the"), lm.END]
    assert learnt == [3, 1, 2, 2] and len(subwords.keys) == 2


def test_new_words_are_spelled_at_once():
    """One call for all new words of a block, none for those known, however many there are."""
    subwords, calls = lm.Subwords(lm_scoring._path(Scoring())), []
    texts = [" ".join(f"w{i} É{i}" for i in range(3_000)), None, "", "w7\x0bw7 x\u2003y " + "z" * 5_000]
    for _ in range(2):
        (found,) = [w for _, _, w in words.blocks(pa.array(texts))]
        every = [w.decode() for i in range(len(texts)) for w in found.text(i)]
        assert found.spelled(np.arange(len(every))) == every and found.spelled(np.arange(0)) == []
        got, first = subwords.cut(found.hashes(), lambda which, found=found: calls.append(len(which)) or found.spelled(which))
        assert [got[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [subwords.encode(" " + w) for w in every]
    assert calls == [len(set(every))]


def test_places_of_clashing_hashes():
    """Hashes that share their first bits, and the table's last cells, are told apart; the table grows."""
    rng = np.random.default_rng(3)
    h = np.unique(np.r_[np.arange(300, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(300, dtype=np.uint64), rng.integers(0, 2**63, 100_000).astype(np.uint64) * np.uint64(2)])
    h = rng.permutation(h)
    known, places = h[: len(h) // 2], words.Places()
    assert (places.find(h) == -1).all()
    for part in np.array_split(known, 7):
        places.add(part)
    assert (places.keys == known).all() and (places.find(known) == np.arange(len(known))).all() and (places.find(h[len(known) :]) == -1).all()
    assert len(places.find(h[:0])) == 0 and (words.Places(known).find(h) == places.find(h)).all()


def test_hashes_byte_by_byte():
    """Sums over a word's bytes alone, whatever white space stands around it, in words beyond 4,096 bytes, too."""
    texts = [" a\t\tB ", None, "é" * 3_000 + " " * 9_000 + "Q", "", "x\x0ey"]
    (found,) = [w for _, _, w in words.blocks(pa.array(texts))]
    step, wrap = int(words._STEP), (1 << 64) - 1
    for h, w in zip(found.hashes().tolist(), [w for i in range(len(texts)) for w in found.text(i)], strict=True):
        own = sum((b + 1) * int(words._PLACES[k % 4096]) + (k // 4096 * step * b if len(w) > 4096 else 0) for k, b in enumerate(w)) + len(w) * step
        assert h == int(words.mix(np.array([own & wrap], np.uint64))[0])


def test_untrained_model_is_its_prior():
    ids, first = _ids(CORPUS)
    rank, row, rows = lm.ranked(np.bincount(ids, minlength=lm.SIZE))
    pairs = Counter(zip([lm.END if i in first else ids[i - 1] for i in range(len(ids))], ids.tolist(), strict=True))
    counts = lm.pairs(rank, row, rows, ids, first).reshape(rows, len(row))
    model = lm.Model.start(*lm.lexicon(rank, row, counts.astype(np.float32)))
    alone, begun = Counter(ids.tolist()), Counter(b for b, _ in pairs.elements())
    total = sum(alone.values()) + 0.02 * (len(alone) + 1)
    wanted = [(pairs[b, w] + lm.PRIOR * (alone[w] + 0.02) / total) / (begun[b] + lm.PRIOR) for b, w in zip([lm.END if i in first else ids[i - 1] for i in range(len(ids))], ids.tolist(), strict=True)]
    assert np.allclose(model.score(ids, first), np.log10(wanted), atol=1e-4)


def test_model_beats_base_on_held_out_documents(spark):
    got = lm_scoring.scored(spark.read.parquet(f"{DATA}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1], got


def test_every_training_text_trains(spark):
    """All subwords of all training texts are in the blocks that train, the counts and the prior's table."""
    texts = [f"plain words of text {i}" for i in range(40)] + ["zebra quartz " * 20, "", "plain words of text 3"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    tokens = lm_scoring._tokens(rows, Scoring()).cache()
    ids, first = _ids(texts)
    blocks = tokens.filter("kind = 2")
    assert blocks.agg(F.sum("a"), F.sum("n")).first() == (len(ids), len(texts))
    counts = {r["a"]: r["n"] for r in tokens.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).collect()}
    assert counts == Counter(ids.tolist())
    rank, row, rows_ = lm.ranked(np.bincount(ids, minlength=lm.SIZE))
    cells = lm.pairs(rank, row, rows_, ids, first)
    assert {r["a"]: r["n"] for r in lm_scoring._paired(blocks, rank, row, rows_).collect()} == {int(i): int(cells[i]) for i in np.flatnonzero(cells)}
    model = _model(texts)
    trained = lm_scoring._trained(blocks, spark.sparkContext.broadcast(model))
    assert trained.filter("piece = 0").agg(F.sum("n")).first()[0] == len(ids)


def test_weights_are_averaged_up_a_tree(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FAN", 2)
    model = _model(CORPUS)
    size = sum(p.size for p in model.net.parts())
    rng = np.random.default_rng(2)
    flats, n = rng.normal(size=(7, size)).astype(np.float32), rng.integers(1, 50, 7)
    step = 1000
    monkeypatch.setattr(lm_scoring, "PIECE", step)
    rows = [(p, k // step, int(n[p]), flats[p, k : k + step].tobytes()) for p in range(7) for k in range(0, size, step)]
    net = lm_scoring._averaged(spark.createDataFrame(rows, lm_scoring.WEIGHTS), model.net)
    assert np.allclose(np.concatenate([p.ravel() for p in net.parts()]), (flats * n[:, None]).sum(0) / n.sum(), atol=1e-5)
    assert lm_scoring._averaged(spark.createDataFrame([], lm_scoring.WEIGHTS), model.net) is model.net


def test_first_weights_come_from_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm.Trainer, "train", lambda self, ids, *_, **__: seen.append(len(ids)))
    texts = [f"word{i} " * 5_000 + "quartz" for i in range(6)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for scoring in (Scoring(), Scoring(characters=70_000), Scoring(characters=10)):  # in the second two texts fit, none is cut
        lm_scoring._started(rows, 6, _model(texts), scoring)
    n = sorted(len(_ids([t])[0]) for t in texts)
    assert seen[0] == sum(n) and 2 * n[0] <= seen[1] < 3 * n[0] and n[0] <= seen[2] <= n[-1]
