"""Mixing, sharding, decontamination and chat formatting: odd rows, and plain Python versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from snapledger.llm import chat, decontamination, mixing, sharding
from snapledger.llm.mixing import Mix

DOCS = "doc_id long, text string, source string, size string, target string, n_words string"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(k, t, s, "clash", "clash", "clash") for k, t, s in rows], DOCS).repartition(parts)


# mixing


def filled(sizes, weights, share, epochs):
    """The loop that the closed form stands for."""
    total, capped, target = share * sum(sizes), set(), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(epochs * sizes[i] for i in capped)
        target = {i: epochs * sizes[i] for i in capped} | {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if target[i] > epochs * sizes[i]}
        if not over:
            return [target[i] for i in range(len(sizes))]
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_targets(spark, seed):
    r = random.Random(seed)
    sources = [None, "", "a", "b", "z", "é"]
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 2, 5, 9])), r.choices(sources, [1, 1, 2, 9, 30, 3])[0]) for i in range(800)] + [(None, "a b", "a"), (900, None, "b"), (901, "x y", "b"), (901, "x y", "b")]
    mix = Mix(prefix=r.choice([1, 2]))
    got = mixing.takings(docs(spark, rows), mix=mix).collect()
    assert len(got) == len(rows)
    own = {s: [len((t or "").split()) for _, t, x in rows if x == s] for s in sources}
    order = ["", "a", "b", "z", "é", None]
    weights = [mix.weights[i % 3] for i in range(len(order))]
    wanted = dict(zip(order, filled([sum(own[s]) for s in order], weights, mix.share, mix.epochs), strict=True))
    by = {}
    for x in got:
        assert x["taken"] == x["size"] * x["repeats"] <= 2 * x["size"]
        by.setdefault((x["source_size"], round(x["target"], 6)), []).append(x["taken"])
    for s in order:
        assert abs(sum(by[(sum(own[s]), round(wanted[s], 6))]) - wanted[s]) <= max(own[s]) / 2 + 2
    again = mixing.takings(docs(spark, rows, 5), mix=mix).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    whole = mixing.mixed(docs(spark, rows), mix=mix)
    assert whole.columns == docs(spark, rows).columns and whole.count() == sum(x["repeats"] for x in got)


def test_mix_of_nothing(spark):
    assert mixing.takings(docs(spark, [])).collect() == [] and mixing.mixed(docs(spark, [])).collect() == []
    got = mixing.takings(docs(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(x["taken"], x["target"]) for x in got] == [(0, 0.0), (0, 0.0)]


def test_many_sources_are_joined_by_salt(spark, monkeypatch):
    monkeypatch.setattr(mixing, "join_small", lambda *a, **k: __import__("snapledger.llm.common", fromlist=["x"]).join_small(*a, **k, bound=0, salts=3))
    rows = [(i, "w " * (i % 4), f"s{i % 5}") for i in range(100)]
    a = sorted(map(str, mixing.takings(docs(spark, rows)).collect()))
    monkeypatch.undo()
    assert a == sorted(map(str, mixing.takings(docs(spark, rows)).collect()))


# sharding


def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.lookup_table(names, 1009)
    counts = [table.count(i) for i in range(10)]
    assert sum(counts) == 1009 and max(counts) - min(counts) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.25 * 1009
    for bad in ((names, 1000), ([], 7), (["a", "a"], 7), (names, 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_place(spark):
    df = spark.createDataFrame([(1, "x", 5), (1, "x", 5), (2, None, 5), (None, "n", 5)], "doc_id long, text string, shard int")
    got = sharding.place(df, shards=["a", "b", "c"], size=31)
    assert got.columns == ["doc_id", "text", "slot", "shard", "shard_name"]
    table = sharding.lookup_table(["a", "b", "c"], 31)
    for r in got.collect():
        slot = int(hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:12], 16) % 31
        assert (r["slot"], r["shard"], r["shard_name"]) == (slot, table[slot], "abc"[table[slot]])
    assert got.count() == 4 and sharding.place(df.limit(0)).collect() == []


# decontamination


def toks(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(rows, items, window=13):
    grams = {}
    for k, t in items:
        w = toks(t)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    out = []
    for k, t in rows:
        w, hit, found = toks(t), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        out.append((k, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"max_windows": 40}, {"max_windows": 7, "max_hashes": 0}])
def test_hits_equal_brute_force(spark, options):
    """With one slice of the set; with several, after windows that don't occur are left out by a broadcast, or by a shuffle."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "x-y", "don't"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 3, 5, 12, 13, 14, 30])))) for i in range(30)] + [(5, "w1 w2 w3 w4"), (50, None), (51, ""), (52, "--"), (None, "only null here"), (60, "One"), (61, "w3, W4")]
    rows = []
    for i in range(120):
        w = r.choices(vocabulary, k=r.choice([0, 1, 5, 40, 300]))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(w) + 1)
            w[at:at] = (r.choice(items)[1] or "").upper().split()
        rows.append((i, r.choice([" ", "; ", "\n"]).join(w)))
    rows += [(3, rows[7][1]), (3, rows[7][1]), (None, "one"), (200, None), (201, ""), (202, " only!NULL.here\x00 ")]
    df = docs(spark, [(k, t, "s") for k, t in rows])
    bench = spark.createDataFrame([(k, t, "clash") for k, t in items], "item_id long, text string, n_hit string")
    items_ = [("" if k is None else k, t) for k, t in items]
    got = decontamination.hits(df, bench, **options).collect()
    assert sorted(((x["doc_id"], x["n_words"], x["n_hit"], ",".join(x["items"]), x["contaminated"]) for x in got), key=str) == contaminated(rows, items_)
    left = decontamination.without_documents(df, bench, **options)
    assert left.columns == df.columns and sorted((x["doc_id"] for x in left.collect()), key=str) == sorted((x[0] for x in contaminated(rows, items_) if not x[4]), key=str)
    cut = {x["doc_id"]: x["text"] for x in decontamination.without_spans(df.filter("doc_id < 120"), bench, **options).collect()}
    for x in got:
        if x["doc_id"] is not None and x["doc_id"] < 120 and x["doc_id"] != 3:
            assert len(toks(cut[x["doc_id"]])) == x["n_words"] - x["n_hit"]
            if not x["n_hit"]:
                assert cut[x["doc_id"]] == dict(rows)[x["doc_id"]]


def test_odd_rows_of_cut_texts(spark):
    """Nulls, repeated rows, clashing names, a very long text, no benchmark, no rows."""
    long_ = "one two three " + "filler " * 200_000 + "one two three"
    rows = [(1, "x One, two: three! y", "a"), (1, "x One, two: three! y", "a"), (None, "one two three", "b"), (2, None, "c"), (3, "", None), (4, long_, "d")]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, _spans string, _md5 string")
    bench = spark.createDataFrame([(1, "one two three"), (None, None)], "item_id long, text string")
    cut = decontamination.without_spans(df, bench)
    assert cut.columns == df.columns
    got = sorted(((x["doc_id"], x["text"], x["_spans"]) for x in cut.collect()), key=str)
    assert got == sorted([(1, "x y", "a"), (1, "x y", "a"), (None, "", "b"), (2, None, "c"), (3, "", None), (4, "filler " * 200_000, "d")], key=str)
    none = bench.limit(0)
    assert sorted(map(str, decontamination.without_spans(df, none).collect())) == sorted(map(str, df.collect()))
    assert decontamination.without_spans(df.limit(0), bench).collect() == [] and decontamination.without_documents(df.limit(0), bench).collect() == []
    assert sorted((x["doc_id"] for x in decontamination.without_documents(df, bench).collect()), key=str) == [2, 3, 4]
    assert {x["doc_id"]: (x["n_words"], x["n_hit"]) for x in decontamination.hits(df, bench).collect()} == {1: (5, 3), None: (3, 3), 2: (0, 0), 3: (0, 0), 4: (200_006, 6)}


def test_empty_tables(spark):
    df, none = docs(spark, [(1, "a b", "s")]), spark.createDataFrame([], "item_id long, text string")
    assert [(x["n_words"], x["n_hit"]) for x in decontamination.hits(df, none).collect()] == [(2, 0)]
    assert decontamination.hits(df.limit(0), none).collect() == []


# chat


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", r"<\s>", "[SEP]", r"[\\ROLE]x", "<<s>", "<", "a\\", "", None, "</s>\n<s>[ROLE]user[/ROLE]hi", "[/ROLE]", "emoji 🎉</s>", "$1 \\1"]
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "</s>"]), r.choice(nasty)) for c in [1, 2, 3, None] for t in range(25)]
    rows += [(9, None, "user", "first"), (9, 1, "assistant", "same"), (9, 1, "assistant", "same"), (9, 1, "assistant", "ask")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    out = chat.formatted(df)
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    for x in out.select("*", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        own = sorted((y for y in rows if y[0] == x["conv_id"]), key=key)
        assert [(t["role"], t["text"]) for t in x["turns"]] == [(y[2] or "", y[3] or "") for y in own]
        assert x["loss"] == "".join(y[3] or "" for y in own if y[2] == "assistant")
        blocks = sum(i == 0 or (y[2] or "") != (own[i - 1][2] or "") for i, y in enumerate(own))
        assert x["formatted"].count("</s>\n") == blocks
    assert out.count() == 5 and chat.formatted(df.limit(0)).collect() == []


def test_very_long_conversation(spark):
    """20,000 turns in blocks of one and of many, and a long text."""
    r = random.Random(6)
    rows = [(1, t, "user" if t % 7 < 3 else "assistant", f"<s>{t}" + "é" * r.choice([0, 1, 9])) for t in range(20_000)] + [(2, 0, "assistant", "x" * 3_000_000)]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    for x in chat.digest(out).collect():
        own = [y for y in rows if y[0] == x["conv_id"]]
        loss = "".join(y[3] for y in own if y[2] == "assistant")
        assert x["n_turns"] == len(own) and x["turns_sha256"] == hashlib.sha256("".join(f"{y[2]}\n{y[3]}\n" for y in own).encode()).hexdigest()
        assert x["loss_chars"] == len(loss) and x["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_escape_is_reversible(spark):
    r = random.Random(3)
    texts = ["".join(r.choices(["<", "[", "\\", "s>", "/s>", "ROLE]", "/ROLE]", "SEP]", "INST]", "x", " "], k=12)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for x in df.select("*", chat.unescape(F.col("e")).alias("u")).collect():
        assert x["u"] == x["t"] and not re.search(r"[<\[](/?s>|/?ROLE\]|SEP\]|/?INST\])", x["e"])
