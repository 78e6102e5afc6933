import random

import numpy as np
import pytest

from snapledger.llm import ngram_join, occurrence
from snapledger.llm.ngram_join import Join

SCHEMA = "doc_id long, text string, n_shingles string"
SPACE = "\x20\t\n\x0b\x0c\r"


def words_of(text):
    out, now = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            if now:
                out.append(now)
            now = ""
        else:
            now += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out


def brute(rows, k, percent):
    """Sizes and groups by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least.setdefault(root(i), []).append(key)
    return sorted(((k_, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None)) for i, (k_, _) in enumerate(rows)), key=str)


def corpus(seed, n=150):
    r = random.Random(seed)
    vocabulary = ["the", "of", "And", "ß", "é"] + [f"w{i}" for i in range(300)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.5:
            w = words_of(r.choice(rows)[1])
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            text = r.choice([" ", "\n", "\t "]).join(w).upper() if r.random() < 0.2 else " ".join(w)
        else:
            w = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 30, 60, 120]))]
            if r.random() < 0.4:
                at = r.randrange(len(w) + 1)
                w[at:at] = passage
            text = " ".join(w)
        rows.append((i * 3 + 1, text))
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (None, "w1 w2 w3 w4 w5 w6"), (9003, "w1 w2 w3 w4 w5 w6"), (None, "alone in here and nowhere else"), (1, rows[0][1])]


def run(spark, rows, join):
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in ngram_join.grouped(df, join=join).select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("seed,join", [(1, ngram_join.CONTRACT), (2, Join()), (3, Join(4, 85, block=400, pending=300)), (4, Join(2, 60, block=150, frequent=3))])
def test_groups_equal_brute_force(spark, seed, join):
    rows = corpus(seed)
    assert run(spark, rows, join) == brute(rows, join.shingle, join.percent)


def test_empty_table_and_words_only_in_nulls(spark):
    assert run(spark, [], Join()) == []
    assert run(spark, [(1, None), (2, ""), (None, None)], Join()) == [(1, 0, 1), (2, 0, 2), (None, 0, None)]


def test_long_text_is_read_to_its_end(spark):
    long_ = [f"a{i}" for i in range(30_000)]
    other = long_[:29_900] + [f"b{i}" for i in range(100)]
    far = long_[:15_000] + [f"c{i}" for i in range(15_000)]
    got = {r[0]: r[2] for r in run(spark, [(3, " ".join(long_)), (2, " ".join(other)), (1, " ".join(far))], Join())}
    assert got == {3: 2, 2: 2, 1: 1}


def test_one_of_each_keeps_the_least(spark):
    df = spark.createDataFrame([(5, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (7, "h i j k l", "z"), (8, None, "n"), (None, "h i j k l", "q")], SCHEMA)
    assert sorted((r[0] for r in ngram_join.one_of_each(df).collect()), key=str) == [2, 7, 8]


def test_one_of_each_tells_rows_apart_by_key_and_text(spark):
    """Repeated rows, several null keys, and a text of its own under the key of a copy."""
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [(2, a, "x"), (2, a, "x"), (5, a, "y"), (5, b, "own text"), (None, c, "n"), (None, c, "n"), (None, a, "m"), (9, None, "w"), (9, None, "w"), (None, "", "v")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    left = ngram_join.one_of_each(df)
    assert left.columns == df.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(2, a, "x"), (5, b, "own text"), (None, c, "n"), (9, None, "w"), (9, None, "w"), (None, "", "v")], key=str)
    assert ngram_join.one_of_each(df.limit(0)).collect() == []


def test_hot_copies_and_hubs(spark, monkeypatch):
    """A third of all rows is one text, and a star of near copies: joins of what is hot are broadcast."""
    from snapledger.llm import common

    monkeypatch.setattr(ngram_join, "join_hot", lambda *a, **k: common.join_hot(*a, **{**k, "parts": 20}))
    base_ = [f"w{i}" for i in range(40)]
    rows = [(1000 + i, " ".join(base_)) for i in range(60)] + [(i, " ".join([*base_, f"x{i}"])) for i in range(60)] + [(200 + i, " ".join(f"y{i}z{j}" for j in range(30))) for i in range(60)]
    assert run(spark, rows, Join()) == brute(rows, 5, 80)


def test_short_lists_are_merged_by_heap(monkeypatch):
    """The heap's counts are those of counting, and sets of many shingles reach it."""
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(2_000, 300, replace=False)).astype(np.uint64) for _ in range(30)]
    sets += [np.unique(np.r_[s[10:], rng.integers(0, 2_000, 10).astype(np.uint64)]) for s in sets[:10]]
    index = occurrence.Index(sorted(sets, key=len))
    merged = []
    monkeypatch.setattr(occurrence.heapq, "merge", lambda *runs: merged.append(len(runs)) or sorted(x for r in runs for x in r))
    for i in range(5, 40):
        heap = index.search(i, 0, 250)
        monkeypatch.setattr(occurrence, "HEAP", -1)
        counted = index.search(i, 0, 250)
        monkeypatch.setattr(occurrence, "HEAP", 1024)
        assert all(np.array_equal(a, b) for a, b in zip(heap, counted, strict=True))
    assert len(merged) == 35 and max(merged) > 1


@pytest.mark.parametrize("seed", range(8))
def test_forest_joins_what_pairs_join(seed):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 400, rng.integers(1, 80))).astype(np.uint64) for _ in range(12)]
    sets = []
    for _ in range(80):
        s = set(base[rng.integers(12)].tolist())
        for _ in range(rng.integers(0, 6)):
            s.discard(int(rng.integers(0, 400)))
            s.add(int(rng.integers(0, 400)))
        sets.append(np.array(sorted(s), np.uint64))
    percent = int(rng.choice([50, 70, 85, 100]))
    sides = rng.integers(0, 2, len(sets)) if seed % 2 else None

    def trees(pairs):
        up = list(range(len(sets)))
        for i, j in pairs:
            a, b = up[i], up[j]
            up = [a if x == b else x for x in up]
        return [up.index(x) for x in up]

    wanted = []
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if (sides is None or sides[i] != sides[j]) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                wanted.append((i, j))
    assert trees(occurrence.forest(sets, percent, sides)) == trees(wanted)


@pytest.mark.parametrize("percent", [40, 60, 80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    """Sets about every border between bands, each beside near copies of all sizes it could be linked with."""
    rng = np.random.default_rng(percent)
    fresh = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    sets = []
    for n in [*range(1, 40), 63, 64, 65, 127, 128, 140, 255, 256, 300, 511, 512, 1000]:
        s = fresh(n)
        sets.append(s)
        for _ in range(6):
            sets.append(np.r_[s[rng.permutation(n)[: rng.integers(percent * n // 100, n + 1)]], fresh(rng.integers(0, n * (100 - percent) // 100 + 1))])
    sets = [np.unique(s) for s in sets]
    owner, token = ngram_join.signatures(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])], np.concatenate(sets) % np.uint64(3) == 0, percent)
    own = [set(token[owner == i].tolist()) for i in range(len(sets))]
    linked = 0
    for i in range(len(sets)):
        for j in range(max(0, i - 7), i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and not np.array_equal(sets[i], sets[j]):
                linked += 1
                assert own[i] & own[j], (len(sets[i]), len(sets[j]), both)
    assert linked > 50
    assert all(len(own[i]) <= 3 * len(s) + 3 for i, s in enumerate(sets))


def test_chance_doesnt_make_candidates(spark, monkeypatch):
    """Texts put together from the same sentences share many shingles but aren't alike: few of them are searched, and the groups are right."""
    r = random.Random(5)
    pool = [" ".join(f"s{i}w{j}" for j in range(12)) for i in range(400)]
    rows = [(i, " ".join(r.sample(pool, 30))) for i in range(200)]
    rows += [(1000 + i, " ".join(rows[i][1].split()[3:])) for i in range(5)]
    found, own = {}, ngram_join.kept
    monkeypatch.setattr(ngram_join, "kept", lambda df, name: found.setdefault(name, own(df, name)))
    assert run(spark, rows, ngram_join.CONTRACT) == brute(rows, 4, 85)
    assert 10 <= found["candidates"].count() <= 20


def test_filtered_joins_equal_broadcast_ones(spark, monkeypatch):
    from snapledger.llm import common

    rows = corpus(6)
    one = lambda: sorted((r[0] for r in ngram_join.one_of_each(df).collect()), key=str)
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], SCHEMA).repartition(5)
    wanted = one()
    monkeypatch.setattr(ngram_join, "join_few", lambda *a: common.join_few(*a, bound=0))
    assert run(spark, rows, Join()) == brute(rows, 5, 80)
    assert one() == wanted
