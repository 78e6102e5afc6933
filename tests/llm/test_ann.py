import numpy as np
import pyarrow as pa
import pytest

from snapledger.llm import ann
from snapledger.llm.queries import op9_nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, id string, v string"


def brute(rows, wanted, k=5):
    use = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            use.setdefault(i, []).append(np.float32(v).astype(np.float64))
    out = {}
    for q, vs in use.items():
        if not wanted(q):
            continue
        best = []
        for i, xs in use.items():
            if i != q:
                best.append((-max(float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))) for a in vs for b in xs), i))
        out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in best)[:k]]
    return out


def run(spark, rows, condition="id % 50 = 0", **options):
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], SCHEMA).repartition(3)
    got = {}
    for r in ann.nearest(df, condition, **options).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def test_odd_rows_take_no_part_and_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    rows += [(i, rows[0][1]) for i in range(200, 230)]  # copies of a query's vector
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0] * 7 + [None]), (304, [float("nan")] + [1.0] * 7), (305, [float("inf")] + [1.0] * 7), (306, [1.0, 2.0]), (None, [1.0] * 8)]
    rows += [rows[3], (350, [x * 1e-30 for x in rows[7][1]]), (400, [x * 1e30 for x in rows[9][1]])]
    got, wanted = run(spark, rows), brute([r for r in rows if r[0] != 306], lambda i: i % 50 == 0)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in wanted.items()}
    for q in wanted:
        assert np.allclose([s for _, s in got[q]], [s for _, s in wanted[q]], atol=1e-12)


def test_few_or_no_candidates(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0, 0.0])]) == {}
    assert [i for i, _ in run(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1])])[0]] == [2, 1]


def test_long_lists_are_dealt_over_chunks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(300)] + [(i, [float(x) for x in rng.normal(size=3)]) for i in range(300, 600)]
    got = run(spark, rows, index=ann.Index(rows=32, chunk=16))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [i for i, _ in got[50]] == [0, 1, 2, 3, 4]


def recall(got, x):
    """Share of the true neighbours found; row i of x has id i, scaled to unit length."""
    found = 0
    for q, near in got.items():
        s = x @ x[q]
        s[q] = -2
        found += len({i for i, _ in near} & set(np.argsort(-s, kind="stable")[:5].tolist()))
    return found / (5 * len(got))


def test_recall_of_the_query(spark):
    pdf = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").toPandas()
    assert pdf["vec_id"].tolist() == list(range(len(pdf)))
    got = {}
    for r in op9_nearest_neighbours(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert len(got) == len(pdf) // 50 and recall(got, ann.unit(np.stack(pdf["embedding"].to_numpy()))) >= 0.95


@pytest.mark.parametrize("clusters", [0, 300])
def test_recall_on_many_lists_without_reading_most(spark, clusters):
    """51,200 made vectors, 512 lists, read as registered: in no direction in particular, the hardest case, and in clusters."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(51_200, 64))
    if clusters:
        x = 0.3 * x + rng.normal(size=(clusters, 64))[rng.integers(clusters, size=len(x))]
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float64()))}))
    got = {}
    for r in ann.nearest(df, "id % 400 = 0").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert len(got) == 128 and recall(got, ann.unit(x)) >= (0.9 if not clusters else 0.97)
    index = ann.INDEX
    graph = ann.Graph(ann.halved(ann.unit(x), 512, np.random.default_rng(7)), index.degree, index.beam)
    read, _ = graph.lists(ann.unit(x[::400]), int(np.ceil(index.probes * 512**index.power)), index.ratio, False)
    assert len(read) / 128 <= (90 if not clusters else 30)  # of 512: the ratio prunes where there is something to prune by


def test_queries_that_find_too_few_read_all_lists(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(256)]
    got = run(spark, rows, k=60, index=ann.Index(rows=1, probes=0.01))  # 32 lists, of which a query reads one
    wanted = brute(rows, lambda i: i % 50 == 0, 60)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in wanted.items()}


def test_repeated_ids_leave_room_for_others(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    rows = rows * 3 + [(7, [x + 1e-3 * j for x in rows[0][1]]) for j in range(1, 8)]  # and one id with many vectors near a query's
    got, wanted = run(spark, rows, "id % 20 = 0"), brute(rows, lambda i: i % 20 == 0)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in wanted.items()}


def test_recall_holds_with_2048_lists(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(16_384, 32)).tolist())]
    got = run(spark, rows, "id % 200 = 0", index=ann.Index(rows=8))
    assert len(got) == 82 and recall(got, ann.unit(np.float32([v for _, v in rows]))) >= 0.95
