"""The pipeline against its stages redone by brute force, each on what the one before has kept."""

from collections import Counter

import corpus_pipeline
from snapledger.llm import mixing, quality, sharding

from .test_native import contaminated
from .test_ngram_join import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    every = rows_of(docs)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = {r["doc_id"] for r in quality.scored(docs).filter("keep").collect()}
    left = corpus_pipeline.keep_quality(spark, docs, SF)
    assert left.columns == COLUMNS and set(rows_of(left)) == good
    one = {k for k, _, c in brute([(k, every[k]["text"]) for k in sorted(good)], 5, 80) if k == c}
    left = corpus_pipeline.drop_near_copies(spark, left, SF)
    assert left.columns == COLUMNS and set(rows_of(left)) == one
    clean = {x[0] for x in contaminated([(k, every[k]["text"]) for k in one], bench) if not x[4]}
    left = corpus_pipeline.drop_contaminated(spark, left, SF)
    assert left.columns == COLUMNS and set(rows_of(left)) == clean
    times = {r["doc_id"]: r["repeats"] for r in mixing.takings(left).collect() if r["repeats"]}
    mixed = corpus_pipeline.mix_sources(spark, left, SF)
    assert mixed.columns == COLUMNS and Counter(r["doc_id"] for r in mixed.collect()) == times
    last = corpus_pipeline.run(spark, SF)
    assert last.columns == [*COLUMNS, "slot", "shard", "shard_name"]
    table = sharding.lookup_table()
    got = last.collect()
    assert Counter(r["doc_id"] for r in got) == times and all(r["text"] == every[r["doc_id"]]["text"] and r["shard"] == table[r["slot"]] for r in got)


def test_stages_name_what_they_are():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near copies", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None
