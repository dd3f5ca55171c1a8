"""The pipeline's stages on a corpus with known parts, and the whole run."""

import brute
import corpus_pipeline as p
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None, 1)], docs.schema))
    state = docs
    for name, stage in p.STAGES[:-1]:
        before = state
        state = stage(spark, before, SF).cache()
        assert state.columns == docs.columns, name
        if name == "MinHash near-dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.dropDuplicates(["doc_id"]).collect()]
            want, _ = brute.near_duplicates([r for r in rows if r[0] is not None], 5, 80)
            assert sorted(r["doc_id"] for r in state.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
        if name == "quality rules":
            assert not any(brute.base_counts(r["text"])[-1] for r in state.collect())
        if name == "line dedup":
            assert state.count() == before.count() and all(r["n_chars"] == len(r["text"]) for r in state.collect())
    last = p.STAGES[-1][1](spark, state, SF)
    assert last.count() == state.count() and min(r["n_tokens"] for r in last.collect()) > 0


def test_run_and_empty_tables(spark, tmp_path):
    got = p.run(spark, SF)
    assert got.count() > 0 and set(got.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_all_corpus_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
