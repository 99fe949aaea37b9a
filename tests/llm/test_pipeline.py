from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from corpuscle.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kinds, n = docs.dtypes, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{shared_dir(spark)}/stage-test/{k}"
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        out = spark.read.parquet(path)
        ids, before = [r[0] for r in out.select("doc_id").collect()], {r[0] for r in docs.select("doc_id").collect()}
        assert set(ids) <= before
        if k < 4:
            assert out.dtypes == kinds
        if k < 3:
            assert len(set(ids)) == len(ids) < n  # each of these takes something out of this table
        n, docs = len(ids), out
    sizes = Counter(r["shard"] for r in docs.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1


@pytest.mark.parametrize("stage", range(5))
def test_empty_documents(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    assert corpus_pipeline.STAGES[stage][1](spark, docs, SF).count() == 0


ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n", "en", None, 2), (None, "a text without an id, and long enough to count", "en", "a", 45),
    (4, "the very same row " * 6, "en", "b", 108), (4, "the very same row " * 6, "en", "b", 108), (5, "THE very same row " * 6, "de", "b", 108),
    (6, "long words of " + " ".join(f"w{i}" for i in range(30_000)), "en", "a", 200_000), (7, "one", "en", "c", 3),
]


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, docs_of, stage):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns: each stage's rule, and no crash."""
    docs = docs_of(ODD, clash=True)
    name, apply = corpus_pipeline.STAGES[stage]
    out = apply(spark, docs, SF)
    assert out.columns[:5] == corpus_pipeline.COLUMNS and len(out.columns) == (7 if name == "sharding" else 5)
    ids = Counter(r["doc_id"] for r in out.collect())
    if name == "near_duplicates":
        assert ids == Counter([1, None, 4, 6, 7])
    elif name in ("decontamination", "sharding"):
        assert ids == Counter(r[0] for r in ODD)
    else:
        assert set(ids) <= {r[0] for r in ODD} and ids[4] != 1  # equal rows go together


def test_registered():
    assert {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in __spark_entry__.queries()
