"""The pipeline's stages, each on its own input, and the whole run."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from mediacat.llm import decontamination, jaccard

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_stages_take_effect(spark, docs):
    """Every stage keeps the columns; what it removes is gone for the next; clean rows stay as they are."""
    kept = docs
    counts = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        before = kept
        kept = P.written(stage(spark, kept, FOLDER), P.shared_folder(spark), name)
        assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
        assert kept.join(before, "doc_id", "left_anti").isEmpty()
        counts.append(kept.count())
        if name != "passages":
            assert kept.exceptAll(before).isEmpty()
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4] > 0.7 * counts[0]
    assert jaccard.link_logs(kept, "doc_id", "text").where("component_id <> job_id").isEmpty()
    items = P.benchmark_items(spark, FOLDER)
    assert decontamination.find_leaks(kept, items, "doc_id", "text").isEmpty()
    assert kept.where(F.col("n_chars") != F.length("text")).isEmpty()
    packed = P.packing_stage(spark, kept, FOLDER)
    assert packed.select("doc_id").distinct().count() == kept.count()


def test_odd_documents(spark, docs):
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", None, None, None), (None, "a b", "en", "s", 3), (-1, None, "en", "s", 0)], docs.schema)
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, odd, FOLDER).count() == 4, name
        assert stage(spark, odd.limit(0), FOLDER).count() == 0, name
    assert P.packing_stage(spark, odd, FOLDER).count() == 4
