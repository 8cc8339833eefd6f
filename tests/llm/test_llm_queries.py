"""The queries of arbora.llm against their SQL twins, and the pipeline against its stages."""

import compare
import pytest

from arbora.llm.catalog import ORACLES, REGISTRY

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    message, _, rows = compare.compare(spark, compare.connect(FOLDER), name, REGISTRY[name], ORACLES[name], FOLDER)
    assert message is None, message
    assert rows > 0


def test_every_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in REGISTRY) == list(range(1, 14))


def test_pipeline(spark, data):
    import corpus_pipeline
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs.count(), docs.columns
        docs = corpus_pipeline.materialize(stage(spark, docs, data))
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before
    assert docs.count() == corpus_pipeline.run(spark, data).count()
