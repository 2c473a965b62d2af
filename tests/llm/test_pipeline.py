"""Registered queries against their SQL, and the pipeline on the smallest tables."""

import os

import pytest
from check_oracles import compare, connect

import corpus_pipeline
from loadcast.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not available")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    result = compare(QUERIES[name](spark, SF_DIR), duck, ORACLES[name])
    assert result.startswith("ok"), result


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs.count()
    out = corpus_pipeline.run(spark, SF_DIR).collect()
    assert len(corpus_pipeline.STAGES) == 5
    assert before / 2 < len({r.doc_id for r in out}) < before
    assert all(r.n_pieces == len(r.ids) for r in out)


def test_filtering_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
