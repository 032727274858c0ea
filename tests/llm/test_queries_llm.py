"""Registered queries of the llm folder against their SQL, and the others by running them on the smallest tables."""

import corpus_pipeline
import pytest
from compare import compare
from conftest import SF

from papertrawl.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    outcome = compare(spark, SF, name, queries.QUERIES[name], queries.ORACLES[name])
    assert outcome.startswith("ok"), outcome


def test_pipeline_keeps_one_clean_copy_and_balances_shards(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "source", "shard", "slot"} <= set(rows.columns)
    found = rows.toPandas()
    assert len(found) and found["text"].str.len().min() > 0
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
