"""The registered queries of the numbered operators: SQL twins, result columns, no product of tables."""

import pytest

import __spark_entry__ as entry
from postrisk.llm import queries as q
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck

COLUMNS = {
    "op2_quality_crf": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op4_pii": [("doc_id", "bigint"), *[(f"n_{k}", "bigint") for k in ("email", "ip", "card", "phone")], ("base_sha256", "string"), ("spans", "string")],
    "op5_token_count": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")],
    "op11_lm_score": [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"),
                      ("base_score", "double"), ("score", "double")],
    "op8_mixing": [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")],
}


def test_registered_once_each():
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 14))
    assert set(q.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(q.QUERIES) == set(q.ORACLE_SQL) | set(COLUMNS)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    res = compare(spark, name, SF_SMALL, duck(SF_SMALL))
    assert res["status"] == "match", res


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns(spark, name):
    df = q.QUERIES[name](spark, SF_SMALL)
    assert df.dtypes == COLUMNS[name]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
