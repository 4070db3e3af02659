"""Graph digests are made in the row of a request."""

from pyspark.sql import functions as F

from spanledger.functions.hashing import canonical_json, plain_json
from spanledger.operators import governance

_DECISIONS = (
    "request_id long, trace_id string, g_trace_sha256 string, g_evaluation_id string, g_job_id string, human_review_required boolean, "
    "trace_issues array<string>, evaluation_issues array<string>, review_issues array<string>, binding_issues array<string>, stamp_issues array<string>"
)
_ROWS = [
    (1, "t", "ab", "e", "j", True, [], [], [], [], []),
    (2, None, None, None, None, False, ["x", "y", "x"], [], ["r"], ["b"], []),
    (None, "t", "ab", "e", "j", True, [], ["é"], [], [], ["s", "s"]),
]


def test_same_digests_as_over_node_rows(spark):
    decisions = spark.createDataFrame(_ROWS, _DECISIONS)
    expected = governance.decision_graph_digest(governance.governance_nodes(decisions)).collect()
    assert sorted(map(str, governance.decision_graphs(decisions).collect())) == sorted(map(str, expected))


def test_nothing_is_shuffled_or_exploded(spark):
    plan = governance.decision_graphs(spark.createDataFrame(_ROWS, _DECISIONS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_plain_json_is_canonical(spark):
    rows = spark.createDataFrame([('a"\\/\n\x01\u2028é😀', [None, "x"], True, 3), (None, None, None, None), ("", [], False, -1)], "a string, b array<string>, c boolean, d int")
    fields = {name: F.col(name) for name in rows.columns}
    for one, other in rows.select(canonical_json(**fields), plain_json(**fields)).collect():
        assert one == other
