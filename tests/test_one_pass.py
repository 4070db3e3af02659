"""Lines that are no JSON and rejected records come out of one pass."""

from pyspark.sql import functions as F

from spanledger.operators import normalize
from spanledger.plans import trace_queries
from spanledger.sources import spans as sources


def test_unparsed_lines_pass_with_the_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"span_id":"1","trace_id":"t","name":"n","start_time":1}\n{"broken\n{"a":1}\n{"a":1,"a":2}\n')
    raw = sources.read_span_lines(spark, str(tmp_path))
    spans, rejected = normalize.split_valid(normalize.normalize_spans(sources.unwrap_envelopes(raw, keep_unparsed=True)))
    _, known = normalize.split_valid(normalize.normalize_spans(sources.unwrap_envelopes(raw)))
    columns = ("code", "reason", "raw")
    expected = sources.unparsed(raw).unionByName(known).select(*columns)
    assert sorted(rejected.select(*columns).collect()) == sorted(expected.collect())
    assert rejected.count() == 3 and spans.count() == 1


def test_quarantine_reads_its_records_once(spark):
    plan = trace_queries.quarantined_records(spark, "/root/testdata/sf0.001").filter(F.lit(True))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
