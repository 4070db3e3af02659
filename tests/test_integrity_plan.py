"""Integrity checks deal keys and problems, not payloads."""

from spanledger.operators import audit


def test_payloads_are_checked_before_they_would_be_dealt(spark):
    registered = audit.register_traces(spark.createDataFrame([("j1", "t1", "aa", 1), ("j2", "t2", "bb", 2)], "job_id string, trace_id string, trace_sha256 string, span_count int"))
    given = [("j1", "t1", "e1", "r", "aa", "{}", "x"), ("j2", "t2", "e2", "r", "cc", "{}", None), ("j3", "t3", "e3", None, "aa", None, None)]
    evaluations = spark.createDataFrame(given, "job_id string, trace_id string, evaluation_id string, receipt_id string, trace_sha256 string, payload string, payload_sha256 string")
    found = audit.verify_integrity(registered, evaluations, registered.select("receipt_id").limit(0))
    assert sorted(tuple(r) for r in found.collect()) == [
        ("evaluation", "e1", "digest_mismatch"), ("evaluation", "e1", "receipt_missing"), ("evaluation", "e2", "receipt_missing"), ("evaluation", "e2", "trace_hash_mismatch"),
        ("evaluation", "e3", "receipt_missing"), ("evaluation", "e3", "registration_missing"),
        ("registration", "j1/t1", "receipt_missing"), ("registration", "j2/t2", "receipt_missing"),
    ]
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    check = next(line for line in lines if "sha2(" in line and "payload#" in line)
    join = next(line for line in lines if "Join LeftOuter" in line and "job_id" in line)
    assert check.index("Project") > join.index("Join")
