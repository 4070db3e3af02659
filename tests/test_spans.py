import json

import pytest
from pyspark.sql import functions as F

from spanledger.functions.anyvalue import parse_record
from spanledger.operators import normalize, validate
from spanledger.sources import spans as sources


def records(spark, *documents):
    rows = [("mem", 0, n, d if isinstance(d, str) else json.dumps(d)) for n, d in enumerate(documents)]
    raw = spark.createDataFrame(rows, "source string, block bigint, row bigint, text string")
    return raw.withColumn("doc", parse_record(F.col("text")))


def normalized(spark, *documents):
    return normalize.normalize_spans(sources.unwrap_envelopes(records(spark, *documents)))


BASE = {"trace_id": "t-1", "span_id": "s-1", "name": "n", "start_time": "2025-01-01T00:00:00Z"}


def test_lines_skip_blanks_and_comments_and_keep_numbers(spark, data):
    raw = sources.read_span_lines(spark, str(data / "traces"))
    assert raw.count() == 10
    numbers = sources.line_numbers(spark, str(data / "traces"))
    numbered = sources.with_line_numbers(raw, numbers).filter("source like '%chain%'")
    assert sorted(r.record for r in numbered.collect()) == [3, 4, 5, 6]


def test_source_digests_match_file_bytes(spark, data):
    import hashlib

    path = data / "traces" / "benign.jsonl"
    row = sources.source_digests(spark, str(path)).first()
    assert row.sha256 == hashlib.sha256(path.read_bytes()).hexdigest()


def test_documents_and_formats(spark, tmp_path):
    otlp = {"resourceSpans": [{"scopeSpans": [{"spans": [{**BASE, "attributes": []}]}]}]}
    (tmp_path / "a.json").write_text(json.dumps([BASE, {**BASE, "span_id": "s-2"}], indent=1))
    (tmp_path / "b.json").write_text(json.dumps([otlp], indent=1))
    raw = sources.read_span_documents(spark, str(tmp_path))
    spans, bad = normalize.split_valid(normalize.normalize_spans(sources.unwrap_envelopes(raw)))
    assert spans.count() == 3 and bad.count() == 0
    formats = {r.source[-6:]: r.format for r in sources.detect_format(raw).collect()}
    assert formats == {"a.json": "openinference", "b.json": "otlp"}


def test_envelopes(spark):
    bare = {k: v for k, v in BASE.items() if k != "trace_id"}
    documents = [
        {"span": bare, "trace_id": "T-1"},
        {"traceId": "t-1", "spans": [bare]},
        {"trace_id": "t-1", "data": json.dumps([bare])},
        {"items": {"records": [{"span": BASE}]}},
        [[{"data": [BASE]}]],
        {"span_id": "s-1", "name": "n", "start": 1735689600, "context": {"trace_id": "t-1"}},
    ]
    rows = normalized(spark, *documents).collect()
    assert sorted(r.row for r in rows) == list(range(len(documents)))
    assert {(r.trace_id, r.span_id, str(r.start_time), tuple(r.issues)) for r in rows} == {("t-1", "s-1", "2025-01-01 00:00:00", ())}


def test_layers_later_wins_and_values_decode(spark):
    document = {
        "resource_spans": [
            {
                "resource": {"attributes": [{"key": "a", "value": {"stringValue": "r"}}, {"key": "b", "value": {"intValue": "7"}}]},
                "scope_spans": [
                    {
                        "scope": {"attributes": [{"key": "a", "value": {"stringValue": "s"}}]},
                        "spans": [
                            {
                                "traceId": "0xABC",
                                "spanId": 255,
                                "name": "n",
                                "startTimeUnixNano": "1735689600000000000",
                                "endTimeUnixNano": "0",
                                "attributes": [
                                    {"key": "c", "value": {"arrayValue": {"values": [{"boolValue": True}, {"kvlistValue": {"values": [{"key": "d", "value": {"doubleValue": 0.5}}]}}]}}},
                                    {"key": "e", "value": {"bytesValue": "aGk="}},
                                ],
                            }
                        ],
                    }
                ],
            }
        ]
    }
    row = normalized(spark, document).select("*", F.to_json("attributes").alias("json")).first()
    assert row.trace_id == "abc".zfill(32) and row.span_id == "ff".zfill(16) and row.end_time is None
    assert json.loads(row.json) == {"a": "s", "b": 7, "c": [True, {"d": 0.5}], "e": "hi"}


FIELD_RULES = [
    ({"trace_id": None}, "trace_id is required"),
    ({"trace_id": "a" * 33}, "trace_id is invalid"),
    ({"span_id": True}, "span_id is invalid"),
    ({"name": "x\u0001"}, "span name is invalid"),
    ({"name": "y" * 513}, "span name is invalid"),
    ({"start_time": True}, "start time is invalid"),
    ({"start_time": "soon"}, "start time is invalid"),
    ({"end_time": "2024-12-31T00:00:00Z"}, "end_time cannot precede start_time"),
    ({"kind": "SPAN_KIND_CLIENT"}, "span kind is invalid"),
    ({"status": {"code": 2}}, "status is invalid"),
    ({"attributes": [{"value": {"stringValue": "x"}}]}, "attributes are invalid"),
    ({"attributes": [{"key": "k", "value": {"intValue": "x"}}]}, "attributes are invalid"),
    ({"events": "text"}, "events and links must be arrays"),
    ({"events": [{"name": "", "timestamp": 1}]}, "span event is invalid"),
    ({"links": [{"trace_id": "t"}]}, "span link is invalid"),
]


def test_field_rules(spark):
    rows = normalized(spark, *({**BASE, **change} for change, _ in FIELD_RULES)).collect()
    assert [r.issues for r in sorted(rows, key=lambda r: r.row)] == [[reason] for _, reason in FIELD_RULES]


TIMES = [
    ("1735689600", "2025-01-01 00:00:00"),
    ("1735689600123", "2025-01-01 00:00:00.123000"),
    ("1735689600123456", "2025-01-01 00:00:00.123456"),
    ("1735689600123456789", "2025-01-01 00:00:00.123457"),
    (1735689600.5, "2025-01-01 00:00:00.500000"),
    ("2025-01-01T02:00:00+02:00", "2025-01-01 00:00:00"),
    ("2025-01-01", "2025-01-01 00:00:00"),
]


def test_timestamps(spark):
    rows = normalized(spark, *({**BASE, "start_time": start} for start, _ in TIMES)).collect()
    assert [str(r.start_time) for r in sorted(rows, key=lambda r: r.row)] == [expected for _, expected in TIMES]


def test_kinds_status_events_links(spark):
    document = {
        **BASE,
        "kind": "Large Language-Model",
        "status": {"status_code": "Failed", "message": " m "},
        "events": {"name": "e", "ts": 5, "attrs": {"x": {"intValue": "3"}}},
        "links": [{"traceId": "EjRWeJCrze8SNFZ4kKvN7w==", "spanId": "0xAB"}],
    }
    row = normalized(spark, document).first()
    assert (row.kind, row.status, row.status_message, row.issues) == ("llm", "error", "m", [])
    assert normalize.explode_events(normalized(spark, document)).first().name == "e"
    link = normalize.explode_links(normalized(spark, document)).first()
    assert (link.linked_trace_id, link.linked_span_id) == ("1234567890abcdef1234567890abcdef", "00000000000000ab")


def test_bad_json_and_repeated_keys_are_quarantined(spark):
    raw = records(spark, "{oops", '{"a":1,"a":2}', BASE)
    assert {r.row for r in sources.unparsed(raw).collect()} == {0, 1}


def test_strict_mode_fails(spark):
    with pytest.raises(Exception, match="span name is required"):
        normalize.require_valid(normalized(spark, {**BASE, "name": " "})).collect()


def test_ingest_drops_copies_and_reports_conflicts(spark):
    other = {**BASE, "span_id": "s-2"}
    spans, issues = validate.ingest(
        normalized(spark, BASE, BASE, {**BASE}, other, {**other, "name": "changed"}, {**BASE, "span_id": "s-3"}, {"span_id": "x"})
    )
    assert sorted(r.span_id for r in spans.collect()) == ["s-1", "s-3"]
    codes = sorted(r.code for r in issues.collect())
    assert codes == ["conflicting_duplicate_span"] * 2 + ["duplicate_span_ignored", "invalid_span"]
    assert spans.filter("span_id = 's-1'").first().row == 0


def wrapped(value, depth):
    for n in range(depth):
        entry = {"arrayValue": {"values": [value]}} if n % 2 else {"kvlistValue": {"values": [{"key": "k", "value": value}]}}
        value = entry
    return value


def otlp(attributes, resource=()):
    span = {"traceId": "t", "spanId": "s", "name": "n", "startTimeUnixNano": "1700000000000000000", "attributes": attributes}
    return {"resourceSpans": [{"resource": {"attributes": list(resource)}, "scopeSpans": [{"spans": [span]}]}]}


def test_typed_values_are_decoded_at_any_depth(spark):
    deep = [{"key": "a", "value": wrapped({"intValue": "7"}, 7)}]
    row = normalized(spark, otlp(deep)).select("issues", F.to_json("attributes").alias("json")).first()
    assert row.issues == [] and json.loads(row.json) == {"a": {"k": [{"k": [{"k": [{"k": 7}]}]}]}}
    # Far beyond the interpreter's own recursion.
    row = normalized(spark, otlp([{"key": "a", "value": wrapped({"boolValue": True}, 60)}])).select("issues").first()
    assert row.issues == []


def test_ill_typed_values_are_found_in_every_layer(spark):
    bad = [{"key": "a", "value": {"arrayValue": {"values": [{"arrayValue": {"values": [{"intValue": "oops"}]}}]}}}]
    nameless = [{"key": "a", "value": {"kvlistValue": {"values": [{"value": {"intValue": 1}}]}}}]
    for document in (otlp(bad), otlp([], bad), otlp(nameless), otlp([], [{"key": "", "value": {"intValue": 1}}])):
        assert normalized(spark, document).first().issues == ["attributes are invalid"]


def test_no_malformed_envelope_is_lost(spark):
    documents = [
        {"spans": {"id": 1}},
        {"resourceSpans": [{"scopeSpans": {"spans": []}}]},
        {"resourceSpans": {"scopeSpans": []}},
        {"resourceSpans": [{"scopeSpans": [{"spans": "x"}]}]},
        {"name": "no id"},
        {"data": [1, {"name": "x"}]},
    ]
    rows = normalized(spark, *documents).select("row", "issues").collect()
    found = sorted((r.row, *r.issues) for r in rows)
    assert found == [
        (0, "spans must be an array"),
        (1, "scopeSpans must be an array"),
        (2, "resourceSpans must be an array"),
        (3, "spans must be an array"),
        (4, "record holds no span"),
        (5, "record holds no span"),
        (5, "record must be an object"),
    ]


def test_whole_number_ids_of_128_bits(spark):
    row = normalized(spark, {**BASE, "trace_id": 2**128 - 1, "span_id": 2**64 - 1}).first()
    assert row.issues == [] and row.trace_id == "f" * 32 and row.span_id == "f" * 16
    assert normalized(spark, {**BASE, "trace_id": 2**128}).first().issues == ["trace_id is invalid"]
