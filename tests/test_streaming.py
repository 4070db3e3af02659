import json


from spanledger.streaming import spans as streaming

BASE = {"trace_id": "t-1", "name": "n", "start_time": "2025-01-01T00:00:00Z"}


def write(folder, name, *documents):
    (folder / name).write_text("\n".join(json.dumps(d) for d in documents) + "\n")


def run(df, name, spark, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_stream_dedup_equals_batch(spark, tmp_path):
    write(tmp_path, "a.jsonl", {**BASE, "span_id": "s1"}, {**BASE, "span_id": "s1"}, {**BASE, "span_id": "s2", "parent_span_id": "s1"})
    write(tmp_path, "b.jsonl", {**BASE, "span_id": "s1"}, {**BASE, "span_id": "s3"}, {"span_id": "bad"})
    rows = run(streaming.dedup_stream(streaming.stream_spans(spark, str(tmp_path))).select("trace_id", "span_id"), "dedup", spark)
    assert sorted(r.span_id for r in rows) == ["s1", "s2", "s3"]


def test_stream_table_and_source_log(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "a.jsonl", {**BASE, "span_id": "s1"}, {**BASE, "span_id": "s1"}, {**BASE, "span_id": "s2"}, {**BASE, "span_id": "s2", "name": "other"})
    streaming.append_spans(streaming.stream_spans(spark, str(source)), str(tmp_path / "table"), str(tmp_path / "c1")).awaitTermination()
    spans, conflicts = streaming.current_spans(spark, str(tmp_path / "table"))
    assert spans.count() == 3
    assert [r.span_id for r in conflicts.collect()] == ["s2"]
    streaming.source_log(spark, str(source), str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_stream_trace_summary_closes_sessions(spark, tmp_path):
    write(tmp_path, "a.jsonl", {**BASE, "span_id": "s1"}, {**BASE, "span_id": "s2", "parent_span_id": "s1"})
    write(tmp_path, "b.jsonl", {**BASE, "trace_id": "later", "span_id": "s9", "start_time": "2025-01-03T00:00:00Z"})
    rows = run(streaming.stream_trace_summary(streaming.stream_spans(spark, str(tmp_path))), "sessions", spark)
    assert [(r.trace_id, r.span_count, r.root_count) for r in rows] == [("t-1", 2, 1)]


def test_stream_conflicts(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    source = tmp_path / "in"
    source.mkdir()
    write(source, "a.jsonl", {**BASE, "span_id": "s1"}, {**BASE, "span_id": "s1"}, {**BASE, "span_id": "s1", "name": "other"})
    rows = run(streaming.stream_conflicts(streaming.stream_spans(spark, str(source))), "conflicts", spark)
    assert [(r.trace_id, r.span_id) for r in rows] == [("t-1", "s1")]


def test_ingest_loses_nothing_and_replays_safely(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    late = {**BASE, "span_id": "s3", "start_time": "2020-01-01T00:00:00Z"}
    write(source, "a.jsonl", {**BASE, "span_id": "s1"}, {**BASE, "span_id": "s1"}, {"span_id": "bad"}, {"spans": {}})
    store = str(tmp_path / "store")
    streaming.ingest_stream(spark, str(source), store, str(tmp_path / "c")).awaitTermination()
    write(source, "b.jsonl", late, {**BASE, "span_id": "s2", "parent_span_id": "s1"})
    (source / "c.jsonl").write_text("{oops\n")
    streaming.ingest_stream(spark, str(source), store, str(tmp_path / "c")).awaitTermination()
    spans, conflicts = streaming.ingested_spans(spark, store)
    assert sorted(r.span_id for r in spans.collect()) == ["s1", "s2", "s3"] and conflicts.count() == 0
    assert sorted(r.code for r in streaming.quarantined(spark, store).collect()) == ["invalid_json", "invalid_span", "invalid_span"]
    assert [(r.trace_id, r.span_count, r.root_count) for r in streaming.trace_summaries(spark, store).collect()] == [("t-1", 3, 2)]
    before = sorted(tuple(r) for r in streaming.source_digests(spark, store).collect())
    assert [n for _, n, *_ in before] and len(before) == 3
    # Everything again, as after a lost checkpoint: the same folders are written.
    streaming.ingest_stream(spark, str(source), store, str(tmp_path / "c2")).awaitTermination()
    assert sorted(r.span_id for r in streaming.ingested_spans(spark, store)[0].collect()) == ["s1", "s2", "s3"]
