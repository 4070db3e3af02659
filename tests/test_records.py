import base64
import hashlib
import hmac
import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spanledger.functions.hashing import canonical_json, hmac_sha256, padded_keys
from spanledger.operators import audit, cost, governance, jobs, packs, standards
from spanledger.operators.skew import lookup_join
from spanledger.session import materialize, shared_folder
from spanledger.sources import tables

KEY = b"k" * 40


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame([("primary", bytearray(KEY)), ("short", bytearray(b"x"))], "signing_key_id string, key binary")


def test_hmac_equals_python(spark):
    rows = [(bytearray(b"a" * n), f"message {n}") for n in (32, 64, 65, 200)]
    df = spark.createDataFrame(rows, "key binary, m string")
    inner, outer = padded_keys(F.col("key"))
    for row in df.select("key", "m", hmac_sha256(inner, outer, F.col("m").cast("binary")).alias("h")).collect():
        assert row.h == hmac.new(bytes(row.key), row.m.encode(), hashlib.sha256).hexdigest()


def test_canonical_json_is_sorted_and_compact(spark):
    row = spark.createDataFrame([("é", None)], "b string, a string").select(canonical_json(b=F.col("b"), a=F.col("a")).alias("j")).first()
    assert row.j == '{"a":null,"b":"é"}'


# --- cost ---------------------------------------------------------------------------


def test_cost_rounds_half_up_at_twelve_places(spark):
    usage = spark.createDataFrame([("m", 10, 4, 14, 3, 1)], "model string, input_tokens bigint, output_tokens bigint, total_tokens bigint, cached_input_tokens bigint, reasoning_tokens bigint")
    cards = spark.createDataFrame(
        [("m", Decimal("0.0000005"), Decimal("2.5"), None, Decimal("1.000001"))],
        "model string, input_rate decimal(24,12), output_rate decimal(24,12), cached_input_rate decimal(24,12), reasoning_rate decimal(24,12)",
    )
    row = cost.token_cost(cost.priced(usage, cards)).first()
    assert row.uncached_input_cost_eur == Decimal("0.000000000004")  # 3.5e-12
    assert row.cached_input_cost_eur == Decimal("0.000000000002")  # 1.5e-12
    assert row.reasoning_output_cost_eur == Decimal("0.000001000001")
    assert row.total_cost_eur == row.input_cost_eur + row.output_cost_eur
    assert cost.cost_checks(cost.token_cost(cost.priced(usage, cards))).count() == 0


def test_overrides_and_positional_cards(spark):
    usage = spark.createDataFrame([(1, 10, 0, 10, 10, 0, Decimal("7"))], "position int, input_tokens bigint, output_tokens bigint, total_tokens bigint, cached_input_tokens bigint, reasoning_tokens bigint, cached_input_rate_override decimal(24,12)")
    cards = spark.createDataFrame([(1, "m", Decimal("1"), Decimal("1"), None, None)], "position int, model string, input_rate decimal(24,12), output_rate decimal(24,12), cached_input_rate decimal(24,12), reasoning_rate decimal(24,12)")
    row = cost.token_cost(cost.priced_by_position(usage, cards)).first()
    assert row.total_cost_eur == Decimal("0.000070000000")


def test_totals_above_exact_limit_fail(spark):
    usage = spark.createDataFrame([(1, 2**52, 0, 0, 0)] * 3, "k int, input_tokens bigint, output_tokens bigint, cached_input_tokens bigint, reasoning_tokens bigint")
    with pytest.raises(Exception, match="exact limit"):
        cost.token_totals(usage, ["k"]).collect()


def test_usage_is_found_in_order(spark):
    payloads = [
        {"total_tokens": 1, "usage": {"input_tokens": 2, "output_tokens": 3}},
        {"a": [{"b": {"completion_tokens": 4}}]},
        {"body": json.dumps({"usage": {"prompt_tokens": "5"}})},
        [json.dumps({"x": {"promptTokens": 6}})],
        {"usage": {"nothing": 1}, "z": {"outputTokens": 7}},
        {"usage": {"input_tokens": 1.5}},
        {"input_tokens": 3, "output_tokens_details": {"reasoning_tokens": 1}, "output_tokens": 2},
        {"x": 1},
    ]
    df = spark.createDataFrame([(n, json.dumps(p)) for n, p in enumerate(payloads)], "n int, payload string")
    located = cost.locate_usage(df)
    good, bad = cost.extract_token_usage(located)
    found = {r.n: (r.input_tokens, r.output_tokens, r.reasoning_tokens) for r in good.collect()}
    assert found == {0: (2, 3, 0), 1: (0, 4, 0), 2: (5, 0, 0), 3: (6, 0, 0), 4: (0, 7, 0), 6: (3, 2, 1)}
    assert {r.n: r.reason for r in bad.collect()} == {5: "input count is not an exact integer", 7: "no usage object found"}
    missing, _ = cost.extract_token_usage(located, allow_missing=True)
    assert missing.filter("n = 7").first().total_tokens == 0


# --- standards -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def catalog(spark, data):
    return tables.read_catalog(spark, str(data / "standards" / "catalog.json"))


def test_catalog_checks(catalog):
    issues = {(r.standard_id, r.issue) for r in tables.catalog_issues(catalog).collect()}
    assert issues == {
        ("std-oversight-2024", "requirement article is not listed by the standard"),
        ("std-oversight-2024", "listing requires harmonised status"),
        ("std-oversight-2024", "source url must be absolute"),
        ("std-oversight-2024", "retrieval date must be an ISO date"),
        ("std-logging-2024", "duplicate requirement id"),
    }


def test_matching_scores(spark, catalog):
    leaves = spark.createDataFrame(
        [
            ("s", "characteristics", "string", "Immutable event logging"),
            ("s", "risk register", "boolean", "true"),
            ("s", "system", "boolean", "true"),
            ("s", "articles", "string", "Art. 12"),
            ("s", "scope", "string", "Annex IV, section 2"),
            ("other", "note", "string", "nothing shared"),
        ],
        "subject string, last_key string, kind string, text string",
    )
    tokens = standards.feature_tokens(leaves)
    assert {r.token for r in tokens.filter("subject = 's'").collect()} == {
        "immutable-event-logging", "risk-register", "12", "Article 12", "article-12", "annex-iv-section-2", "annex-iv-2",
    }
    rows = standards.match_standards(tokens, tables.standards_tables(catalog)).collect()
    assert [r.standard_id for r in rows] == ["std-logging-2024"]
    # 2 of 3 characteristics, 1 of 2 evidence words sets ("log-owner" shares none), 1 of 2 articles, 1 of 2 sections
    expected = (0.70 * 2 / 3 + 0.15 * 1 / 2 + 0.25 * 1 / 2 + 0.15 * 1 / 2) / 1.25
    assert rows[0].score == pytest.approx(expected, abs=1e-6)


# --- reviews, gates, receipts ------------------------------------------------------------


def sign(fields: dict) -> str:
    body = json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    digest = hmac.new(KEY, governance.REVIEW_CONTEXT.encode() + b"\x00" + body, hashlib.sha256).digest()
    return base64.urlsafe_b64encode(digest).decode()


def test_review_signature_equals_python(spark, keys):
    fields = {
        "signoff_id": "s", "job_id": "j", "trace_id": "t", "trace_sha256": "a" * 64, "evaluation_id": "e", "actor": "human",
        "reviewer_id": "r", "reviewer_name": "Zoë", "decision": "approved", "attestation": "ok", "signing_key_id": "primary",
        "scope": ["export"], "signed_at": "2025-01-01T00:00:00.000000Z",
    }
    raw = {**fields, "signature": sign(fields)}
    raws = [raw, {**raw, "decision": "rejected"}, {**raw, "signing_key_id": "short"}]
    df = spark.createDataFrame([{**r, "metadata": None, "receipt_id": None} for r in raws], "signoff_id string, job_id string, trace_id string, trace_sha256 string, evaluation_id string, actor string, reviewer_id string, reviewer_name string, decision string, attestation string, signing_key_id string, scope array<string>, signed_at string, signature string, metadata string, receipt_id string")
    good, bad = tables.read_reviews(df)
    assert bad.count() == 0
    checked = governance.verify_review_signatures(good, keys).collect()
    assert {(r.decision, r.signing_key_id): r.signature_valid for r in checked} == {
        ("approved", "primary"): True, ("rejected", "primary"): False, ("approved", "short"): False,
    }


def events(spark, n, job="j"):
    rows = [(f"{job}-{i}", f"k-{job}-{i}", job, "t", "job.created", "system", "svc", i, json.dumps({"n": i})) for i in range(n)]
    df = spark.createDataFrame(rows, "receipt_id string, idempotency_key string, job_id string, trace_id string, event_type string, actor_type string, actor_id string, i int, payload string")
    return audit.prepare_events(df.withColumn("occurred_at", F.timestamp_seconds(F.col("i") + 1_735_689_600)).drop("i"))[0]


EMPTY = "job_id string, sequence bigint, receipt_hash string"


def test_chain_equals_python_and_continues(spark, keys):
    first = audit.build_receipts(events(spark, 3), spark.createDataFrame([], EMPTY), "primary", keys)
    rows = sorted(first.collect(), key=lambda r: r.sequence)
    last = None
    for i, r in enumerate(rows):
        body = {
            "schema_version": 1, "sequence": i + 1, "event_type": "job.created", "actor_type": "service", "actor_id": "svc", "job_id": "j",
            "occurred_at": f"2025-01-01T00:00:0{i}+00:00", "payload_sha256": hashlib.sha256(b'{"n":%d}' % i).hexdigest(), "previous_receipt_hash": last,
        }
        text = json.dumps(body, sort_keys=True, separators=(",", ":"))
        assert r.previous_receipt_hash == last
        last = hashlib.sha256(text.encode()).hexdigest()
        assert r.receipt_hash == last
        mac = hmac.new(KEY, audit.RECEIPT_CONTEXT.encode() + b"\x00" + text.encode(), hashlib.sha256).digest()
        assert r.signature == base64.urlsafe_b64encode(mac).decode()
    stored = spark.createDataFrame(rows, first.schema)
    fresh, conflicts = audit.new_events(events(spark, 5), stored)
    assert (fresh.count(), conflicts.count()) == (2, 0)
    more = audit.build_receipts(fresh, stored, "primary", keys)
    both = spark.createDataFrame(rows + more.select(*stored.columns).collect(), first.schema)
    assert audit.verify_chains(both, keys).first().valid
    for column, value, where in (("actor_id", "x", "receipt_hash"), ("payload", "{}", "payload_hash"), ("signature", "x", "signature")):
        bad = both.withColumn(column, F.when(F.col("sequence") == 2, value).otherwise(F.col(column)))
        failures = {r.sequence: r.failures for r in audit.verify_receipts(bad, keys).collect() if r.failures}
        assert set(failures) == {2} and where in failures[2]
    assert {tuple(r.failures) for r in audit.verify_receipts(both.filter("sequence <> 3"), keys).collect()} == {(), ("gap",)}


def test_append_only(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, d string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3"), ("c", "3"), ("e", "4"), ("e", "5")], "k string, d string")
    insert, conflicts = audit.append_only(new, stored, ["k"], "d")
    assert [tuple(r) for r in insert.collect()] == [("c", "3")]
    assert sorted(r.k for r in conflicts.collect()) == ["b", "e", "e"]


def test_listing_limits(spark):
    df = spark.createDataFrame([("j", "t", 1)], "job_id string, trace_id string, created_at int")
    with pytest.raises(ValueError):
        jobs.list_jobs(df, limit=101)
    page, total = jobs.list_jobs(df, trace_id="none")
    assert (page.count(), total.first().total) == (0, 0)


def test_salted_lookup_equals_plain_join(spark):
    left = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    plain = {tuple(r) for r in left.join(right, "k", "left").collect()}
    salted = lookup_join(left, right, ["k"], salts=7)
    assert {tuple(r) for r in salted.collect()} == plain and salted.count() == 2000


def test_lookup_with_a_key_that_holds_all_rows(spark):
    # No broadcast, and partitions of a size that counts as skewed here.
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    for name, value in zip(saved, ("-1", "2k", "1k"), strict=True):
        spark.conf.set(name, value)
    try:
        left = spark.range(20_000).repartition(8).select(F.lit(1).alias("k"), F.col("id").alias("v"))
        right = spark.range(3).select(F.col("id").cast("int").alias("k"), F.col("id").alias("w"))
        joined = lookup_join(left, right, ["k"])
        assert joined.count() == 20_000 and joined.agg(F.min("w"), F.max("w")).first() == (1, 1)
        scans = joined._jdf.queryExecution().sparkPlan().toString().count("Range (")
        assert scans == 2
    finally:
        for name, value in saved.items():
            spark.conf.set(name, value)


def test_packs_are_written_and_verified(spark, tmp_path):
    made = spark.createDataFrame([("p1", "j1", '{"a":1}'), ("p2", "j2", '{"b":2}')], "pack_id string, job_id string, document string")
    made = made.withColumn("sha256", F.sha2("document", 256)).withColumn("size", F.octet_length("document"))
    manifest = packs.write_packs(made, str(tmp_path))
    assert {r.pack_id: r.valid for r in packs.verify_packs(spark, str(tmp_path), manifest).collect()} == {"p1": True, "p2": True}
    forged = manifest.withColumn("size", F.col("size") + F.when(F.col("job_id") == "j2", 1).otherwise(0))
    assert {r.pack_id: r.valid for r in packs.verify_packs(spark, str(tmp_path), forged).collect()} == {"p1": True, "p2": False}


def test_packs_written_twice_are_stored_once(spark, tmp_path):
    made = spark.createDataFrame([("p1", "j1", '{"a":1}')], "pack_id string, job_id string, document string")
    made = made.withColumn("sha256", F.sha2("document", 256)).withColumn("size", F.octet_length("document"))
    packs.write_packs(made, str(tmp_path))
    manifest = packs.write_packs(made, str(tmp_path))
    assert [tuple(r) for r in packs.verify_packs(spark, str(tmp_path), manifest).collect()] == [("p1", "j1", True)]


def test_receipts_replayed_within_a_batch(spark):
    schema = (
        "receipt_id string, idempotency_key string, job_id string, trace_id string, event_type string, actor_type string, "
        "actor_id string, occurred_at timestamp, payload_sha256 string, payload string"
    )
    import datetime

    def event(receipt, key, second, content="p"):
        return (receipt, key, "j", "t", "trace-ingested", "system", "a", datetime.datetime(2025, 1, 1, 0, 0, second), content, "{}")

    batch = spark.createDataFrame(
        [
            event("r1", "k1", 1),
            event("r1", "k1", 1),
            event("r2", "k1", 2),
            event("r3", "k1", 3, "other"),
            event("r1", None, 4, "other"),
            event("r4", None, 5),
            event("r5", None, 6),
        ],
        schema,
    )
    fresh, conflicts = audit.new_events(batch, batch.limit(0))
    assert sorted(r.receipt_id for r in fresh.collect()) == ["r1", "r4", "r5"]
    assert sorted((r.receipt_id, r.idempotency_key) for r in conflicts.collect()) == [("r1", None), ("r3", "k1")]


def test_money_at_the_limits(spark):
    top = spark.createDataFrame([(9007199254740991, 0, 0, 0, "1000000000000")], "input_tokens long, output_tokens long, cached_input_tokens long, reasoning_tokens long, r string")
    rates = {n: F.col("r").cast("decimal(25,12)") for n in cost.RATE_COLUMNS}
    row = cost.token_cost(top.withColumns(rates)).first()
    assert str(row.total_cost_eur) == "9007199254740991000000.000000000000"


def test_request_keys_with_a_common_start(spark):
    traces = spark.createDataFrame([("t", "s", "x" * 120 + end, end, 1) for end in "ab"], "trace_id string, trace_sha256 string, request_key string, request_sha256 string, created_at long")
    verdicts = spark.createDataFrame([("t", "e", "allow")], "trace_id string, evaluation_id string, policy_action string")
    stored, _ = jobs.create_jobs(traces.limit(1), verdicts)
    fresh, conflicts = jobs.create_jobs(traces, verdicts, stored)
    assert (fresh.count(), conflicts.count()) == (1, 0)


@pytest.mark.parametrize("segment", [2, 3, 1 << 16])
def test_segments_fold_side_by_side(spark, keys, segment):
    """Chains that start anew at each segment, continued twice, and their mountain ranges."""
    schema = "job_id string, sequence bigint, receipt_hash string"
    both = events(spark, 11).unionByName(events(spark, 4, "k"))
    first = both.filter("occurred_at < timestamp '2025-01-01 00:00:05'")
    stored = materialize(audit.build_receipts(first, spark.createDataFrame([], schema), "primary", keys, segment))
    rest = both.join(stored.select("receipt_id"), "receipt_id", "left_anti")
    chained = stored.unionByName(audit.build_receipts(rest, stored, "primary", keys, segment).select(*stored.columns))
    rows = sorted(chained.collect(), key=lambda r: (r.job_id, r.sequence))
    assert [(r.job_id, r.sequence, r.receipt_id) for r in rows] == [("j", i + 1, f"j-{i}") for i in range(11)] + [("k", i + 1, f"k-{i}") for i in range(4)]
    last = {}
    for r in rows:
        assert r.previous_receipt_hash == (None if (r.sequence - 1) % segment == 0 else last[r.job_id])
        last[r.job_id] = r.receipt_hash
    assert {tuple(r.failures) for r in audit.verify_receipts(chained, keys, segment).collect()} == {()}
    # A receipt cut out, at the edge of a segment too, is missed by the next one.
    for cut in (2, 4, 6):
        failures = {r.sequence: r.failures for r in audit.verify_receipts(chained.filter(f"job_id = 'j' and sequence <> {cut}"), keys, segment).collect() if r.failures}
        assert failures == {cut + 1: ["gap"]}
    twice = chained.unionByName(chained.filter("job_id = 'j' and sequence = 3"))
    assert {r.sequence for r in audit.verify_receipts(twice, keys, segment).collect() if "sequence" in r.failures} == {3}

    def root(hashes):
        peaks, at = [], 0
        while at < len(hashes):
            size = 1 << (len(hashes) - at).bit_length() - 1
            level = hashes[at : at + size]
            while len(level) > 1:
                level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], level[1::2], strict=True)]
            peaks += level
            at += size
        return hashlib.sha256("".join(peaks).encode()).hexdigest()

    heads = {job: [r.receipt_hash for n, r in enumerate(own) if (n + 1) % segment == 0 or n == len(own) - 1] for job in "jk" if (own := [r for r in rows if r.job_id == job])}
    assert {r.job_id: (r.segments, r.root) for r in audit.chain_roots(chained, segment).collect()} == {job: (len(h), root(h)) for job, h in heads.items()}


def test_long_chain_is_spread(spark, keys):
    """One job with all events: its segments are dealt to many tasks, and only slim rows reach Python."""
    rows = spark.range(600).select(
        F.concat(F.lit("r"), F.col("id")).alias("receipt_id"), F.lit(None).cast("string").alias("idempotency_key"), F.lit("j").alias("job_id"), F.lit("t").alias("trace_id"),
        F.lit("job.created").alias("event_type"), F.lit("system").alias("actor_type"), F.lit("a").alias("actor_id"), F.timestamp_seconds(F.lit(0)).alias("occurred_at"), F.lit("{}").alias("payload"),
    )
    built = audit.build_receipts(audit.prepare_events(rows)[0], spark.createDataFrame([], "job_id string, sequence bigint, receipt_hash string"), "primary", keys, 10)
    fold = built._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[1].split("\n")
    assert "payload" not in fold[0] and built.filter("previous_receipt_hash is null").count() == 60
    assert built.agg(F.count_distinct("sequence"), F.max("sequence")).first() == (600, 600)


def test_receipts_appended_twice_are_stored_once(spark, keys, tmp_path):
    made = audit.build_receipts(events(spark, 5), spark.createDataFrame([], EMPTY), "primary", keys)
    path = str(tmp_path / "store")
    assert audit.append_receipts(made.filter("sequence <= 3"), path).count() == 3
    assert audit.append_receipts(made, path).count() == 2
    assert audit.append_receipts(made, path).count() == 0
    assert sorted(r.sequence for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5]


def test_appended_rows_are_written_once(spark, keys, tmp_path):
    """An append deals and writes rows once, copies within it meet, and digests that are none are kept as they are."""
    folder, path = shared_folder(spark), str(tmp_path / "store")
    made = materialize(audit.build_receipts(events(spark, 4), spark.createDataFrame([], EMPTY), "primary", keys))
    odd = made.withColumn("receipt_hash", F.when(F.col("sequence") == 1, F.upper("receipt_hash")).when(F.col("sequence") == 2, "x").when(F.col("sequence") > 3, None).otherwise(F.col("receipt_hash")))
    before = sorted(os.listdir(folder))
    assert audit.append_receipts(odd.unionByName(odd), path).count() == 4
    assert audit.append_receipts(odd, path).count() == 0
    assert audit.append_receipts(made, path).count() == 3
    assert sorted(os.listdir(folder)) == before
    rows = spark.read.parquet(path).select(*made.columns).collect()
    assert sorted(map(str, rows)) == sorted(map(str, odd.unionByName(made.filter("sequence <> 3")).collect()))


def test_checks_of_receipts_stay_in_generated_code(spark, keys):
    """Checks inside a higher-order function are interpreted, and with them the hashes they look at."""
    good, bad = audit.prepare_events(spark.createDataFrame([("r", "k", "j", "t", "Job.Created ", "robot", "a\u00e9\"b", "{}")], "receipt_id string, idempotency_key string, job_id string, trace_id string, event_type string, actor_type string, actor_id string, payload string").withColumn("occurred_at", F.timestamp_seconds(F.lit(0))))
    assert (good.count(), bad.first().reason) == (0, "actor type is unknown")
    stored = audit.build_receipts(events(spark, 2), spark.createDataFrame([], EMPTY), "primary", keys)
    checked = audit.verify_receipts(stored.withColumn("actor_id", F.lit('\u00e9"')), keys)
    for made in (bad, checked):
        assert "filter(array" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.sequence, r.failures) for r in checked.collect()) == [(n, ["receipt_hash", "signature"]) for n in (1, 2)]


def test_issues_of_spans_stay_in_generated_code(spark):
    """Issues are listed outside higher-order functions; short link ids are not tried as base64, whole ones are decoded."""
    from spanledger.operators import normalize

    link = '{"trace_id":"%s","span_id":"%s"}' % (base64.b64encode(bytes(range(240, 256))).decode().rstrip("="), base64.b64encode(bytes(range(248, 256))).decode())
    body = '{"trace_id":"t","span_id":"1","start_time":1,"links":[%s,{"trace_id":"v1","span_id":"2"}]}' % link
    records = spark.sql("select 's' as source, 0L as block, 0L as row, 0 as item, parse_json(:body) as span, cast(null as variant) as trace_hint, cast(array() as array<variant>) as layers", {"body": body})
    rows = normalize.normalize_spans(records)
    assert "array_except(array(CASE WHEN" in rows._jdf.queryExecution().analyzed().toString()
    row = rows.select("issues", "links.trace_id", "links.span_id").first()
    assert row.issues == ["span name is required"]
    assert row.trace_id == [bytes(range(240, 256)).hex(), "v1"] and row.span_id == [bytes(range(248, 256)).hex(), "0" * 15 + "2"]
