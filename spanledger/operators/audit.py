"""Hash-chained audit receipts and record integrity (AUD-01 to AUD-05, SNK-01, SNK-02, WIN-01, WIN-06, JN-08)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanledger.functions import rules
from spanledger.functions.hashing import base64url, digest_of, hmac_sha256, json_string, padded_keys, sha, without_nulls
from spanledger.operators.cost import lookup_or_broadcast
from spanledger.operators.skew import lookup_join
from spanledger.session import HASHES, broadcast_if_small, hold, materialize

#: Domain prefix of receipt signatures.
RECEIPT_CONTEXT = "spanledger/audit-receipt/v1"

#: Receipts of a segment. A chain starts anew at each multiple, so that the segments of a long chain fold side by side.
SEGMENT = 1 << 16

_IDENTIFIER = r"^[^\x00-\x1f\x7f]{1,256}$"
_EVENT = r"^[a-z][a-z0-9]*(?:[._-][a-z0-9]+)*$"


def _lookup(c: Column, table: dict[str, tuple[str, ...]]) -> Column:
    token = F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))
    result = F.lit(None).cast("string")
    for value, words in table.items():
        result = F.when(token.isin(*words), F.lit(value)).otherwise(result)
    return result


def prepare_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(events, rejects)``: actor and event names normalised, human actors only for reviews.

    Input: receipt_id, idempotency_key, job_id, trace_id, event_type,
    actor_type, actor_id, occurred_at timestamp, payload (JSON text).
    """
    c = F.col
    staged = events.select(
        *(n for n in events.columns if n not in ("event_type", "actor_type")),
        F.lower(F.trim("event_type")).alias("event_type"),
        _lookup(c("actor_type"), rules.RECEIPT_ACTORS).alias("actor_type"),
    ).withColumn("canonical_payload", F.to_json(F.try_parse_json("payload")))
    human_event = c("event_type").isin(*rules.REVIEW_EVENTS)
    problems = without_nulls(
        F.when(~F.coalesce(c("event_type").rlike(_EVENT), F.lit(False)), F.lit("event type is invalid")),
        F.when(c("actor_type").isNull(), F.lit("actor type is unknown")),
        F.when(~F.coalesce(c("actor_id").rlike(_IDENTIFIER), F.lit(False)), F.lit("actor id is invalid")),
        F.when(~F.coalesce(c("job_id").rlike(_IDENTIFIER), F.lit(False)), F.lit("job id is invalid")),
        F.when(c("canonical_payload").isNull(), F.lit("payload is not a JSON object")),
        F.when((c("actor_type") == "human") & ~human_event, F.lit("human actor outside a review")),
        F.when((c("actor_type") != "human") & human_event, F.lit("review without a human actor")),
    )
    checked = hold(staged.withColumn("problems", problems))
    good = checked.filter(F.size("problems") == 0).drop("problems", "payload").withColumn(
        "payload_sha256", sha(c("canonical_payload"))
    ).withColumnRenamed("canonical_payload", "payload")
    bad = checked.filter(F.size("problems") > 0).select("receipt_id", "job_id", F.array_join("problems", "; ").alias("reason"))
    return good, bad


def new_events(events: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(fresh, conflicts)``: replays of a receipt or idempotency key are left out.

    A replay whose content differs is a conflict. Within the batch the earliest
    event of an id or key counts, by time and then by id and content; the others
    are its replays. Stored keys are made unique, so no event is multiplied.
    """
    content = digest_of(
        actor_id=F.col("actor_id"),
        actor_type=F.col("actor_type"),
        event_type=F.col("event_type"),
        job_id=F.col("job_id"),
        payload_sha256=F.col("payload_sha256"),
        trace_id=F.col("trace_id"),
    )
    stored = existing.withColumn("stored_content", content)
    by_id = stored.groupBy("receipt_id").agg(F.min("stored_content").alias("content_by_id"))
    by_key = (
        stored.filter("idempotency_key is not null").groupBy("idempotency_key").agg(F.min("stored_content").alias("content_by_key"))
    )
    place = F.struct("occurred_at", "receipt_id", "content")
    batch = events.withColumn("content", content)
    # Equal copies are one event before anything is joined.
    batch = batch.dropDuplicates(["receipt_id", "idempotency_key", "content", "occurred_at"])
    first_id = batch.groupBy("receipt_id").agg(F.min(place).alias("first_by_id"))
    first_key = batch.filter("idempotency_key is not null").groupBy("idempotency_key").agg(F.min(place).alias("first_by_key"))
    # Events without a key have no partner by key; a key of their own spreads them.
    spread = F.coalesce(F.col("idempotency_key"), F.concat(F.lit("\x00"), F.col("receipt_id")))
    seen = (
        batch.withColumn("__key", spread)
        .join(by_id, "receipt_id", "left")
        .join(first_id, "receipt_id")
        .join(by_key.withColumnRenamed("idempotency_key", "__key"), "__key", "left")
        .join(first_key.withColumnRenamed("idempotency_key", "__key"), "__key", "left")
    )
    own = F.struct("occurred_at", "receipt_id", "content")
    earlier = F.when(F.col("first_by_id") < own, F.col("first_by_id.content")).otherwise(
        F.when(F.col("first_by_key") < own, F.col("first_by_key.content"))
    )
    seen = seen.withColumn("known", F.coalesce("content_by_id", "content_by_key", earlier))
    fresh = seen.filter(F.col("known").isNull()).select(*events.columns)
    conflicts = seen.filter(F.col("known") != F.col("content")).select(
        "receipt_id", "idempotency_key", "job_id", F.lit("reused for different evidence").alias("reason")
    )
    return fresh, conflicts


def _material(prefix: Column, previous: Column, sequence: Column) -> Column:
    """Canonical JSON of a receipt; ``prefix`` holds the fields before the previous hash."""
    return F.concat(
        prefix, json_string(previous), F.lit(',"schema_version":1,"sequence":'), sequence.cast("string"), F.lit("}")
    )


def material_prefix() -> Column:
    """``{"actor_id": ... "previous_receipt_hash":`` in canonical key order."""
    stamp = F.regexp_replace(
        F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""
    )
    return F.concat(
        F.lit('{"actor_id":'),
        json_string(F.col("actor_id")),
        F.lit(',"actor_type":'),
        json_string(F.col("actor_type")),
        F.lit(',"event_type":'),
        json_string(F.col("event_type")),
        F.lit(',"job_id":'),
        json_string(F.col("job_id")),
        F.lit(',"occurred_at":"'),
        stamp,
        F.lit('+00:00","payload_sha256":'),
        json_string(F.col("payload_sha256")),
        F.lit(',"previous_receipt_hash":'),
    )


def receipt_material() -> Column:
    """Canonical JSON of a stored receipt row."""
    return _material(material_prefix(), F.col("previous_receipt_hash"), F.col("sequence"))


def starts_segment(sequence: Column, segment: int) -> Column:
    """Whether a receipt is the first of its segment."""
    return (sequence - 1) % segment == 0


def segment_of(sequence: Column, segment: int) -> Column:
    return F.floor((sequence - 1) / segment).cast("bigint")


def _fold_chains(segment: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Walk rows sorted by job and sequence; carry the last hash of the current segment."""
        job, last = None, None
        for batch in batches:
            previous, hashes = [], []
            for own, sequence, prefix, start in zip(batch["job_id"], batch["sequence"], batch["prefix"], batch["start"], strict=True):
                if own != job or (sequence - 1) % segment == 0:
                    job, last = own, start if isinstance(start, str) else None
                quoted = "null" if last is None else f'"{last}"'
                material = f'{prefix}{quoted},"schema_version":1,"sequence":{sequence}}}'
                previous.append(last)
                last = hashlib.sha256(material.encode("utf-8")).hexdigest()
                hashes.append(last)
            yield batch[["__row", "sequence"]].assign(previous_receipt_hash=previous, receipt_hash=hashes)

    return run


def _numbered(slim: DataFrame, heads: DataFrame) -> DataFrame:
    """``slim`` with ``sequence``: its place by time and receipt id behind the stored head of its job.

    Rows are dealt by ranges of (job, time, id) and written in that order, so a
    job of any size is spread over many tasks. A job's places go on from
    partition to partition: one small row for each partition that holds it.
    """
    order = ["job_id", "occurred_at", "receipt_id"]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}))
    parts = ranged.groupBy("job_id", "__part").agg(F.min("__place").alias("__first"), F.count("*").alias("n"))
    before = Window.partitionBy("job_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(heads, "job_id", "left")
        .select("job_id", "__part", "__first", "before", F.coalesce("head_sequence", F.lit(0)).cast("bigint").alias("head_sequence"), "head_hash")
    )
    placed = lookup_join(ranged, starts, ["job_id", "__part"])
    sequence = F.col("head_sequence") + F.col("before") + F.col("__place") - F.col("__first") + 1
    return placed.withColumn("sequence", sequence.cast("bigint"))


def _fold_jobs(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number and walk rows sorted by job, time and id; the other columns pass as they are."""
        job, last, sequence = object(), None, 0
        for batch in batches:
            numbers, previous, hashes = [], [], []
            given = (batch.column(name).to_pylist() for name in ("job_id", "head_sequence", "head_hash", "prefix"))
            for own, head, start, prefix in zip(*given, strict=True):
                if own != job:
                    job, last, sequence = own, start, head or 0
                sequence += 1
                if (sequence - 1) % segment == 0:
                    last = None
                quoted = "null" if last is None else f'"{last}"'
                material = f'{prefix}{quoted},"schema_version":1,"sequence":{sequence}}}'
                numbers.append(sequence)
                previous.append(last)
                last = hashlib.sha256(material.encode("utf-8")).hexdigest()
                hashes.append(last)
            made = {"sequence": pa.array(numbers, pa.int64()), "previous_receipt_hash": pa.array(previous, pa.string()), "receipt_hash": pa.array(hashes, pa.string())}
            kept = {name: batch.column(name) for name in batch.schema.names if name not in ("head_sequence", "head_hash", "prefix")}
            yield pa.RecordBatch.from_pydict({**kept, **made})

    return run


def _chained(*fields: T.StructField) -> T.StructType:
    """A schema with the columns of a chain behind ``fields``."""
    return T.StructType([*fields]).add("sequence", "long").add("previous_receipt_hash", "string").add("receipt_hash", "string")


def _whole_jobs(events: DataFrame, heads: DataFrame, segment: int) -> DataFrame:
    """Chain jobs that a task can hold: whole rows are dealt by job once, and numbered and folded where they then lie."""
    order = ["job_id", "occurred_at", "receipt_id"]
    dealt = events.withColumn("prefix", material_prefix()).join(heads, "job_id", "left").select(*events.columns, "prefix", "head_sequence", "head_hash")
    return dealt.repartition("job_id").sortWithinPartitions(*order).mapInArrow(_fold_jobs(segment), _chained(*events.schema.fields))


def _long_jobs(events: DataFrame, heads: DataFrame, segment: int) -> DataFrame:
    """Chain jobs of any length: rows are numbered by ranges, and segments fold side by side.

    The fold gets the job, the sequence and the canonical beginning of each
    receipt, nothing else; the other columns join by the row's number.
    """
    c = F.col
    # Written once, so that the numbers of the rows hold.
    base = materialize(events.withColumn("__row", F.monotonically_increasing_id()))
    numbered = _numbered(base.select("__row", "job_id", "occurred_at", "receipt_id", material_prefix().alias("prefix")), heads)
    goes_on = (c("sequence") == c("head_sequence") + 1) & ~starts_segment(c("sequence"), segment)
    folded = (
        numbered.select("__row", "job_id", "sequence", "prefix", F.when(goes_on, c("head_hash")).alias("start"))
        .repartition("job_id", segment_of(c("sequence"), segment))
        .sortWithinPartitions("job_id", "sequence")
        .mapInPandas(_fold_chains(segment), _chained(T.StructField("__row", T.LongType())))
    )
    return base.join(folded, "__row").drop("__row")


def build_receipts(fresh: DataFrame, existing: DataFrame, signing_key_id: str, keys: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Chain new events behind the stored head of each job and sign them.

    Each hash needs the one before it, up to the segment's first receipt, which
    has none before it. Jobs of up to ``segment`` new events are dealt whole, by
    one shuffle. Longer ones are numbered by ranges, and their segments fold
    side by side, so a job of any length is spread over all tasks;
    :func:`chain_roots` binds its segments together.
    """
    heads = existing.groupBy("job_id").agg(
        F.max("sequence").alias("head_sequence"), F.max_by("receipt_hash", "sequence").alias("head_hash")
    )
    # Written once: jobs are counted before they are dealt.
    base = materialize(fresh, HASHES)
    long = materialize(base.groupBy("job_id").agg(F.count("*").alias("n")).filter(F.col("n") > segment).select("job_id"))
    if long.isEmpty():
        chained = _whole_jobs(base, heads, segment)
    else:
        long = broadcast_if_small(long)
        some, others = base.join(long, "job_id", "left_semi"), base.join(long, "job_id", "left_anti")
        chained = _whole_jobs(others, heads, segment).unionByName(_long_jobs(some, heads, segment))
    return sign_receipts(chained.withColumn("signing_key_id", F.lit(signing_key_id)), keys)


def segment_heads(receipts: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(job_id, segment, receipts, head_hash) of every segment of stored chains."""
    return receipts.groupBy("job_id", segment_of(F.col("sequence"), segment).alias("segment")).agg(
        F.count("*").alias("receipts"), F.max_by("receipt_hash", "sequence").alias("head_hash")
    )


def chain_roots(receipts: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One hash that commits to all receipts of a job: (job_id, segments, root).

    The heads of a job's segments are the leaves of a mountain range: neighbours
    (0 and 1, 2 and 3, ...) are hashed together level by level, a node without a
    right neighbour is a peak, and the root is the hash of the peaks from left
    to right. New segments leave all finished mountains as they are. A level is
    one aggregation over half the rows of the one before.
    """
    level = materialize(segment_heads(receipts, segment).select("job_id", F.col("segment").alias("place"), F.col("head_hash").alias("hash")))
    sizes = level.groupBy("job_id").agg(F.count("*").alias("segments"))
    peaks, height = [], 0
    while True:
        pairs = level.groupBy("job_id", F.floor(F.col("place") / 2).alias("place")).agg(
            F.count("*").alias("n"), F.min_by("hash", "place").alias("left"), F.max_by("hash", "place").alias("right")
        )
        # A peak's place among the leaves orders the peaks.
        peaks.append(pairs.filter("n = 1").select("job_id", F.shiftleft(F.col("place") * 2, height).alias("leaf"), F.col("left").alias("hash")))
        above = pairs.filter("n = 2").select("job_id", "place", sha(F.concat("left", "right")).alias("hash"))
        if above.isEmpty():
            break
        level, height = materialize(above), height + 1
    every = peaks[0]
    for more in peaks[1:]:
        every = every.unionByName(more)
    # A job has at most one peak of each height.
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "hash"))), lambda p: p["hash"]), "")
    return sizes.join(every.groupBy("job_id").agg(sha(listed).alias("root")), "job_id")


def _padded(keys: DataFrame) -> DataFrame:
    inner, outer = padded_keys(F.col("key"))
    return keys.filter(F.octet_length("key") >= 32).select(
        "signing_key_id", inner.alias("inner_key"), outer.alias("outer_key")
    )


def _signature() -> Column:
    prefix = F.concat(F.lit(RECEIPT_CONTEXT).cast("binary"), F.unhex(F.lit("00")))
    message = F.concat(prefix, receipt_material().cast("binary"))
    return base64url(hmac_sha256(F.col("inner_key"), F.col("outer_key"), message))


def sign_receipts(receipts: DataFrame, keys: DataFrame) -> DataFrame:
    signed = lookup_or_broadcast(receipts, _padded(keys), ["signing_key_id"])
    return signed.withColumn("signature", _signature()).drop("inner_key", "outer_key")


def verify_receipts(receipts: DataFrame, keys: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row per receipt with the checks that failed.

    What a receipt shows alone (its hash, payload and signature) is checked
    where it lies. Hashes and times are then dealt by job and segment, once; a
    frame of the sequence before gives the previous receipt. The last receipt
    of a segment is also seen beside the first of the next, so a chain of any
    length is spread over all tasks.
    """
    c = F.col
    alone = [F.when(~c("receipt_hash").eqNullSafe(sha(receipt_material())), F.lit("receipt_hash"))]
    if "payload" in receipts.columns:
        alone.append(F.when(~c("payload_sha256").eqNullSafe(sha(c("payload"))), F.lit("payload_hash")))
    if keys is not None:
        receipts = lookup_or_broadcast(receipts, _padded(keys), ["signing_key_id"])
        alone.append(F.when(~c("signature").eqNullSafe(_signature()), F.lit("signature")))
    own = segment_of(c("sequence"), segment)
    ghost = F.when(c("sequence") % segment == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    seen = receipts.select(
        "job_id", "sequence", "previous_receipt_hash", "receipt_hash", "occurred_at", without_nulls(*alone).alias("alone"), F.explode(ghost).alias("next")
    ).withColumn("segment", own + c("next"))
    frame = Window.partitionBy("job_id", "segment").orderBy("sequence")
    before, same = frame.rangeBetween(-1, -1), frame.rangeBetween(0, 0)
    first = starts_segment(c("sequence"), segment)
    linked = seen.select(
        "*",
        F.count("*").over(same).alias("copies"),
        (F.count("*").over(before) > 0).alias("has_previous"),
        F.when(~first, F.min("receipt_hash").over(before)).alias("expected_previous"),
        F.max("occurred_at").over(before).alias("previous_time"),
    ).filter("next = 0")
    checks = [
        F.when((c("sequence") > 1) & ~c("has_previous"), F.lit("gap")),
        F.when((c("sequence") < 1) | (c("copies") > 1), F.lit("sequence")),
        F.when(
            ~c("previous_receipt_hash").eqNullSafe(c("expected_previous")) & (c("has_previous") | first),
            F.lit("previous_hash"),
        ),
        F.when(c("occurred_at") < c("previous_time"), F.lit("time")),
    ]
    return linked.select("job_id", "sequence", F.concat(without_nulls(*checks), "alone").alias("failures"))


def verify_chains(receipts: DataFrame, keys: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """Per chain: receipts, failed receipts, first failed sequence and overall result."""
    failed = F.size("failures") > 0
    return verify_receipts(receipts, keys, segment).groupBy("job_id").agg(
        F.count("*").alias("receipts"),
        F.count_if(failed).alias("failed"),
        F.min(F.when(failed, F.col("sequence"))).alias("first_failure"),
        (F.count_if(failed) == 0).alias("valid"),
    )


def append_only(new: DataFrame, existing: DataFrame, keys: list[str], digest: str) -> tuple[DataFrame, DataFrame]:
    """``(insert, conflicts)``: idempotent append by key (SNK-02, AUD-04, AUD-05).

    A stored row with the same digest is a replay and is left out; one with
    another digest is a conflict. Copies inside the batch are counted per
    digest first and follow the same rule.
    """
    batch = new.groupBy(*keys, digest).agg(
        F.min_by(
            F.struct(*(n for n in new.columns if n not in (*keys, digest))),
            F.to_json(F.struct(*(n for n in new.columns if n not in (*keys, digest)))),
        ).alias("kept"),
    ).select(*keys, digest, "kept.*") if set(new.columns) - {*keys, digest} else new.distinct()
    versions = batch.groupBy(*keys).agg(F.count("*").alias("versions"))
    stored = existing.select(*keys, F.col(digest).alias("stored_digest"))
    joined = batch.join(versions, keys).join(stored, keys, "left")
    insert = joined.filter("stored_digest is null and versions = 1").select(*new.columns)
    conflicts = joined.filter(
        (F.col("stored_digest") != F.col(digest)) | (F.col("stored_digest").isNull() & (F.col("versions") > 1))
    ).select(*keys, F.col(digest).alias("new_digest"), "stored_digest")
    return insert, conflicts


def register_traces(traces: DataFrame) -> DataFrame:
    """Registration rows with receipt id and digest derived from job, trace and hash."""
    c = F.col
    rows = traces.withColumn(
        "receipt_id",
        F.concat(
            F.lit("receipt-"),
            F.substring(digest_of(job_id=c("job_id"), trace_id=c("trace_id"), trace_sha256=c("trace_sha256")), 1, 32),
        ),
    )
    return rows.withColumn(
        "registration_sha256",
        digest_of(
            job_id=c("job_id"),
            receipt_id=c("receipt_id"),
            span_count=c("span_count"),
            trace_id=c("trace_id"),
            trace_sha256=c("trace_sha256"),
        ),
    )


def record_reviews(reviews: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One immutable review per job; replays are dropped, other reviews conflict."""
    from spanledger.operators.governance import review_message

    hashed = reviews.withColumn(
        "signoff_sha256", sha(F.concat(review_message(), F.col("signature").cast("binary")))
    )
    return append_only(hashed, existing, ["job_id"], "signoff_sha256")


def verify_integrity(
    registrations: DataFrame, evaluations: DataFrame, receipts: DataFrame, reviews: DataFrame | None = None
) -> DataFrame:
    """Violations ``(record, key, problem)`` over registrations, evaluations and reviews (AUD-03).

    ``evaluations``: job_id, trace_id, evaluation_id, receipt_id, trace_sha256,
    payload, payload_sha256. ``reviews`` carry signature_valid.
    """
    c = F.col
    ids = receipts.select("receipt_id").distinct().withColumn("has_receipt", F.lit(True))

    def violations(df: DataFrame, record: str, key: Column, checks: list[Column]) -> DataFrame:
        # What a record shows alone is checked where it lies; only its key and the problems are dealt by receipt.
        slim = df.select("receipt_id", key.alias("key"), without_nulls(*checks).alias("alone"))
        missing = F.when(F.col("has_receipt").isNull(), F.array(F.lit("receipt_missing"))).otherwise(F.array().cast("array<string>"))
        return slim.join(ids, "receipt_id", "left").select(F.lit(record).alias("record"), "key", F.explode(F.concat(missing, "alone")).alias("problem"))

    expected = digest_of(
        job_id=c("job_id"),
        receipt_id=c("receipt_id"),
        span_count=c("span_count"),
        trace_id=c("trace_id"),
        trace_sha256=c("trace_sha256"),
    )
    found = violations(
        registrations,
        "registration",
        F.concat_ws("/", "job_id", "trace_id"),
        [F.when(c("registration_sha256") != expected, F.lit("digest_mismatch"))],
    )
    registered = registrations.select("job_id", "trace_id", c("trace_sha256").alias("registered_sha256"))
    mismatch = (c("payload_sha256") != sha(c("payload"))).alias("payload_differs")
    own = evaluations.select("job_id", "trace_id", "evaluation_id", "receipt_id", "trace_sha256", mismatch)
    found = found.unionByName(
        violations(
            own.join(registered, ["job_id", "trace_id"], "left"),
            "evaluation",
            c("evaluation_id"),
            [
                F.when(c("payload_differs"), F.lit("digest_mismatch")),
                F.when(c("registered_sha256").isNull(), F.lit("registration_missing")),
                F.when(c("registered_sha256") != c("trace_sha256"), F.lit("trace_hash_mismatch")),
            ],
        )
    )
    if reviews is not None:
        found = found.unionByName(
            violations(reviews, "review", c("signoff_id"), [F.when(~c("signature_valid"), F.lit("signature_invalid"))])
        )
    return found


#: Rows of a month that a task of an append takes.
_APPENDED = 500_000


def _packed(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``rows`` with hexadecimal digests as bytes for a shuffle, and the columns that give ``rows`` again.

    A digest that is not lower-case hexadecimal stays as it is beside them.
    """
    given = {f.name for f in rows.schema.fields if f.dataType == T.StringType() and f.name.endswith(("_hash", "_sha256"))}
    plain = {name: F.col(name).rlike("^(?:[0-9a-f][0-9a-f])+$") for name in given}
    packed = rows.select(
        *(n for n in rows.columns if n not in given),
        *(F.when(plain[n], F.unhex(n)).alias(f"{n}__bytes") for n in given),
        *(F.when(~plain[n], F.col(n)).alias(f"{n}__text") for n in given),
    )
    return packed, [F.coalesce(F.lower(F.hex(f"{n}__bytes")), F.col(f"{n}__text")).alias(n) if n in given else F.col(n) for n in rows.columns]


def append_receipts(receipts: DataFrame, path: str) -> DataFrame:
    """Append-only write, partitioned by month; returns what was new (SNK-01).

    Receipts that the store has already, by receipt id and hash, which covers
    the time, are left out, so a repeated append changes nothing. Of the store,
    only the two columns of the months that the batch touches are read. Rows are
    dealt once, by month and parts of large months, beside the stored keys, and
    written where copies have met; ``batch`` names the append.
    """
    spark = receipts.sparkSession
    batch = uuid.uuid4().hex
    rows = receipts.drop("batch").withColumn("month", F.date_format("occurred_at", "yyyy-MM")).withColumn("batch", F.lit(batch))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    # A few names a year, for the parts of a month and so that the filter prunes folders.
    sizes = {r["month"]: r["n"] for r in rows.groupBy("month").agg(F.count("*").alias("n")).collect()}
    beside = rows.withColumn("stored", F.lit(False))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        stored = spark.read.schema(schema).parquet(path).filter(F.coalesce(F.col("month").isin(*(m for m in sizes if m is not None)), F.lit(None in sizes)))
        beside = beside.unionByName(stored.select("receipt_id", "receipt_hash", "month", F.lit(True).alias("stored")), allowMissingColumns=True)
    parts = F.lit(1)
    for month, n in sizes.items():
        if n > _APPENDED:
            parts = F.when(F.col("month").eqNullSafe(F.lit(month)), F.lit(-(-n // _APPENDED))).otherwise(parts)
    packed, whole = _packed(beside.withColumn("part", F.pmod(F.xxhash64("receipt_id", "receipt_hash"), parts).cast("int")))
    same = Window.partitionBy("month", "part", "receipt_id", "receipt_hash__bytes", "receipt_hash__text").orderBy(F.desc("stored"))
    fresh = packed.repartition("month", "part").withColumn("place", F.row_number().over(same)).filter("place = 1 and not stored").select(*whole)
    fresh.select(*schema.names).write.mode("append").partitionBy("month").option("compression", HASHES).parquet(path)
    return spark.read.schema(schema).parquet(path).filter(F.col("batch") == batch)
