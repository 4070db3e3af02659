"""Reading span files and unwrapping their envelopes.

``raw`` rows are ``(source, block, row, text, doc)``. ``block`` is the byte
offset of the file split and ``row`` grows inside a split, so ``(source, block,
row)`` orders the records of a file without reading the file in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanledger.functions import variants as V
from spanledger.functions.hashing import sha
from spanledger.functions.rules import SPAN_ID_KEYS, TRACE_ID_KEYS
from spanledger.functions.anyvalue import parse_record
from spanledger.session import broadcast_if_small

_OTLP_KEYS = ("resourceSpans", "resource_spans", "scopeSpans", "scope_spans")
_CONTAINER_KEYS = ("data", "records", "items")


def read_span_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSONL files or a directory of them; blank and ``#`` lines are skipped."""
    return _parsed(_with_location(spark.read.text(path)))


def stream_span_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same rows as :func:`read_span_lines` from a growing directory."""
    return _parsed(
        spark.readStream.text(path).select(
            F.col("_metadata.file_path").alias("source"),
            F.col("_metadata.file_block_start").alias("block"),
            F.lit(0).cast("long").alias("row"),
            F.col("value").alias("text"),
        )
    )


def read_span_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON document."""
    return _parsed(_with_location(spark.read.text(path, wholetext=True)))


def _with_location(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("text"),
    )


def _parsed(lines: DataFrame) -> DataFrame:
    text = F.trim(F.regexp_replace("text", "^﻿", ""))
    return (
        lines.withColumn("text", text)
        .filter((F.col("text") != "") & ~F.col("text").startswith("#"))
        .withColumn("doc", parse_record(F.col("text")))
    )


def line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """First ``row`` and number of preceding lines per file split.

    ``record = lines_before + row - first_row + 1`` is the physical line number.
    One small row per split; no file passes through one task.
    """
    located = _with_location(spark.read.text(path))
    blocks = located.groupBy("source", "block").agg(
        F.min("row").alias("first_row"), F.count("*").alias("lines")
    )
    before = Window.partitionBy("source").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return blocks.select(
        "source",
        "block",
        "first_row",
        F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"),
    )


def with_line_numbers(df: DataFrame, numbers: DataFrame) -> DataFrame:
    """Add ``record``, the physical line number, to rows that carry a location."""
    joined = df.join(broadcast_if_small(numbers), ["source", "block"], "left")
    return joined.withColumn(
        "record", F.col("lines_before") + F.col("row") - F.col("first_row") + 1
    ).drop("lines_before", "first_row")


def source_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of the bytes of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path").alias("source"), F.sha2("content", 256).alias("sha256"), "length"
    )


def combined_digest(digests: DataFrame) -> DataFrame:
    """One digest over the sorted digests of several sources."""
    from spanledger.operators.digests import tree_digest

    return tree_digest(digests.withColumn("scope", F.lit("all")), ["scope"], "sha256").select(
        F.col("digest").alias("sha256")
    )


def _any_present(doc: str, keys) -> str:
    return "(" + " or ".join(f"{V.sql_get(doc, key)} is not null" for key in keys) + ")"


def is_otlp(doc: str) -> Column:
    """Whether the document in column ``doc``, or an element of it, is OTLP."""
    return F.expr(
        f"coalesce(exists({V.sql_list(doc)}, d -> {_any_present('d', _OTLP_KEYS)}), "
        f"{_any_present(doc, _OTLP_KEYS)}, false)"
    )


def detect_format(raw: DataFrame) -> DataFrame:
    """``otlp`` if any document of the source is OTLP, else ``openinference``."""
    return raw.groupBy("source").agg(
        F.when(F.max(is_otlp("doc").cast("int")) == 1, "otlp").otherwise("openinference").alias("format")
    )


_NO_TRACE = "cast(null as variant)"
_ITEM = "struct<doc:variant,trace:variant,layers:array<variant>,found:boolean,error:string>"


def _item(doc: str, trace: str, layers: str, found: bool, error: str | None = None) -> str:
    """A document on its way: ``found`` marks a span, the rest is opened further.

    What cannot be opened ends as an item with an error, so that no record is lost.
    """
    reason = f"'{error}'" if error else "cast(null as string)"
    return (
        f"named_struct('doc', {doc}, 'trace', {trace}, "
        f"'layers', cast(array({layers}) as array<variant>), 'found', {str(found).lower()}, 'error', {reason})"
    )


def _failed(doc: str, error: str) -> str:
    return f"array({_item(doc, _NO_TRACE, '', True, error)})"


def _otlp_items(doc: str, fields: str) -> str:
    """resourceSpans > scopeSpans > spans with the resource and scope attributes as layers."""
    given = V.sql_pick(fields, ("resourceSpans", "resource_spans"))
    resources = f"if({given} is null, array({doc}), {V.sql_list(given)})"
    none = f"cast(array() as array<{_ITEM}>)"

    def listed(value: str, rows: str, name: str, whole: str) -> str:
        """Rows of a list; a missing list is empty, another value is an error."""
        return f"case when {value} is null then {none} when {rows} is null then {_failed(whole, f'{name} must be an array')} else {rows} end"

    outer = V.sql_get("rm['resource']", "attributes")
    inner = V.sql_get(V.sql_pick("cm", ("scope", "instrumentationLibrary")), "attributes")
    spans = f"transform({V.sql_list(_member('cm', 'spans'))}, n -> {_item('n', _NO_TRACE, f'{outer}, {inner}', True)})"
    per_scope = _within("c", "cm", listed(_member("cm", "spans"), spans, "spans", "c"))
    scope_value = V.sql_pick("rm", ("scopeSpans", "scope_spans", "instrumentationLibrarySpans"))
    per_resource = _within("r", "rm", listed(scope_value, f"flatten(transform({V.sql_list(scope_value)}, c -> {per_scope}))", "scopeSpans", "r"))
    return f"coalesce(flatten(transform({resources}, r -> {per_resource})), {_failed(doc, 'resourceSpans must be an array')})"


def _member(fields: str, key: str) -> str:
    return f"{fields}['{key}']"


def _within(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for the children of ``value``."""
    return f"get(transform(array({V.sql_fields(value)}), {name} -> {body}), 0)"


def _open_item(x: str) -> str:
    """What one document holds: spans, documents to open further, or nothing."""
    doc, own = f"{x}.doc", _member("m", "attributes")
    trace = f"coalesce({V.sql_pick('m', TRACE_ID_KEYS)}, {x}.trace)"
    single, many = _member("m", "span"), _member("m", "spans")
    nested = V.sql_pick("m", _CONTAINER_KEYS)
    decoded = f"if(schema_of_variant({nested}) = 'STRING', try_parse_json({V.sql_text(nested)}), {nested})"
    has_id = V.sql_any("m", SPAN_ID_KEYS)
    body = f"""case
        when m is null then if({V.sql_list(doc)} is not null,
            transform({V.sql_list(doc)}, d -> {_item('d', f'{x}.trace', '', False)}), {_failed(doc, 'record must be an object')})
        when {V.sql_any('m', _OTLP_KEYS)} then {_otlp_items(doc, 'm')}
        when {V.sql_map(single)} is not null then array({_item(single, trace, own, True)})
        when {V.sql_list(many)} is not null then transform({V.sql_list(many)}, d -> {_item('d', trace, own, True)})
        when {many} is not null then {_failed(doc, 'spans must be an array')}
        when {nested} is not null and not {has_id} then array({_item(decoded, trace, '', False)})
        when {has_id} then array({_item(doc, trace, '', True)})
        else {_failed(doc, 'record holds no span')} end"""
    return f"if({x}.found, array({x}), {_within(doc, 'm', body)})"


#: Error of a line that is no JSON.
UNPARSED = "record is not valid JSON or repeats a key"


def unwrap_envelopes(raw: DataFrame, keep_unparsed: bool = False) -> DataFrame:
    """Span records ``(source, block, row, item, span, trace_hint, layers, error)``.

    Handles bare spans, ``span``, ``spans``, nested ``data`` / ``records`` /
    ``items`` (also as JSON text), arrays of any of them, and OTLP documents.
    A record's keys are looked at once: bare spans pass as they are, the others
    are opened one level per step until only spans are left. With
    ``keep_unparsed`` a line that is no JSON is a record with its text and the
    error ``UNPARSED``, so that one pass gives spans and quarantine.
    """
    wrappers = ("span", "spans", *_CONTAINER_KEYS, *_OTLP_KEYS)
    keys = raw.select("source", "block", "row", "doc", "text", F.expr(f"map_keys({V.sql_fields('doc')})").alias("keys"))
    found = F.arrays_overlap("keys", F.array(*map(F.lit, SPAN_ID_KEYS))) & ~F.arrays_overlap("keys", F.array(*map(F.lit, wrappers)))
    text = ("text",) if keep_unparsed else ()
    shaped = keys.select("source", "block", "row", "doc", *text, F.coalesce(found, F.lit(False)).alias("bare"), F.length(F.regexp_replace("text", r"[^\{\[]", "")).alias("depth"))
    # A filter on the document would be pushed down and parse every record twice.
    none = _failed("cast(text as variant)", UNPARSED) if keep_unparsed else f"cast(array() as array<{_ITEM}>)"
    items = f"""case when doc is null then {none}
        when bare then array({_item('doc', _NO_TRACE, '', True)})
        else aggregate(sequence(0, depth + 1),
            named_struct('done', false, 'items', array({_item('doc', _NO_TRACE, '', False)})),
            (acc, step) -> if(acc.done, acc, named_struct(
                'done', not exists(acc.items, x -> not x.found),
                'items', flatten(transform(acc.items, x -> {_open_item('x')})))),
            acc -> acc.items) end"""
    return _records(shaped.select("source", "block", "row", F.posexplode(F.expr(items)).alias("item", "x")))


def _records(items: DataFrame) -> DataFrame:
    return items.select(
        "source",
        "block",
        "row",
        "item",
        F.col("x.doc").alias("span"),
        F.col("x.trace").alias("trace_hint"),
        F.col("x.layers").alias("layers"),
        F.col("x.error").alias("error"),
    )


def flatten_otlp(raw: DataFrame) -> DataFrame:
    """Span records of documents known to be OTLP, without looking for other envelopes."""
    items = _within("doc", "m", f"coalesce({_otlp_items('doc', 'm')})")
    return _records(raw.select("source", "block", "row", F.posexplode(F.expr(items)).alias("item", "x")))


def unparsed(raw: DataFrame) -> DataFrame:
    """Lines that are not JSON, or repeat a key, as quarantine rows."""
    return raw.filter(F.col("doc").isNull()).select(
        "source",
        "block",
        "row",
        F.lit("invalid_json").alias("code"),
        F.lit(UNPARSED).alias("reason"),
        F.col("text").alias("raw"),
    )


def document_digest(raw: DataFrame) -> DataFrame:
    """Digest of every record's text, the unit of the streaming source log."""
    return raw.select("source", "block", "row", sha(F.col("text")).alias("sha256"))
