"""Span records to the ``spans`` table (PRJ-01 to PRJ-08, VAL-01, VAL-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import rules
from spanledger.functions import variants as V
from spanledger.functions.hashing import without_nulls
from spanledger.session import hold
from spanledger.sources.spans import UNPARSED


def _id_sql(v: str, width: int | None) -> str:
    """``struct<id, ok, empty>``: hex ids are padded, others kept lower-case."""
    fits = f"length(i.txt) <= {width or 256}"
    padded = f"lpad(lower(i.txt), {width}, '0')" if width else "lower(i.txt)"
    ok = f"""case i.kind
        when 'BIGINT' then i.raw rlike '^[0-9]+$' and {fits}
        when 'STRING' then not i.raw rlike '[\\\\x00-\\\\x1f\\\\x7f]'
            and length(i.txt) <= if(i.hex, {width or 256}, 256)
        else false end"""
    parts = (
        f"transform(array({v}), x -> named_struct('kind', schema_of_variant(x), "
        f"'raw', trim({V.sql_text('x')})))"
    )
    named = (
        f"transform({parts}, k -> named_struct('kind', k.kind, 'raw', k.raw, 'txt', "
        "if(k.kind = 'BIGINT', lower(conv(k.raw, 10, 16)), regexp_replace(k.raw, '^0x', ''))))"
    )
    typed = (
        f"transform({named}, k -> named_struct('kind', k.kind, 'raw', k.raw, 'txt', k.txt, "
        "'hex', k.txt rlike '^[0-9a-fA-F]+$'))"
    )
    empty = "(coalesce(i.kind, 'VOID') = 'VOID' or (i.kind = 'STRING' and i.raw = ''))"
    result = (
        f"named_struct('id', if({empty} or not {ok}, null, if(i.hex, {padded}, lower(i.txt))), "
        f"'ok', {empty} or {ok}, 'empty', {empty})"
    )
    return f"get(transform({typed}, i -> {result}), 0)"


def normalize_id(v: str, width: int | None) -> Column:
    """Identifier in variant column ``v`` as ``struct<id, ok, empty>``."""
    return F.expr(_id_sql(v, width))


def _time_sql(v: str, unit: str) -> str:
    """ISO text or a number to a UTC timestamp, else null.

    ``unit`` is SQL for the units per second; 0 means that a numeric text is
    scaled by its size and a JSON number counts seconds.
    """
    number = r"^[+-]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)(?:[eE][+-]?\\d+)?$"
    parts = (
        f"transform(array({v}), x -> named_struct('kind', schema_of_variant(x), "
        f"'txt', trim({V.sql_text('x')}), 'unit', {unit}))"
    )
    typed = (
        f"transform({parts}, k -> named_struct('kind', k.kind, 'txt', k.txt, 'unit', k.unit, "
        f"'num', if(k.kind not in ('BOOLEAN', 'VOID') and k.txt rlike '{number}', try_cast(k.txt as decimal(38,9)), null)))"
    )
    scale = """case when t.unit > 0 then t.unit
        when t.kind <> 'STRING' then 1
        when abs(t.num) >= 100000000000000000 then 1000000000
        when abs(t.num) >= 100000000000000 then 1000000
        when abs(t.num) >= 100000000000 then 1000 else 1 end"""
    micros = f"try_cast(round(cast(t.num as decimal(28,6)) * 1000000 / cast({scale} as decimal(10,0)), 0) as bigint)"
    iso = r"^\\d{4}-\\d{2}-\\d{2}"
    result = (
        f"case when t.num is not null then timestamp_micros({micros}) "
        f"when t.kind = 'STRING' and t.txt rlike '{iso}' then try_cast(t.txt as timestamp) end"
    )
    return f"get(transform({typed}, t -> {result}), 0)"


def coerce_time(v: str, units_per_second: int | None = None) -> Column:
    return F.expr(_time_sql(v, str(units_per_second or 0)))


def _time_unit_sql(fields: str, keys) -> str:
    """SQL for the units per second of the first key present, 0 if it does not say."""
    return "case " + " ".join(f"when {fields}['{key}'] is not null then {units or 0}" for key, units in keys) + " end"


Stage = dict[str, Column]


def _id_stages(name: str, width: int) -> list[Stage]:
    """Columns that turn variant ``name`` into ``{name}_id``, ``{name}_ok`` and ``{name}_empty``, step by step.

    The same rule as :func:`normalize_id`, as plain projections: each step
    stands in the plan once and stays in generated code.
    """
    kind, raw, text, is_hex = (F.col(f"{name}_{part}") for part in ("kind", "raw", "text", "hex"))
    whole = (kind == "BIGINT") & raw.rlike("^[0-9]+$") & (F.length(text) <= width)
    worded = (kind == "STRING") & ~raw.rlike(r"[\x00-\x1f\x7f]") & (F.length(text) <= F.when(is_hex, width).otherwise(256))
    empty = F.coalesce(kind, F.lit("VOID")).isin("VOID") | ((kind == "STRING") & (raw == ""))
    ok, none = F.col(f"{name}_ok"), F.col(f"{name}_empty")
    return [
        {f"{name}_kind": F.schema_of_variant(name), f"{name}_raw": F.trim(V.text(F.col(name)))},
        {f"{name}_text": F.when(kind == "BIGINT", F.lower(F.conv(raw, 10, 16))).otherwise(F.regexp_replace(raw, "^0x", ""))},
        {f"{name}_hex": text.rlike("^[0-9a-fA-F]+$"), f"{name}_empty": empty},
        {f"{name}_ok": none | F.coalesce(whole | worded, F.lit(False))},
        {f"{name}_id": F.when(ok & ~none, F.when(is_hex, F.lpad(F.lower(text), width, "0")).otherwise(F.lower(text)))},
    ]


def _time_stages(name: str) -> list[Stage]:
    """Columns that turn variant ``{name}_raw`` and ``{name}_unit`` into ``{name}_time``; the rule of :func:`coerce_time`."""
    raw, unit, kind, text, number = (F.col(f"{name}_{part}") for part in ("raw", "unit", "kind", "text", "number"))
    numeric = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
    size = F.abs(number)
    scale = (
        F.when(unit > 0, unit)
        .when(kind != "STRING", 1)
        .when(size >= 100_000_000_000_000_000, 1_000_000_000)
        .when(size >= 100_000_000_000_000, 1_000_000)
        .when(size >= 100_000_000_000, 1000)
        .otherwise(1)
    )
    micros = F.round(number.cast("decimal(28,6)") * 1_000_000 / scale.cast("decimal(10,0)"), 0).try_cast("bigint")
    iso = (kind == "STRING") & text.rlike(r"^\d{4}-\d{2}-\d{2}")
    return [
        {f"{name}_kind": F.schema_of_variant(raw), f"{name}_text": F.trim(V.text(raw))},
        {f"{name}_number": F.when(~kind.isin("BOOLEAN", "VOID") & text.rlike(numeric), text.try_cast("decimal(38,9)"))},
        {f"{name}_time": F.when(number.isNotNull(), F.timestamp_micros(micros)).when(iso, text.try_cast("timestamp"))},
    ]


def _word_stages(name: str, token, table: dict[str, tuple[str, ...]], missing: str) -> list[Stage]:
    """Columns that turn variant ``name`` into ``{name}_word``, one of the words of ``table``."""
    given, kind = F.col(name), F.col(f"{name}_is")
    return [
        {f"{name}_is": F.schema_of_variant(given), f"{name}_token": token(F.lower(F.trim(V.text(given))))},
        {f"{name}_word": F.when(given.isNull(), missing).when(kind == "STRING", _lookup(F.col(f"{name}_token"), table))},
    ]


def _staged(df: DataFrame, *columns: list[Stage]) -> DataFrame:
    """Add the steps of several columns side by side."""
    for step in range(max(map(len, columns))):
        df = df.withColumns({k: v for stages in columns if step < len(stages) for k, v in stages[step].items()})
    return df


def _lookup(token: Column, table: dict[str, tuple[str, ...]]) -> Column:
    result = F.lit(None).cast("string")
    for value, words in reversed(list(table.items())):
        result = F.when(token.isin(*words), F.lit(value)).otherwise(result)
    return result


def _kind_token(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _typed_sql(v: str) -> str:
    """``struct<value, bad>`` of an attribute value: typed scalars to plain values, others unchanged.

    ``bad`` marks an ill-typed one. Containers are plain already
    (:func:`spanledger.functions.anyvalue.parse_record`).
    """
    text, boolean = V.sql_pick("t", rules.ANY_TEXT), V.sql_pick("t", rules.ANY_BOOLEAN)
    integer, double = V.sql_pick("t", rules.ANY_INTEGER), V.sql_pick("t", rules.ANY_DOUBLE)
    binary = V.sql_pick("t", rules.ANY_BINARY)
    whole, number = f"try_cast({V.sql_text(integer)} as bigint)", f"try_cast({V.sql_text(double)} as double)"
    bytes_ = f"try_to_binary({V.sql_text(binary)}, 'base64')"
    value = (
        f"coalesce({text}, {boolean}, cast({whole} as variant), cast({number} as variant), "
        f"cast(make_valid_utf8(cast({bytes_} as string)) as variant), {v})"
    )
    bad = (
        f"({boolean} is not null and schema_of_variant({boolean}) <> 'BOOLEAN')"
        f" or ({integer} is not null and {whole} is null)"
        f" or ({double} is not null and not coalesce(abs({number}) < double('Infinity'), false))"
        f" or ({binary} is not null and {bytes_} is null)"
    )
    return (
        f"get(transform(array({V.sql_fields(v)}), t -> if(t is null, named_struct('value', {v}, 'bad', false), "
        f"named_struct('value', {value}, 'bad', {bad}))), 0)"
    )


#: An empty text as SQL.
EMPTY = "''"


def _entries_sql(v: str) -> str:
    """An attribute list or object as ``array<struct<key, value, bad>>``; null stays null.

    Nameless entries, ill-typed values and layers that are neither list nor
    object are bad; bad entries without a name have a null key.
    """
    entry = f"named_struct('key', {{key}}, 'value', x.value, 'bad', x.bad{{more}})"

    def read(value: str, key: str, more: str) -> str:
        return f"get(transform(array({_typed_sql(value)}), x -> {entry.format(key=key, more=more)}), 0)"

    of_map = f"transform(map_entries(om), p -> {read('p.value', 'p.key', '')})"
    named = V.sql_text("e['key']")
    of_list = f"transform(transform({V.sql_list(v)}, q -> {V.sql_fields('q')}), e -> {read(_member('e', 'value'), named, f' or coalesce({named} = {EMPTY}, true)')})"
    other = f"array(named_struct('key', cast(null as string), 'value', {v}, 'bad', true))"
    body = f"case when om is not null then {of_map} when {v} is not null then coalesce({of_list}, {other}) end"
    return f"get(transform(array({V.sql_map(v)}), om -> {body}), 0)"


def _member(fields: str, key: str) -> str:
    return f"{fields}['{key}']"


def _map_sql(entries: str) -> str:
    """Entries to ``map<string,variant>``; of equal keys the last one stays."""
    return f"map_from_entries(transform(filter({entries}, e -> e.key is not null), e -> named_struct('key', e.key, 'value', e.value)))"


def _attributes_sql(v: str) -> str:
    """Key/value list or object to ``map<string,variant>``; null stays null."""
    return _map_sql(_entries_sql(v))


def decode_value(v: str) -> Column:
    """OTLP AnyValue in column ``v`` to a plain variant."""
    return F.expr(f"{_typed_sql(v)}.value")


def decode_attributes(v: str) -> Column:
    """Attribute list or object in column ``v`` to ``map<string,variant>``."""
    return F.expr(_attributes_sql(v))


def layer_entries(layers: str) -> Column:
    """Entries of all attribute layers, oldest first."""
    none = "cast(array() as array<struct<key:string,value:variant,bad:boolean>>)"
    return F.expr(f"flatten(transform({layers}, a -> coalesce({_entries_sql('a')}, {none})))")


def attribute_error(entries: str) -> Column:
    """Whether one of the entries is nameless or ill-typed, or a layer is neither list nor object."""
    return F.expr(f"exists({entries}, e -> e.bad)")


_EMPTY_MAP = "cast(map() as map<string,variant>)"


def merge_layers(entries: str) -> Column:
    """Entries of attribute layers, oldest first, to one map; a later layer wins."""
    return F.expr(_map_sql(entries))


def _rows_sql(v: str) -> str:
    """An array, or a single object as an array of one."""
    return (
        f"coalesce({V.sql_list(v)}, if({V.sql_map(v)} is not null, array({v}), null), "
        f"cast(array() as {V.LIST}))"
    )


def _variant_sql(m: str) -> str:
    return f"to_variant_object(coalesce({m}, {_EMPTY_MAP}))"


_OWN_ATTRIBUTES = _attributes_sql(V.sql_pick("f", ("attributes", "attrs")))


def _each_sql(v: str, body: str) -> str:
    """``body`` for each object of a list, or for a single one, with ``f`` for its children."""
    return f"transform({_rows_sql(v)}, o -> get(transform(array({V.sql_fields('o')}), f -> {body}), 0))"


def events_of(v: str) -> Column:
    """Events of a span: one object or an array, attributes decoded."""
    stamp = V.sql_pick("f", ("timestamp", "time", "time_unix_nano", "ts"))
    return F.expr(
        _each_sql(
            v,
            f"named_struct('name', trim({V.sql_text(_member('f', 'name'))}), "
            f"'timestamp', {_time_sql(stamp, '0')}, "
            f"'attributes', {_variant_sql(_OWN_ATTRIBUTES)})",
        )
    )


def _link_id_sql(v: str, width: int) -> str:
    """Link ids may be base64; decoded only when the byte length is exact."""
    text = f"trim({V.sql_text('q')})"
    decoded = f"lower(hex(try_to_binary({text}, 'base64')))"
    # Shorter texts cannot hold the bytes, and a failed decoding costs an exception.
    base64_form = f"length({text}) >= {-(-width * 2 // 3)} and not {text} rlike '^(?:0x)?[0-9a-fA-F]+$' and length({decoded}) = {width}"
    return f"get(transform(array({v}), q -> if({base64_form}, {decoded}, {_id_sql('q', width)}.id)), 0)"


def links_of(v: str) -> Column:
    """Links of a span: one object or an array, ids normalised, attributes decoded."""
    span_keys = ("span_id", "spanId", "spanID", "linked_span_id", "id")
    return F.expr(
        _each_sql(
            v,
            f"named_struct('trace_id', {_link_id_sql(V.sql_pick('f', rules.TRACE_ID_KEYS), 32)}, "
            f"'span_id', {_link_id_sql(V.sql_pick('f', span_keys), 16)}, "
            f"'trace_state', {_variant_sql(V.sql_map(_member('f', 'trace_state')))}, "
            f"'attributes', {_variant_sql(_OWN_ATTRIBUTES)})",
        )
    )


def _is_scalar(name: str) -> Column:
    """Whether a variant is there and neither list nor object."""
    kind = F.schema_of_variant(name)
    return F.coalesce(~(kind.startswith("ARRAY") | kind.startswith("OBJECT")), F.lit(False))


def _issue(when: Column, reason: str) -> Column:
    return F.when(when, F.lit(reason))


def normalize_spans(records: DataFrame) -> DataFrame:
    """One typed row per span record, with ``issues array<string>`` (empty = valid)."""
    def pick(fields: str, keys) -> Column:
        return F.expr(V.sql_pick(fields, keys))

    # The children of the span, its context and its status, each looked at once.
    parts = records.select(
        "source",
        "block",
        "row",
        "item",
        "span",
        "layers",
        "trace_hint",
        F.col("error") if "error" in records.columns else F.lit(None).cast("string").alias("error"),
        F.expr(V.sql_fields("span")).alias("m"),
    )
    parts = parts.withColumns({"c": F.expr(V.sql_fields("m['context']")), "st": F.expr(V.sql_fields("m['status']"))})
    fields = parts.select(
        "source",
        "block",
        "row",
        "item",
        "span",
        "error",
        F.coalesce(pick("m", rules.TRACE_ID_KEYS), "trace_hint", pick("c", rules.TRACE_ID_KEYS)).alias("trace"),
        pick("m", rules.SPAN_ID_KEYS).alias("id"),
        F.coalesce(pick("m", rules.PARENT_ID_KEYS), pick("c", rules.PARENT_ID_KEYS)).alias("parent"),
        pick("m", rules.NAME_KEYS).alias("label"),
        pick("m", ("kind", "spanKind")).alias("kind"),
        F.when(F.col("st").isNull(), F.expr("m['status']")).otherwise(pick("st", ("code", "status_code", "statusCode"))).alias("status"),
        F.coalesce(
            pick("m", ("status_message", "statusMessage", "status_description", "statusDescription")),
            pick("st", ("message", "description", "status_message", "statusMessage")),
        ).alias("message"),
        layer_entries("concat(layers, array(coalesce(m['attributes'], m['attrs'])))").alias("entries"),
        F.expr("m['events']").alias("event_list"),
        F.expr("m['links']").alias("link_list"),
        pick("m", [key for key, _ in rules.START_KEYS]).alias("start_raw"),
        F.expr(_time_unit_sql("m", rules.START_KEYS)).alias("start_unit"),
        pick("m", [key for key, _ in rules.END_KEYS]).alias("end_raw"),
        F.expr(_time_unit_sql("m", rules.END_KEYS)).alias("end_unit"),
    )
    typed = _staged(
        fields,
        _id_stages("trace", 32),
        _id_stages("id", 16),
        _id_stages("parent", 16),
        _time_stages("start"),
        _time_stages("end"),
        _word_stages("kind", _kind_token, rules.SPAN_KINDS, "internal"),
        _word_stages("status", lambda word: word, rules.SPAN_STATUSES, "unset"),
    )
    end_given = F.col("end_raw").isNotNull() & ~V.text(F.col("end_raw")).isin("0", "")

    staged = typed.select(
        "source",
        "block",
        "row",
        "item",
        "error",
        *(f"{name}_{part}" for name in ("trace", "id", "parent") for part in ("id", "ok", "empty")),
        F.expr(f"trim(if(schema_of_variant(label) = 'STRING', {V.sql_text('label')}, null))").alias("name"),
        F.col("kind_word").alias("kind"),
        F.col("start_raw").isNotNull().alias("start_given"),
        F.col("start_time"),
        end_given.alias("end_given"),
        F.when(end_given, F.col("end_time")).alias("end_time"),
        F.col("status_word").alias("status"),
        F.expr(f"nullif(trim({V.sql_text('message')}), '')").alias("status_message"),
        attribute_error("entries").alias("bad_attributes"),
        F.to_variant_object(merge_layers("entries")).alias("attributes"),
        events_of("event_list").alias("events"),
        links_of("link_list").alias("links"),
        (_is_scalar("event_list") | _is_scalar("link_list")).alias("bad_lists"),
        "span",
    )
    control = r"[\x00-\x1f\x7f]"
    issues = without_nulls(
        _issue(F.col("trace_empty"), "trace_id is required"),
        _issue(~F.col("trace_ok"), "trace_id is invalid"),
        _issue(F.col("id_empty"), "span_id is required"),
        _issue(~F.col("id_ok"), "span_id is invalid"),
        _issue(~F.col("parent_ok"), "parent_span_id is invalid"),
        _issue(F.coalesce(F.col("name"), F.lit("")) == "", "span name is required"),
        _issue((F.length("name") > 512) | F.col("name").rlike(control), "span name is invalid"),
        _issue(~F.col("start_given"), "start time is required"),
        _issue(F.col("start_given") & F.col("start_time").isNull(), "start time is invalid"),
        _issue(F.col("end_given") & F.col("end_time").isNull(), "end time is invalid"),
        _issue(F.col("end_time") < F.col("start_time"), "end_time cannot precede start_time"),
        _issue(F.col("kind").isNull(), "span kind is invalid"),
        _issue(F.col("status").isNull(), "status is invalid"),
        _issue(F.length("status_message") > 2000, "status_message is too long"),
        _issue(F.col("bad_attributes"), "attributes are invalid"),
        _issue(F.col("bad_lists"), "events and links must be arrays"),
        _issue(
            F.exists(
                "events",
                lambda e: e["timestamp"].isNull()
                | ~F.coalesce(F.length(e["name"]).between(1, 128), F.lit(False))
                | e["name"].rlike(control),
            ),
            "span event is invalid",
        ),
        _issue(F.exists("links", lambda e: e["span_id"].isNull()), "span link is invalid"),
    )
    normalized = staged.select(
        F.col("trace_id").alias("trace_id"),
        F.col("id_id").alias("span_id"),
        F.col("parent_id").alias("parent_span_id"),
        "name",
        "kind",
        "start_time",
        "end_time",
        "status",
        "status_message",
        "attributes",
        "events",
        "links",
        "source",
        "block",
        "row",
        "item",
        F.when(F.col("error").isNotNull(), F.array("error")).otherwise(issues).alias("issues"),
        "span",
    )
    # The text of a record is needed for rejected ones only.
    unparsed = F.array_contains("issues", UNPARSED)
    text = F.when(unparsed, V.text(F.col("span"))).when(F.size("issues") > 0, F.to_json("span"))
    return hold(normalized.withColumn("raw", text).drop("span"))


SPAN_COLUMNS = (
    "trace_id",
    "span_id",
    "parent_span_id",
    "name",
    "kind",
    "start_time",
    "end_time",
    "status",
    "status_message",
    "attributes",
    "events",
    "links",
    "source",
    "block",
    "row",
    "item",
)


def split_valid(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(spans, quarantine)`` of a permissive read; no record is lost.

    Both outputs parse the records; write ``normalized`` first to use both.
    Lines that are no JSON are among the rejected ones if the envelopes were
    unwrapped with ``keep_unparsed``.
    """
    spans = normalized.filter(F.size("issues") == 0).select(*SPAN_COLUMNS)
    rejected = normalized.filter(F.size("issues") > 0).select(
        "source",
        "block",
        "row",
        F.when(F.array_contains("issues", UNPARSED), "invalid_json").otherwise("invalid_span").alias("code"),
        F.array_join("issues", "; ").alias("reason"),
        "raw",
    )
    return spans, rejected


def require_valid(normalized: DataFrame) -> DataFrame:
    """Strict read: the job fails on the first invalid record."""
    message = F.concat(F.lit("invalid span: "), F.array_join("issues", "; "))
    checked = F.when(F.size("issues") > 0, F.raise_error(message)).otherwise(F.col("trace_id"))
    return normalized.withColumn("trace_id", checked).select(*SPAN_COLUMNS)


def explode_events(spans: DataFrame) -> DataFrame:
    """Span events; spans without events give no row."""
    return spans.select(
        "trace_id", "span_id", F.posexplode("events").alias("event_index", "e")
    ).select(
        "trace_id",
        "span_id",
        "event_index",
        F.col("e.name").alias("name"),
        F.col("e.timestamp").alias("timestamp"),
        F.col("e.attributes").alias("attributes"),
    )


def explode_links(spans: DataFrame) -> DataFrame:
    """Span links; spans without links give no row."""
    return spans.select(
        "trace_id", "span_id", F.posexplode("links").alias("link_index", "l")
    ).select(
        "trace_id",
        "span_id",
        "link_index",
        F.col("l.trace_id").alias("linked_trace_id"),
        F.col("l.span_id").alias("linked_span_id"),
        F.col("l.attributes").alias("attributes"),
    )
