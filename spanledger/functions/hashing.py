"""Digests, canonical JSON and HMAC as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys and explicit nulls; variants keep their content."""
    parts = [F.expr(f"'{name}'") for name in fields]
    pairs: list[Column] = []
    for key, value in zip(parts, fields.values()):
        pairs += [key, value]
    return F.to_json(F.to_variant_object(F.named_struct(*pairs)))


def digest_of(**fields: Column) -> Column:
    return sha(canonical_json(**fields))


def plain_json(**fields: Column) -> Column:
    """:func:`canonical_json` of fields without a variant or a nested object, given in the order of their names; no variant is built."""
    if [*fields] != sorted(fields):
        raise ValueError("fields must stand in the order of their names")
    return F.to_json(F.struct(*(value.alias(name) for name, value in fields.items())), {"ignoreNullFields": "false"})


def json_string(c: Column) -> Column:
    """A JSON string literal, or ``null``; only texts with other than plain ASCII characters go through the JSON writer."""
    quoted = F.to_json(F.array(c))
    return (
        F.when(c.isNull(), F.lit("null"))
        .when(c.rlike(r'[^ !#-\[\]-~]'), F.substring(quoted, F.lit(2), F.length(quoted) - 2))
        .otherwise(F.concat(F.lit('"'), c, F.lit('"')))
    )


def without_nulls(*texts: Column) -> Column:
    """The texts, which all differ, that are not null. Unlike ``array_compact`` it stays in generated code, as do its arguments."""
    return F.array_except(F.array(*texts), F.array(F.lit(None).cast("string")))


def padded_keys(key: Column) -> tuple[Column, Column]:
    """Inner and outer 64-byte HMAC pads of a binary key."""
    block = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    hexed = F.rpad(F.hex(block), 128, "0")

    def masked(mask: int) -> Column:
        byte = F.expr("sequence(0, 63)")
        return F.unhex(
            F.array_join(
                F.transform(
                    byte,
                    lambda i: F.lpad(
                        F.hex(
                            F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10)
                            .cast("int")
                            .bitwiseXOR(F.lit(mask))
                        ),
                        2,
                        "0",
                    ),
                ),
                "",
            )
        )

    return masked(0x36), masked(0x5C)


def hmac_sha256(inner: Column, outer: Column, message: Column) -> Column:
    """HMAC-SHA256 in lower-case hex from the two padded keys."""
    first = F.unhex(F.sha2(F.concat(inner, message), 256))
    return F.sha2(F.concat(outer, first), 256)


def base64url(hexed: Column) -> Column:
    return F.translate(F.base64(F.unhex(hexed)), "+/", "-_")
