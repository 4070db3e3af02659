"""Nested OTLP values and very long whole numbers of JSON records, in Arrow batches."""

from __future__ import annotations

import base64
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanledger.functions import rules

#: Records that Python has to look at: containers among typed values, or numbers beyond a BIGINT.
_NEEDS = r"(?:array|kvlist)_?[vV]alue|kvListValue|[0-9]{19}"
#: What an ill-typed nested value becomes, for the attribute check to find.
_ILL_TYPED = {"boolValue": "nested value is ill-typed"}
_IDS = frozenset((*rules.TRACE_ID_KEYS, *rules.SPAN_ID_KEYS, *rules.PARENT_ID_KEYS))


class _Repeated(ValueError):
    pass


def _unique(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise _Repeated
    return out


def _named(value: dict, names: tuple[str, ...]):
    return next((value[n] for n in names if value.get(n) is not None), None)


def _plain(value):
    """A typed value of any depth as a plain one; ValueError if a part is ill-typed."""
    # Depth first without recursion: (value, container that takes it, place in it).
    out: list = [None]
    todo = [(value, out, 0)]
    while todo:
        value, into, at = todo.pop()
        into[at] = value
        if not isinstance(value, dict):
            continue
        boolean, integer = _named(value, rules.ANY_BOOLEAN), _named(value, rules.ANY_INTEGER)
        double, binary = _named(value, rules.ANY_DOUBLE), _named(value, rules.ANY_BINARY)
        text, items, pairs = _named(value, rules.ANY_TEXT), _named(value, rules.ANY_ARRAY), _named(value, rules.ANY_PAIRS)
        if text is not None:
            into[at] = text
        elif boolean is not None:
            if not isinstance(boolean, bool):
                raise ValueError("boolean")
            into[at] = boolean
        elif integer is not None:
            number = int(str(integer))
            if isinstance(integer, bool) or not -(1 << 63) <= number < 1 << 63:
                raise ValueError("integer")
            into[at] = number
        elif double is not None:
            number = float(double)
            if isinstance(double, bool) or not math.isfinite(number):
                raise ValueError("double")
            into[at] = number
        elif binary is not None:
            into[at] = base64.b64decode(binary, validate=True).decode(errors="replace")
        elif items is not None or pairs is not None:
            container = items if items is not None else pairs
            if not isinstance(container, dict) or not isinstance(container.get("values", []), list):
                raise ValueError("container")
            values = container.get("values", [])
            if items is not None:
                into[at] = new = [None] * len(values)
                todo += [(v, new, i) for i, v in enumerate(values)]
            else:
                into[at] = new = {}
                for entry in values:
                    if not isinstance(entry, dict) or not isinstance(entry.get("key"), str) or not entry["key"]:
                        raise ValueError("key")
                    todo.append((entry.get("value"), new, entry["key"]))
                    new[entry["key"]] = None
    return out[0]


def _rewritten(document):
    """Containers anywhere in a document to plain values, long ids to hexadecimal text."""
    todo = [document]
    while todo:
        parent = todo.pop()
        for at, child in list(parent.items()) if isinstance(parent, dict) else list(enumerate(parent)):
            if isinstance(child, dict) and (_named(child, rules.ANY_ARRAY) is not None or _named(child, rules.ANY_PAIRS) is not None):
                try:
                    parent[at] = _plain(child)
                except (ValueError, TypeError):
                    parent[at] = dict(_ILL_TYPED)
            elif isinstance(child, dict | list):
                todo.append(child)
            elif isinstance(child, int) and not isinstance(child, bool) and at in _IDS and abs(child) >= 1 << 63:
                parent[at] = format(child, "x")
    return document


def _rewrite(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        document = json.loads(text, object_pairs_hook=_unique)
        return json.dumps(_rewritten(document), ensure_ascii=False) if isinstance(document, dict | list) else text
    except (ValueError, RecursionError):
        # Not JSON, or a repeated key: the reader reports the record.
        return text


@F.pandas_udf(T.StringType())
def _rewrite_batch(texts: pd.Series) -> pd.Series:
    return texts.map(_rewrite, na_action="ignore")


def parse_record(text: Column) -> Column:
    """A record's text as VARIANT; null if it is not JSON or repeats a key.

    Arrays and key/value lists among OTLP values are decoded to any depth and
    checked on the way. Only records that hold some, or a number too long for a
    BIGINT, are sent to Python, in Arrow batches.
    """
    needed = text.rlike(_NEEDS)
    return F.try_parse_json(F.coalesce(_rewrite_batch(F.when(needed, text)), text))
