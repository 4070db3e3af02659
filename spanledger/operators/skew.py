"""A lookup join for sides whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", salts: int = 1) -> DataFrame:
    """Equi join that reads each side once.

    Adaptive execution, which :func:`spanledger.configure` sets up, splits a
    partition of the left side that a hot key makes too large and reads the
    matching right rows for each part; no keys are counted beforehand.
    ``salts`` is for sessions without it: left rows get one of so many salts by
    a hash of all their columns, and each right row is repeated for all of them.
    """
    if salts <= 1:
        return left.join(right, on, how)
    # A hash of the row, not a random number: a re-run task salts the same way.
    spreading = [f.name for f in left.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*spreading), F.lit(salts)).cast("int"))
    repeated = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "__salt"], how).drop("__salt")
