"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast side may hold at most this much; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20

_SETTINGS = {
    # Timestamps without a zone mean UTC.
    "spark.sql.session.timeZone": "UTC",
    # Later attribute layers win over earlier ones.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # tokens x rate must keep all 18 decimals before the half-up rounding.
    "spark.sql.decimalOperations.allowPrecisionLoss": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key is split even where that costs a later shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    # Python workers hold whole texts; small batches bound what they hold at once.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

#: Shuffled bytes that adaptive execution gives a task at most, and partitions of a shuffle before it joins small ones.
#: Rows of keys pack into a few bytes each, and a task holds them unpacked, in sorts and hash tables.
TASK_BYTES, LEAST_PARTITIONS = 8 << 20, 200
_ADVISORY, _INITIAL = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def configure(spark: SparkSession) -> SparkSession:
    """Set the session options the operators rely on and return the session.

    The memory of a task is bounded for all of them here: a larger input makes
    more tasks of a shuffle, not larger ones. Smaller bounds of the session hold.
    """
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if _bytes(spark.conf.get(_ADVISORY)) > TASK_BYTES:
        spark.conf.set(_ADVISORY, f"{TASK_BYTES}b")
    if spark.conf.get(_INITIAL, None) is None:
        spark.conf.set(_INITIAL, str(max(LEAST_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return spark


#: Folders of local sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; in local runs without one, a temporary folder of the application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    name = spark.sparkContext.applicationId
    if name not in _LOCAL:
        _LOCAL[name] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[name]


#: Codec for tables of digests: hexadecimal text is halved by entropy coding and not at all by the default.
HASHES = "zstd"


def materialize(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Used between the rounds of an iterative operator: the written table
    survives the loss of an executor and keeps the plan of round n small.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether ``df`` has at most ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes as JSON text.

    The measurement stops one row beyond the limit.
    """
    width = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    row = df.limit(BROADCAST_ROWS + 1).select(width.alias("width")).agg(F.count("*").alias("n"), F.sum("width").alias("bytes")).first()
    return row["n"] <= BROADCAST_ROWS and (row["bytes"] or 0) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast only for a side measured as small; larger ones shuffle."""
    return F.broadcast(df) if fits_broadcast(df) else df


def hold(df: DataFrame) -> DataFrame:
    """Keep later filters above the columns of ``df``.

    A filter on a derived column is otherwise pushed into the scan with the
    whole derivation copied into it, and everything is computed twice. Filters
    on the output of a generator stay where they are.
    """
    held = df.select(F.explode(F.array(F.struct(*df.columns))).alias("held"))
    return held.select(*(F.col(f"held.{name}").alias(name) for name in df.columns))


def spread(df: DataFrame, each: int = 1) -> DataFrame:
    """Give a scan at least one partition per core.

    A single small file is one partition however many cores there are. Large
    inputs already have more partitions than cores and pass unchanged, without
    a shuffle.

    With ``each`` above 1, every partition of a scan of few files is dealt to so
    many. This is for rows that cost much more than their bytes: a row group
    goes whole to one task, and its rows would all be worked on there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if each > 1 and len(df.inputFiles()) < each * cores:
        return df.repartition(max(cores, each * df.rdd.getNumPartitions()))
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
