"""Registry of named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanledger.session import configure, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
#: Tables whose rows are worth an even spread over the cores.
_LARGE = {"orders", "lineitem", "events", "documents", "pages", "conversations"}

#: Tables whose rows become JSON records, which take far longer to parse than to read.
_RECORDS = {"events": 16}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows, _RECORDS.get(name, 1)) if name in _LARGE else rows


def view(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Run SQL over the given tables, which are passed in as DataFrames."""
    used = {name: table(spark, folder, name) for name in TABLES if f"{{{name}}}" in sql}
    return spark.sql(sql, **used)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def configured(spark: SparkSession, folder: str) -> DataFrame:
            return run(configure(spark), folder)

        QUERIES[name] = configured
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def plain(sql: str) -> str:
    """View SQL with the table placeholders replaced by table names."""
    for name in TABLES:
        sql = sql.replace(f"{{{name}}}", name)
    return sql
