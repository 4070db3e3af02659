"""Rows of one row group are dealt to many tasks."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from spanledger.plans import registry


def test_records_of_one_row_group_are_dealt_evenly(spark, tmp_path):
    columns = {"event_id": list(range(4000)), "props": ["{}"] * 4000}
    pq.write_table(pa.table(columns), tmp_path / "events.parquet")
    counts = registry.table(spark, str(tmp_path), "events").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in counts) == 4000
    assert len(counts) >= 16 and max(r["count"] for r in counts) <= 500
