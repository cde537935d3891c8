"""Writes that count what they write, in the same pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def unit_counts() -> list:
    """What is counted of units (unit_type, source), as assembly.unit_metrics() does for each document."""
    is_table, source = F.col("unit_type") == "table", F.coalesce(F.col("source"), F.lit(""))
    return [
        F.count(F.lit(1)).alias("total_units"), F.count_if(F.col("unit_type") == "paragraph").alias("text_units"), F.count_if(is_table).alias("table_units"),
        F.count_if(source.contains("ocr")).alias("ocr_units"), F.coalesce(F.bool_or(is_table), F.lit(False)).alias("has_tables"), F.coalesce(F.bool_or(source.startswith("ocr")), F.lit(False)).alias("has_images"),
    ]


def write_observed(units: DataFrame, path: str, partition_by: tuple[str, ...] = (), form: str = "parquet", counts: list | None = None) -> dict:
    """Write units and give the counts of the rows written. There is no second pass over them, and a task that is run again counts once."""
    seen = Observation()
    units.observe(seen, *(counts or unit_counts())).write.mode("append").partitionBy(*partition_by).format(form).save(path)
    return seen.get
