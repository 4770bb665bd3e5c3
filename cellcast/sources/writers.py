"""Sinks: cells as JSON for export, versioned tables, composites by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def export(cells: DataFrame, history: DataFrame, digits: int = 4) -> DataFrame:
    """One row for each cell as JSON text, numbers rounded half to even, entries in their order.

    A metric without a value is written as its status, so numbers and sentinels share one key as in a cell file.
    """
    r = lambda c: scalars.half_even(F.col(c), digits)
    entry = F.struct(
        "seq", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), r("max_refl").alias("max_refl"), "num_gates",
        F.array(r("lat"), r("lon")).alias("centroid"), *[r(c).alias(c) for c in ("dx", "dy", "dt") if c in history.columns],
        *[c for c in ("metrics",) if c in history.columns],
    )
    by_seq = lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)  # noqa: E731 - a map of metrics has no order
    entries = history.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(entry), by_seq), lambda e: e.dropFields("seq")).alias("storm_history"))
    joined = cells.join(entries, "cell_id", "left")
    row = F.struct(F.col("cell_id").alias("id"), "num_gates", r("max_refl").alias("max_refl"), F.array(r("lat"), r("lon")).alias("centroid"), F.coalesce("storm_history", F.expr("array()").cast(entries.schema["storm_history"].dataType)).alias("storm_history"))
    return joined.select("cell_id", F.to_json(row).alias("json"))


def value_or_status(value: Column, status: Column) -> Column:
    """A number as text, or its status where there is none."""
    return F.coalesce(value.cast("string"), status)


def write_version(df: DataFrame, path: str, version: str) -> str:
    """Writes a table as a new version below `path`; readers of earlier versions aren't disturbed."""
    target = f"{path.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(target)
    return target


def write_composite(gates: DataFrame, path: str) -> None:
    """Composites by scan, so that a reader of one scan reads one folder."""
    gates.write.mode("overwrite").partitionBy("scan").parquet(path)
