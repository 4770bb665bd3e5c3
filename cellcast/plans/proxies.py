"""Deterministic views of the star-schema tables that stand for radar data, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# boxes and triangles around points of the grid, in index units, of every supplier
_SHAPES = """SELECT CAST(s_suppkey AS INT) AS ordinal, CASE WHEN s_suppkey % 35 = 0 THEN 0 ELSE s_suppkey + 1 END AS id, s_suppkey / 5 % 2 >= 1 AS triangle,
        s_suppkey * 37 % 200 - (2 + s_suppkey % 7) - 503e-3 AS i0, s_suppkey * 53 % 100 - (2 + s_suppkey % 4) - 503e-3 AS j0, 2 * (2 + s_suppkey % 7) + 13e-1 AS hi, 2 * (2 + s_suppkey % 4) + 117e-2 AS hj
        FROM {supplier}"""
VIEWS = {
    # a grid of 200 x 100 gates, values 0..94.5 dBZ, some missing
    "gates": """SELECT 's' AS scan, i, j, 25 + i * 1e-2 AS lat, 280 + j * 1e-2 AS lon, CASE WHEN k % 17 = 0 THEN NULL ELSE k * 15e-1 END AS value
        FROM (SELECT CAST(l_partkey % 200 AS INT) AS i, CAST(l_suppkey % 100 AS INT) AS j, min(l_orderkey * 64 + CAST(l_quantity AS BIGINT)) % 64 AS k FROM {lineitem} GROUP BY 1, 2) AS g""",
    # the same by height
    "sweeps": """SELECT 's' AS scan, CAST(l_partkey % 200 AS INT) AS i, CAST(l_suppkey % 100 AS INT) AS j, l_linenumber AS height, max(CAST(l_quantity AS DOUBLE)) AS value
        FROM {lineitem} GROUP BY 1, 2, 3, 4""",
    # four products on the grid
    "products": """SELECT concat('p', CAST(l_linenumber % 4 AS STRING)) AS product, 25 + l_partkey % 200 * 1e-2 AS lat, 280 + l_suppkey % 100 * 1e-2 AS lon, CAST(l_quantity AS DOUBLE) - 10 AS value FROM {lineitem}""",
    "shapes": _SHAPES,
    "cells": """SELECT concat('s', CAST(c_custkey % 10 AS STRING)) AS scan, c_custkey AS id, c_custkey % 97 + 1 AS num_gates, 40e0 + c_custkey % 25 AS max_refl,
        25 + c_custkey * 7919 % 1000 * 1e-3 AS lat, 280 + c_custkey * 6271 % 1000 * 1e-3 AS lon FROM {customer}""",
    "history": """SELECT user_id AS cell_id, event_id AS seq, ts, CAST(event_id % 2 AS DOUBLE) AS max_refl, event_id % 2 AS num_gates, 25 + event_id * 31 % 500 * 1e-3 AS lat, 280 + event_id * 17 % 500 * 1e-3 AS lon, value FROM {events}""",
    "files": """SELECT event_type AS product, concat('https://data/', event_type, '/', CAST(event_id AS STRING)) AS url, ts FROM {events}""",
}
TABLES = ("lineitem", "supplier", "customer", "events", "orders", "part", "pages", "nation")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **tables)


def sql(name: str) -> str:
    """The view for DuckDB, to stand in a FROM clause."""
    return f"({VIEWS[name].format(**{t: t for t in TABLES})})"


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes as polygons (ordinal, id, rings, props), longitudes -180..180 as they come from files."""
    s = view(spark, sf_dir, "shapes")
    point = lambda i, j: F.struct((280 + j * 1e-2 - 360).alias("lon"), (25 + i * 1e-2).alias("lat"))
    a, b, c, d = point(F.col("i0"), F.col("j0")), point(F.col("i0") + F.col("hi"), F.col("j0")), point(F.col("i0") + F.col("hi"), F.col("j0") + F.col("hj")), point(F.col("i0"), F.col("j0") + F.col("hj"))
    ring = F.when(F.col("triangle"), F.array(a, b, d)).otherwise(F.array(a, b, c, d))
    return s.select("ordinal", "id", F.array(ring).alias("rings"), F.create_map(F.lit("MESH"), F.col("id").cast("string")).alias("props"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
