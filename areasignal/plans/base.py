"""What the catalogue's queries start from: areas, observations, phrases and predictions derived from the given tables.

Each frame is a list of expressions that Spark and the checking SQL share; only the operators on top differ.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from areasignal.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ADJECTIVE = "CASE WHEN l_partkey % 70 < 10 THEN 'old' WHEN l_partkey % 70 < 20 THEN 'worn' WHEN l_partkey % 70 < 30 THEN 'wide' WHEN l_partkey % 70 < 40 THEN 'narrow' WHEN l_partkey % 70 < 50 THEN 'clean' WHEN l_partkey % 70 < 60 THEN 'busy' ELSE 'quiet' END"
NOUN = "CASE l_partkey % 10 WHEN 0 THEN 'brick_house' WHEN 1 THEN 'road' WHEN 2 THEN 'pavement' WHEN 3 THEN 'hedges' WHEN 4 THEN 'street lamp' WHEN 5 THEN 'parked cars' WHEN 6 THEN 'debris' WHEN 7 THEN 'corner shop' WHEN 8 THEN 'open sky' ELSE 'bus shelter' END"
#: Name of a frame to its table, its columns and what rows it has.
FRAMES: dict[str, tuple[str, dict[str, str], str]] = {
    "units": ("supplier", {"unit_id": "s_suppkey", "group_id": "s_nationkey", "fold": "s_nationkey % 5", "x": "s_suppkey % 10", "y": "CAST((s_suppkey - s_suppkey % 10) / 10 AS BIGINT)", "balance": "s_acctbal"}, "TRUE"),
    "phrases": ("lineitem", {"unit_id": "l_suppkey", "modality": "CASE l_linenumber % 3 WHEN 0 THEN 'sat' WHEN 1 THEN 'ntl' ELSE 'sv' END", "pos": "l_orderkey * 10 + l_linenumber", "phrase": f"CASE WHEN l_partkey % 3 = 0 THEN upper({ADJECTIVE} || ' ' || {NOUN}) ELSE ' ' || {ADJECTIVE} || ' ' || {NOUN} END"}, "TRUE"),
    "poi": ("events", {"unit_id": "user_id", "kind": "CASE event_type WHEN 'click' THEN 'shop' WHEN 'view' THEN 'amenity' WHEN 'purchase' THEN 'office' WHEN 'signup' THEN 'tourism' ELSE event_type END"}, "TRUE"),
    "obs": ("lineitem", {"unit_id": "l_suppkey", "fold": "CAST(l_suppkey % 5 AS INT)", "target_income": "CAST(1 + l_partkey % 10 AS DOUBLE)", "pred_income": "CAST(1 + ((l_partkey % 10) * 5 + l_orderkey % 50) / 16.0 AS DOUBLE)", "target_health": "CAST(1 + l_quantity % 10 AS DOUBLE)", "pred_health": "CAST(1 + ((l_quantity % 10) * 3 + l_partkey % 40) / 8.0 AS DOUBLE)", "target_crime": "CAST(1 + l_orderkey % 10 AS DOUBLE)", "pred_crime": "CAST(1 + (l_suppkey % 10 + l_orderkey % 10) / 4.0 AS DOUBLE)"}, "TRUE"),
    "points": ("customer", {"point_id": "c_custkey", "x": "CAST((c_custkey * 37) % 1100 AS DOUBLE) / 100 - 0.5", "y": "CAST((c_custkey * 53) % 1100 AS DOUBLE) / 100 - 0.5", "nation": "c_nationkey", "balance": "c_acctbal"}, "TRUE"),
}
DOMAINS = ("income", "health", "crime")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    of, columns, where = FRAMES[name]
    return table(spark, sf_dir, of).where(where).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def ctes(*names: str) -> str:
    """The frames as the start of a WITH clause."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in FRAMES[n][1].items())} FROM {FRAMES[n][0]} WHERE {FRAMES[n][2]})" for n in names)


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and its SQL."""

    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add
