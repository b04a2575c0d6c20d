"""Queries on keys beyond those of the small tables, against their SQL."""

from compare import DATA, difference, oracle
from pyspark.sql import functions as F

from areasignal.plans import ORACLES, QUERIES


def shifted(spark, to, name, **columns):
    """A table with some of its columns changed, in a folder of its own."""
    spark.read.parquet(f"{DATA}/{name}.parquet").selectExpr("*").withColumns({c: F.expr(e) for c, e in columns.items()}).coalesce(1).write.parquet(f"{to}/{name}.dir")
    made = next((to / f"{name}.dir").glob("*.parquet"))
    made.rename(to / f"{name}.parquet")


def same(spark, to, query):
    con = oracle(DATA)
    for made in to.glob("*.parquet"):
        con.execute(f"CREATE OR REPLACE VIEW {made.stem} AS FROM '{made}'")
    return difference(QUERIES[query](spark, str(to)), con, ORACLES[query])


def test_keys_of_five_digits(spark, tmp_path):
    shifted(spark, tmp_path, "supplier", s_suppkey="s_suppkey * 9973")
    assert not same(spark, tmp_path, "keys_and_paths")
