"""Person-period tables from the driver's orders: one row per customer and order year, with derived codes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def person_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw person-years with repeated keys; ord is the physical order that settles ties."""
    return from_orders(table(spark, sf_dir, "orders"))


def from_orders(orders: DataFrame) -> DataFrame:
    """person_years() of any table of orders."""
    key, person = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        person.alias("simple_id"),
        F.year("o_orderdate").alias("ja"),
        key.alias("ord"),
        (1930 + person % 45).cast("int").alias("gbja"),
        (1 + person % 2).cast("int").alias("ge"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_totalprice")).alias("entgelt"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") * 0.4).alias("rtzb"),
        F.when((F.col("o_orderstatus") == "P") & (key % 3 == 0), F.when(key % 4 == 0, 20).when(key % 4 == 1, 30).otherwise(10)).alias("code"),
        F.when(person % 29 == 0, 2000).alias("death_year"),
        # a sixth of the customers is exposed from one of three years on
        ((person % 6 == 0) & (F.year("o_orderdate") >= 1998 + F.floor(person / 6) % 3)).cast("int").alias("exposed"),
    )
