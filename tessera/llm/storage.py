"""Where intermediate tables go, and other helpers that touch the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where it is unset, a local session (tests) gets one of
    its own; on a cluster that is an error, as no folder of one machine will do."""
    jsc = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and jsc.getCheckpointDir().isDefined():
        found = jsc.getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.  The table
    goes when the driver's file system closes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver's file system remove path when it closes, at the end of the application."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    fs.deleteOnExit(fs.makeQualified(at))


def merged(one: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """one joined with other by sorting and merging both.  Left to itself, Spark broadcasts what it takes for small by the bytes of
    files; these are compressed, and rows that explode adds don't count, so the driver could get a table of any size."""
    return one.join(other.hint("merge"), on, how)


def lookup(big: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "inner", most_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """big joined with small, which has one row a key of a few numbers.

    small is broadcast where it is measured to have at most most_rows rows.  Otherwise both are hashed on the key and a
    salt: a hot key's rows of big (salted by the hash of their columns `by`) spread over salts, and small has every row once
    a salt, and never broadcast.  The result is the same.
    """
    if small.limit(most_rows + 1).count() <= most_rows:
        return big.join(F.broadcast(small), on, how)
    salt = fresh(big, "_salt")
    spread = small.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return merged(big.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts))), spread, [*on, salt], how).drop(salt)


def by_hub(big: DataFrame, small: DataFrame, on: str, by: str, degree: str, most: int = 100_000, most_hubs: int = 200_000) -> DataFrame:
    """big joined with small, which has one row a key and says how many rows of big have it (degree, dropped).

    Keys with more than `most` rows (hubs) are spread over as many salts as they have portions of `most`, by the hash of `by`; all
    others are joined plainly.  Hubs are told to big by a broadcast of at most most_hubs rows, measured; only beyond does every
    key get salts (lookup).
    """
    small = materialize(small)
    hubs = small.filter(F.col(degree) > most).select(on, F.ceil(F.col(degree) / most).alias("_shares"))
    n = hubs.limit(most_hubs + 1).count()
    if not n:
        return merged(big, small.drop(degree), on)
    if n > most_hubs:
        return lookup(big, small.drop(degree), [on], [by])
    salt = F.pmod(F.xxhash64(by), F.coalesce("_shares", F.lit(1))).alias("_salt")
    spread = big.join(F.broadcast(hubs), on, "left").select(*big.columns, salt)
    shares = F.sequence(F.lit(0).cast("long"), F.ceil(F.greatest(F.col(degree), F.lit(1)) / most) - 1)
    return merged(spread, small.withColumn("_salt", F.explode(shares)).drop(degree), [on, "_salt"]).drop("_salt")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; sizes the number of groups, so that each stays small at any scale."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def groups_for(total_bytes: int, each: int, least: int = 8) -> int:
    return max(least, -(-total_bytes // each))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written with a number for each row, and that column's name: a verdict can go by row, whatever the ids are."""
    key = fresh(df, "_row")
    return materialize(df.withColumn(key, F.monotonically_increasing_id())), key


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
