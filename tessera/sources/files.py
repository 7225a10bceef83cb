"""Small tables as text: CSV, checkpoints of replicates, labels and inventories of sources."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """df as CSV with a header; one_file for tables of a few rows."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV with a header under a given schema; a row that doesn't fit it is an error, an empty field a null."""
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


def append_rows(frames: list[DataFrame], path: str) -> None:
    """All frames as one CSV in one write: rows that come in turn are gathered as plans, not appended to a file."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    write_csv(out, path)


class Checkpoint:
    """Rows of finished replicates, by a fingerprint of what made them.

    A replicate is a Parquet folder below path/fingerprint, so that a run that stopped goes on with those that are left; other
    parameters have another folder.
    """

    def __init__(self, spark: SparkSession, path: str, fingerprint: str):
        self.spark, self.at = spark, f"{path.rstrip('/')}/{fingerprint}"

    def done(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        finished = lambda p: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at) if f.getPath().getName().startswith("replicate=") and finished(f.getPath()))

    def add(self, replicate: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.at}/replicate={replicate}")

    def one(self, replicate: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/replicate={replicate}")

    def rows(self) -> DataFrame | None:
        done = self.done()
        return self.spark.read.option("basePath", self.at).parquet(*(f"{self.at}/replicate={r}" for r in done)) if done else None

    def require(self, replicates: int, least: int = 20) -> None:
        """Raises where fewer than half of the replicates (and fewer than `least`) are there."""
        if len(self.done()) < max(least, replicates // 2):
            raise RuntimeError(f"{len(self.done())} of {replicates} replicates succeeded")


def fingerprint(parts: dict) -> str:
    """A digest of parameters and stamps; the order of keys doesn't matter."""
    import hashlib

    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def stata_labels(path: str) -> dict[str, str]:
    """Variable labels of a Stata file; its rows aren't read."""
    from pandas.io.stata import StataReader

    with StataReader(path) as reader:
        return dict(reader.variable_labels())


def matching(df: DataFrame, pattern: str, labels: dict[str, str] | None = None) -> list[str]:
    """The columns whose name or label matches a pattern."""
    return [c for c in df.columns if re.search(pattern, c) or re.search(pattern, (labels or {}).get(c) or "")]


def inventory(spark: SparkSession, tables: dict[str, DataFrame], pattern: str, labels: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """source, column, label of the columns whose name or label matches a pattern, by schemas alone."""
    labels = labels or {}
    found = [(s, c, labels.get(s, {}).get(c)) for s, df in tables.items() for c in matching(df, pattern, labels.get(s))]
    return spark.createDataFrame(found, "source string, column string, label string")


def read_optional(spark: SparkSession, path: str | None, keys: list[str], whole: list[str] = (), domains: dict[str, list] | None = None) -> DataFrame | None:
    """A Parquet table given by the user, checked: keys are there, unique and not null, some columns hold whole numbers,
    others only listed values.  No path: None."""
    if path is None:
        return None
    df = spark.read.parquet(path)
    if absent := [c for c in (*keys, *whole, *(domains or {})) if c not in df.columns]:
        raise ValueError(f"columns are absent: {', '.join(absent)}")
    rules = {f"null {c}": F.col(c).isNull() for c in keys} | {f"fraction in {c}": F.col(c) != F.floor(c) for c in whole} | {f"unknown {c}": F.col(c).isNotNull() & ~F.col(c).isin(v) for c, v in (domains or {}).items()}
    if rules:
        bad = df.agg(*(F.count_if(r).alias(n) for n, r in rules.items())).first().asDict()
        if wrong := [n for n, v in bad.items() if v]:
            raise ValueError(f"rows with {', '.join(wrong)}")
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError("keys are repeated")
    return df
