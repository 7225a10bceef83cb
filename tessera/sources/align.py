"""Reading of shards whose schemas differ: the first file that has a column fixes its type, casts never fail."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns whose types are pinned whatever a shard says.
OVERRIDES = {"simple_id": T.LongType(), "ja": T.IntegerType(), "gbja": T.IntegerType(), "rtwf_jjjj": T.IntegerType(), "ge": T.IntegerType(), "divorcing": T.ByteType(), "entgelt": T.DoubleType(), "rtzb": T.DoubleType()}


def schema_union(spark: SparkSession, files: list[str]) -> dict[str, T.DataType]:
    found: dict[str, T.DataType] = {}
    for path in sorted(files):
        for field in spark.read.parquet(path).schema:
            found.setdefault(field.name, field.dataType)
    return found


def scan_aligned(spark: SparkSession, files: list[str], columns: list[str] | None = None) -> DataFrame:
    """All shards as one frame: typed nulls for absent columns, null where a value can't be cast, and the physical
    order as src_file and src_row.  Shards of equal schema are read together."""
    union = schema_union(spark, files) | {}
    wanted = columns or list(union)
    kinds = {c: OVERRIDES.get(c, union.get(c, T.StringType())) for c in wanted}
    by_schema: dict[str, list[str]] = {}
    for path in sorted(files):
        by_schema.setdefault(spark.read.parquet(path).schema.json(), []).append(path)
    out = None
    for group in by_schema.values():
        df = spark.read.parquet(*group)
        have = dict(df.dtypes)
        part = df.select(*(cast_softly(F.col(f"`{c}`"), have[c], kinds[c]).alias(c) if c in have else F.lit(None).cast(kinds[c]).alias(c) for c in wanted), F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.row_index").alias("src_row"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no shards")
    return out


def cast_softly(column, have: str, want: T.DataType):
    """try_cast; text to whole numbers goes by double, so that '20.0' is 20."""
    if have == "string" and isinstance(want, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return column.try_cast("double").try_cast(want)
    return column.try_cast(want)


def write_panel(df: DataFrame, path: str, partition: str | None = None, key: str = "simple_id") -> None:
    """One distributed zstd write; the output committer makes it atomic.  partition: a column with few values."""
    writer = (df.repartition(partition, key) if partition else df).write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


# Kinds of columns that a source may lack.
OPTIONAL_FLOATS = ("entgelt", "rtzb", "byvlgs", "bygmgs", "mcdams_succeed_1", "mcdams_succeed_2")
OPTIONAL_INTS = ("rtwf_jjjj", "ge", "divorcing", "is_first_marriage", "whot_bland", "whot_skt", "ttsc1_kldb1988", "mcdggr_succeed_1", "mcdggr_succeed_2")


# Fixed value: columns with this in their names are text, whatever a shard says.
TEXT_MARK = "iufzt"


def optional_nulls(df: DataFrame, wanted: list[str], dates: tuple[str, ...] = (), union: dict[str, T.DataType] | None = None) -> DataFrame:
    """df with typed nulls for wanted columns that it lacks: dates, listed numbers, marked texts, else the union's type, else text."""
    def kind(c: str):
        return T.DateType() if c in dates else T.DoubleType() if c in OPTIONAL_FLOATS else T.IntegerType() if c in OPTIONAL_INTS else T.StringType() if TEXT_MARK in c else (union or {}).get(c, T.StringType())

    return df.withColumns({c: F.lit(None).cast(kind(c)) for c in wanted if c not in df.columns})


def present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that df has, in the wanted order."""
    return df.select(*(c for c in dict.fromkeys(wanted) if c in df.columns))


def first_present(columns: list[str], candidates: list[str]) -> str | None:
    """The first of several spellings of a column that a source has."""
    return next((c for c in candidates if c in columns), None)


def row_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, n_rows of each file that has rows; no column is read."""
    return spark.read.parquet(*paths).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_rows"))
