"""Tables about a collection of texts that may leave a secure room.

    python -m jobs.text_release --documents FOLDER --labels LABELS --out FOLDER --checkpoint FOLDER [--config jobs/text_release.yaml]

A data centre lets counts and statistics out only if no small cell can be read or worked out.  New document files keep
coming; each text is read once: a file stream (availableNow, with a checkpoint) measures the documents of new files
only.  The release is then made anew from the measures, which are a few numbers a document.

Below the output folder, all written by Spark:

- measures/lang=LANG: one row a document of the stream, exactly once;
- internal/section=NAME and export/section=NAME: the tables in long form, without and with withholding.

Sections: sources (documents of each source in a language, small sources pooled), lengths (documents by words, with primary
and complementary suppression), ratings (labels likewise), numbers (statistics of words and characters).  A document that
comes again counts once, by its row with the fewest nulls, then the least numbers; documents without an id are left out and
counted in the log.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tessera.functions.exprs import MISSING
from tessera.operators import disclosure, panel, release

LOG = common.logger("text_release")
WORD = "[^\\x20\\x09-\\x0D]+"
MEASURES = "doc_id long, source string, words int, chars int, lang string"
STATISTICS = ("mean", "sd", "q05", "q25", "median", "q75", "q95")


@dataclass(frozen=True)
class Parameters:
    """least: documents that a cell needs to be told.  bands: least words of each band of lengths but the first."""

    least: int = 10
    bands: tuple[int, ...] = (1, 10, 100, 1000)


def measure(documents: DataFrame) -> DataFrame:
    """A row of a few numbers for each document."""
    text, level = F.col("text"), lambda c: F.coalesce(F.col(c), F.lit(MISSING)).alias(c)
    words = F.regexp_count(text, F.lit(WORD)).cast("int").alias("words")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), level("source"), words, F.length(text).alias("chars"), level("lang"))


def take_new(spark: SparkSession, documents: str, out: str, checkpoint: str) -> int:
    """Measures the documents of files that the checkpoint doesn't know, and says how many rows it read."""
    plain = documents.rstrip("/")
    schema = spark.read.parquet(plain).schema
    # as a pattern of one path the source may be a single file too
    source = spark.readStream.schema(schema).parquet(f"{plain[:-1]}[{plain[-1]}]")
    sink = measure(source).writeStream.format("parquet").partitionBy("lang").option("path", f"{out}/measures")
    query = sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def band(words: Column, bounds: tuple[int, ...]) -> Column:
    """The band of a number of words, named by its least; null is missing."""
    out = F.when(words.isNull(), F.lit(MISSING))
    for low in sorted(bounds, reverse=True):
        out = out.when(words >= low, F.lit(f"{low}+"))
    return out.otherwise(F.lit("0+"))


LONG = ("lang", "cell", "statistic", "value", "status")


def _tidy(df: DataFrame, section: str, cell: str, statistics: list[str], status: Column) -> DataFrame:
    """section and LONG: a row a statistic."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value")) for s in statistics)))
    rows = df.select("lang", F.col(cell).alias("cell"), status.alias("status"), each.alias("e")).select("lang", "cell", "status", "e.*")
    return rows.select(F.lit(section).alias("section"), *LONG)


def _counts(docs: DataFrame, section: str, cell: str, least: int, protected: bool) -> DataFrame:
    cells = docs.groupBy("lang", cell).agg(F.count("*").alias("documents"))
    if not protected:
        return _tidy(cells, section, cell, ["documents"], F.lit("internal"))
    return _tidy(disclosure.protect(cells, ["lang"], cell, "documents", least), section, cell, ["documents"], F.col("status"))


def tables(docs: DataFrame, labels: DataFrame, parameters: Parameters, protected: bool) -> DataFrame:
    """All sections of one release.  docs: one measured row a document; labels: doc_id, quality, toxic."""
    least, people = parameters.least, docs.withColumnRenamed("doc_id", "simple_id")
    if protected:
        pooled = disclosure.pool_small(people, ["lang"], "source", least).withColumnRenamed("people", "documents")
        told = F.when(F.col("documents").isNull(), "withheld").when(F.col("pooled"), "pooled").otherwise("reported")
        sources = _tidy(pooled, "sources", "source", ["documents"], told)
    else:
        sources = _counts(docs, "sources", "source", least, False)

    lengths = _counts(docs.withColumn("band", band(F.col("words"), parameters.bands)), "lengths", "band", least, protected)

    said = lambda c: F.concat(F.lit(f"{c} "), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)))
    one = panel.dedup(labels.filter("doc_id IS NOT NULL"), ["doc_id"], ["quality", "toxic"])
    rated = docs.join(one, "doc_id", "left").select("lang", F.concat_ws(", ", said("quality"), said("toxic")).alias("rating"))
    ratings = _counts(rated, "ratings", "rating", least, protected)

    each = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in ("words", "chars")))
    long = docs.select("lang", F.explode(each).alias("v")).select("lang", "v.*")
    stats = release.describe(long, ["lang", "variable"], [])
    few = F.col("n") < least
    if protected:
        stats = stats.select("lang", "variable", *(F.when(~few, F.col(s)).alias(s) for s in STATISTICS), F.when(few, "withheld").otherwise("reported").alias("told"))
    else:
        stats = stats.withColumn("told", F.lit("internal"))
    numbers = _tidy(stats, "numbers", "variable", list(STATISTICS), F.col("told"))
    return sources.unionByName(lengths).unionByName(ratings).unionByName(numbers)


def run(
    spark: SparkSession, documents: str, labels: str, out: str, checkpoint: str, parameters: Parameters = Parameters()
) -> dict[str, int]:
    """Measures what is new and writes the release of all; says what it read and wrote."""
    out = out.rstrip("/")
    read = take_new(spark, documents, out, checkpoint)
    LOG.info("measured %d new documents of %s", read, documents)
    measures = spark.read.schema(MEASURES).parquet(f"{out}/measures")
    docs = panel.dedup(measures.filter("doc_id IS NOT NULL"), ["doc_id"], ["words", "chars", "source", "lang"])
    rated, written = spark.read.parquet(labels).select("doc_id", "quality", "toxic"), {}
    for name, protected in (("internal", False), ("export", True)):
        made = tables(docs, rated, parameters, protected)
        # a few rows a language
        made.repartition(1).write.mode("overwrite").partitionBy("section").parquet(f"{out}/{name}")
        written[name] = spark.read.parquet(f"{out}/{name}").count()
    lost = measures.filter("doc_id IS NULL").count()
    LOG.info("wrote %d internal and %d released rows to %s; %d documents have no id", written["internal"], written["export"], out, lost)
    return {"read": read, "without_id": lost} | written


def command(arguments: list[str]) -> int:
    cli = argparse.ArgumentParser(prog="python -m jobs.text_release", description=__doc__.split("\n")[0])
    cli.add_argument("--documents", required=True, help="Parquet table of documents, to which files are added")
    cli.add_argument("--labels", required=True, help="Parquet table of labels")
    cli.add_argument("--out", required=True, help="folder of measures, internal and export")
    cli.add_argument("--checkpoint", required=True, help="folder of the stream's checkpoint")
    cli.add_argument("--config", help="YAML of parameters")
    a = cli.parse_args(arguments)
    common.start_logging()
    spark = SparkSession.builder.appName("text_release").getOrCreate()
    try:
        run(spark, a.documents, a.labels, a.out, a.checkpoint, common.parameters(spark, Parameters, a.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(command(sys.argv[1:]))
