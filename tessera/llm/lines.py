"""op8: line dedup by distinct-site spread, with DataFrame functions alone.

Each distinct line of a document counts for the document's site (source).  A first aggregation counts every line's documents
by its hash, and drops lines that are too rare or on one site only.  HyperLogLog sketches of sites merge by aggregation
for each line hash that is left, so a line that a third of all documents hold costs one sketch a task.  Lines whose
estimate is within a factor NEAR of the threshold get an exact distinct count; those above it are boilerplate, and
go from every document.

Tables of line hashes are looked up by storage.lookup: broadcast under a measured number of rows (MOST_HELD), else by a salted
hash join of hashes alone.  A document's text meets the hashes of its boilerplate lines in one join by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh, lookup, materialize

LEAST_SITES, LOG_SIZE, NEAR = 10, 10, 2.0
MOST_HELD = 200_000


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    """Distinct lines with a word, by document: h and h2 are two hashes of the line without blanks at its ends."""
    line = F.explode(F.array_distinct(F.split(F.col("text"), "\n")))
    out = docs.select(*more, line.alias("line")).withColumn("line", _bare("line")).filter("line != ''")
    return out.select(*more, _hash("line").alias("h"), _second("line").alias("h2"))


def _bare(c):
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\r\f\x0b"))


def _hash(c):
    return F.xxhash64(F.col(c) if isinstance(c, str) else c)


def _second(c):
    # the literal comes first: the other way round the first hash would be all that the second one sees of the line
    return F.xxhash64(F.lit(1), F.col(c) if isinstance(c, str) else c)


def boilerplate(docs: DataFrame, least_sites: int = LEAST_SITES, log_size: int = LOG_SIZE, near: float = NEAR, most_held: int = MOST_HELD) -> DataFrame:
    """h, h2, n_sites: hashes of the lines on at least least_sites distinct sites.  n_sites is exact near the
    threshold and an estimate beyond near * least_sites."""
    key, site = ["h", "h2"], ["source"]
    sited = _lines(docs.select(F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).filter("source is not null"), "source")
    counted = sited.groupBy(key).agg(F.count("*").alias("n"), F.min(_hash("source")).alias("lo"), F.max(_hash("source")).alias("hi"))
    # a line of fewer than least_sites occurrences can't be on so many sites
    enough = (F.col("n") >= least_sites) & ((F.col("lo") != F.col("hi")) | F.lit(least_sites < 2))
    frequent = materialize(counted.filter(enough).select(key))
    often = materialize(lookup(sited, frequent, key, site, "left_semi", most_held))
    estimated = materialize(often.groupBy(key).agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", log_size)).alias("n_sites")).filter(F.col("n_sites") * near >= least_sites))
    unsure = estimated.filter(F.col("n_sites") <= near * least_sites).select(key)
    exact = lookup(often, unsure, key, site, "left_semi", most_held).distinct().groupBy(key).agg(F.count("*").alias("n_sites"))
    sure = estimated.filter(F.col("n_sites") > near * least_sites)
    return sure.unionByName(exact.filter(F.col("n_sites") >= least_sites))


def _marked(docs: DataFrame, found: DataFrame, most_held: int) -> DataFrame:
    """Hashes of each document's boilerplate lines, by a key that stands for doc_id and text.  Documents that share a
    key by chance share the hashes, which are boilerplate in any document."""
    return lookup(_lines(docs, "key"), found, ["h", "h2"], ["key"], "left_semi", most_held).groupBy("key").agg(F.collect_set(F.struct("h", "h2")).alias("gone"))


def clean_lines(docs: DataFrame, least_sites: int = LEAST_SITES, most_held: int = MOST_HELD) -> DataFrame:
    """All rows and columns of docs, with text rid of boilerplate lines, and n_lines and n_removed added (a column of
    one of these names is replaced).

    A line is compared without blanks at its ends; lines without a word stay.  A null text stays null and has 0 lines (SQL
    that unnests lines has no row for it).  Rows with a null source are no site but are cleaned.  Repeated rows are
    cleaned alike.  No documents: no rows.  most_held bounds the rows of what is broadcast; it doesn't change the result.
    """
    found, text = materialize(boilerplate(docs, least_sites, most_held=most_held).select("h", "h2")), F.col("text").cast("string")
    key, gone_at, kept_at = (fresh(docs, c) for c in ("__key", "__gone", "__kept"))
    own = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text")))
    marked = materialize(_marked(own.select(F.col(key).alias("key"), text.alias("text")), found, most_held)).select(F.col("key").alias(key), F.col("gone").alias(gone_at))
    # texts are streamed past a hash table of the few marked documents, never sorted
    few = (marked.agg(F.sum(F.size(gone_at))).first()[0] or 0) <= most_held // 10
    joined = own.join(F.broadcast(marked) if few else marked.hint("shuffle_hash"), key, "left")
    is_gone = lambda x: F.array_contains(F.col(gone_at), F.struct(_hash(_bare(x)).alias("h"), _second(_bare(x)).alias("h2")))
    lines = F.split(text, "\n")
    kept = F.when(F.col(gone_at).isNull(), lines).otherwise(F.filter(lines, lambda x: (_bare(x) == "") | ~is_gone(x)))
    return _counted(joined.withColumn(kept_at, kept), kept_at).drop(key, gone_at, kept_at)


def _counted(docs: DataFrame, kept_at: str) -> DataFrame:
    lines = F.size(F.split(F.col("text").cast("string"), "\n"))
    return docs.withColumns({
        "text": F.array_join(kept_at, "\n"),
        "n_lines": F.coalesce(lines, F.lit(0)).cast("long"),
        "n_removed": F.coalesce(lines - F.size(kept_at), F.lit(0)).cast("long"),
    })
