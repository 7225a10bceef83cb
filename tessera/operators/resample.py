"""Bootstrap weights of clusters: a fixed number of draws with replacement, without numbering or gathering clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = 10_000


def _rng(*keys: int) -> np.random.Generator:
    return np.random.default_rng([k & 0xFFFFFFFF for k in keys])


def weights(clusters: DataFrame, key: str, replicates: range, seed: int = 11, strata: str | None = None, each: int = BUCKET) -> DataFrame:
    """key, weights: how often each cluster is drawn in each replicate of the range, where each replicate draws as many clusters as
    there are (of each stratum, if given), each with the same chance.

    Draws are dealt in two steps: a replicate's draws to buckets of clusters by hash, in proportion to the buckets' sizes,
    and a bucket's draws to its clusters.  Both are multinomial, so together they are; a task holds a bucket of about `each`
    clusters, or one replicate's numbers for all buckets.  Draws depend on (seed, replicate, bucket) and the clusters alone.
    clusters: one row a cluster.
    """
    spark, level = clusters.sparkSession, F.col(strata).cast("string") if strata else F.lit("")
    own = clusters.select(F.col(key).alias("cluster"), F.coalesce(level, F.lit("null")).alias("stratum"))
    n = own.count()
    buckets = max(1, n // each)
    own = own.withColumn("bucket", F.pmod(F.xxhash64("cluster"), F.lit(buckets)).cast("int"))
    # a row a bucket and stratum: a ten-thousandth of the clusters
    sizes = own.groupBy("stratum", "bucket").agg(F.count("*").alias("n")).orderBy("stratum", "bucket").toPandas()
    sizes["at"] = range(len(sizes))

    def deal(frames):
        for frame in frames:
            for r in frame["rep"]:
                rng = _rng(seed, int(r))
                for _, one in sizes.groupby("stratum", sort=True):
                    drawn = rng.multinomial(one["n"].sum(), one["n"] / one["n"].sum())
                    yield pd.DataFrame({"rep": r, "stratum": one["stratum"], "bucket": one["bucket"], "at": one["at"], "draws": drawn})

    reps = spark.range(replicates.start, replicates.stop, 1, max(1, len(replicates))).withColumnRenamed("id", "rep")
    dealt = reps.mapInPandas(deal, "rep long, stratum string, bucket int, at long, draws long")
    kind, name = clusters.schema[key].dataType.simpleString(), key

    def draw(_, members: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(members["cluster"].to_numpy())
        out = np.zeros((len(ids), len(replicates)), np.int32)
        for r, at, d in draws[["rep", "at", "draws"]].itertuples(index=False):
            out[:, r - replicates.start] = _rng(seed, r, at + 1).multinomial(d, np.full(len(ids), 1 / len(ids)))
        return pd.DataFrame({name: ids, "weights": list(out)})

    grouped = own.groupBy("stratum", "bucket").cogroup(dealt.groupBy("stratum", "bucket"))
    return grouped.applyInPandas(draw, f"{name} {kind}, weights array<int>")
