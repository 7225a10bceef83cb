"""Brings a person-year panel up to date with the years that a delivery adds.

    python -m jobs.panel_update --source ORDERS --out FOLDER [--config jobs/panel_update.yaml] [--through YEAR] [--redo-from YEAR]

A research data centre delivers administrative person-years; each delivery adds years to a growing table.  The job keeps a
high-water mark, the last year taken, reads only later years (the filter reaches the Parquet scan), settles
repeated person-years, and goes on with each person's history from a state of one row a person.

Below the output folder, all written by Spark:

- panel/ja=YEAR: the panel, replaced year by year (dynamic partition overwrite);
- state/RUN: what is known of each person after a run's last year;
- marks: one row a run, appended last: its number, last year, rows read and written, and which state goes with it.

A run that dies before its mark is written leaves the mark where it was: the next run takes the same years again and
replaces the same partitions.  A run without new years changes nothing.  Corrected years are taken again by --redo-from, from
the last state before that year; a year that a correction empties keeps its old rows.  One run at a time may write to a folder.
"""

from __future__ import annotations

import argparse
import sys
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tessera.operators import panel
from tessera.sources.bindings import from_orders

LOG = common.logger("panel_update")
MARK = "number int, run string, asof int, first_year int, rows_read long, rows_written long, state string"


PANEL = (
    "simple_id long, ord long, gbja int, ge int, entgelt double, rtzb double, code int, death_year int, exposed int, rehab int, "
    "msk int, cum_rehab long, cum_msk long, last_rehab int, exposed_since int, death_low int, death_high int, "
    "years_since_rehab int, death_conflict boolean, ja int"
)


@dataclass(frozen=True)
class Parameters:
    """codes: those of msk measures.  first_year: earlier years are never taken."""

    codes: tuple[int, ...] = (20,)
    first_year: int = 1900


def panel_of(spark: SparkSession, out: str) -> DataFrame:
    """The panel as it stands; without rows where nothing was ever taken."""
    found = common.read_if_there(spark, f"{out.rstrip('/')}/panel")
    return spark.createDataFrame([], PANEL) if found is None else spark.read.schema(PANEL).parquet(f"{out.rstrip('/')}/panel")


def marks(spark: SparkSession, out: str) -> list:
    """All marks, the current one first."""
    found = common.read_if_there(spark, f"{out}/marks")
    # one small row for each run there has been
    return found.orderBy(F.desc("number")).collect() if found is not None else []


def base_of(past: list, redo_from: int | None):
    """The mark to go on from: the current one, or the latest before redo_from whose years no later run took again."""
    retaken = None
    for m in past:
        if (retaken is None or m.asof < retaken) and (redo_from is None or m.asof < redo_from):
            return m
        retaken = m.first_year if retaken is None else min(retaken, m.first_year)
    return None


def new_rows(spark: SparkSession, source: str, after: int, through: int | None) -> DataFrame:
    """Raw person-years after a year.  The bounds are on the stored date, so whole row groups are left out."""
    orders = spark.read.parquet(source)
    day = lambda year: F.lit(f"{year:04d}-01-01").cast(orders.schema["o_orderdate"].dataType)
    rows = orders.filter(F.col("o_orderdate") >= day(after + 1))
    return from_orders(rows if through is None else rows.filter(F.col("o_orderdate") < day(through + 1)))


def run(
    spark: SparkSession, source: str, out: str, parameters: Parameters = Parameters(), through: int | None = None, redo_from: int | None = None
) -> dict[str, int | None]:
    """Takes the new years of `source` (a Parquet table of orders) into `out`; says what it read and wrote."""
    out = out.rstrip("/")
    past = marks(spark, out)
    # the next number is above all, also where a redo goes on from an earlier mark
    number = past[0].number + 1 if past else 1
    last = base_of(past, redo_from)
    after = last.asof if last else parameters.first_year - 1
    state = spark.read.parquet(last.state) if last else None
    LOG.info("mark %s, taking years after %s%s of %s", last.asof if last else None, after, f" through {through}" if through else "", source)

    raw = new_rows(spark, source, after, through)
    # of the new years alone: their number of rows, and which they are
    got = raw.agg(F.count(F.lit(1)).alias("rows"), F.min("ja").alias("first"), F.max("ja").alias("last")).first()
    if not got.rows:
        LOG.info("no new year")
        return {"read": 0, "written": 0, "mark": last.asof if last else None}
    rows = panel.flags(panel.dedup(raw, ["simple_id", "ja"], ["ord"]), list(parameters.codes))
    # files of even size a year, however large a year is
    writer = panel.onward(rows, state).hint("rebalance", "ja").write.mode("overwrite").option("compression", "zstd")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("ja").parquet(f"{out}/panel")
    done = panel_of(spark, out).filter(F.col("ja").between(got.first, got.last))
    written = done.count()

    name = uuid.uuid4().hex
    panel.carry(done, state).write.option("compression", "zstd").parquet(f"{out}/state/{name}")
    mark = (number, name, got.last, after + 1, got.rows, written, f"{out}/state/{name}")
    spark.createDataFrame([mark], MARK).coalesce(1).write.mode("append").parquet(f"{out}/marks")
    LOG.info("read %d rows, wrote %d rows of %d to %d to %s/panel", got.rows, written, got.first, got.last, out)
    return {"read": got.rows, "written": written, "mark": got.last}


def command(arguments: list[str]) -> int:
    cli = argparse.ArgumentParser(prog="python -m jobs.panel_update", description=__doc__.split("\n")[0])
    cli.add_argument("--source", required=True, help="Parquet table of orders")
    cli.add_argument("--out", required=True, help="folder of panel, state and marks")
    cli.add_argument("--config", help="YAML of parameters")
    cli.add_argument("--through", type=int, help="last year to take")
    cli.add_argument("--redo-from", type=int, help="take this year and later ones again")
    a = cli.parse_args(arguments)
    common.start_logging()
    spark = SparkSession.builder.appName("panel_update").getOrCreate()
    try:
        run(spark, a.source, a.out, common.parameters(spark, Parameters, a.config), a.through, a.redo_from)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(command(sys.argv[1:]))
