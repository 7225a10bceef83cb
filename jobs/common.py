"""What the jobs share: parameters from YAML, logging, and tables that may not be there yet."""

from __future__ import annotations

import logging
from dataclasses import fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def logger(job: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{job}")


def start_logging() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")


def parameters(spark: SparkSession, kind: type, path: str | None):
    """An instance of a dataclass from a YAML file, which Spark reads; no path: the defaults.  Unknown names are an error."""
    import yaml

    given = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {} if path else {}
    if unknown := set(given) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
