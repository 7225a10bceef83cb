"""Runs on disk: stages kept as tables with a manifest, rebuilt from the first tier that a change touches."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.config import CohortConfig, rebuild_from


class Run:
    """The stages of one configuration below output_dir/sample_tag, in any store that Spark's file systems reach.

    A manifest holds the parameters, the stamps of the inputs (path: length and time of change) and the finished
    stages.  A new Run with other parameters or inputs drops the stages from the first tier touched (0 panel, 1 risk sets,
    2 matching, 3 the rest); stages of earlier tiers are read again.  protect_matching refuses to drop tiers up to 2.
    """

    def __init__(self, spark: SparkSession, config: CohortConfig, inputs: list[str], protect_matching: bool = False):
        if not config.output_dir:
            raise ValueError("output_dir isn't set")
        self.spark, self.config, self.inputs = spark, config, inputs
        self.root = f"{config.output_dir.rstrip('/')}/{config.sample_tag}"
        self._refuse_overlap()
        self.stamps, kept = self.stamp(), self._read()
        now = json.loads(json.dumps(config.as_dict()))
        self.stages: dict[str, int] = {}
        if kept:
            tier = rebuild_from(kept["config"], now, protect_matching)
            if kept["inputs"] != self.stamps:
                if protect_matching:
                    raise ValueError("would rebuild matching: the inputs changed")
                tier = 0
            self.stages = {k: t for k, t in kept["stages"].items() if tier is None or t < tier}
        # the manifest goes first: a run that stops here leaves no stage that it lists but that is gone
        self._write(now)
        for name in set(kept["stages"] if kept else ()) - set(self.stages):
            self._fs(self._at(name)).delete(self._path(self._at(name)), True)

    def stage(self, name: str, tier: int, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
        """The table of a finished stage, or build()'s result written as one."""
        if name not in self.stages:
            build().write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(self._at(name))
            self.stages[name] = tier
            self._write(json.loads(json.dumps(self.config.as_dict())))
        return self.spark.read.parquet(self._at(name))

    def stamp(self) -> dict[str, list[int]]:
        out = {}
        for pattern in self.inputs:
            found = self._fs(pattern).globStatus(self._path(pattern)) or []
            for status in found:
                files = self._fs(pattern).listStatus(status.getPath()) if status.isDirectory() else [status]
                out |= {f.getPath().toString(): [f.getLen(), f.getModificationTime()] for f in files}
        return dict(sorted(out.items()))

    def check_inputs(self) -> None:
        """Raises RuntimeError where an input changed since the run began."""
        if self.stamp() != self.stamps:
            raise RuntimeError("inputs changed during the run")

    def clear(self) -> None:
        """Deletes all of the run's files."""
        self._fs(self.root).delete(self._path(self.root), True)
        self.stages = {}

    def _refuse_overlap(self) -> None:
        root = self._fs(self.root).makeQualified(self._path(self.root)).toString() + "/"
        for pattern in self.inputs:
            one = self._fs(pattern).makeQualified(self._path(pattern)).toString() + "/"
            if one.startswith(root) or root.startswith(one):
                raise ValueError(f"the run's folder and the input overlap: {pattern}")

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self) -> dict | None:
        at = self._at("manifest.json")
        return json.loads(self.spark.read.text(at, wholetext=True).first()[0]) if self._fs(at).exists(self._path(at)) else None

    def _write(self, config: dict) -> None:
        at, fs = self._at("manifest.json"), self._fs(self.root)
        out = fs.create(self._path(f"{at}.new"), True)
        out.write(bytearray(json.dumps({"config": config, "inputs": self.stamps, "stages": self.stages}, sort_keys=True).encode()))
        out.close()
        fs.delete(self._path(at), False)
        fs.rename(self._path(f"{at}.new"), self._path(at))
