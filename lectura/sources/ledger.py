"""Rows written in numbered chunks that count one by one, with a stop between them and a way to go on.

All rows of a run are staged first, in one job, a folder for each chunk. A chunk counts once its line is in the ledger;
that is one small file, so a chunk is there whole or not at all. Lines are made between looks at the stop flag. A run
that was stopped, or whose driver died, goes on under its name: what is staged stays as it is, lines that are there
stay, and no chunk counts twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import create_once, lines

_LINE = "run string, chunk long, n long"


@dataclass(frozen=True)
class Progress:
    """What a run has done: chunks in all, chunks that count, and their rows."""

    chunks: int
    done: int
    rows: int


class Ledger:
    """A table in chunks below `path`, in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _staged(self, run: str) -> str:
        return f"{self.path}/staged/{run}"

    def _lines(self) -> list:
        return lines(self.spark, f"{self.path}/_ledger", _LINE)

    def write(self, rows: DataFrame, run: str, chunk: Column, stop: Callable[[], bool] = lambda: False, tell: Callable[[Progress], None] = lambda p: None) -> Progress:
        """Writes rows as chunks by the number in `chunk`, until `stop` says so between two of them.

        Called again with the same run it goes on; the rows are only looked at if they aren't staged yet.
        """
        sizes = {r["chunk"]: r["n"] for r in lines(self.spark, f"{self.path}/_staged/{run}", _LINE)}
        if not sizes:
            # a stage without its list is none: it is written over
            rows.withColumn("__chunk", chunk.cast("long")).write.mode("overwrite").partitionBy("__chunk").parquet(self._staged(run))
            counts = self.spark.read.parquet(self._staged(run)).groupBy("__chunk").count().collect() if self._any(run) else []  # a row for each chunk
            sizes = {r["__chunk"]: r["count"] for r in counts}
            create_once(self.spark, f"{self.path}/_staged/{run}/list.json", "\n".join(json.dumps({"run": run, "chunk": c, "n": n}) for c, n in sizes.items()))
        there = {r["chunk"]: r["n"] for r in self._lines() if r["run"] == run}
        for number in sorted(c for c in sizes if c not in there):
            if stop():
                break
            create_once(self.spark, f"{self.path}/_ledger/{run}-{number:012d}.json", json.dumps({"run": run, "chunk": number, "n": sizes[number]}))
            there[number] = sizes[number]
            tell(Progress(len(sizes), len(there), sum(there.values())))
        return Progress(len(sizes), len(there), sum(there.values()))

    def _any(self, run: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._staged(run))
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return any(f.isDirectory() for f in found)

    def read(self) -> DataFrame | None:
        """The rows of all chunks that count; None before the first one."""
        by_run: dict[str, list[int]] = {}
        for r in self._lines():
            by_run.setdefault(r["run"], []).append(r["chunk"])
        parts = None
        for run, chunks in by_run.items():
            part = self.spark.read.option("basePath", self._staged(run)).parquet(*(f"{self._staged(run)}/__chunk={c}" for c in chunks)).drop("__chunk")
            parts = part if parts is None else parts.unionByName(part)
        return parts
