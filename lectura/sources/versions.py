"""Tables that several writers change at once: changes are appended by key and merged when read.

A version is one small file in the table's log, made only if no other writer has made it. It names a folder of changed
rows, or of the whole table. A writer works on the version that it read; if another one has committed meanwhile, it
does its work again on what is there now, so no change is lost. Readers see either all of a version or nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Changes after which the table is written whole again; tries of a writer that others overtake.
COMPACT, TRIES = 16, 12


class Overtaken(RuntimeError):
    """Another writer has committed since this one read."""


def create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Makes a small file that didn't exist, at once and whole; false if it did."""
    made, parsed = f"{path}.{uuid.uuid4().hex}", urlparse(path)
    if parsed.scheme in ("", "file"):
        os.makedirs(os.path.dirname(parsed.path), exist_ok=True)
        own = parsed.path + made[len(path) :]
        with open(own, "x", encoding="utf-8") as file:
            file.write(content)
        try:
            os.link(own, parsed.path)
        except FileExistsError:
            return False
        finally:
            os.remove(own)
        return True
    jvm = spark._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in (made, path)]
    files = paths[0].getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(paths[1].getParent())
    out = files.create(paths[0], False)
    out.write(bytearray(content.encode()))
    out.close()
    if files.exists(paths[1]) or not files.rename(*paths):  # a rename onto a file that exists fails
        files.delete(paths[0], False)
        return False
    return True


def lines(spark: SparkSession, folder: str, schema: str) -> list:
    """The rows of all small JSON files in a folder; none if there is no such folder."""
    try:
        return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(folder).collect()  # a row for each commit that isn't compacted
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return []


class Versions:
    """One table below `path`, in a folder that all writers share; rows have one `key` each, which isn't null."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str]):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.fields = spark.createDataFrame([], schema).schema.fields

    # --- reading ----------------------------------------------------------------------------------------------------

    def _entries(self, version: int | None = None) -> list:
        """The newest whole copy and the changes behind it, oldest first."""
        rows = sorted((r for r in lines(self.spark, f"{self.path}/_log", "version long, kind string, folder string") if version is None or r["version"] <= version), key=lambda r: r["version"])
        whole = max((i for i, r in enumerate(rows) if r["kind"] == "whole"), default=0)
        return rows[whole:]

    def version(self) -> int:
        return max((r["version"] for r in self._entries()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the newest one."""
        return self._merged(self._entries(version))

    def _merged(self, entries: list) -> DataFrame:
        names = [f.name for f in self.fields]
        base = self.spark.createDataFrame([], self.schema)
        if entries and entries[0]["kind"] == "whole":
            base, entries = self.spark.read.schema(self.schema).parquet(entries[0]["folder"]), entries[1:]
        if not entries:
            return base
        changed = reduce(DataFrame.unionByName, (self.spark.read.schema(f"{self.schema}, __gone boolean").parquet(e["folder"]).withColumn("__version", F.lit(e["version"])) for e in entries))
        newest = changed.groupBy(*self.key).agg(F.max_by(F.struct(*names, "__gone"), "__version").alias("__row"))
        kept = base.join(newest.select(*self.key), self.key, "left_anti").select(*names)
        return kept.unionByName(newest.filter(~F.col("__row.__gone")).select(*(F.col(f"__row.`{n}`").alias(n) for n in names)))

    # --- writing ----------------------------------------------------------------------------------------------------

    def _typed(self, rows: DataFrame) -> list[Column]:
        return [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.fields]

    def _commit(self, version: int, kind: str, rows: DataFrame) -> bool:
        folder = f"{self.path}/{kind}/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return create_once(self.spark, f"{self.path}/_log/{version:012d}.json", json.dumps({"version": version, "kind": kind, "folder": folder}))

    def replace(self, rows: DataFrame, read_at: int | None = None) -> int:
        """The whole table anew; with `read_at`, only if nobody has committed since that version."""
        at = self.version()
        if read_at is not None and at != read_at:
            raise Overtaken(self.path)
        if not self._commit(at + 1, "whole", rows.select(*self._typed(rows))):
            raise Overtaken(self.path)
        return at + 1

    def update(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """Appends the rows that `change` makes of the table: new or changed ones, and those marked by a column __gone.

        `change` is called again for the newest version if another writer was faster. Of rows with one key one is taken.
        """
        for _ in range(TRIES):
            entries = self._entries()
            at = max((e["version"] for e in entries), default=0)
            rows = change(self._merged(entries))
            gone = F.coalesce(F.col("__gone"), F.lit(False)) if "__gone" in rows.columns else F.lit(False)
            if self._commit(at + 1, "change", rows.dropDuplicates(self.key).select(*self._typed(rows), gone.alias("__gone"))):
                if len(entries) >= COMPACT:
                    self.compact()
                return at + 1
        raise Overtaken(self.path)

    def compact(self) -> bool:
        """Writes the table whole; false if another writer came in between, who may do it."""
        at = self.version()
        return self._commit(at + 1, "whole", self.read(at))
