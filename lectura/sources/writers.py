"""Writers: exports, dictionaries, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.merge import json_list

MEMORY_COLUMNS = ("kind", "term", "definition", "word_type", "collocations", "context_sentence", "article_id", "status", "created_at")


def guarded(value: Column) -> Column:
    """A leading quote before what a spreadsheet would run as a formula."""
    return F.when(value.rlike("^[=+@-]"), F.concat(F.lit("'"), value)).otherwise(value)


def memory_rows(memory: DataFrame) -> DataFrame:
    """The export's rows as strings."""
    flat = memory.withColumns({"collocations": F.array_join(json_list(F.col("collocations_json")), "; "), "created_at": F.col("created_at").cast("string")})
    return flat.select(*(guarded(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in MEMORY_COLUMNS))


def write_memory_csv(memory: DataFrame, path: str) -> None:
    """CSV part files with a header, quotes doubled; spreadsheets get a byte-order mark from the header's first name."""
    rows = memory_rows(memory)
    rows.withColumnRenamed("kind", "﻿kind").write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_dictionary(entries: DataFrame, path: str) -> None:
    """JSON lines sorted by word over all part files."""
    entries.orderBy("word").write.mode("overwrite").json(path)


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A Parquet copy; a failed write leaves no rows, as the commit is one step."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def newest(snapshots: DataFrame, keep: int = 2) -> DataFrame:
    """Of snapshots (path, at) those to keep."""
    return snapshots.orderBy(F.desc("at"), F.desc("path")).limit(keep)
