"""Scan of raw article records: tab-separated text, plain, gz or zip."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Number of fields of a raw record and the positions we keep.
RAW_FIELDS = 27
KEPT_FIELDS = {
    "GKGRECORDID": 0,
    "DATE": 1,
    "SourceCollectionIdentifier": 2,
    "SourceCommonName": 3,
    "DocumentIdentifier": 4,
    "EnhancedThemes": 8,
    "EnhancedLocations": 10,
    "Persons": 11,
    "Organizations": 13,
    "Tone_Raw": 15,
    "TranslationInfo": 25,
}
LINES_PER_BATCH = 20_000


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, value) of plain or gz text; ``line_no`` keeps file order.

    A file may be split over tasks, so the order is the start of the split
    followed by the row number inside it.
    """
    return spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("line_no"),
        "value",
    )


def zip_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same for zip archives, which Spark does not read itself.

    Archives are distributed over the tasks; each is streamed line by line in
    batches, never unpacked as a whole.
    """
    return unpacked(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path))


def unpacked(archives: DataFrame) -> DataFrame:
    """Lines of archives given as ``path`` and ``content``, batch or streaming."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(archive.namelist()[0]) as member:
                    lines = io.TextIOWrapper(member, encoding="utf-8", errors="replace", newline="\n")
                    start, chunk = 0, []
                    for line in lines:
                        chunk.append(line.rstrip("\r\n"))
                        if len(chunk) == LINES_PER_BATCH:
                            yield _frame(name, start, chunk)
                            start, chunk = start + len(chunk), []
                    if chunk:
                        yield _frame(name, start, chunk)

    flat = archives.select("path", "content").mapInPandas(unpack, "file string, row long, value string")
    return flat.select(
        "file", F.struct(F.lit(0).cast("long").alias("block"), F.col("row")).alias("line_no"), "value"
    )


def _frame(name: str, start: int, lines: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"file": name, "row": range(start, start + len(lines)), "value": lines})


def raw_records(lines: DataFrame) -> DataFrame:
    """The kept fields as text; lines with another number of fields are dropped.

    Works on batch and streaming lines alike.
    """
    fields = F.split("value", "\t", -1)
    extra = [c for c in ("file", "line_no") if c in lines.columns]
    return (
        lines.withColumn("_f", fields)
        .filter(F.size("_f") == RAW_FIELDS)
        .select(*extra, *[F.col("_f")[i].alias(n) for n, i in KEPT_FIELDS.items()])
    )
