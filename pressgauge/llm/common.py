"""What the text operators share: the registry, staging and the definition of a word."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register ``run(spark, sf_dir) -> DataFrame`` and its SQL for DuckDB."""

    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write ``df`` once, zstd compressed, to the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


IDS = 16_777_213  # cells of the filter on ids, a prime


def id_bits(rows: DataFrame) -> bytes:
    """A filter of ``IDS`` cells on ``doc_id``, of this size whatever the number of rows."""
    cells = rows.filter("doc_id is not null").groupBy(F.expr(f"pmod(doc_id, {IDS}) div 32").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(doc_id, {IDS}) % 32 as int))")).alias("b")
    )
    got = cells.toArrow()
    out = np.zeros(IDS // 32 + 1, np.uint32)
    out[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.uint32)
    return out.tobytes()


def maybe_in(ids: pa.Array, bits: bytes) -> np.ndarray:
    """Whether the filter may hold each id; a null id always passes."""
    cell = np.mod(ids.fill_null(0).to_numpy(zero_copy_only=False), IDS)
    may = ((np.frombuffer(bits, np.uint8)[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(bool)
    return may | ids.is_null().to_numpy(zero_copy_only=False)
