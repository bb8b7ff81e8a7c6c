"""Joins of large fact tables with lookups whose size is checked first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pressgauge.session import fresh_path
from pressgauge.settings import BROADCAST_ROWS, SALTS


@dataclass(frozen=True)
class Lookup:
    """A lookup table together with its counted number of rows."""

    frame: DataFrame
    rows: int


def measure(frame: DataFrame) -> Lookup:
    """Count a lookup that is cheap to read (a stored file)."""
    return Lookup(frame, frame.count())


def stage_lookup(frame: DataFrame, name: str) -> Lookup:
    """Compute a derived lookup once, store it and count it in the same pass."""
    path = fresh_path(frame.sparkSession, name)
    seen = Observation(name)
    frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return Lookup(frame.sparkSession.read.schema(frame.schema).parquet(path), seen.get["rows"])


def lookup_join(
    facts: DataFrame,
    lookup: Lookup | DataFrame,
    on: list[str],
    how: str = "inner",
    spread_by: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``facts`` to a lookup on equal column names.

    A lookup of at most ``broadcast_rows`` rows is broadcast, so the facts do
    not move. A larger one is joined by sort-merge, with every key split over
    ``salts`` tasks: a source holding a third of all articles then loads no
    single task. ``spread_by`` names the fact column that decides the split;
    the split depends on content only, so a retried task repeats it. Copies
    of one record share a split, and adaptive skew-join handling divides them.
    """
    sized = lookup if isinstance(lookup, Lookup) else measure(lookup)
    if sized.rows <= broadcast_rows:
        return facts.join(F.broadcast(sized.frame), on, how)
    spread = F.col(spread_by) if spread_by else F.struct(*[F.col(c) for c in facts.columns])
    salted_facts = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    salted_lookup = sized.frame.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_facts.join(salted_lookup.hint("merge"), [*on, "_salt"], how).drop("_salt")
