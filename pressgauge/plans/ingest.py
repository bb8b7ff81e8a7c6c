"""Entry point from raw files to the stored article table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.operators import ingest
from pressgauge.operators.lookups import stage_lookup
from pressgauge.sinks.tables import stored, write_articles
from pressgauge.sources import raw


def ledger_of(articles_path: str) -> str:
    """Path of the table (path, batch) of ingested files beside an article table."""
    return articles_path.rstrip("/") + ".files"


def ingest_run(spark: SparkSession, raw_path: str | list[str], articles_path: str, dictionary_path: str) -> DataFrame:
    """Ingest the files (plain, gz or zip) that are not in the ledger; returns the names added to the dictionary.

    What a run takes depends on files alone: records with a bad date and files
    that come late for a stored month are ingested like all others.

    Names are stored before the articles that use their ids: a run that is
    repeated finds them and numbers nothing twice. Articles go to a folder of
    their own for each run, and the ledger names its files and folder last. A
    run that was killed has no entry: its files are taken again, and
    ``ingested`` does not read what it left. The driver holds the paths of the
    new files, as the readers do.
    """
    paths = new_files(spark, raw_path, articles_path)
    found = stored(spark, dictionary_path)
    known = found if found is not None else spark.createDataFrame([], "SourceCommonName_ID int, SourceCommonName string")
    if not paths:
        return known.limit(0)
    plain = [p for p in paths if not p.lower().endswith(".zip")]
    zipped = [p for p in paths if p.lower().endswith(".zip")]
    lines = [read(spark, some) for read, some in ((raw.text_lines, plain), (raw.zip_lines, zipped)) if some]
    records = raw.raw_records(lines[0] if len(lines) == 1 else lines[0].unionByName(lines[1]))
    typed = ingest.with_month(ingest.first_in_file(ingest.typed_records(records)))
    grown = ingest.grown_dictionary(known, typed)
    new = stage_lookup(grown.frame.join(known.select("SourceCommonName_ID"), "SourceCommonName_ID", "left_anti"), "added-names")
    new.frame.write.mode("append").parquet(dictionary_path)
    batch = f"b{uuid.uuid4().hex}"
    write_articles(ingest.encoded(typed, grown).drop("file", "line_no"), f"{articles_path.rstrip('/')}/batch={batch}")
    # One small file: it is there or it is not.
    entries = spark.createDataFrame([(p, batch) for p in paths], "path string, batch string").coalesce(1)
    entries.write.mode("append").parquet(ledger_of(articles_path))
    return new.frame


def new_files(spark: SparkSession, raw_path: str | list[str], articles_path: str) -> list[str]:
    """Paths under ``raw_path`` that no finished run has taken; no content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(raw_path).select("path")
    done = stored(spark, ledger_of(articles_path))
    if done is not None:
        listed = listed.join(done.select("path"), "path", "left_anti")
    return sorted(r["path"] for r in listed.toLocalIterator())


def ingested(spark: SparkSession, articles_path: str) -> DataFrame | None:
    """The articles of all finished runs, or None when there are none."""
    done = stored(spark, ledger_of(articles_path))
    if done is None:
        return None
    batches = [r["batch"] for r in done.select("batch").distinct().collect()]  # one for each run
    return spark.read.parquet(articles_path).filter(F.col("batch").isin(batches)).drop("batch")
