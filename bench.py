"""Benchmark of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. ``stage_articles`` and ``stage_lookups`` are the times to build
and store the article table and its lookups; the queries read them, as in
production. Each query counts as the best of three runs after one that warms up.
``duckdb`` has the time of the same SQL on the same cores, from the raw tables.
"""

from __future__ import annotations

import json
import os
import time

import duckdb

from pressgauge.catalogue import load
from pressgauge.catalogue.tables import tables
from pressgauge.session import build_session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")

HEADLINE = (
    "ag01_global_whitelist",
    "ag09_category_sums",
    "ag11_ten_indicators",
    "ag12_regional_indicators",
    "ag13_wide_table",
    "ag16_one_pass_sums",
    "ag20_cleaning_funnel",
    "ag23_word_quantiles",
    "ag33_source_features",
    "ag34_top_themes",
    "ag35_theme_shares",
    "ag43_word_buckets",
    "gr01_cooccurrence",
    "ing06_encoded_articles",
    "jn13_cascade_match",
    "ts01_lag_correlations",
    "rg03_lasso_with_inertia",
)


def measured(run, times: int) -> float:
    """Best of ``times`` after one run that warms up."""
    run()
    best = float("inf")
    for _ in range(times):
        start = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("pressgauge-bench", cpus, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = load().QUERIES, load().ORACLES
    start = time.perf_counter()
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {"start_up": round(time.perf_counter() - start, 3)}
    data = tables(spark, sf_dir)
    for name, parts in (("stage_articles", ("gkg",)), ("stage_lookups", ("dictionary", "taxonomy", "regions", "whitelist", "lasting", "registered"))):
        start = time.perf_counter()
        for part in parts:
            getattr(data, part)
        took[name] = round(time.perf_counter() - start, 3)
    duck = {}
    with duckdb.connect(config={"threads": cpus}) as con:
        for name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
        for name in HEADLINE:
            took[name] = measured(lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save(), 3)
            if name in oracles:
                # From the raw tables: the SQL has no stored article table.
                duck[name] = measured(lambda: con.execute(oracles[name]).fetchall(), 1)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(took[name] for name in HEADLINE), 3),
        "unit": "sec",
        "queries": took,
        "duckdb": duck,
        "ratio": {name: round(took[name] / max(s, 1e-3), 2) for name, s in duck.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
