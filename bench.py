"""Headline timings: a CSV import of orders, the registered tables, facts, metrics, diagnostics, a pickup scenario, an HTML report, and
single queries.  One JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from parcelight.contract import resolve_rules
from parcelight.operators import diagnostics, facts, ingest, metrics, report, simulate
from parcelight.plans import fixtures, queries
from parcelight.sources import csv
from parcelight.sources.shared import new_path, stored

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        out = run()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
        return out

    spark.range(1000).selectExpr("sum(id)").collect()
    tables = timed("import", lambda: tuple(stored(df, n) for df, n in zip(fixtures.load(spark, SF), ("orders", "warehouse", "tracking"), strict=True)))
    path, n = new_path(spark, "csv"), int(CPUS)
    csv.write(tables[0].repartition(n).selectExpr("order_id", "created_at", "ordered_quantity", "quantity_unit", "raw_order_status", "carrier_id"), path)

    def import_csv() -> None:
        """Scan, mapping and validation of every order as text, and the report of its issues."""
        rows, _ = csv.scan(spark, f"{path}/*.txt")
        found = ingest.suggest_mapping([c for c in rows.columns if c != "row_number"], ingest.CONTRACTS["orders"])
        v = ingest.validate(rows, ingest.CONTRACTS["orders"], {h: f for h, (f, _, _) in found.items()})
        stored(v.valid, "imported")

    timed("import_csv_orders", import_csv)
    queries._datasets[(spark.sparkContext.applicationId, SF)] = tables
    f = timed("facts", lambda: facts.evaluated(*tables))
    queries._evaluated[(spark.sparkContext.applicationId, SF)] = f
    timed("metrics_summary", lambda: metrics.build_metrics(f).collect())
    timed("trend_week", lambda: metrics.trend(f, "week").collect())
    timed("breakdown_carrier", lambda: metrics.breakdown(f, "carrier_id").collect())
    evidence = timed("diagnostics", lambda: stored(diagnostics.analyze(f, resolve_rules(), keep=lambda df: stored(df, "evidence")), "evidence"))
    timed("report_html", lambda: report.html_document("report", report.document(f, evidence, resolve_rules())))
    timed("pareto", lambda: diagnostics.pareto(evidence).collect())
    timed("simulation_pickup", lambda: simulate.run(tables, simulate.Scenario(pickup=simulate.Improvement("ready_to_pickup", 1.0)), keep=lambda df: stored(df, "scenario"), evaluated=f).comparison.collect())
    for name in ("kpi_overall", "otif_by_carrier", "process_variants", "event_gaps"):
        timed(name, lambda name=name: queries.queries()[name](spark, SF).collect())
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
