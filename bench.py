"""Headline queries on local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from modlens import analyze
from modlens.plans import corpus, queries, tables
from modlens.plans.queries import QUERIES
from modlens.session import get_session
from modlens.streaming.incremental import latest_traces

HEADLINE = [
    "findings_by_rule",
    "findings_by_module",
    "dependency_list",
    "statement_list",
    "parameter_list",
    "module_index",
    "risk_summary",
    "object_usage",
    "graph_nodes",
    "graph_edges",
    "module_diff",
    "diff_changes",
    "diff_documents",
    "shared_texts",
    "trace_json",
    "report_md",
    "long_module_text",
    "long_module_findings",
    "long_module_dependencies",
    "dense_module_dependencies",
    "dense_module_usage",
    "nested_parameters",
    "duplicate_keys",
    "join_inflation",
    "folder_scan",
]
#: Copies of the long modules that make about 1 GB of text at sf0.1.
COPIES = 20


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.time() - started, 3)

    warm_up = run("findings_by_module") + run("dependency_list")
    seconds = {name: run(name) for name in HEADLINE}

    def timed(step):
        started = time.time()
        done = step()
        return round(time.time() - started, 3), done

    def save(frame):
        return frame.write.format("noop").mode("overwrite").save()

    # Streams: taking arrivals in, and reading what they left, apart.
    seconds["arrivals_appended"], out = timed(lambda: queries.arrive(spark, folder))
    seconds["latest_traces_read"], _ = timed(lambda: save(tables.findings(latest_traces(spark.read.parquet(out)))))
    seconds["arrivals_kept"], store = timed(lambda: queries.kept_store(spark, folder))
    seconds["kept_traces_read"], _ = timed(lambda: save(tables.findings(store.traces())))
    seconds["kept_summary_read"], _ = timed(lambda: save(store.object_usage()))

    long = corpus.long_modules(spark, folder)
    many = long.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).withColumn("module_id", F.concat_ws("/", "module_id", "copy"))
    seconds["long_text_times_20_findings"], _ = timed(lambda: save(tables.findings(analyze(many))))

    modules = spark.read.parquet(f"{folder}/orders.parquet").count()
    long_bytes = corpus.long_modules(spark, folder).selectExpr("sum(octet_length(sql))").first()[0]
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "warm_up": round(warm_up, 3),
                "modules_per_sec": {
                    name: round(modules / seconds[name])
                    for name in ("findings_by_module", "dependency_list", "module_index")
                },
                "long_mb_per_sec": {
                    name: round(long_bytes / 1e6 / seconds[name], 1)
                    for name in ("long_module_text", "long_module_findings")
                }
                | {"long_text_times_20_findings": round(COPIES * long_bytes / 1e6 / seconds["long_text_times_20_findings"], 1)},
            }
        )
    )
    spark.stop()
    sys.stdout.flush()


if __name__ == "__main__":
    main()
