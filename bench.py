"""Timed headline queries on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to a no-op sink after one small warm-up of the session, so that
every row and column is computed but none is collected.
"""

import json
import os
import pathlib
import sys
import tempfile
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from bytelayout.layout import Layout  # noqa: E402
from bytelayout.operators.reports import summarize  # noqa: E402
from bytelayout.operators.validate import validate  # noqa: E402
from bytelayout.plans import catalog  # noqa: E402
from bytelayout.session import materialize, work_path  # noqa: E402
from bytelayout.sources.csv import read_csv  # noqa: E402
from bytelayout.sources.sink import write_csv, write_fixed_width  # noqa: E402
from bytelayout.sources.tables import table_rows  # noqa: E402

HEADLINE = [
    "records_lineitem", "cjk_records", "defaults_required", "file_summary", "file_gate", "issue_table",
    "issue_cap", "preview_first_rows", "field_profile", "compare_outputs", "unencodable_docs",
    "unencodable_characters", "csv_records", "layout_offsets",
]


def drain(frame):
    frame.write.format("noop").mode("overwrite").save()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bytelayout-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    drain(catalog.QUERIES["records_customer_left"](spark, folder))

    times, rates = {}, {}

    def timed(name, action):
        started = time.perf_counter()
        result = action()
        times[name] = round(time.perf_counter() - started, 3)
        return result

    for name in HEADLINE:
        timed(name, lambda: drain(catalog.QUERIES[name](spark, folder)))

    # The whole path: lineitem to CSV files, read, validated, gated and written.
    lines = catalog.table(spark, folder, "lineitem").withColumn("n", catalog.F.monotonically_increasing_id() + 1)
    rows = table_rows(lines, catalog.LINEITEM_FIELDS, "l_returnflag", "n")
    source_path, out = work_path(spark, "bench-csv"), work_path(spark, "bench-out")
    timed("write_csv", lambda: write_csv(rows, source_path, rows_per_part=10**12))
    source = timed("read_csv_evidence", lambda: read_csv(spark, source_path))
    timed("read_csv_rows", lambda: drain(source.rows))
    layout = Layout.of_widths(catalog.LINEITEM.widths)
    checked = validate(source.rows, layout)
    timed("validate_csv", lambda: drain(checked))
    summary = timed("summarize_csv", lambda: materialize(summarize(checked, layout)))
    timed("write_fixed_width", lambda: write_fixed_width(checked, summary, layout, out, by_block=source.by_block))

    count = catalog.table(spark, folder, "lineitem").count()
    rates["validated_rows_per_sec"] = round(count / times["records_lineitem"])
    rates["written_mb_per_sec"] = round(
        count * (layout.record_width + 2) / 1e6 / times["write_fixed_width"], 1
    )
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": pathlib.Path(folder).name.removeprefix("sf"), "cpus": int(cpus), **rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
