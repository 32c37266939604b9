"""Command line for the two file jobs a shop runs by hand.

    python -m marketlens export --tables <parquet root> --output <csv dir>
    python -m marketlens report --file <csv export> --output <report dir>

``export`` writes the sales export (A3) from the seven shop tables stored
as Parquet; ``report`` reads such an export (A2) and writes the JSON report
(A5: sales trend, top products, category performance, customer segments and
a summary).  Both run on whatever cluster ``spark-submit`` provides.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .operators import sales
from .plans.jobs import sales_report_job
from .session import build_session
from .sources.sinks import write_sales_export
from .sources.tables import read_sales_csv, read_table, type_sales_lines


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="marketlens")
    sub = parser.add_subparsers(dest="command", required=True)
    exp = sub.add_parser("export", help="write the sales export CSV from Parquet shop tables")
    exp.add_argument("--tables", required=True, help="folder with users/orders/order_items/products .parquet")
    exp.add_argument("--output", required=True)
    rep = sub.add_parser("report", help="write the JSON report from a sales export CSV")
    rep.add_argument("--file", required=True, help="CSV export (file or folder of parts)")
    rep.add_argument("--output", required=True)
    args = parser.parse_args(argv)

    spark = build_session(app_name=f"marketlens-{args.command}")
    if args.command == "export":
        t = {n: read_table(spark, args.tables, n) for n in ("users", "orders", "order_items", "products")}
        lines = sales.sales_lines(t["orders"], t["users"], t["order_items"], t["products"])
        write_sales_export(lines, args.output)
    else:
        lines = type_sales_lines(read_sales_csv(spark, args.file))
        sales_report_job(spark, lines, args.output)
        totals = spark.read.json(f"{args.output}/summary").select(F.col("total_records")).first()
        print(f"report written to {args.output} ({totals.total_records} records)")
    return 0


if __name__ == "__main__":
    sys.exit(main())
