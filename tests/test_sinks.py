"""CSV export (A3, A4), reading it back (A2) and the JSON report (A5)."""

import glob
import json
import os

from marketlens.operators import sales
from marketlens.sources.sinks import export_frame, write_enquiry_export, write_report, write_sales_export
from marketlens.sources.tables import read_sales_csv, type_sales_lines
from marketlens import schema as S


def _lines(seed):
    return sales.sales_lines(seed["orders"], seed["users"], seed["order_items"], seed["products"])


def _csv_text(path):
    parts = sorted(glob.glob(os.path.join(path, "part-*.csv")))
    return "".join(open(p, encoding="utf-8").read() for p in parts)


def test_export_quotes_everything_and_empties_falsy(spark, seed, scratch_dir):
    df = spark.createDataFrame([(0, 'say "hi"', None, 2.50, "2024-01-15 10:00:00")],
                               "order_id long, customer string, email string, price double, created_at string")
    row = export_frame(df, ["order_id", "customer", "email", "price"]).first()
    assert tuple(row) == ("", 'say "hi"', "", "2.5")
    out = os.path.join(scratch_dir, "export")
    write_sales_export(_lines(seed), out)
    text = _csv_text(out)
    header, first = text.splitlines()[:2]
    assert header == ",".join(f'"{c}"' for c in S.SALES_CSV_COLUMNS)
    assert first.count('","') == 9 and first.startswith('"') and '"2024-01-15 10:00:00"' in first


def test_export_round_trip_feeds_the_report(spark, seed, scratch_dir):
    out = os.path.join(scratch_dir, "export")
    write_sales_export(_lines(seed), out)
    typed = type_sales_lines(read_sales_csv(spark, out))
    assert typed.count() == 7
    perf = {r.category: (r.revenue, r.units_sold, r.order_count)
            for r in sales.category_performance(typed).collect()}
    assert perf == {"Terracotta Decor": (9400.0, 4, 3), "Dokra Metal Art": (5600.0, 4, 3)}


def test_empty_quantity_counts_as_zero(spark, scratch_dir):
    path = os.path.join(scratch_dir, "lines.csv")
    with open(path, "w") as f:
        f.write(",".join(S.SALES_CSV_COLUMNS) + "\n")
        f.write('"1","A","a@x.com","10","confirmed","2024-01-15 10:00:00","P","C","","5"\n')
        f.write('"2","B","b@x.com","10","confirmed","2024-01-15 10:00:00","P","C","0",""\n')
        f.write('"3","C","","10","confirmed","2024-01-16 10:00:00","P","C","2","5"\n')
    typed = type_sales_lines(read_sales_csv(spark, path))
    trend = {r.date: (r.orders, r.revenue, r.units_sold) for r in sales.line_sales_trend(typed).collect()}
    assert trend == {"2024-01-15": (2, 0.0, 0), "2024-01-16": (1, 10.0, 2)}
    segs = {r.email for r in sales.customer_segments(typed).collect()}
    assert segs == {"a@x.com", "b@x.com"}


def test_enquiry_export_order(spark, seed, scratch_dir):
    out = os.path.join(scratch_dir, "enq")
    write_enquiry_export(seed["b2b_enquiries"], out)
    lines = _csv_text(out).splitlines()
    assert len(lines) == 4 and lines[0].startswith('"id","company_name"')


def test_report_sections(spark, seed, scratch_dir):
    lines = _lines(seed)
    out = os.path.join(scratch_dir, "report")
    sections = {
        "sales_trend": sales.line_sales_trend(lines),
        "top_products": sales.top_products_by_revenue(lines),
        "category_performance": sales.category_performance(lines),
        "customer_segments": sales.customer_segments(lines),
    }
    write_report(spark, sections, out, lines.selectExpr("count(*) AS total_records"), generated_at="t0")
    summary = [json.loads(x) for p in glob.glob(f"{out}/summary/part-*") for x in open(p)]
    assert summary == [{"generated_at": "t0", "total_records": 7}]
    segs = [json.loads(x) for p in glob.glob(f"{out}/customer_segments/part-*") for x in open(p)]
    assert sorted(s["email"] for s in segs) == ["buyer5@shop.example", "buyer6@shop.example", "buyer7@shop.example"]


def test_command_line_export_then_report(spark, seed, scratch_dir):
    from marketlens.__main__ import main

    tables = os.path.join(scratch_dir, "tables")
    for name in ("users", "orders", "order_items", "products"):
        seed[name].write.parquet(os.path.join(tables, f"{name}.parquet"))
    export = os.path.join(scratch_dir, "export")
    report = os.path.join(scratch_dir, "report")
    assert main(["export", "--tables", tables, "--output", export]) == 0
    assert main(["report", "--file", export, "--output", report]) == 0
    cats = {json.loads(x)["category"]: json.loads(x)["order_count"]
            for p in glob.glob(f"{report}/category_performance/part-*") for x in open(p)}
    assert cats == {"Terracotta Decor": 3, "Dokra Metal Art": 3}
    summary = [json.loads(x) for p in glob.glob(f"{report}/summary/part-*") for x in open(p)]
    assert summary[0]["total_records"] == 7


def test_export_keeps_surrounding_blanks(spark, scratch_dir):
    df = spark.createDataFrame([(1, "  padded  ", " x", "2024-01-15 10:00:00")],
                               "order_id long, customer string, email string, created_at string")
    out = os.path.join(scratch_dir, "blanks")
    from marketlens.sources.sinks import write_export

    write_export(df, out, ["order_id", "customer", "email"])
    assert '"  padded  "," x"' in _csv_text(out)
    back = spark.read.schema("order_id string, customer string, email string").option("header", True) \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out).first()
    assert (back.customer, back.email) == ("  padded  ", " x")
