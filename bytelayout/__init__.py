"""Fixed-width Big5 export and validation on Spark."""

from bytelayout.layout import FieldSpec, InvalidSettings, Layout
from bytelayout.operators.compare import compare_files
from bytelayout.operators.reports import (
    cap_issues, gate, in_report_order, issue_counts, issue_table, preview, records, summarize,
)
from bytelayout.operators.validate import validate, with_field_results, with_record
from bytelayout.plans.convert import Conversion, convert_csv, convert_folder, convert_xlsx
from bytelayout.sources.csv import read_csv
from bytelayout.sources.fixed_width import read_fixed_width
from bytelayout.sources.sink import write_csv, write_fixed_width, write_report
from bytelayout.sources.tables import number_rows, table_rows
from bytelayout.sources.xlsx import read_xlsx

__all__ = [
    "Conversion", "FieldSpec", "InvalidSettings", "Layout", "cap_issues", "compare_files",
    "convert_csv", "convert_folder", "convert_xlsx", "gate", "in_report_order", "issue_counts",
    "issue_table", "number_rows", "preview", "read_csv", "read_fixed_width", "read_xlsx", "records", "summarize",
    "table_rows", "validate", "with_field_results", "with_record", "write_csv",
    "write_fixed_width", "write_report",
]
