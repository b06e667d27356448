"""Schemas of the lineage tables."""

from __future__ import annotations

OP = (
    "file string, op_no int, op_id string, op_type string, start_line int, end_line int, raw_line string, "
    "source_assets array<string>, target_assets array<string>, call_name string, sql_text string, statement_kind string, "
    "select_items array<struct<expression:string,alias:string>>, join_predicates array<string>"
)
VARIABLE = "file string, ord int, name string, value string"
CALL = "file string, fn string, callee string"
TEMP = "file string, asset string"
REJECT = "file string, reason string"
#: One scan of the scripts gives every kind of row; `what` tells which columns are filled.
EXTRACTED = (
    "what string, file string, ord int, name string, value string, op struct<"
    "op_type:string,start_line:int,end_line:int,raw_line:string,source_assets:array<string>,target_assets:array<string>,"
    "call_name:string,sql_text:string,statement_kind:string,"
    "select_items:array<struct<expression:string,alias:string>>,join_predicates:array<string>>"
)
CASE = (
    "case_name string, output_sql string, expected_contains array<string>, expected_not_contains array<string>, "
    "expected_edges array<string>, forbidden_edges array<string>"
)
