"""Scripts to lineage tables: one Arrow-batched pass with Python's own parser, the rest in DataFrame operations."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary import schemas
from tributary.functions import clauses, scan
from tributary.functions.text import ASSET

# The substrings that mark a call as a read or a write.
READ_MARKS = (
    "spark.read", ".read.format(", ".read.option(", ".read.csv(", ".read.parquet(", "read_sql(",
    "requests.get(", "requests.post(", "requests.put(", "requests.delete(", "read_ndw(",
)
WRITE_MARKS = (".write", ".save(", ".saveAsTable(", ".insertInto(", ".to_sql(", "write_ndw(", "createOrReplaceTempView(")
WRITE_CALLS = ("createorreplacetempview", "executeupdate", "save", "saveastable", "insertinto")
WRITE_VERBS = ("INSERT ", "UPDATE ", "DELETE ", "MERGE ", "CREATE ", "DROP ", "ALTER ")
PATH_READS = ("csv", "parquet", "orc", "json", "text", "load", "table")
PATH_WRITES = ("csv", "parquet", "orc", "json", "text", "save", "saveAsTable", "insertInto")


@dataclass
class Folder:
    """Constant folding of string expressions over known names."""

    known: dict[str, str]

    def fold(self, node: ast.AST | None) -> str | None:
        match node:
            case ast.Constant(value=str(text)):
                return text
            case ast.Name(id=name):
                return self.known.get(name)
            case ast.JoinedStr(values=values):
                return "".join(self._piece(v) for v in values)
            case ast.BinOp(left=a, op=ast.Add(), right=b):
                left, right = self.fold(a), self.fold(b)
                return None if left is None or right is None else left + right
            case ast.Call(func=ast.Attribute(value=base, attr="format"), args=args, keywords=named):
                return self._format(self.fold(base), args, named)
            case ast.Call(func=ast.Attribute(attr="join", value=ast.Attribute(attr="path"))):
                parts = [self.fold(a) for a in node.args]
                return None if None in parts else "/".join(p.strip("/") if i else p.rstrip("/") for i, p in enumerate(parts))
        return None

    def _piece(self, node: ast.AST) -> str:
        if isinstance(node, ast.Constant):
            return str(node.value)
        return "{" + (node.value.id if isinstance(node.value, ast.Name) else ast.unparse(node.value).strip()) + "}"

    def _format(self, base: str | None, args: list[ast.expr], named: list[ast.keyword]) -> str | None:
        if base is None:
            return None
        values = {str(i): self.fold(a) for i, a in enumerate(args)} | {k.arg: self.fold(k.value) for k in named if k.arg}
        count = iter(range(len(args)))
        filled = re.sub(r"\{\}", lambda m: "{" + str(next(count, "")) + "}", base)
        return re.sub(r"\{(\w+)\}", lambda m: values.get(m[1]) or m[0], filled)


def dotted(func: ast.AST) -> tuple[str, bool]:
    """The dotted name of a called thing, and whether calls in the chain were left out of it."""
    names: list[str] = []
    chained = False
    while True:
        if isinstance(func, ast.Attribute):
            names.append(func.attr)
            func = func.value
        elif isinstance(func, ast.Call):
            chained = True
            func = func.func
        else:
            break
    if isinstance(func, ast.Name):
        names.append(func.id)
    return ".".join(reversed(names)), chained


def sql_details(sql: str) -> dict:
    """Kind, targets, sources, select items and join predicates of one statement; by patterns where it cannot be read to its end."""
    kind, rule, _, found = clauses.read(sql)
    if rule is not None:
        return _guessed_details(sql)
    rows = [dict(zip(clauses.CLAUSE, r, strict=True)) for r in found]
    bare = lambda name: name.strip("\"'`")
    targets = [bare(r["name"]) for r in rows if r["clause"] == "target"]
    gone = {t.lower() for t in targets} | {r["name"].lower() for r in rows if r["clause"] == "cte"}
    sources = [bare(r["name"]) for r in rows if r["clause"] in ("from", "join") and r["name"] and bare(r["name"]).lower() not in gone]
    main = next((r["child"] for r in rows if r["clause"] == "query"), None)
    return {
        "statement_kind": kind, "source_assets": list(dict.fromkeys(sources)), "target_assets": targets,
        "select_items": [{"expression": r["text"], "alias": r["name"]} for r in rows if r["clause"] == "item" and r["parent"] == main and not r["branch"]],
        "join_predicates": [r["text"] for r in rows if r["clause"] == "on"],
    }


def _guessed_details(sql: str) -> dict:
    words = [t.word for t in scan.tokens(sql)]
    kind = next((w.lower() for w in words[:1] if w in ("INSERT", "UPDATE", "MERGE", "SELECT")), "")
    if words[:1] == ["WITH"]:
        kind = "insert" if "INSERT" in words else "select"
    names = lambda pattern: [m.strip("\"'`;,") for m in re.findall(pattern, sql, re.IGNORECASE)]
    targets = names(rf"\b(?:INSERT\s+INTO|INSERT\s+OVERWRITE\s+TABLE|UPDATE|MERGE\s+INTO)\s+({ASSET})")[:1] if kind != "select" else []
    gone = {t.lower() for t in targets}
    sources = list(dict.fromkeys(s for s in names(rf"\b(?:FROM|JOIN|USING)\s+({ASSET})") if s and s.lower() not in gone))
    items = [{"expression": e, "alias": a} for e, a in scan.projections(sql)] if kind in ("insert", "select") else []
    return {"statement_kind": kind, "source_assets": sources, "target_assets": targets, "select_items": items, "join_predicates": []}


def op_type(name: str, call: ast.Call, sql: str | None) -> str | None:
    """read, write or neither."""
    last = name.rsplit(".", 1)[-1].lower()
    if last in WRITE_CALLS:
        return "write"
    if last == "to_sql":
        return "write"
    if last.endswith("sql"):
        return "write" if (sql or "").lstrip().upper().startswith(WRITE_VERBS) else "read"
    literals = [n.value for n in ast.walk(call) if isinstance(n, ast.Constant) and isinstance(n.value, str)]
    hint = " ".join([name + "(", *literals])
    dotted_hint = "." + hint
    if any(m in hint or m in dotted_hint for m in READ_MARKS):
        return "read"
    if any(m in hint or m in dotted_hint for m in WRITE_MARKS):
        return "write"
    return None


def extract_script(code: str) -> tuple[dict[str, str], list[tuple[str, str]], list[dict]]:
    """Variables in order, (function, callee) pairs, and operations in source order. Raises SyntaxError."""
    tree = ast.parse(code)
    folder = Folder({})
    calls: set[tuple[str, str]] = set()
    outer: set[int] = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign):
            text = folder.fold(node.value)
            for target in node.targets:
                if isinstance(target, ast.Name) and text:
                    folder.known[target.id] = text
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            calls |= {(node.name, c.func.id) for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name)}
        elif isinstance(node, ast.Call):
            # of a chain such as df.write.mode(..).saveAsTable(..) only the outermost call is an operation
            inner = node.func
            while isinstance(inner, ast.Attribute):
                inner = inner.value
            if isinstance(inner, ast.Call):
                outer.add(id(inner))
    ops = []
    for node in sorted((n for n in ast.walk(tree) if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.end_lineno or n.lineno)):
        name, _ = dotted(node.func)
        text = folder.fold(node.args[0]) if node.args else None
        kind = op_type(name, node, text)
        if kind is None or (id(node) in outer and not name.lower().endswith("sql")):
            continue
        last = name.rsplit(".", 1)[-1]
        details = sql_details(text) if text and (last.lower().endswith(("sql", "update")) or re.match(r"\s*(?:SELECT|WITH|INSERT|UPDATE|MERGE)\b", text, re.I)) else (
            {"statement_kind": "", "source_assets": [], "target_assets": [], "select_items": [], "join_predicates": []}
        )
        if last.lower() == "createorreplacetempview" and text:
            details |= {"target_assets": ["#" + text], "statement_kind": "create_temp_view"}
        elif text and kind == "read" and not details["statement_kind"] and last in (*PATH_READS, "get", "post", "put", "delete", "read_ndw"):
            details["source_assets"] = [text]
        elif text and kind == "write" and not details["statement_kind"] and last in (*PATH_WRITES, "to_sql", "write_ndw"):
            details["target_assets"] = [text]
        line = (ast.get_source_segment(code, node) or name).strip().splitlines()[0]
        ops.append({"op_type": kind, "start_line": node.lineno, "end_line": node.end_lineno or node.lineno, "raw_line": line, "call_name": name, "sql_text": text or "", **details})
    return folder.known, sorted(calls), ops


def extract(scripts: DataFrame) -> DataFrame:
    """Rows of schemas.EXTRACTED from (file, code): variables, calls, operations, and rejects with the reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, code in zip(batch["file"], batch["code"], strict=True):
                try:
                    names, calls, ops = extract_script(code or "")
                except (SyntaxError, ValueError, RecursionError) as reason:
                    rows.append(("reject", file, 0, None, f"{type(reason).__name__}: {reason}", None))
                    continue
                rows += [("variable", file, i, k, v, None) for i, (k, v) in enumerate(names.items())]
                rows += [("call", file, i, fn, callee, None) for i, (fn, callee) in enumerate(calls)]
                rows += [("op", file, i, None, None, op) for i, op in enumerate(ops, 1)]
            yield pd.DataFrame(rows, columns=["what", "file", "ord", "name", "value", "op"])

    return scripts.select("file", "code").mapInPandas(run, schemas.EXTRACTED)


def operations(extracted: DataFrame) -> DataFrame:
    """The op table; numbers follow source order within a file."""
    return extracted.where("what = 'op'").select(
        "file", F.col("ord").alias("op_no"), F.concat(F.lit("op_"), "ord").alias("op_id"), "op.*"
    )


def variables(extracted: DataFrame) -> DataFrame:
    return extracted.where("what = 'variable'").select("file", "ord", "name", "value")


def call_graph(extracted: DataFrame) -> DataFrame:
    """(file, fn, callees) with callees sorted."""
    calls = extracted.where("what = 'call'")
    return calls.groupBy("file", F.col("name").alias("fn")).agg(F.array_sort(F.collect_set("value")).alias("callees"))


def temp_views(ops: DataFrame) -> DataFrame:
    """(file, asset): registered temporary views, lower case with #."""
    made = ops.where("statement_kind = 'create_temp_view'").select("file", F.explode("target_assets").alias("asset"))
    return made.select("file", F.lower("asset").alias("asset")).distinct()


def rejects(extracted: DataFrame) -> DataFrame:
    return extracted.where("what = 'reject'").select("file", F.col("value").alias("reason"))
