"""One script followed as it would run: a helper of operators/dataflow.py, which assembles statements with joins.

Module statements are followed in order. Calls of the script's own functions are
entered with their arguments bound, loops over known short sequences run once an
element, both arms of a condition count. Each DataFrame a method gives is a step with
the SELECT that the method stands for; each write names the step it writes. Functions
that nothing calls are followed last, their parameters as placeholders.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from tributary.functions import clauses

#: Most iterations that are expanded; steps of one script, calls within calls.
MAX_ITERATIONS = 31
MAX_STEPS = 20_000
MAX_DEPTH = 40
#: Methods that name what is read or written.
READS = ("parquet", "csv", "json", "orc", "text", "load", "table", "jdbc")
WRITES = ("parquet", "csv", "json", "orc", "text", "save", "saveAsTable", "insertInto", "jdbc", "start", "toTable")
PANDAS_WRITES = ("to_csv", "to_parquet", "to_json", "to_excel", "to_sql")
OPERATORS = {
    ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.BitAnd: "AND", ast.BitOr: "OR",
    ast.Eq: "=", ast.NotEq: "<>", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=",
}
#: Fields that hold statements, in the order of every node's own fields.
BODIES = ("body", "handlers", "orelse", "finalbody", "cases")
STEP = ("step", "what", "line", "scope", "loop", "name", "method", "format", "options", "args", "inputs", "sql", "cte", "uses")


@dataclass
class Frame:
    step: int
    columns: list[str] | None = None


@dataclass
class Column:
    """An expression; ~7~x is column x of the frame of step 7."""

    text: str
    name: str = ""

    def named(self) -> str:
        return f"{self.text} AS {self.name}" if self.name else self.text

    def output(self) -> str:
        text = re.sub(r"~\d+~", "", self.text)
        return self.name or (text.rsplit(".", 1)[-1] if re.fullmatch(r"[\w.]+", text) else text)


@dataclass
class Access:
    """A reader, or a writer of a frame, with what has been set so far."""

    frame: Frame | None
    format: str = ""
    options: dict[str, str] = field(default_factory=dict)


@dataclass
class Grouped:
    frame: Frame
    keys: list[Column]


@dataclass
class Window:
    parts: dict[str, list[Column]]


class Stop(Exception):
    """Too many steps."""


def defined(tree: ast.Module) -> list[ast.FunctionDef | ast.AsyncFunctionDef]:
    """The functions of a script in the order of ast.walk, which would go through all expressions too."""
    found, level = [], [tree]
    while level:
        found += [n for n in level if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
        level = [m for n in level for part in BODIES for m in getattr(n, part, ()) if isinstance(m, ast.stmt | ast.excepthandler | ast.match_case)]
    return found


class Follower:
    """Follows one script."""

    def __init__(self, tree: ast.Module) -> None:
        self.functions = {n.name: n for n in defined(tree)}
        self.entered: set[str] = set()
        self.scope: list[str] = []
        self.loops: list[str] = []
        self.rows: list[tuple] = []
        self.names: dict[int, str] = {}
        self.known: dict[int, list[str] | None] = {}
        self.used: dict[str, int] = {}
        self.env: dict[str, object] = {}
        self.outer: dict[str, object] = self.env
        self.returned: list[object] = []
        try:
            self.block(tree.body)
            called = {c.func.id for f in self.functions.values() for c in ast.walk(f) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name) and c.func.id != f.name}
            for left in (sorted(set(self.functions) - called, key=list(self.functions).index), list(self.functions)):
                for name in left:
                    if name not in self.entered:
                        self.enter(self.functions[name], {})
        except Stop:
            self.row("reject", 0, name="too_many_steps", sql=str(MAX_STEPS))

    # --- rows ---

    def row(self, what: str, line: int, name: str = "", method: str = "", format: str = "", options: dict | None = None, args: list[str] | None = None, inputs: list[int] | None = None, sql: str = "") -> int:
        if len(self.rows) >= MAX_STEPS and what != "reject":
            raise Stop
        step = len(self.rows)
        self.rows.append((step, what, line, ">".join(self.scope), ",".join(self.loops), name, method, format, options or {}, args or [], inputs or [], sql))
        return step

    def named_rows(self) -> list[dict]:
        """The rows as dictionaries; frames with the name of their CTE and their columns as a list."""
        out = []
        for r in self.rows:
            row = dict(zip(STEP, r, strict=False)) | {"cte": "", "uses": []}
            if row["what"] == "frame":
                row |= {"cte": self.names.get(row["step"]) or f"step_{row['step']}", "listed": self.listed(self.known.get(row["step"]))}
            out.append(row)
        return out

    def frame(self, node: ast.AST, method: str, sql: str, inputs: list[Frame], columns: list[str] | None, **more) -> Frame:
        """A step; @0, @1 in its SQL stand for its inputs' names."""
        sides = dict(zip((f.step for f in inputs), ("l.", "r."), strict=False)) if " AS l " in sql else {}
        sql = re.sub(r"~(\d+)~", lambda m: sides.get(int(m[1]), ""), sql)
        step = self.row("frame", node.lineno, method=method, sql=sql, inputs=[f.step for f in inputs], **more)
        self.known[step] = columns
        return Frame(step, columns)

    # --- statements ---

    def block(self, body: list[ast.stmt]) -> None:
        for node in body:
            self.statement(node)

    def statement(self, node: ast.stmt) -> None:
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef() | ast.Import() | ast.ImportFrom():
                pass
            case ast.Assign(targets=targets, value=value):
                made = self.value(value)
                for target in targets:
                    self.assign(target, made)
            case ast.AnnAssign(target=target, value=value) if value is not None:
                self.assign(target, self.value(value))
            case ast.AugAssign(target=ast.Name(id=name), op=ast.Add(), value=value):
                before, more = self.env.get(name), self.value(value)
                known = isinstance(before, str | list) and type(before) is type(more)
                self.env[name] = before + more if known else None
            case ast.Expr(value=value):
                self.value(value)
            case ast.Return(value=value):
                self.returned.append(self.value(value) if value is not None else None)
            case ast.If(test=test, body=body, orelse=orelse):
                self.value(test)
                self.block(body)
                self.block(orelse)
            case ast.For(target=target, iter=source, body=body, orelse=orelse):
                self.loop(node, target, source, lambda: self.block(body))
                self.block(orelse)
            case ast.While(body=body, orelse=orelse):
                self.row("reject", node.lineno, name="loop_unknown", sql="while")
                self.block(body)
                self.block(orelse)
            case ast.With(items=items, body=body) | ast.AsyncWith(items=items, body=body):
                for item in items:
                    made = self.value(item.context_expr)
                    if item.optional_vars is not None:
                        self.assign(item.optional_vars, made)
                self.block(body)
            case ast.Try(body=body, handlers=handlers, orelse=orelse, finalbody=final):
                for part in (body, *[h.body for h in handlers], orelse, final):
                    self.block(part)

    def assign(self, target: ast.expr, made: object) -> None:
        if isinstance(target, ast.Name):
            self.env[target.id] = made
            if isinstance(made, Frame) and made.step not in self.names:
                n = self.used[target.id] = self.used.get(target.id, 0) + 1
                self.names[made.step] = target.id if n == 1 else f"{target.id}_{n}"
        elif isinstance(target, ast.Tuple | ast.List):
            parts = made if isinstance(made, list) and len(made) == len(target.elts) else [None] * len(target.elts)
            for t, m in zip(target.elts, parts, strict=True):
                self.assign(t, m)

    def loop(self, node: ast.AST, target: ast.expr, source: ast.expr, body) -> None:
        items = self.value(source)
        items = list(items) if isinstance(items, dict) else items
        shown = ast.unparse(target)
        if isinstance(items, list) and len(items) <= MAX_ITERATIONS:
            for item in items:
                self.assign(target, item)
                self.loops.append(f"{shown}={self.shown(item)}")
                body()
                self.loops.pop()
            return
        known = isinstance(items, list)
        self.row("reject", node.lineno, name="loop_bound" if known else "loop_unknown", sql=f"{shown}: {len(items)} iterations" if known else f"{shown} in {ast.unparse(source)}")
        for name in [n.id for n in ast.walk(target) if isinstance(n, ast.Name)]:
            self.env[name] = "{" + name + "}"
        body()

    def shown(self, value: object) -> str:
        return ";".join(map(self.shown, value)) if isinstance(value, list) else str(value) if isinstance(value, str | int | float) else "?"

    def enter(self, function: ast.FunctionDef | ast.AsyncFunctionDef, bound: dict[str, object], line: int = 0) -> object:
        if function.name in self.scope:
            self.row("reject", line, name="recursion", sql=">".join([*self.scope, function.name]))
            return None
        if len(self.scope) >= MAX_DEPTH:
            self.row("reject", line, name="too_deep", sql=function.name)
            return None
        self.entered.add(function.name)
        args = function.args
        names = [a.arg for a in (*args.posonlyargs, *args.args, *args.kwonlyargs)]
        local: dict[str, object] = {n: "{" + n + "}" for n in names}
        positional = [a.arg for a in (*args.posonlyargs, *args.args)]
        for n, d in [*zip(positional[len(positional) - len(args.defaults) :], args.defaults, strict=True), *zip((a.arg for a in args.kwonlyargs), args.kw_defaults, strict=True)]:
            if d is not None:
                local[n] = self.value(d)
        held = self.env, self.returned
        self.env, self.returned = local | {k: v for k, v in bound.items() if k in local}, []
        self.scope.append(function.name)
        self.block(function.body)
        self.scope.pop()
        made = next((r for r in self.returned if r is not None), None)
        self.env, self.returned = held
        return made

    # --- values ---

    def value(self, node: ast.AST | None) -> object:
        match node:
            case ast.Constant(value=value):
                return value
            case ast.Name(id=name):
                return self.env[name] if name in self.env else self.outer.get(name)
            case ast.JoinedStr(values=values):
                return "".join(str(v.value) if isinstance(v, ast.Constant) else self.placed(v.value) for v in values)
            case ast.List(elts=elts) | ast.Tuple(elts=elts):
                return [self.value(e) for e in elts]
            case ast.Dict(keys=keys, values=values):
                return {self.value(k): self.value(v) for k, v in zip(keys, values, strict=True) if isinstance(k, ast.Constant)}
            case ast.ListComp(elt=elt, generators=[one]) | ast.GeneratorExp(elt=elt, generators=[one]):
                made: list[object] = []
                self.loop(node, one.target, one.iter, lambda: made.append(self.value(elt)))
                return made
            case ast.IfExp(body=body, orelse=orelse):
                first, second = self.value(body), self.value(orelse)
                return first if first is not None else second
            case ast.Subscript(value=base, slice=index):
                held, key = self.value(base), self.value(index)
                if isinstance(held, Frame) and isinstance(key, str):
                    return Column(f"~{held.step}~{key}")
                try:
                    return held[key]
                except (TypeError, KeyError, IndexError):
                    return None
            case ast.Attribute(value=base, attr=attr):
                held = self.value(base)
                if isinstance(held, Frame):
                    return Access(held) if attr in ("write", "writeStream", "writeTo") else Column(f"~{held.step}~{attr}")
                return Access(None) if attr in ("read", "readStream") else None
            case ast.BinOp(left=a, op=op, right=b):
                left, right = self.value(a), self.value(b)
                if isinstance(op, ast.Add) and type(left) is type(right) and isinstance(left, str | list | int):
                    return left + right
                if isinstance(left, Column) or isinstance(right, Column):
                    return Column(f"{self.operand(left)} {OPERATORS.get(type(op), '?')} {self.operand(right)}")
                return None
            case ast.Compare(left=a, ops=[op], comparators=[b]):
                left, right = self.value(a), self.value(b)
                return Column(f"{self.operand(left)} {OPERATORS.get(type(op), '?')} {self.operand(right)}") if isinstance(left, Column) or isinstance(right, Column) else None
            case ast.UnaryOp(op=op, operand=operand):
                held = self.value(operand)
                if isinstance(held, Column):
                    return Column(("NOT " if isinstance(op, ast.Invert) else "-") + self.operand(held))
                return -held if isinstance(op, ast.USub) and isinstance(held, int | float) else None
            case ast.Call():
                return self.call(node)
        return None

    def placed(self, node: ast.expr) -> str:
        """A part of a formatted string: its text, or a placeholder."""
        made = self.value(node)
        return str(made) if isinstance(made, str | int | float) else "{" + ast.unparse(node) + "}"

    def operand(self, value: object) -> str:
        """SQL of an operand: an expression in parentheses where it has parts, a literal otherwise."""
        if isinstance(value, Column):
            return value.text if re.fullmatch(r"[\w.#~]+(\([^()]*\))?|'[^']*'", value.text) else f"({value.text})"
        return self.literal(value)

    def literal(self, value: object) -> str:
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else str(value)

    def columns(self, values: list[object]) -> list[Column]:
        """Arguments as columns: text is a name, lists are opened."""
        out: list[Column] = []
        for v in values:
            out += self.columns(v) if isinstance(v, list) else [v] if isinstance(v, Column) else [Column(str(v))]
        return out

    # --- calls ---

    def call(self, node: ast.Call) -> object:
        func = node.func
        if isinstance(func, ast.Name):
            args, named = self.arguments(node)
            if func.id in self.functions:
                function = self.functions[func.id]
                names = [a.arg for a in (*function.args.posonlyargs, *function.args.args)]
                return self.enter(function, dict(zip(names, args, strict=False)) | named, node.lineno)
            if func.id == "range" and args and all(isinstance(a, int) for a in args):
                return list(range(*args)) if len(range(*args)) <= 100_000 else None
            if func.id == "enumerate" and args and isinstance(args[0], list):
                return [[i, x] for i, x in enumerate(args[0])]
            if func.id == "zip" and all(isinstance(a, list) for a in args):
                return [list(x) for x in zip(*args, strict=False)]
            if func.id in ("list", "sorted", "tuple") and args and isinstance(args[0], list):
                return args[0]
            if func.id == "str" and args and isinstance(args[0], str | int):
                return str(args[0])
            return self.free_call(node, func.id, args, named)
        if not isinstance(func, ast.Attribute):
            return None
        base = self.value(func.value)
        args, named = self.arguments(node)
        if isinstance(base, Frame):
            return self.frame_method(node, base, func.attr, args, named)
        if isinstance(base, Access):
            return self.access_method(node, base, func.attr, args, named)
        if isinstance(base, Grouped):
            return self.aggregate(node, base, func.attr, args)
        if isinstance(base, Column):
            return self.column_method(base, func.attr, args)
        if isinstance(base, Window):
            return Window(base.parts | {func.attr: self.columns(args)})
        if isinstance(base, str):
            return self.text_method(base, func.attr, args, named)
        if isinstance(base, dict) and func.attr in ("items", "keys", "values"):
            return [[k, v] for k, v in base.items()] if func.attr == "items" else list(getattr(base, func.attr)())
        if isinstance(base, list) and func.attr == "append":
            base += args
            return None
        whole = ast.unparse(func)
        if whole == "os.path.join" and all(isinstance(a, str) for a in args):
            return "/".join(a.strip("/") if i else a.rstrip("/") for i, a in enumerate(args))
        if func.attr in ("partitionBy", "orderBy") and isinstance(func.value, ast.Name) and func.value.id == "Window":
            return Window({func.attr: self.columns(args)})
        return self.free_call(node, whole, args, named)

    def arguments(self, node: ast.Call) -> tuple[list[object], dict[str, object]]:
        args: list[object] = []
        for a in node.args:
            made = self.value(a.value if isinstance(a, ast.Starred) else a)
            args += made if isinstance(a, ast.Starred) and isinstance(made, list) else [made]
        return args, {k.arg: self.value(k.value) for k in node.keywords if k.arg}

    def text_method(self, text: str, attr: str, args: list[object], named: dict[str, object]) -> object:
        if attr == "format":
            count = iter(range(len(args)))
            numbered = re.sub(r"\{\}", lambda m: "{" + str(next(count, "")) + "}", text)
            values = {str(i): a for i, a in enumerate(args)} | named
            return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]) if isinstance(values.get(m[1]), str | int | float) else m[0], numbered)
        if attr in ("lower", "upper", "strip", "split", "replace", "lstrip", "rstrip") and all(isinstance(a, str) for a in args):
            return getattr(text, attr)(*args)
        if attr == "join" and args and isinstance(args[0], list) and all(isinstance(a, str) for a in args[0]):
            return text.join(args[0])
        return None

    def free_call(self, node: ast.Call, name: str, args: list[object], named: dict[str, object]) -> object:
        """A call of something that is not the script's own."""
        last = name.rsplit(".", 1)[-1]
        text = next((a for a in args if isinstance(a, str)), "")
        if last in ("sql", "executeUpdate", "executeQuery", "execute", "read_sql", "read_sql_query") and text:
            return self.sql(node, last, text)
        if last == "table" and text:
            return self.frame(node, last, f"SELECT * FROM {text}", [], None, name=text, format="table")
        if last in ("read_ndw", "write_ndw"):
            asset = ".".join(str(named[k]) for k in ("database", "table") if isinstance(named.get(k), str)) or text
            if last == "read_ndw":
                return self.frame(node, last, f"SELECT * FROM {asset}", [], None, name=asset, format="table")
            frame = next((a for a in (named.get("dataframe"), *args) if isinstance(a, Frame)), None)
            self.row("write", node.lineno, name=asset, method=last, format="table", inputs=[frame.step] if frame else [])
            return None
        if re.fullmatch(r"(pd|pandas)\.read_\w+", name) and text:
            return self.frame(node, last, f"SELECT * FROM {path_asset(text)}", [], None, name=text, format=last[5:])
        if re.fullmatch(r"(\w+\.)*(requests|session)\.(get|post|put|delete)", name) and text:
            return self.frame(node, last, f"SELECT * FROM {path_asset(text)}", [], None, name=text, format="http")
        if last == "createDataFrame":
            schema = next((a for a in (named.get("schema"), *args[1:]) if isinstance(a, list | str)), None)
            columns = [c.split()[0] for c in schema.split(",")] if isinstance(schema, str) else [c for c in schema or [] if isinstance(c, str)] or None
            return self.frame(node, last, "SELECT " + (", ".join(f"NULL AS {c}" for c in columns) if columns else "*"), [], columns)
        made = self.function(last, args)
        if made is None:
            self.row("call", node.lineno, name=name, method=last, args=[self.shown(a) for a in args])
        return made

    def function(self, name: str, args: list[object]) -> Column | None:
        """A column function, or nothing if the arguments are none of columns."""
        if name in ("col", "column") and args:
            return Column(str(args[0]))
        if name == "lit" and args:
            return Column(self.literal(args[0]))
        if name == "expr" and args:
            return Column(str(args[0]))
        if name == "when" and len(args) == 2:
            return Column(f"CASE WHEN {args[0].text if isinstance(args[0], Column) else '?'} THEN {self.operand(args[1])} END")
        if name in ("desc", "asc") and args:
            return Column(f"{self.columns(args)[0].text} {name.upper()}")
        if re.fullmatch(r"[a-z]\w*", name) and (name in KNOWN_FUNCTIONS or any(isinstance(a, Column) for a in args)):
            return Column(f"{name}({', '.join(a.text if isinstance(a, Column) else str(a) for a in args)})")
        return None

    def sql(self, node: ast.Call, method: str, text: str) -> Frame | None:
        kind, rule, _, found = clauses.read(text)
        if kind == "select":
            rows = [dict(zip(clauses.CLAUSE, r, strict=True)) for r in found]
            main = next((r["child"] for r in rows if r["clause"] == "query"), None)
            columns = [r["name"] for r in rows if r["clause"] == "item" and r["parent"] == main and not r["branch"]]
            known = rule is None and columns and not any("*" in c or not re.fullmatch(r"\w+", c) for c in columns)
            return self.frame(node, method, text.strip().rstrip(";"), [], columns if known else None, format="sql")
        self.row("sql", node.lineno, method=method, sql=text.strip())
        return None

    # --- frames ---

    def listed(self, columns: list[str] | None) -> str:
        return ", ".join(columns) if columns else "*"

    def frame_method(self, node: ast.Call, f: Frame, attr: str, args: list[object], named: dict[str, object]) -> object:
        step = lambda sql, columns, *others: self.frame(node, attr, sql, [f, *others], columns)
        if attr in ("select", "selectExpr"):
            cols = self.columns(args)
            names = [c.output() if attr == "select" else (re.split(r"(?i)\s+as\s+", c.text)[-1]).strip() for c in cols]
            return step(f"SELECT {', '.join(c.named() for c in cols)} FROM @0", None if any("*" in n for n in names) else names)
        if attr == "withColumn" and len(args) == 2:
            text = args[1].text if isinstance(args[1], Column) else self.literal(args[1])
            kept = [c for c in f.columns if c != args[0]] if f.columns else None
            return step(f"SELECT {self.listed(kept)}, {text} AS {args[0]} FROM @0", [*kept, str(args[0])] if kept is not None else None)
        if attr == "withColumnRenamed" and len(args) == 2:
            names = [str(args[1]) if c == args[0] else c for c in f.columns] if f.columns else None
            shown = ", ".join(f"{c} AS {args[1]}" if c == args[0] else c for c in f.columns) if f.columns else f"*, {args[0]} AS {args[1]}"
            return step(f"SELECT {shown} FROM @0", names)
        if attr == "drop":
            gone = {c.output() for c in self.columns(args)}
            kept = [c for c in f.columns if c not in gone] if f.columns else None
            return step(f"SELECT {self.listed(kept)} FROM @0", kept)
        if attr in ("filter", "where") and args:
            return step(f"SELECT {self.listed(f.columns)} FROM @0 WHERE {self.columns(args)[0].text}", f.columns)
        if attr in ("distinct", "dropDuplicates"):
            return step(f"SELECT DISTINCT {self.listed(f.columns)} FROM @0", f.columns)
        if attr in ("orderBy", "sort"):
            return step(f"SELECT {self.listed(f.columns)} FROM @0 ORDER BY {', '.join(c.text for c in self.columns(args))}", f.columns)
        if attr == "limit" and args:
            return step(f"SELECT {self.listed(f.columns)} FROM @0 LIMIT {args[0]}", f.columns)
        if attr in ("union", "unionAll", "unionByName") and args and isinstance(args[0], Frame):
            other = args[0].columns if attr != "unionByName" else f.columns or args[0].columns
            return step(f"SELECT {self.listed(f.columns)} FROM @0 UNION ALL SELECT {self.listed(other)} FROM @1", f.columns, args[0])
        if attr in ("join", "crossJoin") and args and isinstance(args[0], Frame):
            return self.join(node, f, args[0], args[1] if len(args) > 1 else named.get("on"), args[2] if len(args) > 2 else named.get("how"))
        if attr in ("groupBy", "groupby"):
            return Grouped(f, self.columns(args))
        if attr == "agg":
            return self.aggregate(node, Grouped(f, []), attr, args)
        if attr in ("createOrReplaceTempView", "createTempView", "createOrReplaceGlobalTempView", "registerTempTable") and args:
            self.row("write", node.lineno, name="#" + str(args[0]), method=attr, format="view", inputs=[f.step])
            return None
        if attr in PANDAS_WRITES and args:
            self.row("write", node.lineno, name=str(args[0]), method=attr, format=attr[3:], inputs=[f.step])
            return None
        self.row("call", node.lineno, name=attr, method=attr, args=[self.shown(a) for a in args], inputs=[f.step])
        return None if attr in ("count", "collect", "show", "take", "head", "first", "printSchema", "isEmpty") else f

    def join(self, node: ast.Call, f: Frame, other: Frame, on: object, how: object) -> Frame:
        word = {"left": "LEFT ", "leftouter": "LEFT ", "right": "RIGHT ", "rightouter": "RIGHT ", "outer": "FULL ", "full": "FULL ", "fullouter": "FULL ", "left_semi": "LEFT SEMI ", "leftsemi": "LEFT SEMI ", "left_anti": "LEFT ANTI ", "leftanti": "LEFT ANTI "}.get(str(how).replace("_outer", ""), "")
        keys = [c.text for c in self.columns([on])] if isinstance(on, str | list) and not any(isinstance(c, Column) for c in (on if isinstance(on, list) else [])) else []
        if keys:
            rest = [c for c in other.columns if c not in keys] if other.columns else None
            columns = f.columns if "SEMI" in word or "ANTI" in word else f.columns + rest if f.columns and rest is not None else None
            return self.frame(node, "join", f"SELECT {self.listed(columns)} FROM @0 {word}JOIN @1 USING ({', '.join(keys)})", [f, other], columns)
        condition = on.text if isinstance(on, Column) else " AND ".join(c.text for c in on) if isinstance(on, list) else ""
        return self.frame(node, "join", f"SELECT * FROM @0 AS l {word if condition else 'CROSS '}JOIN @1 AS r" + (f" ON {condition}" if condition else ""), [f, other], None)

    def aggregate(self, node: ast.Call, g: Grouped, attr: str, args: list[object]) -> Frame | None:
        if attr == "agg" and args and isinstance(args[0], dict):
            made = [Column(f"{v}({k})", f"{v}_{k}") for k, v in args[0].items()]
        elif attr == "agg":
            made = self.columns(args)
        elif attr == "count":
            made = [Column("count(*)", "count")]
        elif attr in ("sum", "avg", "mean", "min", "max"):
            made = [Column(f"{attr}({c.text})", f"{attr}_{c.output()}") for c in self.columns(args)]
        else:
            return g.frame
        by = f" GROUP BY {', '.join(c.text for c in g.keys)}" if g.keys else ""
        return self.frame(node, attr, f"SELECT {', '.join(c.named() for c in [*g.keys, *made])} FROM @0{by}", [g.frame], [c.output() for c in [*g.keys, *made]])

    def column_method(self, c: Column, attr: str, args: list[object]) -> Column:
        first = args[0] if args else None
        if attr in ("alias", "name"):
            return Column(c.text, str(first))
        if attr in ("cast", "astype"):
            return Column(f"CAST({c.text} AS {first if isinstance(first, str) else '?'})")
        if attr == "otherwise":
            return Column(c.text.removesuffix(" END") + f" ELSE {self.operand(first)} END")
        if attr == "when" and len(args) == 2:
            return Column(c.text.removesuffix(" END") + f" WHEN {first.text if isinstance(first, Column) else '?'} THEN {self.operand(args[1])} END")
        if attr in ("isNull", "isNotNull"):
            return Column(f"{self.operand(c)} IS {'NOT ' if attr == 'isNotNull' else ''}NULL")
        if attr == "isin":
            return Column(f"{self.operand(c)} IN ({', '.join(self.literal(a) for a in (first if isinstance(first, list) else args))})")
        if attr == "between" and len(args) == 2:
            return Column(f"{self.operand(c)} BETWEEN {self.operand(first)} AND {self.operand(args[1])}")
        if attr in ("like", "rlike"):
            return Column(f"{self.operand(c)} {attr.upper()} {self.operand(first)}")
        if attr in ("desc", "asc"):
            return Column(f"{c.text} {attr.upper()}")
        if attr == "over" and isinstance(first, Window):
            parts = [f"{word} {', '.join(x.text for x in first.parts[k])}" for k, word in (("partitionBy", "PARTITION BY"), ("orderBy", "ORDER BY")) if k in first.parts]
            return Column(f"{c.text} OVER ({' '.join(parts)})")
        return Column(f"{attr}({', '.join([c.text, *(self.operand(a) for a in args)])})")

    def access_method(self, node: ast.Call, a: Access, attr: str, args: list[object], named: dict[str, object]) -> object:
        first = args[0] if args else named.get("path", named.get("name", named.get("table")))
        if attr == "format":
            return Access(a.frame, str(first), a.options)
        if attr in ("option", "options"):
            given = {str(args[0]): self.shown(args[1])} if len(args) == 2 else {k: self.shown(v) for k, v in named.items()}
            return Access(a.frame, a.format, a.options | given)
        if a.frame is None and attr in READS:
            kind = a.format or ("parquet" if attr == "load" else attr)
            asset = str(first) if isinstance(first, str) else a.options.get("dbtable") or a.options.get("path") or a.options.get("subscribe") or ""
            if a.options.get("query"):
                return self.sql(node, attr, a.options["query"])
            shown = asset if kind in ("table", "jdbc") or attr == "table" else path_asset(asset)
            return self.frame(node, attr, f"SELECT * FROM {shown or '{source}'}", [], None, name=asset, format=kind, options=a.options)
        if a.frame is not None and attr in WRITES:
            kind = "table" if attr in ("saveAsTable", "insertInto", "toTable") else a.format or ("parquet" if attr == "save" else attr)
            self.row("write", node.lineno, name=str(first) if isinstance(first, str) else "", method=attr, format=kind, options=a.options, inputs=[a.frame.step])
            return None
        return Access(a.frame, a.format, a.options)


#: Functions of column names whose arguments may all be plain text.
KNOWN_FUNCTIONS = frozenset(
    "sum avg mean min max count first last countDistinct collect_list collect_set upper lower trim ltrim rtrim length concat coalesce abs round floor ceil "
    "year month dayofmonth to_date date_add date_sub datediff add_months last_day substring current_date current_timestamp row_number rank dense_rank".split()
)


def path_asset(path: str) -> str:
    """A path as an asset: in double quotes, dots as underscores, slashes as they are."""
    return '"' + path.replace(".", "_").replace('"', "") + '"' if path else ""


PLAIN = ("table", "jdbc", "http", "csv", "parquet", "json", "orc", "text", "excel", "delta", "avro")


def follow(code: str) -> list[tuple]:
    """Rows of STEP of one script. Raises SyntaxError.

    A frame that only reads a table or path is no CTE: its readers name the asset itself.
    """
    rows = Follower(ast.parse(code)).named_rows()
    frames = {r["step"]: r for r in rows if r["what"] == "frame"}
    shown: dict[int, str] = {}
    for r in frames.values():
        plain = not r["inputs"] and r["format"] in PLAIN
        r["sql"] = re.sub(r"@(\d)", lambda m, r=r: shown[r["inputs"][int(m[1])]], r["sql"]) if r["inputs"] else r["sql"]
        shown[r["step"]] = r["sql"].removeprefix("SELECT * FROM ") if plain else r["cte"]
        r["uses"] = sorted({u for i in r["inputs"] for u in frames[i]["uses"]} | (set() if plain else {r["step"]}))
    for r in rows:
        if r["what"] == "write":
            last = frames[r["inputs"][0]] if r["inputs"] else None
            r["uses"] = last["uses"] if last else []
            r["cte"] = shown[last["step"]] if last else ""
            r["sql"] = last["listed"] if last else ""
    return [tuple(r[c] for c in STEP) for r in rows]
