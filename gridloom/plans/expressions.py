"""Band and table expressions, compiled to Spark columns.

An expression is in Python's arithmetic with quoted references: "b1", "bandset1b2", "bandset#b*", "#RED#", "#NDVI#". Text is
parsed, never evaluated, and only the operators and functions below are known. Missing values are nulls and spread through
arithmetic; division by zero and functions outside their domain give null; a comparison's result is 0 or 1.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# fixed values: centre and reach in micrometres of the spectral ranges
SPECTRAL_RANGES = {"BLUE": (0.475, 0.2), "GREEN": (0.56, 0.03), "RED": (0.65, 0.04), "NIR": (0.85, 0.15), "SWIR1": (1.61, 0.2), "SWIR2": (2.2, 0.2)}
# fixed values: index formulas over spectral ranges
INDEX_FORMULAS = {
    "NDVI": '("#NIR#" - "#RED#") / ("#NIR#" + "#RED#")',
    "EVI": '2.5 * ("#NIR#" - "#RED#") / ("#NIR#" + 6 * "#RED#" - 7.5 * "#BLUE#" + 1)',
}

Value = Column | list
_REFERENCE = re.compile(r'"([^"]*)"')


def _valid(values: list) -> Column:
    return F.filter(F.array(*values), lambda x: x.isNotNull())


def _total(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x))


def _mean(a: Column) -> Column:
    return F.try_divide(_total(a), F.size(a))


def _sorted_at(values: list, p: float) -> Column:
    """The value of nearest rank: place round-half-even((n - 1) p / 100) of the sorted values."""
    a = F.array_sort(_valid(values))
    return F.when(F.size(a) > 0, F.element_at(a, (F.rint((F.size(a) - 1) * F.lit(p) / 100) + 1).cast("int")))


def _median(values: list) -> Column:
    a = F.array_sort(_valid(values))
    n = F.size(a)
    low, high = F.element_at(a, F.floor((n + 1) / 2).cast("int")), F.element_at(a, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def _std(values: list) -> Column:
    a = _valid(values)
    return F.sqrt(_mean(F.transform(a, lambda x: (x - _mean(a)) * (x - _mean(a)))))


#: Over a list of bands, band by band in each pixel; nulls are skipped.
LIST_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "min": lambda v: F.array_min(F.array(*v)),
    "max": lambda v: F.array_max(F.array(*v)),
    "sum": lambda v: _total(_valid(v)),
    "mean": lambda v: _mean(_valid(v)),
    "median": _median,
    "std": _std,
    "percentile": _sorted_at,
}
#: Over one column: its value for the whole table, found by an aggregation before.
TABLE_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "min": F.min, "max": F.max, "sum": F.sum, "mean": F.avg, "median": F.median, "std": F.stddev_pop,
    "percentile": lambda c, p: F.percentile(c, F.lit(p / 100)),
}


def _within(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


def _double(c: Column) -> Column:
    return c.cast("double")


SCALAR_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "log": lambda x: F.ln(_double(x)), "log10": lambda x: F.log10(_double(x)), "exp": lambda x: F.exp(_double(x)),
    "sqrt": lambda x: _within(x >= 0, F.sqrt(_double(x))), "abs": F.abs, "absolute": F.abs,
    "sin": lambda x: F.sin(_double(x)), "cos": lambda x: F.cos(_double(x)), "tan": lambda x: F.tan(_double(x)),
    "arcsin": lambda x: _within(F.abs(x) <= 1, F.asin(_double(x))), "arccos": lambda x: _within(F.abs(x) <= 1, F.acos(_double(x))), "arctan": lambda x: F.atan(_double(x)),
    "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "rint": lambda x: F.rint(_double(x)),
    "isnan": lambda x: x.isNull(), "power": lambda x, y: F.pow(x, y),
    "minimum": lambda x, y: _within(x.isNotNull() & y.isNotNull(), F.least(x, y)), "maximum": lambda x, y: _within(x.isNotNull() & y.isNotNull(), F.greatest(x, y)),
    "clip": lambda x, low, high: _within(x.isNotNull(), F.greatest(low, F.least(high, x))),
    "where": lambda c, a, b: F.when(c.isNotNull(), F.when(c, a).otherwise(b)),
    "nan_to_num": lambda x: F.coalesce(x, F.lit(0.0)),
}
_CONSTANTS = {"nan": None, "pi": 3.141592653589793, "e": 2.718281828459045, "True": True, "False": False}


class Compiler:
    """Compiles expressions over references that `resolve` turns into a column or a list of columns.

    Functions of one column over the whole table are kept in `pending`, as (name, arguments); with `known` results they are
    literals. `nodata` gives a reference's NoData value.
    """

    def __init__(self, resolve: Callable[[str], Value], nodata: Callable[[str], float | None] = lambda name: None, known: dict | None = None):
        self.resolve, self.nodata, self.known = resolve, nodata, known
        self.pending: dict[str, Column] = {}

    def compile(self, text: str) -> Column:
        for name, formula in INDEX_FORMULAS.items():
            text = re.sub(f'"#{name}#"', lambda _, f=formula: f"({f})", text, flags=re.I)
        names: list[str] = []

        def hold(m: re.Match) -> str:
            names.append(m[1])
            return f"_r{len(names) - 1}"

        self.names = names
        self.flags: set[int] = set()
        tree = ast.parse(_REFERENCE.sub(hold, text).strip(), mode="eval")
        out = self.visit(tree.body)
        if isinstance(out, list):
            raise ValueError(f"a list of bands is not a value: {text}")
        return out.cast("int") if self.boolean(tree.body) else out

    def boolean(self, node: ast.AST) -> bool:
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitAnd | ast.BitOr | ast.BitXor):
            return self.boolean(node.left) or self.boolean(node.right)
        return isinstance(node, ast.Compare | ast.BoolOp) or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not | ast.Invert) and self.boolean(node.operand) or isinstance(node, ast.Call) and self.function(node) in ("isnan", "isin")

    def function(self, node: ast.Call) -> str:
        f = node.func
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in ("np", "ma", "numpy"):
            return f.attr
        if isinstance(f, ast.Name):
            return f.id
        raise ValueError("unknown call")

    def number(self, node: ast.AST) -> float:
        value = ast.literal_eval(node)
        if isinstance(value, bool) or not isinstance(value, int | float):
            raise ValueError("a number is wanted")
        return value

    def flag(self, node: ast.AST) -> Column:
        """As a condition: numbers hold if they aren't 0."""
        out = self.visit(node)
        return out if self.boolean(node) else out != 0

    def plain(self, node: ast.AST) -> Column:
        """As a number."""
        out = self.visit(node)
        if isinstance(out, list):
            raise ValueError("a list of bands is not a number")
        return out.cast("int") if self.boolean(node) else out

    def visit(self, node: ast.AST) -> Value:
        match node:
            case ast.Constant(value=v) if isinstance(v, int | float):
                return F.lit(v)
            case ast.Name(id=name) if name.startswith("_r") and name[2:].isdigit():
                return self.resolve(self.names[int(name[2:])])
            case ast.Name(id=name) if name in _CONSTANTS:
                return F.lit(_CONSTANTS[name]).cast("double") if name == "nan" else F.lit(_CONSTANTS[name])
            case ast.Attribute(value=ast.Name(id="np" | "numpy"), attr=name) if name in _CONSTANTS:
                return F.lit(_CONSTANTS[name]).cast("double")
            case ast.List(elts=items) | ast.Tuple(elts=items):
                out: list = []
                for x in items:
                    v = self.visit(x)
                    out += v if isinstance(v, list) else [v]
                return out
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -self.plain(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return self.plain(x)
            case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=x):
                return ~self.flag(x)
            case ast.BinOp(left=a, op=op, right=b):
                return self.binary(a, op, b)
            case ast.BoolOp(op=op, values=values):
                flags = [self.flag(x) for x in values]
                out = flags[0]
                for x in flags[1:]:
                    out = out & x if isinstance(op, ast.And) else out | x
                return out
            case ast.Compare(left=a, ops=ops, comparators=rest):
                return self.compare(a, ops, rest)
            case ast.Call():
                return self.call(node)
        raise ValueError(f"not part of the language: {ast.dump(node)[:80]}")

    def binary(self, a: ast.AST, op: ast.operator, b: ast.AST) -> Column:
        if isinstance(op, ast.BitAnd | ast.BitOr):
            x, y = self.flag(a), self.flag(b)
            return _within(x.isNotNull() & y.isNotNull(), x & y if isinstance(op, ast.BitAnd) else x | y)
        x, y = self.plain(a), self.plain(b)
        match op:
            case ast.Add():
                return x + y
            case ast.Sub():
                return x - y
            case ast.Mult():
                return x * y
            case ast.Div():
                return F.try_divide(_double(x), _double(y))
            case ast.FloorDiv():
                return F.floor(F.try_divide(_double(x), _double(y))).cast("double")
            case ast.Mod():
                return F.when(y != 0, x - y * F.floor(F.try_divide(_double(x), _double(y))))
            case ast.Pow():
                return F.pow(_double(x), _double(y))
        raise ValueError("unknown operator")

    def compare(self, a: ast.AST, ops: list, rest: list) -> Column:
        out, left = None, self.plain(a)
        for op, node in zip(ops, rest, strict=True):
            right = self.plain(node)
            one = {ast.Eq: left == right, ast.NotEq: left != right, ast.Lt: left < right, ast.LtE: left <= right, ast.Gt: left > right, ast.GtE: left >= right}.get(type(op))
            if one is None:
                raise ValueError("unknown comparison")
            out, left = one if out is None else out & one, right
        return out

    def call(self, node: ast.Call) -> Column:
        name, args = self.function(node), node.args
        if name == "nodata":
            ref = args[0]
            return F.lit(self.nodata(self.names[int(ref.id[2:])])).cast("double")
        if name == "isin":
            return self.plain(args[0]).isin([self.number(x) for x in args[1].elts])
        if name == "round":
            return F.round(_double(self.plain(args[0])), int(self.number(args[1])) if len(args) > 1 else 0)
        if name == "where":
            return SCALAR_FUNCTIONS["where"](self.flag(args[0]), self.plain(args[1]), self.plain(args[2]))
        if name in LIST_FUNCTIONS:
            value, rest = self.visit(args[0]), [self.number(x) for x in args[1:2]] if name == "percentile" else []
            if isinstance(value, list):
                return LIST_FUNCTIONS[name]([_double(x) for x in value], *rest)
            return self.whole(ast.dump(node), TABLE_FUNCTIONS[name](_double(value), *rest))
        if name in SCALAR_FUNCTIONS:
            return SCALAR_FUNCTIONS[name](*map(self.plain, args))
        raise ValueError(f"unknown function {name}")

    def whole(self, key: str, aggregate: Column) -> Column:
        key = f"{key}|{self.names}"
        self.pending[key] = aggregate
        return F.lit((self.known or {}).get(key)).cast("double")


def compile_over(df, expressions: list[str], resolve: Callable[[str], Value], nodata: Callable[[str], float | None] = lambda name: None) -> list[Column]:
    """Columns of the expressions over df; whole-table functions cost one aggregation, whatever their number."""
    first = Compiler(resolve, nodata)
    out = [first.compile(e) for e in expressions]
    if not first.pending:
        return out
    keys = list(first.pending)
    row = df.agg(*(first.pending[k].alias(f"g{i}") for i, k in enumerate(keys))).first()
    second = Compiler(resolve, nodata, dict(zip(keys, row, strict=True)))
    return [second.compile(e) for e in expressions]
