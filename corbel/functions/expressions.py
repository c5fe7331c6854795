"""Arithmetic expression strings as Columns, and the null, clip and bin helpers every operator shares."""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corbel.errors import ExpressionSyntaxError, MissingVariableError, UnsafeExpressionError

#: Numbers that stand for a missing value.
SENTINELS = (-999, -9998, -9996)

_BINARY: dict[type, Callable] = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide}


def parse(expression: str) -> ast.expr:
    """The expression's tree, if it holds only numbers, names, + - * / and signs."""
    if not isinstance(expression, str) or not expression.strip():
        raise ExpressionSyntaxError("an expression is a non-empty string")
    try:
        tree = ast.parse(expression.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError) as e:
        raise ExpressionSyntaxError(f"cannot parse {expression!r}: {e}") from e
    for node in ast.walk(tree):
        ok = isinstance(node, (ast.BinOp, ast.UnaryOp, ast.Name, ast.Load, ast.UAdd, ast.USub, *_BINARY))
        if isinstance(node, ast.Constant):
            ok = type(node.value) in (int, float)
        if not ok:
            raise UnsafeExpressionError(f"{type(node).__name__} is not allowed in {expression!r}")
    return tree


def variables(expression: str) -> list[str]:
    """Names in the order in which they first stand in the expression."""
    names = [n for n in ast.walk(parse(expression)) if isinstance(n, ast.Name)]
    return list(dict.fromkeys(n.id for n in sorted(names, key=lambda n: (n.lineno, n.col_offset))))


def number(column: Column | str) -> Column:
    """As double; NULL for what is no number, and for NaN."""
    c = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(~F.isnan(c), c)


def compile_expression(expression: str, columns: Sequence[str], fill: float | None = None) -> Column:
    """A Column for the expression.  NULL, NaN and division by zero give NULL; ``fill`` replaces missing inputs."""
    tree = parse(expression)
    if missing := [v for v in variables(expression) if v not in columns]:
        raise MissingVariableError(missing)

    def build(node: ast.expr) -> Column:
        if isinstance(node, ast.Constant):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            c = number(F.col(f"`{node.id}`"))
            return c if fill is None else F.coalesce(c, F.lit(float(fill)))
        if isinstance(node, ast.UnaryOp):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        return _BINARY[type(node.op)](build(node.left), build(node.right))

    out = build(tree)
    return F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)


def evaluate(expression: str, row: Mapping[str, object], fill: float | None = None) -> float | None:
    """The same for one row of values, without Spark."""
    tree = parse(expression)
    if missing := [v for v in variables(expression) if v not in row]:
        raise MissingVariableError(missing)

    def value(x: object) -> float | None:
        try:
            v = float(x)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            v = None
        return fill if v is None or v != v else v

    def run(node: ast.expr) -> float | None:
        if isinstance(node, ast.Constant):
            return float(node.value)
        if isinstance(node, ast.Name):
            return value(row[node.id])
        if isinstance(node, ast.UnaryOp):
            v = run(node.operand)
            return v if v is None or isinstance(node.op, ast.UAdd) else -v
        a, b = run(node.left), run(node.right)
        if a is None or b is None or isinstance(node.op, ast.Div) and b == 0:
            return None
        return a / b if isinstance(node.op, ast.Div) else _BINARY[type(node.op)](a, b)

    out = run(tree)
    return out if out is not None and abs(out) != float("inf") and out == out else None


def derive(df: DataFrame, expressions: Mapping[str, str] | Sequence, fill: float | None = None) -> DataFrame:
    """``df`` with a column for each (target, expression); expressions see the columns of ``df`` only."""
    pairs = list(expressions.items()) if isinstance(expressions, Mapping) else [(e["target_col"], e["expression"]) if isinstance(e, Mapping) else tuple(e) for e in expressions]
    names = [t for t, _ in pairs]
    if taken := [t for t in names if t in df.columns or names.count(t) > 1]:
        raise ValueError(f"targets collide: {sorted(set(taken))}")
    return df.withColumns({t: compile_expression(e, df.columns, fill) for t, e in pairs})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def without_sentinels(df: DataFrame, sentinels: Sequence[float] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL for sentinel values, and for NaN, in numeric columns."""
    marks = SENTINELS if sentinels is None else tuple(sentinels)

    def clean(name: str) -> Column:
        c = F.col(f"`{name}`")
        ok = ~F.isnan(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else F.lit(True)
        return F.when(ok & ~c.isin(*marks) if marks else ok, c)

    return df.withColumns({n: clean(n) for n in (columns or numeric_columns(df)) if n in numeric_columns(df)})


def clip(column: Column, low: float | None, high: float | None) -> Column:
    """Bounds applied where the value is not NULL."""
    out = column if low is None else F.greatest(column, F.lit(float(low)))
    out = out if high is None else F.least(out, F.lit(float(high)))
    return F.when(column.isNotNull(), out)


def bin_index(column: Column, edges: Sequence[float] | Column, closed: str) -> Column:
    """The bin of a value among ascending ``edges``; NULL for NULL and for values outside.

    ``closed`` names one of the interval rules: ``right`` is (a, b] with the first bin closed at both ends; ``left`` is
    [a, b) with the last bin closed at both ends; ``open`` counts the inner edges that are not above the value, so
    outer edges do not matter.  NULL edges stand for minus and plus infinity.
    """
    if isinstance(edges, Column):
        count = lambda cond: F.size(F.filter(edges, cond))
        first, last, n = F.element_at(edges, 1), F.element_at(edges, -1), F.size(edges)
        if closed == "open":
            return F.when(column.isNotNull(), count(lambda e: e <= column))
        if closed == "right":
            k = F.greatest(count(lambda e: e < column) - 1, F.lit(0))
        else:
            k = F.least(count(lambda e: e <= column) - 1, n - 2)
        return F.when((column >= first) & (column <= last), k)
    inf = float("inf")
    known = [(-inf if i == 0 else inf) if e is None else float(e) for i, e in enumerate(edges)]
    if closed == "open":
        steps = [(e, k) for k, e in enumerate(known)]
        out = F.lit(len(known))
        for e, k in reversed(steps):
            out = F.when(column < e, k).otherwise(out)
        return F.when(column.isNotNull(), out)
    out = F.lit(None).cast("int")
    for k in range(len(known) - 2, -1, -1):
        lo, hi = known[k], known[k + 1]
        upper = column <= hi if closed == "right" or k == len(known) - 2 else column < hi
        lower = column > lo if closed == "right" and k else column >= lo
        out = F.when(lower & upper, k).otherwise(out)
    return F.when(column.isNotNull(), out)


def lookup(column: Column, mapping: Mapping) -> Column:
    """The value for a key, NULL for an unknown one."""
    if not mapping:
        return F.lit(None).cast("double")
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(table, column)


def bin_labels(edges: Sequence[float | None]) -> list[str]:
    """(-inf, x], (a, b], (a, inf) with four decimals; None is an infinite edge."""
    inner = [f"{e:.4f}" for e in edges[1:-1]]
    if not inner:
        return ["(-inf, inf)"]
    return [f"(-inf, {inner[0]}]", *[f"({a}, {b}]" for a, b in zip(inner, inner[1:], strict=False)], f"({inner[-1]}, inf)"]
