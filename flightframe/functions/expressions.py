"""User expressions over series as column expressions, with NumPy's rules for zeros, NaN and infinities.

The text is Python's arithmetic: numbers, + - * / // % **, comparisons, & | ~ of comparisons, parentheses, the functions of
FUNCTIONS (each also as np.name), and np.pi, np.e, np.nan, np.inf.  Names of series stand as they are, as in GPS.AltMSL or IMU[0].AccX
(words with dots and brackets).  It is
read by Python's own grammar, and only what is listed here becomes part of a query.  np.arctan2 takes -0.0 for 0.0.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
WHOLE = float(1 << 53)


def _number(x: float) -> Column:
    return F.lit(float(x))


def divided(a: Column, b: Column) -> Column:
    """a / b; by zero an infinity of the sign of both, or NaN."""
    return F.when(b == 0, a * F.pow(b, _number(-1))).otherwise(a / F.nullif(b, _number(0)))


def _whole(function: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A rounding function that leaves NaN, infinities and numbers without a fraction alone."""
    return lambda x: F.when(F.abs(x) < WHOLE, function(x).cast("double")).otherwise(x)


def remainder(a: Column, b: Column) -> Column:
    """With the sign of b; by zero NaN."""
    rest = a % F.nullif(b, _number(0))
    return F.when(b == 0, _number(NAN)).when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def power(a: Column, b: Column) -> Column:
    return F.when((a == 1) | (b == 0) | ((a == -1) & (F.abs(b) == INF)), _number(1)).otherwise(F.pow(a, b))


def _logarithm(base: float | None) -> Callable[[Column], Column]:
    log = F.log if base is None else (F.log10 if base == 10 else F.log2)
    return lambda x: F.when(x == 0, _number(-INF)).when(x < 0, _number(NAN)).otherwise(log(x))


def _either_nan(a: Column, b: Column, pick: Callable[[Column, Column], Column]) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), _number(NAN)).otherwise(pick(a, b))


#: Functions by name, with the number of their arguments.
FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "sqrt": (1, F.sqrt), "abs": (1, F.abs), "absolute": (1, F.abs), "fabs": (1, F.abs), "square": (1, lambda x: x * x), "cbrt": (1, F.cbrt), "sign": (1, lambda x: F.when(F.isnan(x), x).otherwise(F.signum(x))),
    "sin": (1, F.sin), "cos": (1, F.cos), "tan": (1, F.tan), "arcsin": (1, F.asin), "arccos": (1, F.acos), "arctan": (1, F.atan), "arctan2": (2, F.atan2), "sinh": (1, F.sinh), "cosh": (1, F.cosh), "tanh": (1, F.tanh),
    "exp": (1, F.exp), "log": (1, _logarithm(None)), "log2": (1, _logarithm(2)), "log10": (1, _logarithm(10)), "hypot": (2, F.hypot), "power": (2, power), "mod": (2, remainder), "remainder": (2, remainder),
    "floor": (1, _whole(F.floor)), "ceil": (1, _whole(F.ceil)), "rint": (1, _whole(F.rint)), "round": (1, _whole(F.rint)), "trunc": (1, lambda x: F.when(x < 0, _whole(F.ceil)(x)).otherwise(_whole(F.floor)(x))),
    "degrees": (1, F.degrees), "rad2deg": (1, F.degrees), "radians": (1, F.radians), "deg2rad": (1, F.radians),
    "minimum": (2, lambda a, b: _either_nan(a, b, F.least)), "maximum": (2, lambda a, b: _either_nan(a, b, F.greatest)), "clip": (3, lambda x, low, high: F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, low), high))),
    "where": (3, lambda c, a, b: F.when(c != 0, a).otherwise(b)), "isnan": (1, lambda x: F.isnan(x).cast("double")),
}
#: Functions that are known without np.
BARE = {"sqrt", "abs", "sin", "cos"}
CONSTANTS = {"pi": math.pi, "e": math.e, "nan": NAN, "inf": INF}
BINARY: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: divided, ast.FloorDiv: lambda a, b: _whole(F.floor)(divided(a, b)), ast.Mod: remainder, ast.Pow: power,
}
COMPARED: dict[type, Callable[[Column, Column], Column]] = {
    ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b,
}


def parsed(text: str) -> ast.expr:
    """The text's tree; ValueError if it is no expression."""
    try:
        return ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise ValueError(f"no expression: {text!r}") from e


def with_places(text: str, names: Sequence[str]) -> tuple[str, list[str]]:
    """The text with each name replaced by a short one, longer names first, and the names in that order."""
    order = sorted({n for n in names if n and n in text}, key=lambda n: (-len(n), n))
    pieces: list[tuple[str, int | None]] = [(text, None)]
    for k, name in enumerate(order):
        cut: list[tuple[str, int | None]] = []
        for piece, place in pieces:
            if place is not None:
                cut.append((piece, place))
                continue
            parts = piece.split(name)
            for i, part in enumerate(parts):
                cut += ([("", k)] if i else []) + [(part, None)]
        pieces = cut
    used = sorted({k for _, k in pieces if k is not None})
    number = {k: i for i, k in enumerate(used)}
    return "".join(piece if k is None else f"series_{number[k]}" for piece, k in pieces), [order[k] for k in used]


def as_column(text: str, columns: dict[str, Column]) -> Column:
    """The value of a text in which names stand for columns; ValueError for anything that is not listed above."""
    return _value(parsed(text), columns, text)


def _value(node: ast.expr, columns: dict[str, Column], text: str) -> Column:
    value = lambda n: _value(n, columns, text)
    match node:
        case ast.Constant(value=bool() | int() | float() as x):
            return _number(x)
        case ast.Name(id=name) if name in columns:
            return columns[name]
        case ast.Attribute(value=ast.Name(id="np"), attr=name) if name in CONSTANTS:
            return _number(CONSTANTS[name])
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -value(x)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return value(x)
        case ast.UnaryOp(op=ast.Invert(), operand=x) if _is_truth(x):
            return 1.0 - value(x)
        case ast.BinOp(left=a, op=ast.BitAnd(), right=b) if _is_truth(a) and _is_truth(b):
            return value(a) * value(b)
        case ast.BinOp(left=a, op=ast.BitOr(), right=b) if _is_truth(a) and _is_truth(b):
            return F.greatest(value(a), value(b))
        case ast.BinOp(left=a, op=op, right=b) if type(op) in BINARY:
            return BINARY[type(op)](value(a), value(b))
        case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in COMPARED:
            x, y = value(a), value(b)
            # NaN is unequal to all, itself too
            return F.when(F.isnan(x) | F.isnan(y), _number(isinstance(op, ast.NotEq))).otherwise(COMPARED[type(op)](x, y).cast("double"))
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in BARE and len(args) == FUNCTIONS[name][0]:
            return FUNCTIONS[name][1](*map(value, args))
        case ast.Call(func=ast.Attribute(value=ast.Name(id="np"), attr=name), args=args, keywords=[]) if name in FUNCTIONS and len(args) == FUNCTIONS[name][0]:
            return FUNCTIONS[name][1](*map(value, args))
    raise ValueError(f"not known in an expression: {ast.unparse(node)!r} in {text!r}")


def _is_truth(node: ast.expr) -> bool:
    match node:
        case ast.Compare() | ast.Call(func=ast.Attribute(attr="isnan")):
            return True
        case ast.UnaryOp(op=ast.Invert(), operand=x):
            return _is_truth(x)
        case ast.BinOp(left=a, op=ast.BitAnd() | ast.BitOr(), right=b):
            return _is_truth(a) and _is_truth(b)
    return False
