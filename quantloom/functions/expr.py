"""Lazy factor expressions, planned in levels.

An expression is a tree over the columns of a panel ``(date_, code, ...)``. Nothing
is computed until it is lowered. Lowering gives every windowed operator a level: one
more than the levels of what it reads. All windowed operators of a level become columns
of one ``select``, so those with the same partitioning share one shuffle and sort,
and equal subtrees are computed once.

The same tree is rendered as SQL by :mod:`quantloom.functions.render` for checks in another engine.

Missing values are null; NaN and infinities become null where they arise.
Windows count rows of a code, in the order of dates, and by default give null until
they hold as many values as they are long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW, TIME, CROSS, GROUP = "row", "time", "cross", "group"

Value = "Expr | float | int | str | bool | None"


class Expr:
    """A node: an operator's name, its operands, and its parameters."""

    __slots__ = ("op", "args", "params", "_key")

    def __init__(self, op: str, args: Iterable = (), **params):
        self.op = op
        self.args = tuple(as_expr(a) for a in args)
        self.params = tuple(sorted(params.items()))
        self._key = f"{op}({','.join(a._key for a in self.args)};{self.params})"

    def __add__(self, other):
        return Expr("add", (self, other))

    def __radd__(self, other):
        return Expr("add", (other, self))

    def __sub__(self, other):
        return Expr("sub", (self, other))

    def __rsub__(self, other):
        return Expr("sub", (other, self))

    def __mul__(self, other):
        return Expr("mul", (self, other))

    def __rmul__(self, other):
        return Expr("mul", (other, self))

    def __truediv__(self, other):
        return Expr("div", (self, other))

    def __rtruediv__(self, other):
        return Expr("div", (other, self))

    def __pow__(self, other):
        return Expr("pow", (self, other))

    def __neg__(self):
        return Expr("neg", (self,))

    def __lt__(self, other):
        return Expr("lt", (self, other))

    def __le__(self, other):
        return Expr("le", (self, other))

    def __gt__(self, other):
        return Expr("gt", (self, other))

    def __ge__(self, other):
        return Expr("ge", (self, other))

    def __eq__(self, other):
        return Expr("eq", (self, other))

    def __ne__(self, other):
        return Expr("ne", (self, other))

    def __and__(self, other):
        return Expr("and", (self, other))

    def __or__(self, other):
        return Expr("or", (self, other))

    def __invert__(self):
        return Expr("not", (self,))

    def __hash__(self):
        return hash(self._key)

    def __getattr__(self, name: str):
        """Every operator is a method too: ``x.ts_mean(5)`` is ``call("ts_mean", x, 5)``."""
        if name.startswith("_"):
            raise AttributeError(name)
        from quantloom.functions import dsl

        return lambda *args, **params: dsl.call(name, self, *args, **params)

    def __repr__(self):
        return self._key


def col(name: str) -> Expr:
    return Expr("col", name=name)


def lit(value) -> Expr:
    return Expr("lit", value=value)


def as_expr(value) -> Expr:
    return value if isinstance(value, Expr) else lit(value)


@dataclass(frozen=True)
class Op:
    """An operator: its kind, and how its column is built from operands and parameters."""

    kind: str
    build: Callable[..., Column]


OPS: dict[str, Op] = {}


def op(name: str, kind: str = ROW):
    def add(build):
        OPS[name] = Op(kind, build)
        return build

    return add


@dataclass(frozen=True)
class Frame:
    """Names of the axes, and the window specifications over them."""

    date: str = "date_"
    code: str = "code"
    group: str = "industry"
    #: Columns of other classes of codes, by the class's name in formulas; a class without one takes the group's.
    classes: tuple[tuple[str, str], ...] = ()
    _unbounded: int = field(default=Window.unboundedPreceding, repr=False)

    @property
    def time(self):
        return Window.partitionBy(self.code).orderBy(self.date)

    def rows(self, n: int | None):
        return self.time.rowsBetween(self._unbounded if n is None else -(n - 1), 0)

    def ahead(self, n: int | None):
        return self.time.rowsBetween(0, Window.unboundedFollowing if n is None else n)

    @property
    def all_time(self):
        return Window.partitionBy(self.code)

    @property
    def cross(self):
        return Window.partitionBy(self.date)

    @property
    def in_group(self):
        return Window.partitionBy(self.date, self.group)

    def group_of(self, by: str | None):
        return Window.partitionBy(self.date, dict(self.classes).get(by, self.group))

    @property
    def whole_group(self):
        return Window.partitionBy(self.group)


def level(expr: Expr, memo: dict[str, int]) -> int:
    """Windowed operators between a node and the scan, at most, the node included."""
    known = memo.get(expr._key)
    if known is None:
        below = max((level(a, memo) for a in expr.args), default=0)
        known = memo[expr._key] = below + (kind_of(expr) != ROW)
    return known


def kind_of(expr: Expr) -> str:
    return ROW if expr.op in ("col", "lit") else OPS[expr.op].kind


def windowed(exprs: Iterable[Expr]) -> list[list[Expr]]:
    """Distinct windowed nodes of the trees by level."""
    memo: dict[str, int] = {}
    levels: list[dict[str, Expr]] = []
    todo = list(exprs)
    seen: set[str] = set()
    while todo:
        e = todo.pop()
        if e._key in seen:
            continue
        seen.add(e._key)
        todo.extend(e.args)
        if kind_of(e) != ROW:
            n = level(e, memo)
            while len(levels) < n:
                levels.append({})
            levels[n - 1][e._key] = e
    return [[stage[k] for k in sorted(stage)] for stage in levels]


def lower(panel: DataFrame, factors: dict[str, Expr], frame: Frame | None = None, keep: Iterable[str] | None = None) -> DataFrame:
    """The panel's keys and the factors, as one plan."""
    frame = frame or Frame()
    names: dict[str, str] = {}

    def column(e: Expr) -> Column:
        if e._key in names:
            return F.col(names[e._key])
        params = dict(e.params)
        if e.op == "col":
            return F.col(params["name"])
        if e.op == "lit":
            return F.lit(params["value"])
        return OPS[e.op].build(frame, *(column(a) for a in e.args), **params)

    out = panel
    for stage in windowed(factors.values()):
        made = {f"__w{len(names) + i}": e for i, e in enumerate(stage)}
        out = out.select("*", *(column(e).alias(n) for n, e in made.items()))
        names |= {e._key: n for n, e in made.items()}
    kept = list(keep) if keep is not None else [frame.date, frame.code]
    return out.select(*kept, *(column(e).alias(n) for n, e in factors.items()))
