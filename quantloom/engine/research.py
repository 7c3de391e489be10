"""Research frames: feeds of several kinds on one panel, screens, classifiers, and factors over them.

Feeds hold values by date and code, by date alone (macro series), or by code alone (static
data). All become columns ``feed__column`` of one panel; screens and factors are expressions over
these, or functions that get the frame and return one. Nothing runs before the result is used.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.dsl import call
from quantloom.functions.expr import Expr, Frame, as_expr, col, lower
from quantloom.operators import align


@dataclass(frozen=True)
class Feed:
    name: str
    frame: DataFrame
    kind: str = "price"
    #: Sessions after its date from which a value is known.
    lag: int = 0
    #: Whether a value holds until the next one.
    fill: bool = False

    @property
    def has_date(self) -> bool:
        return "date_" in self.frame.columns

    @property
    def has_code(self) -> bool:
        return "code" in self.frame.columns

    @property
    def values(self) -> list[str]:
        return [c for c in self.frame.columns if c not in ("date_", "code")]

    def named(self) -> DataFrame:
        keys = [k for k in ("date_", "code") if k in self.frame.columns]
        return self.frame.select(*keys, *(F.col(c).alias(f"{self.name}__{c}") for c in self.values))


Maker = Callable[["Research"], Expr]


@dataclass(frozen=True)
class Research:
    """Immutable: every method returns a new frame."""

    feeds: tuple[Feed, ...] = ()
    screens: tuple[tuple[str, Expr | Maker], ...] = ()
    classes: tuple[tuple[str, DataFrame | Expr], ...] = ()
    factors: tuple[tuple[str, Expr | Maker], ...] = ()
    start: str | None = None
    end: str | None = None
    #: "outer" takes the keys of all feeds, "inner" those that all have.
    keys: str = "outer"
    #: Whether rows that fail a screen go before factors see them, or only from the output.
    screen_first: bool = False
    frame: Frame = field(default_factory=Frame)

    # -- building

    def feed(self, name: str, df: DataFrame, *, kind: str = "price", date: str = "date_", code: str = "code", columns: list[str] | None = None, lag: int = 0, fill: bool = False) -> Research:
        if any(f.name == name for f in self.feeds):
            raise KeyError(f"there is a feed {name}")
        keys = [F.col(source).alias(key) for source, key in ((date, "date_"), (code, "code")) if source in df.columns]
        wanted = columns or [c for c in df.columns if c not in (date, code)]
        return replace(self, feeds=(*self.feeds, Feed(name, df.select(*keys, *wanted), kind, lag, fill)))

    def feed_price(self, df: DataFrame, name: str = "price", **how) -> Research:
        return self.feed(name, df, kind="price", **how)

    def feed_financial(self, df: DataFrame, name: str = "financial", *, lag: int = 1, **how) -> Research:
        """Filings: known from the session after their date on, and until the next."""
        return self.feed(name, df, kind="financial", lag=lag, fill=True, **how)

    def feed_valuation(self, df: DataFrame, name: str = "valuation", **how) -> Research:
        return self.feed(name, df, kind="valuation", fill=True, **how)

    def feed_macro(self, df: DataFrame, name: str = "macro", **how) -> Research:
        return self.feed(name, df, kind="macro", fill=True, **how)

    def feed_news(self, df: DataFrame, name: str = "news", **how) -> Research:
        return self.feed(name, df, kind="news", **how)

    def add_screen(self, name: str, screen: Expr | Maker) -> Research:
        return replace(self, screens=(*self.screens, (name, screen)))

    def add_classifier(self, name: str, labels: DataFrame | Expr) -> Research:
        """A label per row: a table by date, code or both with a column ``label``, or an expression."""
        return replace(self, classes=(*self.classes, (name, labels)))

    def add_factor(self, name: str, factor: Expr | Maker) -> Research:
        if any(n == name for n, _ in self.factors):
            raise KeyError(f"there is a factor {name}")
        return replace(self, factors=(*self.factors, (name, factor)))

    add_strategy = add_factor

    def add_factors(self, factors: dict[str, Expr | Maker]) -> Research:
        return reduce(lambda r, item: r.add_factor(*item), factors.items(), self)

    def add_definition(self, definition: Definition) -> Research:
        return self.add_factor(definition.name, lambda r: definition.expression(r))

    # -- reading

    def get(self, name: str) -> Feed:
        for f in self.feeds:
            if f.name == name:
                return f
        near = difflib.get_close_matches(name, [f.name for f in self.feeds], 1)
        raise KeyError(f"no feed {name}" + (f"; did you mean {near[0]}?" if near else ""))

    def of_kind(self, kind: str) -> tuple[Feed, ...]:
        return tuple(f for f in self.feeds if f.kind == kind)

    def column(self, feed: str, column: str) -> Expr:
        if column not in self.get(feed).values:
            raise KeyError(f"feed {feed} has no column {column}")
        return col(f"{feed}__{column}")

    def price(self, column: str = "close", feed: str = "price") -> Expr:
        return self.column(feed, column)

    def financial(self, column: str, feed: str = "financial") -> Expr:
        return self.column(feed, column)

    def valuation(self, column: str, feed: str = "valuation") -> Expr:
        return self.column(feed, column)

    def macro(self, column: str, feed: str = "macro") -> Expr:
        return self.column(feed, column)

    def news(self, column: str, feed: str = "news") -> Expr:
        return self.column(feed, column)

    def label(self, name: str) -> Expr:
        return col(f"class__{name}")

    # -- running

    def base(self) -> DataFrame:
        """The dates and codes of the panel."""
        whole = [f.frame.select("date_", "code") for f in self.feeds if f.has_date and f.has_code and not f.fill]
        if not whole:
            raise ValueError("a frame needs a feed by date and code")
        together = reduce(lambda a, b: a.intersect(b) if self.keys == "inner" else a.union(b), whole).distinct()
        if self.start:
            together = together.where(F.col("date_") >= F.lit(self.start).cast("date"))
        return together.where(F.col("date_") <= F.lit(self.end).cast("date")) if self.end else together

    def panel(self) -> DataFrame:
        """All feeds and labels on the base."""
        out = self.base()
        for f in self.feeds:
            named = f.named()
            names = [c for c in named.columns if c not in ("date_", "code")]
            if f.has_date and f.has_code:
                if f.fill:
                    out = align.asof(out, named, names, lag=f.lag)
                else:
                    out = out.join(named if not f.lag else align.lag_sessions(named, align.sessions(out), f.lag), ["date_", "code"], "left")
            elif f.has_date:
                daily = align.dedupe_last(named, ["date_"], names) if f.fill else named
                days = out.select("date_").distinct().join(daily, "date_", "full")
                so_far = Window.orderBy("date_").rowsBetween(Window.unboundedPreceding, -f.lag)  # a row per date
                days = days.select("date_", *(F.last(c, True).over(so_far).alias(c) if f.fill else F.col(c) for c in names))
                out = out.join(days, "date_", "left")
            else:
                out = out.join(named, "code", "left")
        for name, labels in self.classes:
            if isinstance(labels, DataFrame):
                keys = [k for k in ("date_", "code") if k in labels.columns]
                out = out.join(labels.select(*keys, F.col("label").alias(f"class__{name}")), keys, "left")
            else:
                keep = out.columns
                out = lower(out, {f"class__{name}": labels}, self.frame, keep)
        return out

    def _built(self, value: Expr | Maker) -> Expr:
        return as_expr(value(self) if callable(value) and not isinstance(value, Expr) else value)

    def mask(self) -> Expr | None:
        """All screens together."""
        tests = [self._built(s) for _, s in self.screens]
        return reduce(lambda a, b: a & b, tests) if tests else None

    def run(self, keep: list[str] | None = None) -> DataFrame:
        """``date_, code`` and the factors, where all screens hold."""
        panel, mask = self.panel(), self.mask()
        factors = {n: self._built(f) for n, f in self.factors}
        if mask is None:
            return lower(panel, factors, self.frame, ["date_", "code", *(keep or [])])
        test = {"__screen": call("bool", mask)}
        if self.screen_first:
            passed = lower(panel, test, self.frame, panel.columns).where("__screen = 1").drop("__screen")
            return lower(passed, factors, self.frame, ["date_", "code", *(keep or [])])
        out = lower(panel, factors | test, self.frame, ["date_", "code", *(keep or [])])
        return out.where("__screen = 1").drop("__screen")

    def codes_that_pass(self) -> DataFrame:
        """Codes that ever pass all screens."""
        panel, mask = self.panel(), self.mask()
        if mask is None:
            return panel.select("code").distinct()
        return lower(panel, {"__screen": call("bool", mask)}, self.frame).where("__screen = 1").select("code").distinct()


# -- definitions and templates ----------------------------------------------


@dataclass(frozen=True)
class Definition:
    """A factor in three steps over expressions: prepare the inputs, compute, post-process."""

    name: str
    compute: Callable[..., Expr]
    inputs: tuple[tuple[str, str], ...] = (("price", "close"),)
    prepare: Callable[[Expr], Expr] = lambda x: x
    post: Callable[[Expr], Expr] = lambda x: x
    note: str = ""

    def expression(self, r: Research) -> Expr:
        return self.post(self.compute(*(self.prepare(r.column(*i)) for i in self.inputs)))


class Registry:
    """Definitions by name."""

    def __init__(self):
        self._held: dict[str, Definition] = {}

    def register(self, definition: Definition, *, replace: bool = False) -> Definition:
        if definition.name in self._held and not replace:
            raise KeyError(f"{definition.name} is registered")
        self._held[definition.name] = definition
        return definition

    def get(self, name: str) -> Definition:
        if name not in self._held:
            near = difflib.get_close_matches(name, list(self._held), 3)
            raise KeyError(f"no definition {name}" + (f"; near: {', '.join(near)}" if near else ""))
        return self._held[name]

    def names(self) -> list[str]:
        return sorted(self._held)


def template(name: str, build: Callable[..., Callable[[Expr], Expr]], inputs: tuple[tuple[str, str], ...] = (("price", "close"),)) -> Callable[..., Definition]:
    """A factory of definitions; a variant's name has its parameters."""

    def make(**params) -> Definition:
        suffix = "".join(f"_{k}{v}" for k, v in sorted(params.items()))
        return Definition(f"{name}{suffix}", build(**params), inputs)

    return make


#: Definitions that come with the engine.
DEFINITIONS = Registry()
MOMENTUM = template("momentum", lambda n=20, skip=0: lambda x: call("momentum", x, n, skip))
VOLATILITY = template("volatility", lambda n=20: lambda x: call("volatility", x, n))
REVERSAL = template("reversal", lambda n=5: lambda x: -call("pct_change", x, n))
DISTANCE = template("distance", lambda n=250: lambda x: call("drawdown", x) if n is None else x / call("ts_max", x, n) - 1)
for _definition in (MOMENTUM(n=20), VOLATILITY(n=20), REVERSAL(n=5), DISTANCE(n=60)):
    DEFINITIONS.register(_definition)


# -- groups -----------------------------------------------------------------


def combined(rows: DataFrame, members: dict[str, float], how: str = "mean") -> DataFrame:
    """One factor from several columns of a panel, per date and code: mean, median, sum by weights, or the means of ranks or of standard scores; missing members don't count."""
    day = Window.partitionBy("date_")

    def part(name: str) -> Column:
        x = F.col(name)
        if how == "rank_mean":
            from quantloom.operators.evaluation import mean_rank

            return mean_rank(x, ("date_",)) / F.count(x).over(day)
        if how == "zscore_mean":
            sd = F.stddev_pop(x).over(day)
            return F.when(sd > 1e-9, (x - F.avg(x).over(day)) / sd)
        return x * members[name] if how == "weighted" else x

    made = rows.select("date_", "code", F.array_compact(F.array(*map(part, members))).alias("__v"))
    total = F.aggregate("__v", F.lit(0.0), lambda a, v: a + v)
    if how == "weighted":
        value = F.when(F.size("__v") > 0, total)
    elif how == "median":
        held = F.sort_array("__v")
        value = (F.get(held, F.floor((F.size(held) - 1) / 2).cast("int")) + F.get(held, F.floor(F.size(held) / 2).cast("int"))) / 2
    else:
        value = F.try_divide(total, F.size("__v"))
    return made.select("date_", "code", value.alias("value"))
