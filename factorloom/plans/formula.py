"""Factor formulas: text to a tree, and trees to stages of one DataFrame plan."""

from __future__ import annotations

import inspect
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import indicators
from ..functions import panel_ops as ops
from ..functions.library import LIBRARY
from ..functions.panel_ops import Keys
from ..functions.scans import AHEAD_SCANS, SCAN_COLUMNS, SCANS


@dataclass(frozen=True)
class Node:
    """A node of a formula: kind num, str, name, op or call."""

    kind: str
    value: object
    args: tuple[Node, ...] = ()
    named: tuple[tuple[str, Node], ...] = field(default=())

    def __str__(self) -> str:
        if self.kind in ("num", "str", "name"):
            return str(self.value)
        inside = [*map(str, self.args), *(f"{k}={v}" for k, v in self.named)]
        return f"{self.value}({', '.join(inside)})"


TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|([A-Za-z_]\w*)|('[^']*'|\"[^\"]*\")|(\*\*|<=|>=|==|!=|[-+*/<>?:(),=]))")
LEVELS = (("<", ">", "<=", ">=", "==", "!="), ("+", "-"), ("*", "/"))


class Parser:
    """Recursive descent: ternary, comparison, sum, product, sign, power, call."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read the formula at: {text[at:]!r}")
            kind = ("num", "name", "str", "op")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        i = self.at + ahead
        return self.tokens[i][1] if i < len(self.tokens) and self.tokens[i][0] != "str" else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or want and self.peek() != want:
            raise ValueError(f"expected {want or 'more'} at token {self.at}")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self) -> Node:
        out = self.ternary()
        if self.at != len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def ternary(self) -> Node:
        c = self.level(0)
        if self.peek() != "?":
            return c
        self.take()
        x = self.ternary()
        self.take(":")
        return Node("call", "where", (c, x, self.ternary()))

    def level(self, i: int) -> Node:
        if i == len(LEVELS):
            return self.sign()
        out = self.level(i + 1)
        while self.peek() in LEVELS[i]:
            op = self.take()[1]
            out = Node("op", op, (out, self.level(i + 1)))
        return out

    def sign(self) -> Node:
        if self.peek() in ("-", "+"):
            op = self.take()[1]
            x = self.sign()
            return x if op == "+" else Node("num", -x.value) if x.kind == "num" else Node("op", "neg", (x,))
        base = self.atom()
        if self.peek() == "**":
            self.take()
            return Node("call", "power", (base, self.sign()))
        return base

    def atom(self) -> Node:
        kind, t = self.take()
        if kind == "num":
            return Node("num", float(t) if re.search(r"[.eE]", t) else int(t))
        if kind == "str":
            return Node("str", t[1:-1])
        if t == "(":
            x = self.ternary()
            self.take(")")
            return x
        if kind != "name":
            raise ValueError(f"unexpected {t!r}")
        if t in ("True", "False"):
            return Node("num", t == "True")
        if self.peek() != "(":
            return Node("name", t)
        self.take()
        args, named = [], []
        while self.peek() != ")":
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" and self.peek(1) == "=":
                k = self.take()[1]
                self.take("=")
                named.append((k, self.ternary()))
            else:
                args.append(self.ternary())
            if self.peek() != ")":
                self.take(",")
        self.take(")")
        return Node("call", t.lower(), tuple(args), tuple(named))


#: Element-wise functions of Columns.
ELEMENT: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "sqrt": ops.sqrt, "exp": lambda x: ops.clean(F.exp(x)), "log": ops.log, "power": ops.power, "signedpower": ops.signedpower, "sign": F.signum,
    "add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": ops.div, "neg": lambda x: -x,
    "lt": partial(ops.compare, "<"), "gt": partial(ops.compare, ">"), "lte": partial(ops.compare, "<="), "gte": partial(ops.compare, ">="), "eq": partial(ops.compare, "=="), "ne": partial(ops.compare, "!="),
    "where": lambda c, x, y: F.when(c, x).otherwise(y), "if_else": lambda c, x, y: F.when(c, x).otherwise(y), "fillna": lambda x, v: F.coalesce(x, v), "copy": lambda x: x, "max": F.greatest, "min": F.least,
    "floor": lambda x: F.floor(x).cast("double"), "only_if": lambda c, x: F.when(c, x), "exists": lambda x: x.isNotNull(), "normal_cdf": ops.normal_cdf,
}
#: Functions over windows, and how many of their first arguments are panel values.
WINDOWED: dict[str, tuple[int, Callable[..., Column]]] = {
    **{n: (1, getattr(ops, n)) for n in ("delay", "delta", "pct_change", "ffill", "bfill", "ts_sum", "ts_prod", "ts_min", "ts_max", "ts_mean", "ts_stddev", "ts_rank", "ts_argmax", "ts_cumsum_agg", "num_gt_mean", "num_lt_mean", "upper_center_squared_sum", "lower_center_squared_sum", "block_agg", "cs_rank", "cs_median", "cs_row", "cs_count", "cs_max", "cs_min", "normalize", "standardize", "clip_mad", "winsorize_quantile")},
    **{n: (2, getattr(ops, n)) for n in ("ts_cov", "ts_corr", "ts_linreg", "cs_linreg", "cs_mean", "cs_mean_by_industry", "industry_neutralize")},
    **{n: (i + 1, getattr(indicators, n)) for i, ns in enumerate((indicators.ONE, indicators.TWO, indicators.THREE)) for n in ns},
}
ALIASES = {"rank": "cs_rank", "stddev": "ts_stddev", "shift": "delay", "diff": "delta", "clip": "clip_mad", "winsorize": "winsorize_quantile", "std": "ts_stddev", "correlation": "ts_corr", "covariance": "ts_cov"}
COMPARISONS = LEVELS[0]
#: Cross-section forms that take several levels, as formulas of x and their constants.
MACROS = {
    "clip_mad": "only_if(exists(X), cs_median(abs(X - cs_median(X))) < 1e-6 ? X : max(min(X, cs_median(X) + 1.4826 * A * cs_median(abs(X - cs_median(X)))), cs_median(X) - 1.4826 * A * cs_median(abs(X - cs_median(X)))))",
    "winsorize_quantile": "only_if(exists(X), max(min(X, cs_max(only_if(cs_row(X) == cs_count(X) - floor(B * cs_count(X)), X))), cs_max(only_if(cs_row(X) == floor(A * cs_count(X)) + 1, X))))",
}
MACRO_DEFAULTS = {"clip_mad": (3.0, 0.0), "winsorize_quantile": (0.1, 0.1)}


def substitute(node: Node, put: dict[str, Node]) -> Node:
    """A formula with its parameters put in; operations on constants are worked out."""
    if node.kind == "name" and node.value in put:
        return put[node.value]
    args = tuple(substitute(a, put) for a in node.args)
    if node.kind == "op" and all(a.kind == "num" for a in args) and node.value in ("+", "-", "*", "/"):
        x, y = (a.value for a in args)
        v = {"+": x + y, "-": x - y, "*": x * y}[node.value] if node.value != "/" else x / y
        return Node("num", int(v) if float(v).is_integer() else v)
    if node.kind == "call" and node.value in ("floor", "sqrt") and len(args) == 1 and args[0].kind == "num":
        v = math.sqrt(args[0].value) if node.value == "sqrt" else math.floor(args[0].value)
        return Node("num", int(v) if float(v).is_integer() else v)
    return Node(node.kind, node.value, args, tuple((k, substitute(v, put)) for k, v in node.named))


def expand(node: Node) -> Node:
    """A call of a library indicator or cross-section macro as its formula; other nodes as they are."""
    name = ALIASES.get(str(node.value), str(node.value)) if node.kind == "call" else ""
    named = dict(node.named)
    if name in LIBRARY:
        params, text = LIBRARY[name]
        put = {}
        for i, (p, default) in enumerate(params):
            given = node.args[i] if i < len(node.args) else named.get(p.lower())
            if given is None and default is None:
                raise ValueError(f"{name} needs {p}")
            put[p] = Node("num", default) if given is None else given
        return substitute(parse(text), put)
    if name not in MACROS or "window" in named or "expanding" in named or not named.get("cross_section", Node("num", True)).value:
        return node
    consts = [*node.args[1:], *(Node("num", v) for v in MACRO_DEFAULTS[name][len(node.args) - 1 :])]
    put = {"X": node.args[0], "A": consts[0], "B": consts[-1]}
    return substitute(parse(MACROS[name]), put)


def parse(text: str) -> Node:
    """The tree of a formula. Names are columns; functions are those of the registries above, in any case."""
    return Parser(text).parse()


#: History of functions that carry a state or see all rows so far.
UNBOUNDED = 1 << 30
_PAST = ("ffill", "cumulative", "expanding_max", "expanding_min", "drawdown", "expanding_mean", "expanding_std", "rebase", "nonzero_difference", "cross_over")
_AHEAD = ("bfill", "future_max", "future_min", "future_mean", "future_std", "fixed_label", "mean_label")
_PLUS_ONE = ("aroon_up", "aroon_down")
_LAGGED = ("delay", "delta", "pct_change", "roc", "log_return")
_STEP = ("signed_volume", "crossed_above", "crossed_below", "true_range", "log_true_range")


def lookback(node: Node) -> int:
    """Rows of history before a row that its value depends on; UNBOUNDED for states and expanding windows.

    Library indicators and macros are expanded first; the history of nested functions adds
    up. Functions of later rows and of a date's cross-section need none of their own.
    """
    if (simple := expand(node)) is not node:
        return lookback(simple)
    inner = max((lookback(a) for a in [*node.args, *(v for _, v in node.named)]), default=0)
    if node.kind != "call" or inner >= UNBOUNDED:
        return inner
    name = ALIASES.get(str(node.value), str(node.value))
    if name in SCANS:
        return inner if name in AHEAD_SCANS else UNBOUNDED
    if name not in WINDOWED:
        return inner
    n, fn = WINDOWED[name]
    given = inspect.signature(fn).bind_partial(None, *(None if i < n else getattr(a, "value", None) for i, a in enumerate(node.args)), **{k: v.value for k, v in node.named})
    given.apply_defaults()
    a = given.arguments
    if name in _PAST or a.get("expanding"):
        return UNBOUNDED
    if name in _AHEAD or name.startswith("cs_") or name == "industry_neutralize" or a.get("cross_section"):
        return inner
    rows = a.get("n") if a.get("n") is not None else a.get("window")
    if name in _STEP:
        return inner + 1
    if name in _LAGGED:
        return inner + max(int(rows), 0)
    if rows is None:
        raise ValueError(f"{name} has no known history")
    return inner + int(rows) - (0 if name in _PLUS_ONE else 1)


def safe_lookback(formula: str, most: int = 252) -> int:
    """lookback of a formula's text, at most `most` rows (a year); `most` where the history is unbounded."""
    return min(lookback(parse(formula)), most)


def scan_arguments(name: str, node: Node) -> tuple[list, dict]:
    """Constants of a call of a scan, bound by the function's own signature; too many or unknown ones are an error."""
    reads = SCAN_COLUMNS.get(name, ("x",))
    for v in [*node.args[len(reads) :], *(v for _, v in node.named)]:
        if v.kind not in ("num", "str"):
            raise ValueError(f"expected a constant, not {v}")
    if len(node.args) < len(reads):
        raise ValueError(f"{name} needs {', '.join(reads)}")
    args, named = [a.value for a in node.args[len(reads) :]], {k: v.value for k, v in node.named}
    try:
        inspect.signature(SCANS[name]).bind(None, *[None] * len(reads), "", *args, **named)
    except TypeError as e:
        raise ValueError(f"{name}: {e}") from None
    return args, named


class Compiler:
    """Lays formulas out in levels: a level's windows are computed together over columns of the level before."""

    def __init__(self, keys: Keys, columns: list[str]):
        self.keys, self.columns = keys, set(columns)
        self.short: dict[str, str] = {}
        self.known: dict[str, tuple[Column, int]] = {}
        self.inputs: dict[int, dict[str, Column]] = {}
        self.windows: dict[int, dict[str, Column]] = {}
        self.scans: dict[int, list[tuple[str, list[str], str, list, dict]]] = {}

    def plain(self, node: Node) -> object:
        if node.kind in ("num", "str"):
            return node.value
        if node.kind == "name":
            return str(node.value)
        raise ValueError(f"expected a constant, not {node}")

    def column(self, node: Node, level: int) -> str:
        """The name of a column holding a node's value before the windows of a level."""
        if node.kind == "name":
            return str(node.value)
        col, _ = self.value(node)
        name = self.short.setdefault(f"in {node}", f"_x{len(self.short)}")
        self.inputs.setdefault(level, {})[name] = col.cast("double")
        return name

    def value(self, node: Node) -> tuple[Column, int]:
        """A node's Column and the level after whose windows it can be computed."""
        text = str(node)
        if text not in self.known:
            self.known[text] = self._value(node)
        return self.known[text]

    def _value(self, node: Node) -> tuple[Column, int]:
        if (simple := expand(node)) is not node:
            return self.value(simple)
        if node.kind in ("num", "str"):
            return F.lit(float(node.value) if node.kind == "num" and not isinstance(node.value, bool) else node.value), 0
        if node.kind == "name":
            if node.value not in self.columns:
                raise ValueError(f"no column {node.value}")
            return F.col(f"`{node.value}`"), 0
        name = ALIASES.get(str(node.value), str(node.value))
        if node.kind == "op" or name in ELEMENT:
            parts = [self.value(a) for a in node.args]
            cols, level = [c for c, _ in parts], max(x for _, x in parts)
            if node.kind == "op" and name in COMPARISONS:
                return ops.compare(name, *cols), level
            fn = {"+": ELEMENT["add"], "-": ELEMENT["sub"], "*": ELEMENT["mul"], "/": ELEMENT["div"], "neg": ELEMENT["neg"]}.get(name) or ELEMENT[name]
            return fn(*cols), level
        if name in SCANS:
            reads = SCAN_COLUMNS.get(name, ("x",))
            cols = node.args[: len(reads)]
            level = max(self.value(x)[1] for x in cols)
            out = self.short.setdefault(str(node), f"_x{len(self.short)}")
            args, named = scan_arguments(name, node)
            self.scans.setdefault(level, []).append((name, [self.column(x, level) for x in cols], out, args, named))
            return F.col(f"`{out}`"), level + 1
        if name not in WINDOWED:
            raise ValueError(f"no function {name}")
        n, fn = WINDOWED[name]
        values = [a for a in node.args[:n] if a.kind != "num" or name == "cs_mean"]
        level = max(self.value(a)[1] for a in values)
        named = {}
        for k, v in node.named:
            if k == "weight" and v.kind != "num":
                level = max(level, self.value(v)[1])
        for k, v in node.named:
            named[k] = self.column(v, level) if k == "weight" and v.kind != "num" else self.plain(v)
        args = [self.column(a, level) if a in values else self.plain(a) for a in node.args[:n]] + [self.plain(a) for a in node.args[n:]]
        out = self.short.setdefault(str(node), f"_x{len(self.short)}")
        self.windows.setdefault(level, {})[out] = fn(self.keys, *args, **named)
        return F.col(f"`{out}`"), level + 1


def names_of(node: Node) -> set[str]:
    """The columns a formula reads."""
    own = {str(node.value)} if node.kind == "name" else set()
    return own.union(*(names_of(x) for x in [*node.args, *(v for _, v in node.named)]))


def first_row(panel: DataFrame, since: str, rows: int, keys: Keys = Keys()) -> str | None:
    """The date `rows` dates of the panel before `since` (the first date, if there are fewer), as text.

    One aggregate over the date column, from the filtered scan; rows is bounded by the caller.
    """
    dates = panel.where(F.col(keys.date) < F.lit(since).cast("date")).select(keys.date).distinct().orderBy(F.col(keys.date).desc()).limit(rows)
    return dates.agg(F.min(keys.date).cast("string")).first()[0]


def evaluate(panel: DataFrame, formulas: dict[str, str], keys: Keys = Keys(), last_only: bool = False, since: str | None = None, until: str | None = None) -> DataFrame:
    """A table of the panel's keys and one column per formula.

    All formulas share one plan: equal sub-formulas are computed once, and the windows of a
    nesting level of like partitioning share a shuffle and sort; so do the recursive scans of
    a level, which run in one grouped map over the keys and the columns that are still needed.

    since, until (YYYY-MM-DD): only these dates come out, and only they and the history the
    formulas look back on are read, by a date filter that reaches the scan (formulas of
    unbounded history read all before). last_only: the last date alone, likewise.
    """
    trees = {n: parse(t) for n, t in formulas.items()}
    read = set().union(*map(names_of, trees.values()))
    panel = panel.select(keys.ticker, keys.date, *[c for c in panel.columns if c in read and c not in (keys.ticker, keys.date)])
    c = Compiler(keys, panel.columns)
    results = {n: c.value(t) for n, t in trees.items()}
    if until:
        panel = panel.where(F.col(keys.date) <= F.lit(until).cast("date"))
    if last_only:
        since = panel.agg(F.max(keys.date).cast("string")).first()[0]
    if since and (rows := max(map(lookback, trees.values()), default=0)) < UNBOUNDED:
        begin = first_row(panel, since, rows, keys) if rows else None
        panel = panel.where(F.col(keys.date) >= F.lit(begin or since).cast("date"))
    df = panel
    top = max((x for _, x in results.values()), default=0)
    for level in range(top):
        if level in c.inputs:
            df = df.withColumns(c.inputs[level])
        if level in c.windows:
            df = df.withColumns(c.windows[level])
        if level in c.scans:
            steps = [(partial(_scan_call, SCANS[name], columns=cols, out=out, args=args, named=named)) for name, cols, out, args, named in c.scans[level]]
            df = scan(df, keys, partial(_in_turn, steps), [x[2] for x in c.scans[level]])
    if since:
        df = df.where(F.col(keys.date) >= F.lit(since).cast("date"))
    return df.select(keys.ticker, keys.date, *[col.alias(n) for n, (col, _) in results.items()])


def _scan_call(fn: Callable, pdf: pd.DataFrame, columns: list[str], out: str, args: list, named: dict) -> pd.DataFrame:
    return fn(pdf, *columns, out, *args, **named)


def _in_turn(steps: list[Callable[[pd.DataFrame], pd.DataFrame]], pdf: pd.DataFrame) -> pd.DataFrame:
    for step in steps:
        pdf = step(pdf)
    return pdf


def scan(df: DataFrame, keys: Keys, fn: Callable[[pd.DataFrame], pd.DataFrame], outs: list[str]) -> DataFrame:
    """An order-dependent recursion along each ticker's rows (one row per date at most), in date order."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(o, T.DoubleType()) for o in outs]])

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values(keys.date, kind="stable"))

    return df.groupBy(keys.ticker).applyInPandas(each, schema)
