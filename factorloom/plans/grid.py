"""Formulas over grids of parameters, and the choice of the best by its information coefficient."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.panel_ops import Keys
from ..operators import analytics as an
from .formula import Node, evaluate, parse, substitute


def formula_grid(template: str, **values: Sequence[float]) -> dict[str, str]:
    """A formula per combination of parameter values, labelled by them: name=value,..."""
    names = list(values)
    out = {}
    for combo in product(*values.values()):
        put = {n: Node("num", v) for n, v in zip(names, combo, strict=True)}
        out[",".join(f"{n}={v}" for n, v in zip(names, combo, strict=True))] = render(substitute(parse(template), put))
    return out


def render(node: Node) -> str:
    """A tree as formula text that parses to the same tree."""
    if node.kind == "num":
        return str(node.value) if node.value is True or node.value is False or node.value >= 0 else f"({node.value})"
    if node.kind == "str":
        return f"'{node.value}'"
    if node.kind == "name":
        return str(node.value)
    if node.kind == "op":
        return f"(-{render(node.args[0])})" if node.value == "neg" else f"({render(node.args[0])} {node.value} {render(node.args[1])})"
    inside = [*map(render, node.args), *(f"{k}={render(v)}" for k, v in node.named)]
    return f"{node.value}({', '.join(inside)})"


def grid_search(panel: DataFrame, price: str, template: str, period: int = 1, keys: Keys = Keys(), **values: Sequence[float]) -> DataFrame:
    """Mean and deviation of the daily linear information coefficient of every parameter combination.

    All combinations are columns of one plan over one scan; they are then stacked, so that
    one aggregate per (combination, date) gives every coefficient.
    """
    grid = formula_grid(template, **values)
    wide = evaluate(panel, {**{f"p{i}": f for i, f in enumerate(grid.values())}, "_price": price}, keys)
    t = an.forward_returns(wide, "_price", (period,), keys)
    stacked = t.select(keys.date, f"r{period}", F.explode(F.array(*[F.struct(F.lit(label).alias("params"), F.col(f"p{i}").alias("factor")) for i, label in enumerate(grid)])).alias("x")).select(keys.date, f"r{period}", "x.*")
    ic = stacked.groupBy("params", keys.date).agg(an.safe_corr(F.col("factor"), F.col(f"r{period}")).alias("ic"))
    return ic.groupBy("params").agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.count("ic").alias("dates"))
