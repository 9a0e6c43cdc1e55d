"""Schemas that drift between files: tree edit distance, change report, projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocked import carry

ADD = DELETE = 1.0
RENAME, RETYPE = 0.2, 0.1


@dataclass(frozen=True)
class Node:
    """A field of a schema tree. meaning: what it is known to hold ('' if unknown); middle: a typical number."""

    name: str
    meaning: str = ""
    type: str | None = None
    middle: float | None = None
    children: tuple[Node, ...] = field(default=())

    @property
    def size(self) -> int:
        return 1 + sum(c.size for c in self.children)


def assign(cost: np.ndarray) -> list[int]:
    """The column of each row in the cheapest one-to-one assignment of a square matrix.

    Shortest augmenting paths with potentials, one row at a time.
    """
    n = len(cost)
    rows, cols = np.zeros(n + 1), np.zeros(n + 1)
    held = [-1] * (n + 1)  # row held by each column; n is the virtual start column
    for row in range(n):
        held[n], at = row, n
        slack, via, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while held[at] >= 0:
            done[at] = True
            r = held[at]
            reach = cost[r] - rows[r] - cols[:n]
            better = ~done[:n] & (reach < slack)
            slack[better], via[better] = reach[better], at
            nxt = int(np.argmin(np.where(done[:n], np.inf, slack)))
            step = slack[nxt]
            for c in np.flatnonzero(done):
                rows[held[c]] += step
                cols[c] -= step
            slack[~done[:n]] -= step
            at = nxt
        while at != n:
            held[at] = held[via[at]]
            at = int(via[at])
    out = [0] * n
    for c in range(n):
        out[held[c]] = c
    return out


def relabel(a: Node, b: Node) -> float:
    """Cost of taking field a for field b: nothing if equal, above add plus delete if they can't be the same."""
    kind = RETYPE * (a.type != b.type and a.type is not None and b.type is not None)
    if a.name == b.name:
        return kind
    if a.meaning and b.meaning:
        return RENAME + kind if a.meaning == b.meaning else 4.0
    alike = SequenceMatcher(None, a.name.casefold(), b.name.casefold()).ratio()
    if a.middle and b.middle and a.type == b.type and 0.8 < a.middle / b.middle < 1.25:
        alike = max(alike, 0.75)
    return RENAME + kind + 2.4 * (1 - alike)


def _solver() -> Callable[[Node, Node], tuple[float, tuple[tuple[int, int], ...]]]:
    """Cost of turning one tree into another, and the matched positions of their children (-1: none), solved once per pair."""

    @lru_cache(maxsize=None)
    def solve(x: Node, y: Node) -> tuple[float, tuple[tuple[int, int], ...]]:
        total = relabel(x, y)
        # leaves that are the same on both sides cost nothing, and no other partner can do better
        there = {c: j for j, c in enumerate(y.children) if not c.children}
        same = [(i, there.pop(c)) for i, c in enumerate(x.children) if c in there]
        taken = {i for i, _ in same}, {j for _, j in same}
        xs, ys = ([k for k in range(len(t.children)) if k not in used] for t, used in zip((x, y), taken, strict=True))
        m, n = len(xs), len(ys)
        if not m + n:
            return total, tuple(same)
        big = np.zeros((m + n, m + n))
        for a, i in enumerate(xs):
            for b, j in enumerate(ys):
                big[a, b] = solve(x.children[i], y.children[j])[0] + 1e-6 * (i != j)
        if m:
            big[:m, n:] = np.where(np.eye(m, dtype=bool), [[DELETE * x.children[i].size] for i in xs], 1e9)
        if n:
            big[m:, :n] = np.where(np.eye(n, dtype=bool), [ADD * y.children[j].size for j in ys], 1e9)
        pairs = assign(big)
        rest = [(xs[a] if a < m else -1, ys[b] if b < n else -1) for a, b in enumerate(pairs) if a < m or b < n]
        return total + float(sum(big[a, b] for a, b in enumerate(pairs))), tuple(same + rest)

    return solve


def edit_script(a: Node, b: Node) -> tuple[float, list[tuple[str, tuple[str, ...], tuple[str, ...]]]]:
    """Minimum cost of turning schema tree a into b, and the script: (kind, path in a, path in b).

    Unordered trees; a subtree is matched with one subtree (constrained edit distance),
    children by the cheapest assignment. Kinds: added, removed, renamed, retyped, moved
    (another place among the siblings that stayed), same.
    """

    solve = _solver()
    script: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = []

    def walk(x: Node, y: Node, px: tuple[str, ...], py: tuple[str, ...]) -> None:
        pairs = solve(x, y)[1]
        stayed = sorted((i, j) for i, j in pairs if i >= 0 and j >= 0)
        order = {j: k for k, j in enumerate(sorted(j for _, j in stayed))}
        for i, j in sorted(pairs):
            if i < 0:
                script.append(("added", py, (*py, y.children[j].name)))
            elif j < 0:
                script.append(("removed", (*px, x.children[i].name), px))
            else:
                c, d = x.children[i], y.children[j]
                at = ((*px, c.name), (*py, d.name))
                kinds = [k for k, yes in (("renamed", c.name != d.name), ("retyped", c.type != d.type and c.type is not None and d.type is not None), ("moved", stayed.index((i, j)) != order[j])) if yes]
                script.extend((k, *at) for k in kinds or ["same"])
                walk(c, d, *at)

    walk(a, b, (), ())
    return solve(a, b)[0], script


def previous_schema(schemas: DataFrame, keys: Sequence[str], block: str, order: Sequence[str]) -> DataFrame:
    """Adds `before`, the columns of the file before this one of the same keys (null for the first)."""
    return carry(schemas, keys, block, order, F.col("columns"), "before")


def drift_report(compared: DataFrame) -> DataFrame:
    """file_id, change_kind, column_name of every change between `before` and `columns`.

    added, renamed and retyped name the header in this file, removed the one before;
    moves are no change of the table. Each distinct pair of schemas is solved once per
    task. First files (before is null) give no rows.
    """
    # files of the schema before them never reach Python
    need = compared.where(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col("columns"))).select("file_id", "before", "columns")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            ids, kinds, names = [], [], []
            for i, old, new in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a, z = (tuple((c["header"], c["meaning"], c["type"]) for c in s) for s in (old, new))
                if a == z:
                    continue
                # medians only decide about headers of unknown meaning
                key = (a, z) if all(c[1] for c in (*a, *z)) else None
                found = known.get(key) if key else None
                if found is None:
                    trees = [Node("", children=tuple(Node(c["header"], c["meaning"], c["type"], c["middle"]) for c in s)) for s in (old, new)]
                    script = edit_script(*trees)[1]
                    found = [(k, (x if k == "removed" else y)[-1]) for k, x, y in script if k in ("added", "removed", "renamed", "retyped")]
                    if key:
                        if len(known) > 50_000:
                            known.clear()
                        known[key] = found
                for k, n in found:
                    ids.append(i), kinds.append(k), names.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(names, pa.string())], names=["file_id", "change_kind", "column_name"])

    return need.mapInArrow(report, "file_id bigint, change_kind string, column_name string")


def column_pairs(a: Node, b: Node) -> list[tuple[int, int]]:
    """Positions of the fields of a and b that the edit script from a to b takes for the same."""
    return sorted((i, j) for i, j in _solver()(a, b)[1] if i >= 0 and j >= 0)


def _follow(edges: DataFrame) -> DataFrame:
    """file_id, pos, meaning: what the edges (file_id, pos, to_id, to_pos, meaning of the target or null) lead to.

    Each round doubles the length of the way every open edge has gone, so a run of n files of
    unlisted headers takes log2(n) rounds and no symbol gathers in one task.
    """
    edges = cut_lineage(edges)
    while edges.where("meaning is null and to_id is not null").limit(1).count():
        t = edges.select(F.col("file_id").alias("to_id"), F.col("pos").alias("to_pos"), F.col("to_id").alias("_id"), F.col("to_pos").alias("_pos"), F.col("meaning").alias("_meaning"))
        going = edges.where("meaning is null and to_id is not null").join(t, ["to_id", "to_pos"], "left")
        going = going.select("file_id", "pos", F.col("_id").alias("to_id"), F.col("_pos").alias("to_pos"), F.col("_meaning").alias("meaning"))
        edges = cut_lineage(edges.where("meaning is not null or to_id is null").unionByName(going))
    return edges.where("meaning is not null").select("file_id", "pos", "meaning")


def learned_columns(schemas: DataFrame, keys: Sequence[str], block: str, order: Sequence[str]) -> DataFrame:
    """file_id, learned (array of pos, meaning): what the columns of unlisted headers hold, by the edit scripts along the files of a key.

    A column has the meaning of the nearest file before in which the scripts, composed, pair it
    with a listed header, else of the nearest file after. Files where nothing is learned give no row.
    """
    near = carry(schemas, keys, block, order, F.struct("file_id", "columns"), "before").where(F.col("before").isNotNull())
    unlisted = lambda c: F.exists(F.col(c), lambda x: x["meaning"] == "")
    near = near.where(unlisted("columns") | unlisted("before.columns")).select("file_id", "columns", "before")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_id", "pos", "meaning", "to_id", "to_pos", "to_meaning"]
        for b in batches:
            out = []
            for i, new, old in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a, z = (Node("", children=tuple(Node(c["header"], c["meaning"], c["type"], c["middle"]) for c in s)) for s in (old["columns"], new))
                for j, k in column_pairs(a, z):
                    x, y = a.children[j].meaning or None, z.children[k].meaning or None
                    if x is None or y is None:
                        out.append((i, k, y, old["file_id"], j, x))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string()) * 2, strict=True)], names=names)

    links = cut_lineage(near.mapInArrow(link, "file_id bigint, pos int, meaning string, to_id bigint, to_pos int, to_meaning string"))
    back = _follow(links.where("meaning is null").select("file_id", "pos", "to_id", "to_pos", F.col("to_meaning").alias("meaning")))
    ahead = _follow(links.where("to_meaning is null").select(F.col("to_id").alias("file_id"), F.col("to_pos").alias("pos"), F.col("file_id").alias("to_id"), F.col("pos").alias("to_pos"), "meaning"))
    both = back.withColumn("_side", F.lit(0)).unionByName(ahead.withColumn("_side", F.lit(1))).groupBy("file_id", "pos").agg(F.min_by("meaning", "_side").alias("meaning"))
    return both.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("pos", "meaning"))).alias("learned"))
