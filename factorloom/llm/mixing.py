"""Mixing sources to target shares by cube-method balanced sampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import TOKENIZERS, count_tokens

#: Documents a flight handles in one task; larger sources are flown in blocks.
BLOCK = 4000
EPS = 1e-9


def fly(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase: moves probabilities to 0 or 1 within the null space of (size, count).

    Three fractional units at a time move along the one direction that keeps both the
    expected size and the expected count, up to where one of them is decided; at most two
    stay fractional.
    """
    p = prob.astype(float).copy()
    open_: list[int] = []
    for k in range(len(p)):
        if not EPS < p[k] < 1 - EPS:
            p[k] = round(p[k])
            continue
        open_.append(k)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        ahead = min(((1 - p[i]) / d if d > 0 else p[i] / -d) for i, d in zip(open_, u, strict=True) if d)
        back = min((p[i] / d if d > 0 else (1 - p[i]) / -d) for i, d in zip(open_, u, strict=True) if d)
        step = ahead if rng.random() * (ahead + back) < back else -back
        for i, d in zip(open_, u, strict=True):
            p[i] += step * d
            if p[i] < EPS or p[i] > 1 - EPS:
                p[i] = round(p[i])
        open_ = [i for i in open_ if 0 < p[i] < 1]
    return p


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The landing phase: the 0/1 choice of the few units left that is closest in size, then count."""
    p = prob.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    want, count = float((p[left] * size[left]).sum()), float(p[left].sum())
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(size[k] for i, k in enumerate(left) if m >> i & 1) - want), abs(bin(m).count("1") - count), m))
    for i, k in enumerate(left):
        p[k] = best >> i & 1
    return p


def _level(df: DataFrame, ident: str, blocks: dict[str, int], salt: int, final: bool) -> DataFrame:
    """One flight of the fractional units per source and block; the last one lands."""
    n = F.lit(1)
    for s, k in blocks.items():
        n = F.when(F.col("source") == s, F.lit(k)).otherwise(n)
    placed = df.withColumn("_order", F.xxhash64(F.col(ident), F.lit(salt))).withColumn("_block", F.pmod(F.xxhash64(F.col(ident), F.lit(salt + 1)), n))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", ident], kind="stable")
        rng = np.random.default_rng([salt, int(pdf["_block"].iat[0]), int(pdf["n_tokens"].sum()) & 0xFFFFFFFF])
        sizes = pdf["n_tokens"].to_numpy(float)
        p = fly(pdf["prob"].to_numpy(), sizes, rng)
        return pdf.drop(columns=["_order", "_block"]).assign(prob=land(p, sizes) if final else p)

    return placed.groupBy("source", "_block").applyInPandas(run, df.schema)


def mix(docs: DataFrame, targets: DataFrame, ident: str = "doc_id", text: str = "text", total: float | None = None, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> tuple[DataFrame, DataFrame]:
    """The documents of a mixture and the shares it reaches.

    `targets` (source, target_share, max_repeats) is a small table of one row per source.
    `total` is the mixture's size in tokens; by default, and at most, the largest size at
    which no source needs more than its max_repeats. A source needs r = total * share /
    its tokens passes: every document is taken floor(r) times and once more with
    probability r - floor(r), by the cube method balanced on tokens and documents, in
    blocks, whose undecided units (two a block at most) fly on together until a landing of
    two units a source is left.

    Returns (source, ident, n_tokens, repeats >= 1) and per source (source, target_share,
    max_repeats, documents, tokens, share). Documents of null or untargeted source, and
    those without tokens (null, empty), are not in it. Targeted sources without tokens
    reach share 0 and the other shares are scaled up. Repeated rows are used as documents
    of their own. Empty tables give no documents.
    """
    goal = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).select("source", "target_share", "max_repeats").distinct()
    counted = cut_lineage(count_tokens(docs.select(ident, "source", text).where(F.col("source").isNotNull()), text, "n_tokens", folder, name).where("n_tokens > 0").join(F.broadcast(goal.select("source")), "source"))
    have = {r[0]: (r[1], r[2]) for r in counted.groupBy("source").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()}
    want = {r[0]: (r[1], r[2]) for r in goal.collect() if r[0] in have}
    scale = sum(s for s, _ in want.values()) or 1.0
    most = min((m * have[k][0] * scale / s for k, (s, m) in want.items()), default=0.0)
    size = min(total, most) if total else most
    passes = {k: size * s / scale / have[k][0] for k, (s, _) in want.items()}
    passes = {k: float(round(r)) if abs(r - round(r)) < 1e-9 else r for k, r in passes.items()}
    base, prob = F.lit(0), F.lit(0.0)
    for k, r in passes.items():
        base = F.when(F.col("source") == k, F.lit(math.floor(r))).otherwise(base)
        prob = F.when(F.col("source") == k, F.lit(r - math.floor(r))).otherwise(prob)
    rows = counted.withColumn("repeats", base.cast("int")).withColumn("prob", prob.cast("double"))
    blocks = {k: max(1, math.ceil(have[k][1] / BLOCK)) for k in want}
    decided, level = None, 0
    while True:
        final = all(n == 1 for n in blocks.values())
        out = _level(rows, ident, blocks, 17 + 2 * level, final)
        if not final:
            out = cut_lineage(out)
        undecided = (F.col("prob") > 0) & (F.col("prob") < 1)
        done = out if final else out.where(~undecided)
        decided = done if decided is None else decided.unionByName(done)
        if final:
            break
        rows, level = out.where(undecided), level + 1
        blocks = {k: max(1, math.ceil(2 * n / BLOCK)) for k, n in blocks.items()}
    chosen = decided.select("source", ident, "n_tokens", (F.col("repeats") + F.col("prob").cast("int")).alias("repeats")).where("repeats > 0")
    sums = chosen.groupBy("source").agg(F.sum("repeats").alias("documents"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"))
    whole = sums.agg(F.sum("tokens").alias("_all"))
    shares = goal.join(sums, "source", "left").crossJoin(F.broadcast(whole))
    tokens = F.coalesce(F.col("tokens"), F.lit(0))
    report = shares.select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), tokens.alias("tokens"), F.coalesce(tokens / F.col("_all"), F.lit(0.0)).alias("share"))
    return chosen, report
