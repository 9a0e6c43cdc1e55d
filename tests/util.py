"""Comparison of result rows without regard to order."""

import math
from collections import Counter

import numpy as np
import pandas as pd


def cell(v, digits=9):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, np.floating)):
        return float(f"{v:.{digits}g}")
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(cell(x, digits) for x in v)
    return v


def bag(rows, digits=9):
    return Counter(tuple(cell(v, digits) for v in r) for r in rows)


def frame_bag(pdf):
    return bag(pdf[sorted(pdf.columns)].itertuples(index=False, name=None))
