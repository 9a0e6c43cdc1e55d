"""Implausible readings per source: robust exponentially weighted control charts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import slices


@dataclass(frozen=True)
class Chart:
    """How one measured field is charted.

    floor: readings at or below it are physically impossible (below it if `strict`).
    log: chart the logarithm (levels that scale); readings <= 0 are then not charted.
    walk: the level drifts from record to record, so ordinary size is that of its steps.
    limit: control limit, in robust standard deviations.
    least: a deviation smaller than this is never a spike (in charted units).
    """

    field: str
    floor: float
    strict: bool = False
    log: bool = False
    walk: bool = False
    limit: float = 9.0
    least: float = 0.0


#: Sources a worker charts at a time (memory bound; results don't depend on it).
SOURCES = 500
STUCK_RUN = 5
SPIKE_RUN = 2
#: Weights of the newest record in the mean and the scale; records for the first estimate.
MEAN_WEIGHT, WALK_WEIGHT, SCALE_WEIGHT, START = 0.1, 0.6, 0.05, 25
#: How far the scale may move from the series' usual one: it follows lasting changes of volatility, not a few quiet records.
SCALE_RANGE = (0.5, 6.0)


def run_lengths(x: np.ndarray) -> np.ndarray:
    """Length of the run of equal values each cell belongs to, along axis 1; NaN runs have length 0."""
    same = np.zeros(x.shape, bool)
    same[:, 1:] = x[:, 1:] == x[:, :-1]
    ahead = np.zeros(x.shape, np.int64)
    back = np.zeros(x.shape, np.int64)
    for t in range(1, x.shape[1]):
        ahead[:, t] = np.where(same[:, t], ahead[:, t - 1] + 1, 0)
    for t in range(x.shape[1] - 2, -1, -1):
        back[:, t] = np.where(same[:, t + 1], back[:, t + 1] + 1, 0)
    return np.where(np.isnan(x), 0, ahead + back + 1)


def _nanmedian(x: np.ndarray) -> np.ndarray:
    out = np.full(x.shape[0], np.nan)
    some = ~np.isnan(x).all(1)
    out[some] = np.nanmedian(x[some], axis=1)
    return out


def control_chart(y: np.ndarray, quiet: np.ndarray, chart: Chart) -> np.ndarray:
    """Spikes of (source, record) readings y; NaN cells are skipped. quiet cells don't move the scale.

    Per source the mean and scale move with exponential weights; a reading beyond the
    limit is suspected and moves them only by its clipped value. A run counter follows the
    suspected readings: one or two of them followed by an ordinary reading are spikes, a
    third near the others means a lasting new level, at which the chart restarts.
    """
    b, n = y.shape
    # readings pushed to the left, so that a step is always one record of every source
    order = np.argsort(np.isnan(y), axis=1, kind="stable")
    v, q = np.take_along_axis(y, order, 1), np.take_along_axis(quiet, order, 1)
    steps = np.abs(np.diff(v, axis=1)) if chart.walk else np.abs(v - _nanmedian(v)[:, None])
    steps[(q[:, 1:] if chart.walk else q)] = np.nan
    usual = 1.4826 * _nanmedian(steps)
    first = 1.4826 * _nanmedian(steps[:, :START])
    tiny = 1e-9
    usual = np.where(usual > tiny, usual, np.nan)
    base = np.where(np.isnan(usual), np.inf, usual)
    scale = np.clip(np.where(first > tiny, first, base), SCALE_RANGE[0] * base, SCALE_RANGE[1] * base)
    mean = _nanmedian(v[:, : 5 if chart.walk else START])
    found = np.zeros((b, n), bool)
    pending = np.zeros(b, np.int64)
    level = np.zeros(b)
    weight = WALK_WEIGHT if chart.walk else MEAN_WEIGHT
    for t in range(n):
        x = v[:, t]
        here = ~np.isnan(x)
        if not here.any():
            break
        e = np.where(here, x - mean, 0.0)
        bound = np.maximum(chart.limit * scale, chart.least)
        suspect = here & (np.abs(e) > bound)
        calm = here & ~suspect
        # what was suspected before an ordinary reading is a spike
        for back in range(1, SPIKE_RUN + 1):
            if t >= back:
                found[:, t - back] |= calm & (pending >= back) & (pending <= SPIKE_RUN)
        near = suspect & (pending > 0) & (np.abs(x - level) <= bound)
        level = np.where(suspect, np.where(near, level + (x - level) / (pending + 1), x), level)
        pending = np.where(suspect, pending + 1, np.where(calm, 0, pending))
        moved = suspect & (pending > SPIKE_RUN) & near
        clipped = np.clip(e, -2.5 * scale, 2.5 * scale)
        mean = mean + np.where(calm, weight * np.where(chart.walk, e, clipped), 0.0)
        grow = calm & ~q[:, t]
        scale = np.where(grow, np.clip((1 - SCALE_WEIGHT) * scale + SCALE_WEIGHT * 1.2533 * np.abs(clipped), SCALE_RANGE[0] * base, SCALE_RANGE[1] * base), scale)
        mean = np.where(moved, level, mean)
        pending = np.where(moved, 0, pending)
    out = np.zeros((b, n), bool)
    np.put_along_axis(out, order, found, 1)
    return out


def _matrix(values: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Series of flat values as rows padded with NaN."""
    place = np.arange(lengths.max(initial=0))
    inside = place < lengths[:, None]
    out = np.full(inside.shape, np.nan)
    out[inside] = values[(starts[:, None] + place)[inside]]
    return out


def implausible_readings(held: DataFrame, source: str, at: str, charts: Sequence[Chart], idle: str | None = None) -> DataFrame:
    """Readings that can't be true, judged by the source's own behaviour.

    `held` has one row per source and `at` (resolve versions first: that folds a hot
    source's repeated rows, so a source's series is bounded by its distinct days). Columns
    out: source, at, field_name, kind. Kinds, each given independently:
    impossible - at or below the field's physical floor;
    stuck      - any record of a run of five or more consecutive equal non-null readings
                 (a null ends a run);
    spike      - a possible reading, for one or two records, beyond the control limit with
                 ordinary readings after it; lasting new levels are none.
    `idle` names a field whose zero marks a record without activity: such records don't
    move the scale of any chart. Nulls and NaN are no readings; null sources or times are
    left out; infinite readings are impossible; empty tables and single records give no rows.
    """
    fields = [c.field for c in charts]
    record = F.struct(F.col(at).alias("_at"), *[F.col(f).cast("double").alias(f) for f in fields])
    series = held.where(F.col(source).isNotNull() & F.col(at).isNotNull()).groupBy(source).agg(F.array_sort(F.collect_list(record)).alias("_series"))
    schema = T.StructType([held.schema[source], T.StructField(at, held.schema[at].dataType), T.StructField("field_name", T.StringType()), T.StructField("kind", T.StringType())])

    names = [f.name for f in schema.fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, SOURCES)):
            lengths = pc.list_value_length(b.column("_series")).to_numpy(zero_copy_only=False).astype(np.int64)
            starts, flat = np.cumsum(lengths) - lengths, b.column("_series").flatten()
            at_time = flat.field("_at")
            # sources of like length share a matrix, so one long series doesn't widen all
            kinds_of_length = np.ceil(np.log2(np.maximum(lengths, 1)))
            for size in np.unique(kinds_of_length):
                part = np.flatnonzero(kinds_of_length == size)
                take = lambda field: _matrix(flat.field(field).to_numpy(zero_copy_only=False).astype(float), lengths[part], starts[part])  # noqa: B023, E731
                resting = take(idle) == 0 if idle else None
                for c in charts:
                    x = take(c.field)
                    bad = (x < c.floor) | (x == np.inf) | ((x == c.floor) & (not c.strict))
                    runs = run_lengths(x)
                    chartable = ~bad & ~np.isnan(x) & ((x > 0) | (not c.log))
                    y = np.where(chartable, np.log(np.where(chartable, x, 1.0)) if c.log else x, np.nan)
                    quiet = runs > 2 if resting is None else resting | (runs > 2)
                    spikes = control_chart(y, quiet, c)
                    for kind, hit in (("impossible", bad), ("stuck", runs >= STUCK_RUN), ("spike", spikes & chartable)):
                        i, j = np.nonzero(hit)
                        if len(i):
                            yield pa.RecordBatch.from_arrays([b.column(source).take(pa.array(part[i])), at_time.take(pa.array(starts[part[i]] + j)), pa.array([c.field] * len(i)), pa.array([kind] * len(i))], names=names)

    return series.mapInArrow(scan, schema)
