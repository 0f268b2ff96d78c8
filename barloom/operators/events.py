"""Daily volatility and cumulative-sum events."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bars import DAY
from .ordered import asof, by_span, decaying_sums, previous, relay

KEYS = ("market",)


def _kinds(df: DataFrame, keys: tuple[str, ...]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def day_returns(bars: DataFrame, *columns: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ts_us, ret for one column, ret_<column> for several): the change since the last bar strictly more than a day before; rows without one are left out."""
    columns = columns or ("close",)
    asks = bars.select(*keys, "ts_us", (F.col("ts_us") - DAY - 1).alias("at"), *[F.col(c).alias(f"now_{c}") for c in columns])
    rows = asof(bars.select(*keys, "ts_us", *columns), asks, list(keys), list(columns)).where("found")
    ret = [(F.try_divide(f"now_{c}", c) - 1).alias("ret" if len(columns) == 1 else f"ret_{c}") for c in columns]
    return rows.select(*keys, "ts_us", *ret)


def ewm_std(rows: DataFrame, columns: str | dict[str, str], span: int = 100, keys: tuple[str, ...] = KEYS, name: str = "vol") -> DataFrame:
    """(keys, ts_us, names): exponentially weighted sample deviations of ``columns`` (one as ``name``, or name: column), weights 1 - 2 / (span + 1), adjusted and corrected for bias; the
    first is missing. A missing value decays the weights and repeats the last result. All columns share one pass of decaying sums."""
    columns = {name: columns} if isinstance(columns, str) else columns
    keep, inputs, decay = 1 - 2 / (span + 1), [], []
    for c in columns.values():
        x = F.when(~F.isnan(c), F.col(c))
        inputs += [x.isNotNull().cast("double"), x.isNotNull().cast("double"), x, x * x]
        decay += [keep, keep * keep, keep, keep]
    sums = decaying_sums(rows, list(keys), inputs, decay)

    def deviation(i: int) -> F.Column:
        w, w2, s1, s2 = (F.col("sums")[4 * i + j] for j in range(4))
        spare = w * w - w2
        variance = (s2 / w - (s1 / w) * (s1 / w)) * w * w / spare
        return F.when((w > 0) & (spare > 1e-12), F.sqrt(F.greatest(F.lit(0.0), variance)))

    return sums.select(*keys, "ts_us", *[deviation(i).alias(name) for i, name in enumerate(columns)])


def daily_vol(bars: DataFrame, column: str = "close", span: int = 100, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ts_us, vol) for each bar with a bar more than a day before."""
    return ewm_std(day_returns(bars, column, keys=keys), {"vol": "ret"}, span, keys)


class _Sums:
    """The two sums of a filter over rows (diff, h), run between resets by running minima and maxima instead of row by row."""

    def __init__(self, diff: np.ndarray, h: np.ndarray) -> None:
        self.diff, self.h = diff, h
        self.missing = np.append(np.flatnonzero(np.isnan(diff)), len(diff))

    def run(self, up: float, down: float, start: int = 0) -> tuple[np.ndarray, float, float]:
        """(rows with an event, up, down) from row ``start`` on. Below -h comes first and resets the lower sum, else above h the upper; a missing diff resets both."""
        hits, i, n, block = [], start, len(self.diff), 64
        while i < n:
            gap = int(self.missing[np.searchsorted(self.missing, i)])
            if gap == i:
                up = down = 0.0
                hits += [i] if 0.0 < -self.h[i] or 0.0 > self.h[i] else []
                i += 1
                continue
            stop = min(gap, i + block)
            path = np.cumsum(self.diff[i:stop])
            ups = np.maximum(up + path, path - np.minimum.accumulate(path))
            downs = np.minimum(down + path, path - np.maximum.accumulate(path))
            low = downs < -self.h[i:stop]
            fires = low | (ups > self.h[i:stop])
            k = int(fires.argmax()) if fires.any() else -1
            if k < 0:
                up, down, i, block = float(ups[-1]), float(downs[-1]), stop, min(4096, 2 * block)
                continue
            up, down, block = float(ups[k]), float(downs[k]), 64
            up, down = (up, 0.0) if low[k] else (0.0, down)
            hits.append(i + k)
            i += k + 1
        return np.array(hits, np.int64), up, down

    def meets(self) -> tuple[int, float, float] | None:
        """(row, up, down) from which on all starts are one: bounds of either sum hold for every start, a move of the size of a threshold pins them. None if the chunk has no such row."""
        low_up, high_up, low_down, high_down = 0.0, math.inf, -math.inf, 0.0
        for i, (d, h) in enumerate(zip(self.diff.tolist(), self.h.tolist(), strict=True)):
            if math.isnan(d):
                return i + 1, 0.0, 0.0
            low_up, high_up = max(0.0, low_up + d), max(0.0, high_up + d)
            low_down, high_down = min(0.0, low_down + d), min(0.0, high_down + d)
            if math.isnan(h):
                continue
            surely, maybe = high_down < -h, low_down < -h
            if surely:
                low_down = high_down = 0.0
                continue
            if maybe:  # those below start anew, the others are no lower than -h
                low_down, high_down = min(-h, high_down), 0.0
            if low_up > h and not maybe:
                low_up = high_up = 0.0
            elif high_up > h:
                low_up, high_up = 0.0, high_up if maybe else max(h, 0.0)
            if low_up == high_up and low_down == high_down:
                return i + 1, low_up, low_down
        return None


def _cusum(rows: DataFrame, keys: tuple[str, ...], chunk: int | None = None) -> DataFrame:
    """Events of rows (keys, ts_us, diff, h).

    A relay: in almost every chunk all starts run together once the series has moved by a threshold either way, and the chunk then knows its last state whatever it starts from;
    only a chunk without such a move hands its rows on, to be run when its start is known.
    """

    def summary(pdf: pd.DataFrame) -> dict:
        sums = _Sums(pdf["diff"].to_numpy(float), pdf["h"].to_numpy(float))
        met = sums.meets()
        if met is None:
            return {"up": None, "down": None, "diffs": sums.diff, "hs": sums.h}
        _, up, down = sums.run(met[1], met[2], met[0])
        return {"up": up, "down": down, "diffs": None, "hs": None}

    def carry(state, row):
        if row.diffs is None:
            return row.up, row.down
        # null stands for NaN on the way
        diff, h = (np.array(x, float) for x in (row.diffs, row.hs))
        return _Sums(diff, h).run(*(state or (0.0, 0.0)))[1:]

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        hits, _, _ = _Sums(pdf["diff"].to_numpy(float), pdf["h"].to_numpy(float)).run(float(pdf["up0"].iloc[0]), float(pdf["down0"].iloc[0]))
        return pdf.loc[hits, [*keys, "ts_us"]]

    return relay(
        rows.select(*keys, "ts_us", "diff", "h"), list(keys), ["ts_us"], by_span(), (summary, "up double, down double, diffs array<double>, hs array<double>"),
        carry, (lambda state: list(state or (0.0, 0.0)), "up0 double, down0 double"), (final, f"{_kinds(rows, keys)}, ts_us long"), chunk,
    )


def cusum_events(series: DataFrame, column: str, h: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ts_us) where the symmetric cumulative sum of the column's differences passes ``h``."""
    rows = previous(series.select(*keys, "ts_us", F.col(column).alias("x")), list(keys), ["x"]).where(F.col("before").isNotNull())
    return _cusum(rows.select(*keys, "ts_us", (F.col("x") - F.col("before.x")).alias("diff"), F.lit(float(h)).alias("h")), keys)


def cusum_events_by(series: DataFrame, column: str, limits: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same with a threshold ``h`` at each time of ``limits`` (all but its first); differences are those of the full series."""
    diffs = previous(series.select(*keys, "ts_us", F.col(column).alias("x")), list(keys), ["x"])
    diffs = diffs.select(*keys, "ts_us", (F.col("x") - F.col("before.x")).alias("diff"))
    rows = previous(limits.select(*keys, "ts_us", "h"), list(keys), ["ts_us"]).where(F.col("before").isNotNull())
    return _cusum(rows.select(*keys, "ts_us", "h").join(diffs, [*keys, "ts_us"]), keys)
