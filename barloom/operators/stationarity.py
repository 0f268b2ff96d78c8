"""Fractional differencing and unit-root tests, on long tables (keys, segment, ts_us, feature, x)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .events import _kinds
from .ordered import by_span, numbered, ordered_scan

D_GRID = tuple(round(0.1 * k, 1) for k in range(1, 11))
ENTER, ACCEPT, COARSE = 0.001, 0.0001, 1e-3
BLOCK, SLICES, EXACT = 1 << 14, 64, 1 << 20


def _binomial(d: float, size: int) -> np.ndarray:
    """The first ``size`` coefficients of (1 - lag) ** d: each is the one before times (k - 1 - d) / k."""
    k = np.arange(1, size)
    return np.cumprod(np.concatenate([[1.0], (k - 1 - d) / k]))


def weights(d: float, size: int) -> list[float]:
    """The first ``size`` weights of (1 - lag) ** d, oldest lag first."""
    return _binomial(d, max(size, 1))[::-1].tolist()


def weights_fixed(d: float, threshold: float) -> list[float]:
    """Weights down to the first whose size is at or below the threshold, which is included, oldest lag first."""
    size = 64
    while True:
        w = _binomial(d, size)
        small = np.flatnonzero(np.abs(w) <= threshold)
        if len(small):
            return w[small[0] :: -1].tolist()
        size *= 2


def long_form(wide: DataFrame, features: list[str], ids: list[str]) -> DataFrame:
    """(ids, feature, x) of a wide table; x is a double."""
    cols = [F.col(f"`{f}`").cast("double").alias(f) for f in features]
    return wide.select(*ids, *cols).unpivot(ids, [F.col(f"`{f}`") for f in features], "feature", "x")


class _Series:
    """The fixed-width difference of one series that comes in pieces; it keeps the last width - 1 values."""

    def __init__(self, w: np.ndarray) -> None:
        self.w, self.past = w, np.zeros(0)

    def next(self, own: np.ndarray) -> np.ndarray:
        """A value for each of ``own``, missing where there is none: missing values take the last one, rows that are not finite themselves give none."""
        filled = pd.Series(np.concatenate([self.past[-1:], own])).ffill().to_numpy()[len(self.past[-1:]) :]
        there = ~np.isnan(filled)
        series, fresh = np.concatenate([self.past, filled[there]]), int(there.sum())
        out = np.full(len(own), np.nan)
        if len(series) >= len(self.w):
            y = np.convolve(series, self.w[::-1], "valid")
            tail = np.full(fresh, np.nan)
            tail[max(0, fresh - len(y)) :] = y[max(0, len(y) - fresh) :]
            out[there] = tail
        self.past = series[max(0, len(series) - len(self.w) + 1) :]
        return np.where(np.isfinite(own), out, np.nan)


def difference_fixed(rows: DataFrame, d: float | str, threshold: float = 1e-5, keys: tuple[str, ...] = ("market", "feature")) -> DataFrame:
    """(keys, ts_us, y): the fixed-width difference. Missing values take the last one; rows not finite themselves, and the first width - 1, are absent.

    ``d`` may name a column that is the same for all rows of a key. The state is the last width - 1 values, so a long series streams through.
    """

    def step(state, pdf: pd.DataFrame):
        state = state or _Series(np.array(weights_fixed(float(pdf[d].iloc[0]) if isinstance(d, str) else d, threshold)))
        out = state.next(pdf["x"].to_numpy(float))
        keep = ~np.isnan(out)
        return state, pdf.loc[keep, [*keys, "ts_us"]].assign(y=out[keep])

    columns = [*keys, "ts_us", "x", *([d] if isinstance(d, str) else [])]
    return ordered_scan(rows.select(columns), list(keys), ["ts_us"], step, f"{_kinds(rows, keys)}, ts_us long, y double")


def difference_fixed_lags(rows: DataFrame, d: float, threshold: float, keys: tuple[str, ...] = ("market", "feature")) -> DataFrame:
    """The same for short widths and series without gaps, as a sum of lags inside one window."""
    w = Window.partitionBy(*keys).orderBy("ts_us")
    terms = [F.lag("x", k).over(w) * c for k, c in enumerate(reversed(weights_fixed(d, threshold)))]
    return rows.where("x is not null").select(*keys, "ts_us", sum(terms[1:], terms[0]).alias("y")).where("y is not null")


def _weights_at(d: float, first: int, n: int) -> np.ndarray:
    """The coefficients of lags first ... first + n - 1; beyond ``EXACT`` they go on from there by their asymptotic ratio, whose error is below 1e-18."""
    start = min(first, EXACT)
    w = _binomial(d, start + 1)[start]
    if first > start:
        size = lambda k: k ** (-d - 1) * (1 + d * (d + 1) / (2 * k) + d * (d + 1) * (d + 2) * (3 * d + 1) / (24 * k * k))
        w *= size(float(first)) / size(float(start))
    k = np.arange(first + 1, first + n)
    return w * np.cumprod(np.concatenate([[1.0], (k - 1 - d) / k]))


def _skipped(d: float, size: int, threshold: float, step: int = 1 << 20) -> int:
    """How many lags leave more than ``threshold`` of all weight at themselves and beyond; in pieces, so of bounded memory."""
    pieces = [np.abs(_weights_at(d, i, min(step, size - i))).sum() for i in range(0, size, step)]
    total, beyond, out = sum(pieces), sum(pieces), 0
    for i, piece in zip(range(0, size, step), pieces, strict=True):
        if (beyond - piece) / total <= threshold:
            w = np.abs(_weights_at(d, i, min(step, size - i)))
            left = np.cumsum(w[::-1])[::-1] + (beyond - piece)
            return out + int((left / total > threshold).sum())
        out, beyond = out + min(step, size - i), beyond - piece
    return out


def difference_expanding(rows: DataFrame, d: float, threshold: float = 0.01, keys: tuple[str, ...] = ("market", "feature"), block: int | None = None) -> DataFrame:
    """(keys, ts_us, y): all weights a row has past for; the first rows, as many as cumulative weight shares exceed the threshold, are skipped.

    A convolution in parts: rows and weights are cut into blocks of ``BLOCK``, whose spectra are made block by block, then dealt by frequency. For a few frequencies a task holds one number of
    each block and convolves the blocks' order; then spectra go back to their blocks. No task holds a series: a block's task 4 numbers a row of it, a frequency's task
    about 4 * ``BLOCK`` / ``SLICES`` numbers a block.
    """
    size = block or BLOCK
    kinds = _kinds(rows, keys)
    by, spectrum = list(keys), f"{kinds}, block long, slice long, re array<double>, im array<double>, wre array<double>, wim array<double>"
    x = F.when(~F.isnan("x"), F.col("x"))
    placed = numbered(rows.select(*by, "ts_us", x.alias("x")), by, ["ts_us"], by_span())
    ends = placed.groupBy(*by).agg(F.min(F.when(F.col("x").isNotNull(), F.col("rn"))).alias("first"), F.count("*").alias("n"), F.min(F.when(F.abs("x") == float("inf"), F.col("rn"))).alias("bad"))
    ends = ends.where("first is not null")
    skips = ends.select(*by, "first", "n", "bad").groupBy(*by).applyInPandas(
        lambda pdf: pdf.assign(skip=[_skipped(d, int(n - f), threshold) for n, f in zip(pdf["n"], pdf["first"], strict=True)]), f"{kinds}, first long, n long, bad long, skip long"
    )
    there = placed.join(skips, by).where("rn >= first").withColumn("pos", F.col("rn") - F.col("first")).withColumn("block", F.floor(F.col("pos") / size))
    last = there.groupBy(*by, "block").agg(F.max_by("x", F.when(F.col("x").isNotNull(), F.col("pos"))).alias("x"))
    earlier = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    there = there.join(last.select(*by, "block", F.last("x", ignorenulls=True).over(earlier).alias("carried")), [*by, "block"])
    edges = np.linspace(0, size + 1, min(SLICES, size + 1) + 1).astype(int)

    def spectra(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, k = pdf.sort_values("pos"), int(pdf["block"].iloc[0])
        own = pdf["x"].to_numpy(float)
        own[:1] = np.where(np.isnan(own[:1]), pdf["carried"].iloc[0], own[:1])
        own = pd.Series(own).ffill().to_numpy()
        signal = np.fft.rfft(np.where(np.isfinite(own), own, 0.0), 2 * size)
        # lags k * size + u, and before them, for u from 1 - size to size - 1
        w = _weights_at(d, max(0, (k - 1) * size), 2 * size if k else size)
        w = np.concatenate([w[size:], w[:size]]) if k else np.concatenate([w, np.zeros(size)])
        own_w = np.fft.rfft(w)
        out = pdf.iloc[[0] * (len(edges) - 1)][[*by, "block"]].assign(slice=range(len(edges) - 1))
        cut = lambda z: [z[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out.assign(re=cut(signal.real), im=cut(signal.imag), wre=cut(own_w.real), wim=cut(own_w.imag))

    def convolved(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        z, w = (np.stack(pdf[a].to_list()) + 1j * np.stack(pdf[b].to_list()) for a, b in (("re", "im"), ("wre", "wim")))
        n = 1 << (2 * len(z) - 1).bit_length()
        y = np.fft.ifft(np.fft.fft(z, n, axis=0) * np.fft.fft(w, n, axis=0), axis=0)[: len(z)] if len(z) > 1 else z * w
        return pdf[[*by, "block", "slice"]].assign(re=list(y.real), im=list(y.imag))

    def back(pdf: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        pdf, parts = pdf.sort_values("pos"), parts.sort_values("slice")
        y = np.fft.irfft(np.concatenate(parts["re"].to_list()) + 1j * np.concatenate(parts["im"].to_list()), 2 * size)[: len(pdf)]
        y = np.where((pdf["rn"] >= pdf["bad"]).to_numpy(), np.nan, y)
        keep = (pdf["pos"] >= pdf["skip"]).to_numpy() & np.isfinite(pdf["x"].to_numpy(float))
        return pdf[[*by, "ts_us"]][keep].assign(y=y[keep])

    parts = there.groupBy(*by, "block").applyInPandas(spectra, spectrum)
    made = parts.groupBy(*by, "slice").applyInPandas(convolved, f"{kinds}, block long, slice long, re array<double>, im array<double>")
    cells = there.select(*[F.col(c).alias(c) for c in (*by, "block", "ts_us", "pos", "rn", "bad", "skip", "x")])
    return cells.groupBy(*by, "block").cogroup(made.groupBy(*by, "block")).applyInPandas(back, f"{kinds}, ts_us long, y double")


def _p_value(tau: float) -> float:
    """MacKinnon's approximate p-value of the test with a constant. The published coefficients."""
    if tau > 2.74:
        return 1.0
    if tau < -18.83:
        return 0.0
    if tau <= -1.61:
        z = 2.1659 + 1.4412 * tau + 0.038269 * tau**2
    else:
        z = 1.7339 + 0.93202 * tau - 0.12745 * tau**2 - 0.010368 * tau**3
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _regress(n: float, xx: np.ndarray, xy: np.ndarray, yy: float) -> tuple[float, float]:
    """(t-value of the first regressor, residual sum of squares) from cross sums; the last regressor is the constant."""
    if n <= len(xy):
        return math.nan, math.nan
    try:
        inverse = np.linalg.inv(xx)
    except np.linalg.LinAlgError:
        return math.nan, math.nan
    beta = inverse @ xy
    rss = max(yy - float(beta @ xy), 0.0)
    se = math.sqrt(max(rss / (n - len(xy)) * inverse[0, 0], 0.0))
    return (float(beta[0]) / se if se else math.nan), rss


_NAMES = ("n", "a", "b", "c", "aa", "ab", "bb", "ac", "bc", "cc")


def _tested(sums: DataFrame, keys: tuple[str, ...], lags: str) -> DataFrame:
    """(keys, tau, lag, p_value) from the cross-moments, a row for each key."""

    def of(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                one = _regress(r.s_n, np.array([[r.s_aa, r.s_ab, r.s_a], [r.s_ab, r.s_bb, r.s_b], [r.s_a, r.s_b, r.s_n]]), np.array([r.s_ac, r.s_bc, r.s_c]), r.s_cc)
                tau, lag = one[0], 1
                if lags == "aic":
                    none = _regress(r.s_n, np.array([[r.s_aa, r.s_a], [r.s_a, r.s_n]]), np.array([r.s_ac, r.s_c]), r.s_cc)
                    aic = [r.s_n * math.log(x / r.s_n) + 2 * k if x > 0 else math.inf for x, k in ((none[1], 2), (one[1], 3))] if r.s_n else [math.inf] * 2
                    if aic[0] <= aic[1]:
                        tau, lag = _regress(r.z_n, np.array([[r.z_aa, r.z_a], [r.z_a, r.z_n]]), np.array([r.z_ac, r.z_c]), r.z_cc)[0], 0
                out.append((None, lag, None) if math.isnan(tau) else (tau, lag, _p_value(tau)))
            yield pdf[list(keys)].assign(tau=[o[0] for o in out], lag=[o[1] for o in out], p_value=[o[2] for o in out])

    return sums.mapInPandas(of, f"{_kinds(sums, keys)}, tau double, lag long, p_value double")


_SHORT = ("n", "a", "c", "aa", "ac", "cc")


def adf(rows: DataFrame, column: str = "x", lags: str = "aic", keys: tuple[str, ...] = ("market", "feature")) -> DataFrame:
    """(keys, tau, lag, p_value): the augmented Dickey-Fuller test with a constant; ``lags`` is "aic" (0 or 1, then refitted on all rows) or "one".

    Spark sums the cross-moments of the level before, the change before and the change, the level less its mean; only these reach the small solver.
    The means are partial sums joined back, so a series is ordered once.
    """
    w = Window.partitionBy(*keys).orderBy("ts_us")
    rows = rows.select(*keys, "ts_us", F.col(column).alias("y")).where(F.abs("y") < float("inf"))
    rows = rows.join(rows.groupBy(*keys).agg(F.avg("y").alias("mean")), list(keys)).withColumn("y", F.col("y") - F.col("mean"))
    rows = rows.withColumn("a", F.lag("y").over(w)).withColumn("c", F.col("y") - F.col("a"))
    rows = rows.withColumn("b", F.lag("c").over(w))
    parts = {"n": F.lit(1.0)} | {k: F.col(k) for k in "abc"} | {x + y: F.col(x) * F.col(y) for x, y in ("aa", "ab", "bb", "ac", "bc", "cc")}
    both, short = F.col("b").isNotNull(), F.col("c").isNotNull()
    sums = rows.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(both, parts[k])), F.lit(0.0)).alias(f"s_{k}") for k in _NAMES],
        *[F.coalesce(F.sum(F.when(short, parts[k])), F.lit(0.0)).alias(f"z_{k}") for k in _SHORT],
    )
    return _tested(sums, keys, lags)


def _moments(y: np.ndarray, shift: float, last: np.ndarray) -> tuple[list[float], np.ndarray]:
    """The cross-moments that values add to those before, of which ``last`` are the last two; levels are less ``shift``."""
    line = np.concatenate([last, y]) - shift
    at = np.arange(len(last), len(line))
    level, change = line, np.diff(line)
    at = at[at >= 2]
    a, b, c = level[at - 1], change[at - 2], change[at - 1]
    pair = {"a": a, "b": b, "c": c}
    s = [float(len(at)), *(float(pair[k].sum()) for k in "abc"), *(float(pair[k[0]] @ pair[k[1]]) for k in _NAMES[4:])]
    return s, np.concatenate([last, y])[-2:]


def d_values(rows: DataFrame, grid: tuple[float, ...] = D_GRID, threshold: float = COARSE, enter: float = ENTER) -> DataFrame:
    """(market, feature, d, p_value) over the grid, of the features whose own p-value exceeds ``enter``. Differences go by segment, the test by market.

    One scan makes all differences of a series and hands on their cross-moments only: a row for each Arrow batch and d.
    """
    first = adf(rows.select("market", "feature", "ts_us", "x"))
    moving = rows.join(first.where(F.col("p_value") > enter).select("market", "feature"), ["market", "feature"], "left_semi")
    w = {d: np.array(weights_fixed(d, threshold)) for d in grid}

    def step(state, pdf: pd.DataFrame):
        state = state or {"segment": None, "series": {}, "shift": dict.fromkeys(grid), "last": {d: np.zeros(0) for d in grid}}
        segments, x, out = pdf["segment"].to_numpy(), pdf["x"].to_numpy(float), []
        edges = [0, *(np.flatnonzero(segments[1:] != segments[:-1]) + 1), len(x)]
        made = {d: [] for d in grid}
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if segments[i] != state["segment"]:
                state["segment"], state["series"] = segments[i], {d: _Series(w[d]) for d in grid}
            for d in grid:
                y = state["series"][d].next(x[i:j])
                made[d].append(y[np.isfinite(y)])
        for d in grid:
            y = np.concatenate(made[d])
            if len(y):
                if state["shift"][d] is None:
                    state["shift"][d] = float(y[0])
                sums, state["last"][d] = _moments(y, state["shift"][d], state["last"][d])
                out.append((d, *sums))
        return state, pd.DataFrame(out, columns=["d", *(f"s_{k}" for k in _NAMES)]).assign(market=pdf["market"].iloc[0], feature=pdf["feature"].iloc[0])[["market", "feature", "d", *(f"s_{k}" for k in _NAMES)]]

    schema = f"{_kinds(rows, ('market', 'feature'))}, d double, " + ", ".join(f"s_{k} double" for k in _NAMES)
    parts = ordered_scan(moving.select("market", "feature", "segment", "ts_us", "x"), ["market", "feature"], ["ts_us"], step, schema)
    sums = parts.groupBy("market", "feature", "d").agg(*[F.sum(f"s_{k}").alias(f"s_{k}") for k in _NAMES], *[F.lit(0.0).alias(f"z_{k}") for k in _SHORT])
    every = moving.select("market", "feature").distinct().crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(d,) for d in grid], "d double")))  # ten rows a series
    tested = _tested(sums, ("market", "feature", "d"), "one").select("market", "feature", "d", "p_value")
    return every.join(tested, ["market", "feature", "d"], "left")


def chosen_d(values: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(market, feature, d): the least d with p_value at or below ``accept``, else 1; a missing p-value counts as accepted."""
    return values.groupBy("market", "feature").agg(F.coalesce(F.min(F.when(F.coalesce("p_value", F.lit(0.0)) <= accept, F.col("d"))), F.lit(1.0)).alias("d"))


def make_stationary(rows: DataFrame, values: DataFrame, threshold: float = COARSE, accept: float = ACCEPT) -> DataFrame:
    """(market, segment, ts_us, feature, x): features without d-values as they are, the others differenced at their chosen d."""
    d = chosen_d(values, accept)
    out = rows.join(d, ["market", "feature"], "left_anti").select("market", "segment", "ts_us", "feature", "x")
    made = difference_fixed(rows.join(d, ["market", "feature"]), "d", threshold, ("market", "segment", "feature"))
    return out.unionByName(made.select("market", "segment", "ts_us", "feature", F.col("y").alias("x")))


def wide_form(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.groupBy("market", "segment", "ts_us").pivot("feature", features).agg(F.first("x"))
