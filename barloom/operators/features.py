"""Bar features: 7 raw and 279 derived columns.

Rolling figures need a full window of values that are not missing (infinite ones count as missing); deviations are sample deviations. All rolling columns
are made in one pass over chunks of rows that bring the longest window along, at a cost that does not depend on the windows' lengths; the exponential ones are decaying
sums, carried from chunk to chunk. So a market with a third of all bars is many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .events import _kinds, day_returns, ewm_std
from .ordered import chunked, decaying_sums

KEYS = ("market",)
# The periods and pairs of the feature set.
LONG = (5, 10, 20, 50, 100, 200, 500, 1000, 2400)
LAGS = (1, 5, 10, 20, 50, 100, 200, 500)
ATR = (5, 10, 20, 50, 100)
CCI = (2, 5, 10, 20, 50, 100, 200, 500, 1000)
RSI = (2, 5, 10, 20, 50, 100, 200, 500)
PAIRS = ((1, 5), (1, 10), (5, 10), (5, 20), (10, 20), (10, 50), (20, 50), (20, 100), (50, 100), (50, 200), (100, 200), (100, 500), (200, 500), (200, 1000), (500, 1000), (500, 2400))
RAW = ("open", "high", "low", "close", "wavg", "volume", "value")


def np_log(c: F.Column) -> F.Column:
    """Logarithm with log(0) = -Infinity; missing below 0."""
    return F.when(c == 0, F.lit(float("-inf"))).otherwise(F.log(c))


def _finite(c: F.Column) -> F.Column:
    return F.when(F.abs(c) < float("inf"), c)


def _diff(a: F.Column, b: F.Column) -> F.Column:
    """a - b, missing where both are the same infinity."""
    return F.when(~F.isnan(a - b), a - b)


#: name: (column, rows, "mean", "std", "max" or "min", whether all rows must be there)
Rolled = dict[str, tuple[str, int, str, bool]]


def rolled(rows: DataFrame, specs: Rolled, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``rows`` with the rolling columns of ``specs``."""
    sources = sorted({c for c, *_ in specs.values()})

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {c: pdf[c].astype(float).where(np.isfinite(pdf[c].astype(float))) for c in sources}
        made = {name: getattr(own[c].rolling(n, min_periods=n if full else 1), how)() for name, (c, n, how, full) in specs.items()}
        return pd.concat([pdf[[*keys, "ts_us"]], pd.DataFrame(made)], axis=1)

    schema = f"{_kinds(rows, keys)}, ts_us long, " + ", ".join(f"`{name}` double" for name in specs)
    new = chunked(rows.select(*keys, "ts_us", *[F.col(f"`{c}`").cast("double") for c in sources]), list(keys), of, schema, max(n for _, n, *_ in specs.values()) - 1)
    return rows.join(new, [*keys, "ts_us"])


def log_columns(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """ret, the seven logarithms, and the differences of open, high, low and close."""
    w = Window.partitionBy(*keys).orderBy("ts_us")
    out = bars.withColumn("ret", F.try_divide("close", F.lag("close").over(w)) - 1).withColumns({f"log{c}": np_log(F.col(c)) for c in RAW})
    pairs = {"oh": ("open", "high"), "ol": ("open", "low"), "hl": ("high", "low"), "hc": ("high", "close"), "lc": ("low", "close")}
    return out.withColumns({k: _diff(F.col(f"log{a}"), F.col(f"log{b}")) for k, (a, b) in pairs.items()})


def differences(rows: DataFrame, lags: tuple[int, ...] = LAGS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """First differences of the logs of close, wavg, volume and value, second ones of close and wavg, over each lag."""
    w = Window.partitionBy(*keys).orderBy("ts_us")
    name = lambda c, n: "logret" if (c, n) == ("close", 1) else f"{n}_1d{c}"
    rows = rows.withColumns({name(c, n): _diff(F.col(f"log{c}"), F.lag(f"log{c}", n).over(w)) for c in ("close", "wavg", "volume", "value") for n in lags})
    return rows.withColumns({f"{n}_2d{c}": _diff(F.col(f"`{name(c, n)}`"), F.lag(f"`{name(c, n)}`", n).over(w)) for c in ("close", "wavg") for n in lags})


def average_specs(periods: tuple[int, ...] = LONG) -> Rolled:
    of = {"sma": "close", "smah": "high", "smal": "low"}
    return {f"{p}{s}{n}": (f"{p}{c}", n, "mean", True) for p in ("", "log") for s, c in of.items() for n in periods}


def averages(rows: DataFrame, periods: tuple[int, ...] = LONG, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """sma, smah, smal of close, high and low, and of their logs."""
    return rolled(rows, average_specs(periods), keys)


def ranges(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """tr and logtr, true ranges (missing parts left out), and tp, the typical price."""
    w = Window.partitionBy(*keys).orderBy("ts_us")
    for p in ("", "log"):
        high, low, before = F.col(f"{p}high"), F.col(f"{p}low"), F.lag(f"{p}close").over(w)
        rows = rows.withColumn(f"{p}tr", F.greatest(F.abs(_diff(high, low)), F.abs(_diff(high, before)), F.abs(_diff(low, before))))
    return rows.withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)


def spread_specs(periods: tuple[int, ...] = LONG, atr: tuple[int, ...] = ATR, cci: tuple[int, ...] = CCI) -> Rolled:
    out = {f"std{n}": ("logret", n, "std", True) for n in periods} | {f"{p}atr{n}": (f"{p}tr", n, "mean", True) for p in ("", "log") for n in atr}
    return out | {f"tp{how}{n}": ("tp", n, how, True) for how in ("mean", "std") for n in cci}


def channels(rows: DataFrame, cci: tuple[int, ...] = CCI) -> DataFrame:
    """cci: the distance of the typical price from its mean, in deviations."""
    rows = rows.withColumns({f"cci{n}": F.try_divide(F.col("tp") - F.col(f"tpmean{n}"), 0.015 * F.col(f"tpstd{n}")) for n in cci})
    return rows.drop("tp", *[f"tp{how}{n}" for how in ("mean", "std") for n in cci])


def spreads(rows: DataFrame, periods: tuple[int, ...] = LONG, atr: tuple[int, ...] = ATR, cci: tuple[int, ...] = CCI, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """std of logret; true ranges and their averages, plain and of logs; the distance of the typical price from its mean."""
    return channels(rolled(ranges(rows, keys), spread_specs(periods, atr, cci), keys), cci)


def _volatilities(bars: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    of = {"dvol": "ret_close", "dvolh": "ret_high", "dvoll": "ret_low", "dvolwavg": "ret_wavg"}
    return ewm_std(day_returns(bars, "close", "high", "low", "wavg", keys=keys), of, keys=keys)


def daily_volatilities(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """dvol, dvolh, dvoll and dvolwavg."""
    return rows.join(_volatilities(rows, keys), [*keys, "ts_us"], "left")


def _strengths(bars: DataFrame, periods: tuple[int, ...], keys: tuple[str, ...]) -> DataFrame:
    moves = bars.select(*keys, "ts_us", (F.col("close") - F.lag("close").over(Window.partitionBy(*keys).orderBy("ts_us"))).alias("move"))
    move = F.when(~F.isnan("move"), F.col("move"))
    inputs = [F.greatest(m, F.lit(0.0)) for _ in periods for m in (move, -move)]
    sums = decaying_sums(moves, list(keys), inputs, [1 - 1 / n for n in periods for _ in range(2)])

    def of(i: int) -> F.Column:
        up, down = F.col("sums")[2 * i], F.col("sums")[2 * i + 1]  # the weights' sum is common to both means
        return F.when(down > 0, 100 - 100 / (1 + up / down)).when(up > 0, 100.0)

    return sums.select(*keys, "ts_us", *[of(i).alias(f"rsi{n}") for i, n in enumerate(periods)])


def rsi(rows: DataFrame, periods: tuple[int, ...] = RSI, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Relative strength: adjusted exponential means (weight 1/n) of the up and down moves of close; the first bar's move counts as none."""
    return rows.join(_strengths(rows, periods, keys), [*keys, "ts_us"], "left")


def williams_specs(periods: tuple[int, ...] = RSI) -> Rolled:
    return {f"wr{how}{n}": (c, n, how, False) for how, c in (("max", "high"), ("min", "low")) for n in periods}


def williams_of(rows: DataFrame, periods: tuple[int, ...] = RSI) -> DataFrame:
    of = lambda n: F.try_divide(F.col(f"wrmax{n}") - F.col("close"), F.col(f"wrmax{n}") - F.col(f"wrmin{n}")) * 100
    return rows.withColumns({f"wr{n}": of(n) for n in periods}).drop(*williams_specs(periods))


def williams(rows: DataFrame, periods: tuple[int, ...] = RSI, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """wr: the close's distance below the highest high as a share of the range, over up to n bars."""
    return williams_of(rolled(rows, williams_specs(periods), keys), periods)


def crossovers(rows: DataFrame, pairs=PAIRS) -> DataFrame:
    """Differences of two averages; a period of 1 is the price itself."""
    of = {"": ("sma", "close"), "h": ("smah", "high"), "l": ("smal", "low")}
    side = lambda p, s, c, n: F.col(f"{p}{c}") if n == 1 else F.col(f"{p}{s}{n}")
    return rows.withColumns({f"{p}dma{k}{a}-{b}": _diff(side(p, s, c, a), side(p, s, c, b)) for p in ("", "log") for k, (s, c) in of.items() for a, b in pairs})


def extreme_specs(periods: tuple[int, ...] = LONG) -> Rolled:
    return {f"last{k}{n}": (f"log{k}", n, how, True) for k, how in (("high", "max"), ("low", "min")) for n in periods}


def below_and_above(rows: DataFrame, periods: tuple[int, ...] = LONG) -> DataFrame:
    return rows.withColumns({name: _diff(F.col(name), F.col("logclose")) for name in extreme_specs(periods)})


def extremes(rows: DataFrame, periods: tuple[int, ...] = LONG, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Highest log high and lowest log low of n bars, less the log close."""
    return below_and_above(rolled(rows, extreme_specs(periods), keys), periods)


def mass_features(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """All columns: keys, ts_us, 7 raw and 279 derived. One pass for all rolling columns, one of decaying sums each for volatility and strength."""
    bars = bars.select(*keys, "ts_us", *RAW)
    rows = differences(log_columns(bars, keys), keys=keys)
    rows = rolled(ranges(rows, keys), average_specs() | spread_specs() | williams_specs() | extreme_specs(), keys)
    rows = below_and_above(crossovers(williams_of(channels(rows))))
    for more in (_volatilities(bars, keys), _strengths(bars, RSI, keys)):
        rows = rows.join(more, [*keys, "ts_us"], "left")
    return rows
