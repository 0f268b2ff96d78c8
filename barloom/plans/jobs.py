"""Whole jobs: ticks to bars, bars to weighted labels, bars to stationary features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bars, clean, events, features, labels, stationarity, weights
from ..operators.stored import materialize
from ..sources import trades


def bars_job(ticks: DataFrame, method: str, *args, gap_us: int | None = None, **options) -> DataFrame:
    """Bars of all markets, with gap segments if a gap is given."""
    out = bars.sample(ticks, method, *args, **options)
    return clean.segments(clean.complete(out), gap_us) if gap_us else out


def labels_job(b: DataFrame, criterion: float, days: float, target: float, decay: float) -> DataFrame:
    """(market, ts_us, t1, ret, bin, tw, w, dw): events where the log close moves by ``criterion`` daily deviations, barriers at ``target`` of them."""
    b = materialize(b)
    vol = materialize(events.daily_vol(b))
    series = b.select("market", "ts_us", F.log("close").alias("x"))
    e = materialize(events.cusum_events_by(series, "x", vol.select("market", "ts_us", (F.col("vol") * criterion).alias("h"))))
    trgt = vol.select("market", "ts_us", (F.col("vol") * target).alias("trgt"))
    least = vol.groupBy("market").agg((F.min("vol") * target).alias("min_ret"))
    barriers = labels.barrier_events(b, e, trgt, 1.0, least, labels.vertical(b, e, days))
    made = materialize(labels.label(b, barriers))
    w = weights.aged(weights.normalise(weights.span_weights(b, made)), decay)
    return made.join(w.select("market", "ts_us", "tw", "w", "dw"), ["market", "ts_us"])


def features_job(b: DataFrame, names: list[str], grid: tuple[float, ...] = stationarity.D_GRID) -> tuple[DataFrame, DataFrame]:
    """(d-values, stationary features in long form) of the named features, by market and gap segment; ``b`` has a segment."""
    made = features.mass_features(b, ("market", "segment"))
    rows = materialize(stationarity.long_form(made, names, ["market", "segment", "ts_us"]))
    values = materialize(stationarity.d_values(rows, grid))
    return values, stationarity.make_stationary(rows, values)


def label_grid_job(b: DataFrame, grid: list[tuple[float, float, float, float]], path: str) -> list[tuple[float, float, float, float]]:
    """Labels of bars ``b`` for each (criterion, days, target, decay) of ``grid``, below ``path`` by these and the market; those that are there stay. What was made."""
    spark, names = b.sparkSession, ("criterion", "days", "target", "decay")
    b, made = materialize(b), []
    for parameters in grid:
        part = path.rstrip("/") + "".join(f"/{k}={float(v)}" for k, v in zip(names, parameters, strict=True))
        place = spark._jvm.org.apache.hadoop.fs.Path(part)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            trades.write(labels_job(b, *parameters), part)
            made.append(parameters)
    return made
