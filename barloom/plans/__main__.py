"""Jobs from the command line: ``python -m barloom.plans bars|labels|features --input FOLDER --output FOLDER ...``; tables are Parquet."""

from __future__ import annotations

import argparse
from itertools import product

from pyspark.sql import SparkSession

from ..operators import clean
from ..operators.bars import DAY, METHODS
from ..operators.features import mass_features
from ..sources import trades
from . import jobs


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="barloom.plans")
    kinds = out.add_subparsers(dest="job", required=True)
    for name, text in (("bars", "raw chunks to bars by market"), ("labels", "bars to weighted labels, for every combination of the parameters"), ("features", "bars to d-values and stationary features")):
        job = kinds.add_parser(name, help=text)
        job.add_argument("--input", required=True)
        job.add_argument("--output", required=True)
        if name == "bars":
            job.add_argument("--method", default="time", choices=sorted(METHODS))
            job.add_argument("--limit", type=float, help="ticks, volume or value of a bar; microseconds of a time bar")
        elif name == "labels":
            for option, value in (("--criterion", 2.0), ("--days", 5.0), ("--target", 2.0), ("--decay", 10.0)):
                job.add_argument(option, type=float, nargs="+", default=[value])
        else:
            job.add_argument("--gap-days", type=float, default=7.0, help="a longer gap starts a segment")
            job.add_argument("--names", nargs="*", help="features; all if none are named")
    return out


def run(spark: SparkSession, arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    if a.job == "bars":
        limit = [] if a.limit is None else [int(a.limit) if METHODS[a.method] in (METHODS["time"], METHODS["tick"]) else a.limit]
        trades.write(jobs.bars_job(trades.construct(trades.read_raw(spark, a.input)), a.method, *limit), a.output)
    elif a.job == "labels":
        jobs.label_grid_job(spark.read.parquet(a.input), list(product(a.criterion, a.days, a.target, a.decay)), a.output)
    else:
        b = clean.segments(clean.complete(spark.read.parquet(a.input)), int(a.gap_days * DAY))
        names = a.names or [c for c in mass_features(b, ("market", "segment")).columns if c not in ("market", "segment", "ts_us")]
        values, made = jobs.features_job(b, names)
        values.write.mode("overwrite").parquet(f"{a.output}/d_values")
        trades.write(made, f"{a.output}/stationary")


if __name__ == "__main__":
    run(SparkSession.builder.appName("barloom").getOrCreate())
