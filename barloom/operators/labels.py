"""Triple-barrier and trend labels. Bars have unique times within a key; missing t1 means the path runs to the last bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bars import DAY, HOUR
from .ordered import SPAN, asof, numbered
from .stored import materialize

KEYS, FAN, LEVELS = ("market",), 32, 2


def vertical(bars: DataFrame, events: DataFrame, days: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ts_us, t1): the first bar at or after ts_us + days, null near the end."""
    asks = events.select(*keys, "ts_us", (F.col("ts_us") + int(days * DAY)).alias("at"))
    return asof(bars.select(*keys, "ts_us", F.col("ts_us").alias("t1")), asks, list(keys), ["t1"], forward=True).select(*keys, "ts_us", "t1")


def pyramid(bars: DataFrame, keys: tuple[str, ...] = KEYS, span: int = SPAN) -> DataFrame:
    """(keys, level, block, low, high, bar_us): closes of bars at level 0, by their numbers, and the extremes of blocks of ``FAN`` blocks of the level below."""
    rows = numbered(bars.select(*keys, "ts_us", "close"), list(keys), ["ts_us"], F.floor(F.col("ts_us") / span), "block")
    level = rows.select(*keys, F.lit(0).alias("level"), "block", F.col("close").alias("low"), F.col("close").alias("high"), F.col("ts_us").alias("bar_us"))
    out = level
    for k in range(1, LEVELS + 1):
        level = level.groupBy(*keys, F.floor(F.col("block") / FAN).alias("block")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        level = level.select(*keys, F.lit(k).alias("level"), "block", "low", "high", F.lit(None).cast("long").alias("bar_us"))
        out = out.unionByName(level)
    return out


def _cover(first: F.Column, last: F.Column) -> F.Column:
    """Blocks (level, block) that make up the bars from ``first`` to ``last``: bars at both edges, then blocks of each level, and at the top as many as there are."""
    parts, a, b = [], first, last
    run = lambda k, x, y: F.when(x <= y, F.transform(F.sequence(x, y), lambda i: F.struct(F.lit(k).alias("level"), i.alias("block")))).otherwise(F.array().cast("array<struct<level: int, block: bigint>>"))
    for k in range(LEVELS):
        up, down = F.ceil(a / FAN), F.floor((b + 1) / FAN)  # whole blocks of the level above
        whole = up < down
        parts.append(run(k, a, F.when(whole, up * FAN - 1).otherwise(b)))
        parts.append(F.when(whole, run(k, down * FAN, b)).otherwise(F.array().cast("array<struct<level: int, block: bigint>>")))
        a, b = F.when(whole, up).otherwise(F.lit(1)), F.when(whole, down - 1).otherwise(F.lit(0))
    parts.append(run(LEVELS, a, b))
    return F.concat(*parts)


def _touched(bars: DataFrame, events: DataFrame, pt: float, sl: float, bucket: int, keys: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``events`` with sl_us and pt_us. One chain over the events: all that they bring is carried along, and an event without a bar or a touch keeps nulls."""
    tree = materialize(pyramid(bars, keys, bucket))
    places = tree.where("level = 0").select(*keys, F.col("bar_us").alias("ts_us"), "block", F.col("low").alias("p0"))
    on = [*keys, "ts_us", *by]
    more = [c for c in events.columns if c not in on]
    ends = places.groupBy(*keys).agg(F.max("ts_us").alias("last_us"))
    asks = events.select(*on, F.struct(*more).alias("e")).join(places.withColumnRenamed("block", "first"), [*keys, "ts_us"], "left").join(ends, list(keys), "left")
    asks = asof(places.select(*keys, "ts_us", F.col("block").alias("last")), asks.withColumn("at", F.coalesce("e.t1", "last_us")), list(keys), ["last"], span=bucket)
    none = F.array().cast("array<struct<level: int, block: bigint>>")
    span = F.when(F.col("first") <= F.col("last"), _cover(F.col("first"), F.col("last"))).otherwise(none)
    sides = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(f)).alias("width")) for k, f in (("sl", sl), ("pt", pt))])
    ret = lambda c: (F.try_divide(c, "p0") - 1) * F.col("e.side")
    reach = F.col("s.width") * F.col("e.trgt")
    hit = F.when(F.col("s.kind") == "sl", F.least(ret("low"), ret("high")) < -reach).otherwise(F.greatest(ret("low"), ret("high")) > reach)
    # one block for each event and side, at the end a bar
    opened = asks.withColumn("s", F.explode(sides)).withColumn("c", F.explode_outer(F.when(F.col("s.width") > 0, span).otherwise(none)))
    place = F.col("block") * F.pow(F.lit(float(FAN)), F.col("level")).cast("long")  # blocks of a higher level count by their first bar
    for k in range(LEVELS, -1, -1):
        met = opened.select(*on, "e", "s", "p0", "c.*").join(tree, [*keys, "level", "block"], "left")
        first = F.min_by(F.struct("level", "block", "bar_us"), F.when(hit, place)).alias("m")
        found = met.groupBy(*on, "s").agg(F.first("e").alias("e"), F.first("p0").alias("p0"), first)
        if k:
            inner = F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda i: F.struct((F.col("m.level") - 1).alias("level"), (F.col("m.block") * FAN + i).alias("block")))
            opened = found.withColumn("c", F.explode_outer(F.when(F.col("m.level") > 0, inner).when(F.col("m").isNotNull(), F.array(F.struct("m.level", "m.block"))).otherwise(none)))
    out = found.groupBy(*on).agg(F.first("e").alias("e"), *[F.min(F.when(F.col("s.kind") == k, F.col("m.bar_us"))).alias(f"{k}_us") for k in ("sl", "pt")])
    return out.select(*on, "e.*", "sl_us", "pt_us")


def touches(bars: DataFrame, events: DataFrame, pt: float, sl: float, bucket: int = 24 * HOUR, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ts_us, t1, sl_us, pt_us): the first bars below -sl * trgt and above pt * trgt of events (keys, ts_us, t1, trgt, side); factor 0: none.

    An event does not read its path. It asks the extremes of the few blocks that make up its span, opens the first that holds a touch on a side, and goes down level by level. Returns grow
    with prices, so a block's extremes are tested by the very expression that tests a bar.
    """
    return _touched(bars, events, pt, sl, bucket, keys).select(*keys, "ts_us", "t1", "sl_us", "pt_us")


def barrier_events(bars: DataFrame, events: DataFrame, target: DataFrame, width: float | tuple[float, float], min_ret: float | DataFrame, vertical_t1: DataFrame | None = None, side: DataFrame | None = None, bucket: int = 24 * HOUR, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ts_us, t1, trgt[, side]): events whose target exceeds ``min_ret`` (a number, or a table (keys, min_ret)), with their first barrier's time.

    ``width`` is a number for both sides or (profit, stop); without ``side`` it is 1 and the profit width holds for both.
    """
    on = [*keys, "ts_us"]
    rows = events.select(*on).join(target.select(*on, "trgt"), on)
    rows = rows.where(F.col("trgt") > min_ret) if not isinstance(min_ret, DataFrame) else rows.join(min_ret, list(keys)).where("trgt > min_ret").drop("min_ret")
    rows = rows.join(vertical_t1.select(*on, "t1"), on, "left") if vertical_t1 is not None else rows.withColumn("t1", F.lit(None).cast("long"))
    pt, sl = (width, width) if not isinstance(width, tuple) else width
    if side is None:
        rows, sl = rows.withColumn("side", F.lit(1.0)), pt
    else:
        rows = rows.join(side.select(*on, "side"), on)
    out = _touched(bars, rows, pt, sl, bucket, keys).withColumn("t1", F.least("t1", "sl_us", "pt_us")).drop("sl_us", "pt_us")
    return out.drop("side") if side is None else out


def label(bars: DataFrame, barriers: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ts_us, t1, ret, bin): the return over [ts_us, t1] and its sign; with a side, ret is times it and losses are 0. Events without t1 are left out.

    A time off the bars takes the next bar's price.
    """
    rows = barriers.where("t1 is not null")
    # closes that are missing are filled by the next one
    known = bars.where("close is not null")
    for at, name in (("ts_us", "p0"), ("t1", "p1")):
        rows = asof(known.select(*keys, "ts_us", F.col("close").alias(name)), rows.withColumn("at", F.col(at)), list(keys), [name], forward=True).drop("at", "found")
    ret = F.try_divide("p1", "p0") - 1
    if "side" in barriers.columns:
        ret = ret * F.col("side")
        rows = rows.withColumn("ret", ret).withColumn("bin", F.when(F.col("ret") <= 0, 0).otherwise(F.signum("ret")).cast("int"))
    else:
        rows = rows.withColumn("ret", ret).withColumn("bin", F.signum("ret").cast("int"))
    return rows.select(*keys, "ts_us", "t1", "ret", "bin")


def zero_unreached(labels: DataFrame, target: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """bin 0 where the return stays below the target."""
    out = labels.join(target.select(*keys, "ts_us", "trgt"), [*keys, "ts_us"])
    return out.withColumn("bin", F.when(F.abs("ret") < F.col("trgt"), 0).otherwise(F.col("bin")))


def label_counts(bars: DataFrame, events: DataFrame, target: DataFrame, factors: list[float], days: list[float], bucket: int = 24 * HOUR, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(factor, days, zeros, ups, downs): labels of all events for each pair of target factor and holding period.

    The first touches of an event at a factor hold for all periods that last so long, so they are looked up once, for the longest period.
    """
    on = [*keys, "ts_us"]
    rows = events.select(*on).join(target.select(*on, "trgt"), on)
    ahead = F.explode(F.array(*[F.struct(F.lit(float(d)).alias("days"), F.lit(int(d * DAY)).alias("us")) for d in days]))
    asks = rows.select(*on, "trgt", ahead.alias("d")).select(*on, "trgt", "d.days", (F.col("ts_us") + F.col("d.us")).alias("at"))
    ends = asof(bars.select(*keys, "ts_us", F.col("ts_us").alias("v")), asks, list(keys), ["v"], forward=True).where("found")
    ends = materialize(ends.select(*on, "trgt", "days", "v"))
    each = F.explode(F.array(*[F.lit(float(f)) for f in factors]))
    longest = ends.groupBy(*on).agg(F.max("v").alias("t1"), F.first("trgt").alias("trgt")).withColumn("factor", each)
    scaled = longest.select(*on, "factor", "t1", (F.col("factor") * F.col("trgt")).alias("trgt"), F.lit(1.0).alias("side"))
    first = _touched(bars, scaled, 1.0, 1.0, bucket, keys, ("factor",)).select(*on, "factor", "sl_us", "pt_us")
    known = ends.join(first, on).withColumn("at", F.least("sl_us", "pt_us"))
    kind = F.when(F.coalesce(F.col("at") > F.col("v"), F.lit(True)), 0).when(F.col("at") == F.col("sl_us"), -1).otherwise(1)
    count = lambda k: F.sum((kind == k).cast("long"))
    return known.groupBy("factor", "days").agg(count(0).alias("zeros"), count(1).alias("ups"), count(-1).alias("downs"))


def trend_t(bars: DataFrame, horizon: int, column: str = "close", keys: tuple[str, ...] = KEYS) -> F.Column:
    """t-value of the slope of the next ``horizon`` bars against 0, 1, ...; 0 for a perfect or flat fit, null if there are fewer bars."""
    w = Window.partitionBy(*keys).orderBy("ts_us")
    ahead = w.rowsBetween(0, horizon - 1)
    x, y = F.row_number().over(w).cast("double"), F.col(column)
    r = F.corr(x, y).over(ahead)
    t = F.try_divide(r * (horizon - 2) ** 0.5, F.sqrt(F.greatest(1 - r * r, F.lit(0.0))))
    return F.when(F.count(column).over(ahead) == horizon, F.coalesce(F.when(F.abs(r) < 1 - 1e-12, t), F.lit(0.0)))


def trend_labels(bars: DataFrame, events: DataFrame, span: tuple[int, int, int], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ts_us, best_end, horizon_end, t_val, bin): the horizon of ``range(*span)`` whose slope's t-value is largest in size, the first on a tie.

    Events with fewer bars ahead than the longest horizon are left out.
    """
    horizons = list(range(*span))
    w = Window.partitionBy(*keys).orderBy("ts_us")
    rows = bars.select(*keys, "ts_us", "close")
    rows = rows.select("*", *[trend_t(rows, h, keys=keys).alias(f"t{h}") for h in horizons], *[F.lead("ts_us", h - 1).over(w).alias(f"e{h}") for h in horizons])
    rows = rows.join(events.select(*keys, "ts_us"), [*keys, "ts_us"]).where(F.col(f"e{max(horizons)}").isNotNull())
    best = F.array_max(F.array(*[F.struct(F.abs(F.col(f"t{h}")).alias("size"), F.lit(-h).alias("h"), F.col(f"t{h}").alias("t"), F.col(f"e{h}").alias("e")) for h in horizons]))
    return rows.withColumn("b", best).select(*keys, "ts_us", F.col("b.e").alias("best_end"), F.col(f"e{horizons[-1]}").alias("horizon_end"), F.col("b.t").alias("t_val"), F.signum("b.t").cast("int").alias("bin"))
