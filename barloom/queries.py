"""Registered queries of the market operators over the driver's tables, and their oracles in DuckDB's SQL.

``events`` is the tick table (types are markets). Hour bars without empty ones are the common input; every fifth bar is an event, with a width that
goes round. Times are microseconds; figures are rounded alike on both sides, and plus 0.0 turns -0.0 into 0.0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import bars as B
from .operators import bets, clean, events, features, folds, importance, labels, stationarity, weights
from .operators.stored import materialize, work_dir
from .plans.jobs import bars_job, features_job, labels_job
from .sources import trades

DAY = B.DAY
QUERIES, ORACLES = {}, {}


def register(oracle: str | None = None):
    def of(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return of


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{c}`"), places) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def r(expr: str, name: str, places: int = 6) -> str:
    return f'round({expr}, {places}) + 0.0 AS "{name}"'


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return trades.from_events(spark.read.parquet(f"{sf}/events.parquet"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return trades.from_lineitem(spark.read.parquet(f"{sf}/lineitem.parquet"))


def hours(spark: SparkSession, sf: str) -> DataFrame:
    return clean.complete(B.time_bars(ticks(spark, sf)))


def stored(b: DataFrame) -> DataFrame:
    """``b`` written once, for queries that read it many times."""
    return materialize(b)


def numbered(b: DataFrame) -> DataFrame:
    return b.withColumn("rn", F.row_number().over(Window.partitionBy("market").orderBy("ts_us")))


def fifth(b: DataFrame) -> DataFrame:
    """(market, ts_us, rn, trgt) of every fifth bar."""
    return numbered(b).where("rn % 5 = 0").select("market", "ts_us", "rn", (F.lit(0.2) + F.col("rn") % 7 * 0.1).alias("trgt"))


def spans(b: DataFrame) -> DataFrame:
    """Labels (market, ts_us, t1): every fifth bar, lasting 3 to 7 bars; the last ones are left out."""
    end = F.lead("ts_us", 3).over(Window.partitionBy("market").orderBy("ts_us"))
    end7 = F.lead("ts_us", 7).over(Window.partitionBy("market").orderBy("ts_us"))
    return numbered(b.withColumn("e3", end).withColumn("e7", end7)).where("rn % 5 = 0 and e7 is not null").select("market", "ts_us", F.when(F.col("rn") % 2 == 0, F.col("e7")).otherwise(F.col("e3")).alias("t1"), "rn")


TICKS = """ticks AS (SELECT market, seq, ts_us, price, volume, price * volume AS value FROM (SELECT event_type AS market, event_id AS seq, epoch_us(ts) AS ts_us,
  round(value * 100) + 100 AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS volume FROM events))"""


def time_sql(step: int, name: str = "all_bars", source: str = "ticks") -> str:
    return f"""made_{name} AS (SELECT market, ts_us - ts_us % {step} AS ts_us, first(price ORDER BY ts_us, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts_us, seq) AS close,
  sum(volume) AS volume, sum(value) AS value, count(*) AS trades FROM {source} GROUP BY 1, 2),
spine_{name} AS (SELECT market, unnest(range(min(ts_us), max(ts_us) + 1, {step})) AS ts_us FROM made_{name} GROUP BY market),
{name} AS (SELECT market, ts_us, open, high, low, close, value / volume AS wavg, coalesce(volume, 0.0) AS volume, coalesce(value, 0.0) AS value, coalesce(trades, 0) AS trades
  FROM spine_{name} LEFT JOIN made_{name} USING (market, ts_us))"""


BARS = f"""{TICKS}, {time_sql(B.HOUR)},
b AS (SELECT market, ts_us, open, high, low, close, wavg, volume, value, row_number() OVER (PARTITION BY market ORDER BY ts_us) AS rn FROM all_bars WHERE open IS NOT NULL),
ev AS (SELECT market, ts_us, rn, 0.2 + rn % 7 * CAST(0.1 AS DOUBLE) AS trgt FROM b WHERE rn % 5 = 0),
lab AS (SELECT market, ts_us, CASE WHEN rn % 2 = 0 THEN e7 ELSE e3 END AS t1, rn FROM (SELECT *, lead(ts_us, 3) OVER w AS e3, lead(ts_us, 7) OVER w AS e7 FROM b WINDOW w AS (PARTITION BY market ORDER BY ts_us)) WHERE rn % 5 = 0 AND e7 IS NOT NULL)"""
BAR_OUT = ", ".join([r("open", "open"), r("high", "high"), r("low", "low"), r("close", "close"), r("wavg", "wavg"), r("volume", "volume"), r("value", "value")])


# --- sources and sinks
@register(f"WITH {TICKS} SELECT * FROM ticks")
def s1_construct_ticks(spark, sf):
    return ticks(spark, sf)


@register(f"WITH {TICKS}, n AS (SELECT market, seq, ts_us, CASE WHEN seq % 97 <> 0 THEN price END AS price, volume FROM ticks) SELECT *, price * volume AS value FROM n")
def s1_construct_from_raw(spark, sf):
    """Chunk files with unix seconds and NaN, written and read as such."""
    path, t = work_dir(spark), ticks(spark, sf)
    price = F.when(F.col("seq") % 97 != 0, F.col("price")).otherwise(float("nan"))
    t.select("market", F.floor(F.col("seq") / 500).alias("chunk_id"), "seq", (F.col("ts_us") / 1e6).alias("time"), price.alias("price"), "volume").write.parquet(path)
    return trades.construct(trades.read_raw(spark, path))


def _raw(spark, sf):
    t = ticks(spark, sf)
    return t.select("market", F.floor(F.col("seq") / 500).alias("chunk_id"), "seq", "price", "volume")


@register(f"WITH {TICKS} SELECT market, seq // 500 AS chunk_id, seq, price, volume FROM ticks WHERE seq // 500 > length(market) % 3")
def s2_resume_after_last_chunk(spark, sf):
    raw = _raw(spark, sf)
    return trades.resume(raw, raw.where(F.col("chunk_id") <= F.length("market") % 3))


@register(f"WITH {TICKS} SELECT market, seq, ts_us, price, volume FROM ticks WHERE ts_us * 1000 >= 1705000000000000000")
def s3_chunks_since(spark, sf):
    raw = ticks(spark, sf).withColumn("chunk_id", F.col("ts_us") * 1000)
    return trades.since(raw, 1_705_000_000).select("market", "seq", "ts_us", "price", "volume")


GAP = 2 * B.HOUR
SEGMENTS = f"seg AS (SELECT *, CAST(sum(far) OVER (PARTITION BY market ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY market ORDER BY ts_us) > {GAP} THEN 1 ELSE 0 END AS far FROM b))"


@register(f"WITH {BARS}, {SEGMENTS} SELECT market, segment, count(*) AS n_bars, min(ts_us) AS first_us, max(ts_us) AS last_us FROM seg GROUP BY 1, 2")
def s4_markets_and_segments(spark, sf):
    rows = clean.segments(hours(spark, sf), GAP)
    return rows.groupBy("market", "segment").agg(F.count("*").alias("n_bars"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@register(f"WITH {BARS} SELECT market, ts_us, {BAR_OUT} FROM b")
def s5_partitioned_sink(spark, sf):
    path = f"{work_dir(spark)}/bars"
    trades.write(hours(spark, sf), path)
    return rounded(spark.read.parquet(path).select("market", "ts_us", *B.COLUMNS))


@register(f"WITH {BARS} SELECT market, count(*) AS n_bars FROM b WHERE market NOT IN (SELECT market FROM b GROUP BY market HAVING count(*) % 2 = 0) GROUP BY market")
def s6_unfinished_markets(spark, sf):
    b = hours(spark, sf)
    done = b.groupBy("market").count().where("count % 2 = 0")
    return trades.unfinished(b, done).groupBy("market").agg(F.count("*").alias("n_bars"))


# --- bars
@register(f"WITH {TICKS}, {time_sql(DAY)} SELECT market, ts_us, {BAR_OUT} FROM all_bars")
def b1_sample_bars(spark, sf):
    return rounded(B.sample(ticks(spark, sf), "tb", DAY))


@register(f"WITH {TICKS}, {time_sql(B.HOUR)} SELECT market, ts_us, {BAR_OUT} FROM all_bars")
def b2_time_bars(spark, sf):
    return rounded(B.time_bars(ticks(spark, sf)))


def tick_sql(n: int, full: bool) -> str:
    own = "true" if full else f"rn % {n} < {n - 1}"
    last = "n // {0}".format(n) if full else f"n // {n} - 1"
    return f"""WITH {TICKS}, t AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ts_us, seq) - 1 AS rn, count(*) OVER (PARTITION BY market) AS n FROM ticks),
x AS (SELECT market, rn // {n} AS bar_no, max(ts_us) AS ts_us, first(price ORDER BY rn) AS open, max(price) FILTER ({own}) AS high, min(price) FILTER ({own}) AS low, last(price ORDER BY rn) AS close,
 coalesce(sum(volume) FILTER ({own}), 0) AS volume, coalesce(sum(value) FILTER ({own}), 0) AS value FROM t WHERE rn // {n} < {last} GROUP BY 1, 2)
SELECT market, bar_no, ts_us, {BAR_OUT.replace('round(wavg', 'round(value / nullif(volume, 0)')} FROM x"""


@register(tick_sql(50, False))
def b3_tick_bars(spark, sf):
    return rounded(B.tick_bars(ticks(spark, sf), 50))


@register(tick_sql(50, True))
def b3_tick_bars_full(spark, sf):
    return rounded(B.tick_bars(ticks(spark, sf), 50, edges="full"))


def reset_sql(counted: str, limit: str, full: bool, as_volume: bool = False, before: str = "") -> str:
    """Bars by a running sum that starts anew after each close, stated as a recursion over row numbers."""
    other = "value" if counted == "volume" or as_volume else "volume"
    carry = "" if full else "UNION ALL SELECT market, rn, bar_no + 1, false, true FROM s WHERE closes"
    sums = f"sum({counted}) FILTER (NOT carry) AS counted, sum({other}) AS other"
    volume, value = ("counted", "other") if counted == "volume" else ("other", "counted")
    return f"""WITH RECURSIVE {TICKS}{before}, t AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ts_us, seq) AS rn, {limit} AS lim FROM {'limited' if before else 'ticks'}),
s AS (SELECT market, rn, CAST(0 AS BIGINT) AS bar_no, {counted} > lim AS closes, CASE WHEN {counted} > lim THEN 0 ELSE {counted} END AS held FROM t WHERE rn = 1
 UNION ALL SELECT t.market, t.rn, s.bar_no + CASE WHEN s.closes THEN 1 ELSE 0 END, s.held + t.{counted} > t.lim, CASE WHEN s.held + t.{counted} > t.lim THEN 0 ELSE s.held + t.{counted} END FROM s JOIN t ON t.market = s.market AND t.rn = s.rn + 1),
p AS (SELECT market, rn, bar_no, closes, false AS carry FROM s {carry}),
x AS (SELECT market, bar_no, max(ts_us) AS ts_us, first(price ORDER BY rn) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY rn) AS close, {sums}, bool_or(closes) AS closed FROM p JOIN t USING (market, rn) GROUP BY 1, 2)
SELECT market, bar_no, ts_us, {BAR_OUT.replace('round(wavg', f'round({value} / {volume}').replace('round(volume', f'round({volume}').replace('round(value,', f'round({value},')} FROM x WHERE closed"""


@register(reset_sql("volume", "500.0", False))
def b4_volume_bars(spark, sf):
    return rounded(B.volume_bars(ticks(spark, sf), 500))


@register(reset_sql("volume", "500.0", True))
def b4_volume_bars_full(spark, sf):
    return rounded(B.volume_bars(ticks(spark, sf), 500, edges="full"))


@register(reset_sql("value", "5000000.0", False, True))
def b5_value_bars(spark, sf):
    return rounded(B.value_bars(ticks(spark, sf), 5e6))


@register(reset_sql("value", "5000000.0", True))
def b5_value_bars_full(spark, sf):
    return rounded(B.value_bars(ticks(spark, sf), 5e6, edges="full"))


def limits_sql(counted: str, window: int) -> str:
    frame = "UNBOUNDED PRECEDING" if not window else f"{window - 1} PRECEDING"
    return f""", {time_sql(B.HOUR)},
g AS (SELECT market, ts_us, {counted} AS x, row_number() OVER (PARTITION BY market ORDER BY ts_us) AS rn FROM all_bars),
m AS (SELECT market, ts_us, mean, row_number() OVER (PARTITION BY market ORDER BY ts_us) - 1 AS k FROM (SELECT market, ts_us, avg(x) OVER w AS mean, count(x) OVER w AS have FROM g WHERE rn > 1 WINDOW w AS (PARTITION BY market ORDER BY ts_us ROWS BETWEEN {frame} AND CURRENT ROW)) WHERE have >= {max(1, window)}),
ti AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ts_us, seq) - 1 AS i FROM ticks),
a AS (SELECT ti.*, coalesce(m.k, 0) AS seen FROM ti ASOF LEFT JOIN m ON ti.market = m.market AND ti.ts_us > m.ts_us),
f AS (SELECT *, least(i + 1, i + min(seen - i) OVER (PARTITION BY market ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS kk FROM a),
limited AS (SELECT f.market, f.seq, f.ts_us, f.price, f.volume, f.value, m.mean FROM f LEFT JOIN m ON f.market = m.market AND f.kk = m.k)"""


@register(reset_sql("volume", "mean", False, before=limits_sql("volume", 0)))
def b6_rolling_volume_bars(spark, sf):
    return rounded(B.rolling_volume_bars(ticks(spark, sf)))


@register(reset_sql("value", "mean", False, before=limits_sql("value", 24)))
def b7_rolling_value_bars(spark, sf):
    return rounded(B.rolling_value_bars(ticks(spark, sf), 24))


@register(
    f"WITH {TICKS}, {time_sql(30 * B.MINUTE)}, c AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY market ORDER BY ts_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM all_bars) "
    f"SELECT market, ts_us, coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, c AS close, volume, {r('coalesce(wavg, c)', 'vwap')}, trades FROM c"
)
def b8_ohlc(spark, sf):
    return rounded(B.ohlc(ticks(spark, sf), 30))


@register(
    f"WITH {TICKS}, moved AS (SELECT market, seq, ts_us + {B.HOUR} AS ts_us, price, volume, value FROM ticks), {time_sql(8 * B.HOUR, source='moved')}, c AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY market ORDER BY ts_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM all_bars) "
    f"SELECT market, ts_us - {B.HOUR} AS ts_us, coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, c AS close, volume, {r('coalesce(wavg, c)', 'vwap')}, trades FROM c"
)
def b8_ohlc_in_zone(spark, sf):
    """Bins of local days; the events' month lies in winter, an hour east of UTC."""
    return rounded(B.ohlc(ticks(spark, sf), 480, zone="Europe/Berlin"))


DAYS = f"""SELECT market, ts_us - ts_us % {DAY} AS ts_us, {', '.join(f'count({c}) AS {c}' for c in B.COLUMNS)} FROM b GROUP BY 1, 2"""


@register(f"WITH {BARS}, made AS ({DAYS}), s AS (SELECT market, unnest(range(min(ts_us), max(ts_us) + 1, {DAY})) AS ts_us FROM made GROUP BY market) SELECT market, ts_us, {', '.join(f'coalesce({c}, 0) AS {c}' for c in B.COLUMNS)} FROM s LEFT JOIN made USING (market, ts_us)")
def b9_bars_per_day(spark, sf):
    return B.per_day(hours(spark, sf))


# --- cleaning
@register(f"WITH {BARS}, {SEGMENTS} SELECT market, ts_us, segment FROM seg")
def c1_gap_segments(spark, sf):
    return clean.segments(hours(spark, sf), GAP).select("market", "ts_us", "segment")


@register(f"WITH {BARS} SELECT market, ts_us, close FROM b WHERE rn > 30")
def c2_trim_warm_up(spark, sf):
    return clean.trim(hours(spark, sf), 30).select("market", "ts_us", "close")


@register(f"WITH {BARS} SELECT market, ts_us, {BAR_OUT} FROM b")
def c3_complete_bars(spark, sf):
    return rounded(hours(spark, sf))


@register("SELECT l_returnflag AS market, epoch_us(l_shipdate) AS ts_us, max(round(l_extendedprice / l_quantity)) AS price FROM lineitem GROUP BY 1, 2")
def c4_keep_last(spark, sf):
    return clean.keep_last(lines(spark, sf), order=("price", "seq")).select("market", "ts_us", "price")


@register(f"WITH {BARS} SELECT market, ts_us, close FROM b WHERE ts_us BETWEEN 1704500000000000 AND 1705500000000000")
def c5_time_range(spark, sf):
    return clean.between(hours(spark, sf), 1_704_500_000_000_000, 1_705_500_000_000_000).select("market", "ts_us", "close")


@register(f"WITH {BARS} SELECT market, ts_us, close FROM b WHERE rn <= 10 UNION ALL SELECT market, ts_us, close FROM b WHERE rn > 20")
def c6_append_segments(spark, sf):
    b = numbered(hours(spark, sf)).select("market", "ts_us", "close", "rn")
    return clean.append(b.where("rn <= 10"), b.where("rn > 20")).drop("rn")


# --- events
def ewm_sql(source: str, column: str, span: int) -> str:
    a = f"(1 - CAST(2 AS DOUBLE) / {span + 1})"
    return f"""ew AS (SELECT market, rn, ts_us, CAST(1 AS DOUBLE) AS w, CAST(1 AS DOUBLE) AS w2, {column} AS s1, {column} * {column} AS s2 FROM {source} WHERE rn = 1
 UNION ALL SELECT x.market, x.rn, x.ts_us, {a} * e.w + 1, {a} * {a} * e.w2 + 1, {a} * e.s1 + x.{column}, {a} * e.s2 + x.{column} * x.{column} FROM ew e JOIN {source} x ON x.market = e.market AND x.rn = e.rn + 1),
vol AS (SELECT market, ts_us, CASE WHEN rn > 1 THEN sqrt(greatest(0, (s2 / w - (s1 / w) * (s1 / w)) * w * w / (w * w - w2))) END AS vol FROM ew)"""


def day_ret_sql(column: str) -> str:
    return f"dr AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ts_us) AS rn FROM (SELECT c.market, c.ts_us, c.{column} / p.{column} - 1 AS ret FROM b c ASOF JOIN b p ON c.market = p.market AND c.ts_us - {DAY} > p.ts_us))"


@register(f"WITH RECURSIVE {BARS}, {day_ret_sql('close')}, {ewm_sql('dr', 'ret', 100)} SELECT market, ts_us, {r('vol', 'vol')} FROM vol")
def e1_daily_volatility(spark, sf):
    return rounded(events.daily_vol(hours(spark, sf)))


def cusum_sql(source: str) -> str:
    up, down = "greatest(0, c.up + x.d)", "least(0, c.down + x.d)"
    return f"""cs AS (SELECT market, rn, ts_us, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, false AS hit FROM {source} WHERE rn = 0
 UNION ALL SELECT x.market, x.rn, x.ts_us, CASE WHEN {down} >= -x.h AND {up} > x.h THEN 0 ELSE {up} END, CASE WHEN {down} < -x.h THEN 0 ELSE {down} END, {down} < -x.h OR {up} > x.h FROM cs c JOIN {source} x ON x.market = c.market AND x.rn = c.rn + 1)
SELECT market, ts_us FROM cs WHERE hit"""


@register(f"WITH RECURSIVE {BARS}, src AS (SELECT market, rn - 1 AS rn, ts_us, CAST(5000 AS DOUBLE) AS h, close - lag(close) OVER (PARTITION BY market ORDER BY ts_us) AS d FROM b), {cusum_sql('src')}")
def e2_cusum_events(spark, sf):
    return events.cusum_events(hours(spark, sf), "close", 5000)


@register(f"WITH RECURSIVE {BARS}, src AS (SELECT market, rn - 1 AS rn, ts_us, CAST(1000 * (1 + rn % 9) AS DOUBLE) AS h, close - lag(close) OVER (PARTITION BY market ORDER BY ts_us) AS d FROM b), {cusum_sql('src')}")
def e3_cusum_events_by_threshold(spark, sf):
    b = numbered(hours(spark, sf))
    return events.cusum_events_by(b, "close", b.select("market", "ts_us", (1000.0 * (1 + F.col("rn") % 9)).alias("h")))


# --- labels
VERTICAL = f"vert AS (SELECT e.market, e.ts_us, (SELECT min(b.ts_us) FROM b WHERE b.market = e.market AND b.ts_us >= e.ts_us + 2 * {DAY}) AS t1 FROM ev e)"
TOUCH = """pth AS (SELECT e.market, e.ts_us, v.t1, e.trgt, p.ts_us AS bar_us, p.close / s.close - 1 AS ret FROM ev e JOIN vert v ON v.market = e.market AND v.ts_us = e.ts_us JOIN b s ON s.market = e.market AND s.ts_us = e.ts_us
  JOIN b p ON p.market = e.market AND p.ts_us >= e.ts_us AND p.ts_us <= coalesce(v.t1, (SELECT max(ts_us) FROM b z WHERE z.market = e.market)) WHERE e.trgt > 0.25),
tch AS (SELECT market, ts_us, any_value(t1) AS t1, any_value(trgt) AS trgt, min(bar_us) FILTER (ret < -trgt) AS sl_us, min(bar_us) FILTER (ret > trgt) AS pt_us FROM pth GROUP BY 1, 2),
bar AS (SELECT market, ts_us, least(t1, sl_us, pt_us) AS t1, trgt FROM tch),
lbl AS (SELECT r.market, r.ts_us, r.t1, e.close / s.close - 1 AS ret, CAST(sign(e.close / s.close - 1) AS INTEGER) AS bin, r.trgt FROM bar r JOIN b s ON s.market = r.market AND s.ts_us = r.ts_us JOIN b e ON e.market = r.market AND e.ts_us = r.t1 WHERE r.t1 IS NOT NULL)"""


def _barriers(spark, sf):
    b = stored(hours(spark, sf))
    e = fifth(b)
    return b, labels.barrier_events(b, e, e, 1.0, 0.25, labels.vertical(b, e, 2.0))


@register(f"WITH {BARS}, {VERTICAL} SELECT market, ts_us, t1 FROM vert")
def l1_vertical_barrier(spark, sf):
    b = hours(spark, sf)
    return labels.vertical(b, fifth(b), 2.0)


@register(f"WITH {BARS}, {VERTICAL}, {TOUCH} SELECT market, ts_us, t1, {r('trgt', 'trgt')} FROM bar")
def l2_barrier_events(spark, sf):
    return rounded(_barriers(spark, sf)[1])


@register(f"WITH {BARS}, {VERTICAL}, {TOUCH} SELECT market, ts_us, t1, sl_us, pt_us FROM tch")
def l3_barrier_touches(spark, sf):
    b = stored(hours(spark, sf))
    e = fifth(b).where("trgt > 0.25").join(labels.vertical(b, fifth(b), 2.0), ["market", "ts_us"]).withColumn("side", F.lit(1.0))
    return labels.touches(b, e, 1.0, 1.0)


@register(f"WITH {BARS}, {VERTICAL}, {TOUCH} SELECT market, ts_us, t1, {r('ret', 'ret')}, bin FROM lbl")
def l4_labels(spark, sf):
    b, e = _barriers(spark, sf)
    return rounded(labels.label(b, e))


@register(f"WITH {BARS}, {VERTICAL}, {TOUCH} SELECT market, ts_us, CASE WHEN abs(ret) < trgt THEN 0 ELSE bin END AS bin FROM lbl")
def l5_zero_unreached(spark, sf):
    b, e = _barriers(spark, sf)
    return labels.zero_unreached(labels.label(b, e), fifth(b)).select("market", "ts_us", "bin")


SIDED = """pth AS (SELECT e.market, e.ts_us, v.t1, e.trgt, CASE WHEN e.rn % 3 = 0 THEN -1.0 ELSE 1.0 END AS side, p.ts_us AS bar_us, p.close / s.close - 1 AS ret FROM ev e JOIN vert v ON v.market = e.market AND v.ts_us = e.ts_us JOIN b s ON s.market = e.market AND s.ts_us = e.ts_us
  JOIN b p ON p.market = e.market AND p.ts_us >= e.ts_us AND p.ts_us <= coalesce(v.t1, (SELECT max(ts_us) FROM b z WHERE z.market = e.market)) WHERE e.trgt > 0.25),
tch AS (SELECT market, ts_us, any_value(t1) AS t1, any_value(trgt) AS trgt, any_value(side) AS side, min(bar_us) FILTER (ret * side < -2 * trgt) AS sl_us, min(bar_us) FILTER (ret * side > trgt) AS pt_us FROM pth GROUP BY 1, 2),
bar AS (SELECT market, ts_us, least(t1, sl_us, pt_us) AS t1, trgt, side FROM tch),
lbl AS (SELECT r.market, r.ts_us, r.t1, (e.close / s.close - 1) * side AS ret, CASE WHEN (e.close / s.close - 1) * side > 0 THEN 1 ELSE 0 END AS bin FROM bar r JOIN b s ON s.market = r.market AND s.ts_us = r.ts_us JOIN b e ON e.market = r.market AND e.ts_us = r.t1 WHERE r.t1 IS NOT NULL)"""


def _sided(spark, sf):
    b = stored(hours(spark, sf))
    e = fifth(b)
    side = e.select("market", "ts_us", F.when(F.col("rn") % 3 == 0, -1.0).otherwise(1.0).alias("side"))
    return b, labels.barrier_events(b, e, e, (1.0, 2.0), 0.25, labels.vertical(b, e, 2.0), side)


@register(f"WITH {BARS}, {VERTICAL}, {SIDED} SELECT market, ts_us, t1, {r('trgt', 'trgt')}, CAST(side AS DOUBLE) AS side FROM bar")
def l2_barrier_events_with_side(spark, sf):
    return rounded(_sided(spark, sf)[1].select("market", "ts_us", "t1", "trgt", "side"))


@register(f"WITH {BARS}, {VERTICAL}, {SIDED} SELECT market, ts_us, t1, {r('ret', 'ret')}, CAST(bin AS INTEGER) AS bin FROM lbl")
def l4_labels_with_side(spark, sf):
    b, e = _sided(spark, sf)
    return rounded(labels.label(b, e))


# The grid of target factors and holding periods.
FACTORS, PERIODS = [0.5, 1.0, 1.5, 2.0], [0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
GRID = " UNION ALL ".join(
    f"SELECT CAST({f} AS DOUBLE) AS factor, CAST({d} AS DOUBLE) AS days, count(*) FILTER (NOT hit OR ret = 0) AS zeros, count(*) FILTER (hit AND ret > 0) AS ups, count(*) FILTER (hit AND ret < 0) AS downs FROM "
    f"(SELECT market, ts_us, bool_or(abs(ret) > {f} * trgt) AS hit, coalesce(arg_min(ret, bar_us) FILTER (abs(ret) > {f} * trgt), arg_max(ret, bar_us)) AS ret FROM (SELECT e.*, p.ts_us AS bar_us, p.close / s.close - 1 AS ret FROM "
    f"(SELECT e.*, (SELECT min(b.ts_us) FROM b WHERE b.market = e.market AND b.ts_us >= e.ts_us + {int(d * DAY)}) AS v, (SELECT min(b.ts_us) FROM b WHERE b.market = e.market AND b.ts_us >= e.ts_us + {int(max(PERIODS) * DAY)}) AS v2 FROM ev e) e "
    f"JOIN b s ON s.market = e.market AND s.ts_us = e.ts_us JOIN b p ON p.market = e.market AND p.ts_us BETWEEN e.ts_us AND e.v) GROUP BY 1, 2)"
    for f in FACTORS for d in PERIODS
)


@register(f"WITH {BARS} {GRID}")
def l6_label_counts(spark, sf):
    b = stored(hours(spark, sf))
    return labels.label_counts(b, fifth(b), fifth(b), FACTORS, PERIODS)


def slope_sql(h: int) -> str:
    f = f"OVER (PARTITION BY market ORDER BY ts_us ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)"
    return f"CASE WHEN count(close) {f} = {h} THEN coalesce(CASE WHEN abs(corr(close, rn) {f}) < 1 - 1e-12 THEN corr(close, rn) {f} * sqrt({h - 2}) / sqrt(1 - corr(close, rn) {f} * corr(close, rn) {f}) END, 0.0) END"


@register(f"WITH {BARS} SELECT market, ts_us, {r(slope_sql(12), 't_val', 4)} FROM b")
def l7_trend_t_value(spark, sf):
    b = hours(spark, sf)
    return rounded(b.select("market", "ts_us", labels.trend_t(b, 12).alias("t_val")), 4)


@register(
    f"WITH {BARS}, t AS (SELECT market, ts_us, rn, {', '.join(f'{slope_sql(h)} AS t{h}, lead(ts_us, {h - 1}) OVER (PARTITION BY market ORDER BY ts_us) AS e{h}' for h in (4, 8, 12))} FROM b), "
    "u AS (SELECT *, greatest(abs(t4), abs(t8), abs(t12)) AS top FROM t WHERE e12 IS NOT NULL AND rn % 5 = 0), "
    "p AS (SELECT *, CASE WHEN abs(t4) = top THEN t4 WHEN abs(t8) = top THEN t8 ELSE t12 END AS t_val, CASE WHEN abs(t4) = top THEN e4 WHEN abs(t8) = top THEN e8 ELSE e12 END AS best_end FROM u) "
    f"SELECT market, ts_us, best_end, e12 AS horizon_end, {r('t_val', 't_val', 4)}, CAST(sign(t_val) AS INTEGER) AS bin FROM p"
)
def l8_trend_labels(spark, sf):
    b = stored(hours(spark, sf))
    return rounded(labels.trend_labels(b, fifth(b), (4, 13, 4)), 4)


# --- weights
CONC = """con AS (SELECT b.market, b.ts_us, b.rn, count(l.ts_us) AS n FROM b LEFT JOIN lab l ON l.market = b.market AND b.ts_us BETWEEN l.ts_us AND l.t1 WHERE b.ts_us BETWEEN (SELECT min(ts_us) FROM lab z WHERE z.market = b.market) AND (SELECT max(t1) FROM lab z WHERE z.market = b.market) GROUP BY 1, 2, 3),
lr AS (SELECT market, ts_us, ln(close / lag(close) OVER (PARTITION BY market ORDER BY ts_us)) AS r FROM b),
wt AS (SELECT l.market, l.ts_us, l.t1, avg(CAST(1 AS DOUBLE) / c.n) AS tw, abs(coalesce(sum(lr.r / c.n), 0)) AS w, coalesce(sum(lr.r), 0) AS ret_sum FROM lab l JOIN con c ON c.market = l.market AND c.ts_us BETWEEN l.ts_us AND l.t1 JOIN lr ON lr.market = c.market AND lr.ts_us = c.ts_us GROUP BY 1, 2, 3),
nw AS (SELECT *, w * count(w) OVER m / sum(w) OVER m AS nw, sum(tw) OVER (PARTITION BY market ORDER BY ts_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(tw) OVER m AS total, (max(ts_us) OVER m - min(ts_us) OVER m) // 86400000000 AS days FROM wt WINDOW m AS (PARTITION BY market))"""


def _weights(spark, sf):
    b = stored(hours(spark, sf))
    return weights.span_weights(b, spans(b))


@register(f"WITH {BARS}, {CONC} SELECT market, ts_us, n FROM con")
def w1_concurrent_labels(spark, sf):
    b = stored(hours(spark, sf))
    return weights.concurrency(b, spans(b))


@register(f"WITH {BARS}, {CONC} SELECT market, ts_us, {r('tw', 'tw')} FROM wt")
def w2_average_uniqueness(spark, sf):
    return rounded(_weights(spark, sf).select("market", "ts_us", "tw"))


@register(f"WITH {BARS}, {CONC} SELECT market, ts_us, {r('w', 'w')}, {r('ret_sum', 'ret_sum')} FROM wt")
def w3_return_weights(spark, sf):
    return rounded(_weights(spark, sf).select("market", "ts_us", "w", "ret_sum"))


@register(f"WITH {BARS}, {CONC} SELECT market, ts_us, {r('nw', 'w')} FROM nw")
def w4_normalised_weights(spark, sf):
    return rounded(weights.normalise(_weights(spark, sf)).select("market", "ts_us", "w"))


@register(f"WITH {BARS}, {CONC} SELECT market, ts_us, {r('greatest(0, 1 - 0.5 + 0.5 / total * cum)', 'decay')} FROM nw")
def w5_time_decay(spark, sf):
    return rounded(weights.time_decay(_weights(spark, sf), 0.5).select("market", "ts_us", "decay"))


@register(f"WITH {BARS}, {CONC} SELECT market, ts_us, {r('greatest(0, 1 - 0.1 * days / 365.0 + 0.1 * days / 365.0 / total * cum)', 'decay')}, {r('nw * greatest(0, 1 - 0.1 * days / 365.0 + 0.1 * days / 365.0 / total * cum)', 'dw')} FROM nw")
def w6_aged_weights(spark, sf):
    return rounded(weights.aged(weights.normalise(_weights(spark, sf)), 10).select("market", "ts_us", "decay", "dw"))


@register(f"WITH {BARS}, {CONC} SELECT market, {r('avg(tw)', 'tw')} FROM wt GROUP BY market")
def w7_mean_uniqueness(spark, sf):
    return rounded(weights.mean_uniqueness(_weights(spark, sf)))


# --- features
COLUMNS: dict[str, str] = {}


def feature_query(name: str, columns: dict[str, str], build, places: int = 4, extra: str = "") -> None:
    """Register columns of bar features with the SQL of each; ``extra`` are further tables from ``b``, the last named x."""
    sql = f"WITH RECURSIVE {BARS}, {LOGS}{extra} SELECT market, ts_us, {', '.join(r(e, c, places) for c, e in columns.items())} FROM x"

    def of(spark, sf):
        return rounded(build(hours(spark, sf)).select("market", "ts_us", *[F.col(f"`{c}`") for c in columns]), places)

    of.__name__ = name
    register(sql)(of)
    COLUMNS.update(columns)


ORDER = "PARTITION BY market ORDER BY ts_us"
LOGS = f"""x0 AS (SELECT *, {', '.join(f'ln({c}) AS log{c}' for c in features.RAW)}, lag(close) OVER ({ORDER}) AS prev FROM b),
x1 AS (SELECT *, logclose - lag(logclose) OVER ({ORDER}) AS logret, greatest(abs(high - low), abs(high - prev), abs(low - prev)) AS tr, greatest(abs(loghigh - loglow), abs(loghigh - ln(prev)), abs(loglow - ln(prev))) AS logtr, (high + low + close) / 3 AS tp FROM x0), x AS (SELECT * FROM x1)"""


def lag_sql(c: str, n: int) -> str:
    return f"lag({c}, {n}) OVER ({ORDER})"


def roll_sql(f: str, c: str, n: int) -> str:
    over = f"OVER ({ORDER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {over} = {n} THEN {f}({c}) {over} END"


AVERAGES = {f"{p}{s}{n}": roll_sql("avg", f"{p}{c}", n) for p in ("", "log") for s, c in {"sma": "close", "smah": "high", "smal": "low"}.items() for n in features.LONG}
feature_query("f1_returns", {"ret": "close / prev - 1"}, features.log_columns)
feature_query("f2_logarithms", {f"log{c}": f"log{c}" for c in features.RAW}, features.log_columns)
feature_query("f3_log_differences", {"oh": "logopen - loghigh", "ol": "logopen - loglow", "hl": "loghigh - loglow", "hc": "loghigh - logclose", "lc": "loglow - logclose"}, features.log_columns)
feature_query(
    "f4_first_differences", {("logret" if (c, n) == ("close", 1) else f"{n}_1d{c}"): f"log{c} - {lag_sql(f'log{c}', n)}" for c in ("close", "wavg", "volume", "value") for n in features.LAGS},
    lambda b: features.differences(features.log_columns(b)),
)
feature_query(
    "f5_second_differences", {f"{n}_2d{c}": f"log{c} - 2 * {lag_sql(f'log{c}', n)} + {lag_sql(f'log{c}', 2 * n)}" for c in ("close", "wavg") for n in features.LAGS},
    lambda b: features.differences(features.log_columns(b)),
)
feature_query("f6_moving_averages", {k: v for k, v in AVERAGES.items() if k[0] == "s"}, lambda b: features.averages(features.log_columns(b)))
feature_query("f7_log_moving_averages", {k: v for k, v in AVERAGES.items() if k[0] == "l"}, lambda b: features.averages(features.log_columns(b)))


def _spreads(b: DataFrame) -> DataFrame:
    return features.spreads(features.differences(features.log_columns(b), (1,)))


feature_query("f8_return_deviations", {f"std{n}": roll_sql("stddev_samp", "logret", n) for n in features.LONG}, _spreads)
feature_query("f9_true_ranges", {"tr": "tr"} | {f"atr{n}": roll_sql("avg", "tr", n) for n in features.ATR}, _spreads)
feature_query("f10_log_true_ranges", {"logtr": "logtr"} | {f"logatr{n}": roll_sql("avg", "logtr", n) for n in features.ATR}, _spreads)
feature_query("f12_channel_index", {f"cci{n}": f"(tp - {roll_sql('avg', 'tp', n)}) / nullif(0.015 * {roll_sql('stddev_samp', 'tp', n)}, 0)" for n in features.CCI}, _spreads)


@register(
    f"WITH RECURSIVE {BARS}, " + ", ".join(
        f"{day_ret_sql(c).replace('dr AS', f'dr_{c} AS', 1)}, {ewm_sql(f'dr_{c}', 'ret', 100).replace('ew ', f'ew_{c} ', 1).replace('FROM ew e', f'FROM ew_{c} e').replace('vol AS (', f'vol_{c} AS (', 1).replace('FROM ew)', f'FROM ew_{c})')}" for c in ("close", "high", "low", "wavg")
    ) + f" SELECT b.market, b.ts_us, {r('vol_close.vol', 'dvol')}, {r('vol_high.vol', 'dvolh')}, {r('vol_low.vol', 'dvoll')}, {r('vol_wavg.vol', 'dvolwavg')} FROM b " + " ".join(f"LEFT JOIN vol_{c} ON vol_{c}.market = b.market AND vol_{c}.ts_us = b.ts_us" for c in ("close", "high", "low", "wavg"))
)
def f11_daily_volatilities(spark, sf):
    return rounded(features.daily_volatilities(hours(spark, sf)).select("market", "ts_us", "dvol", "dvolh", "dvoll", "dvolwavg"))


def rsi_sql(periods: tuple[int, ...]) -> str:
    start = ", ".join(f"CAST(0 AS DOUBLE) AS u{n}, CAST(0 AS DOUBLE) AS d{n}" for n in periods)
    step = ", ".join(f"s.u{n} * (1 - CAST(1 AS DOUBLE) / {n}) + greatest(m.move, 0), s.d{n} * (1 - CAST(1 AS DOUBLE) / {n}) + greatest(-m.move, 0)" for n in periods)
    return f"""mv AS (SELECT market, ts_us, rn, close - lag(close) OVER ({ORDER}) AS move FROM b),
st AS (SELECT market, ts_us, rn, {start} FROM mv WHERE rn = 1 UNION ALL SELECT m.market, m.ts_us, m.rn, {step} FROM st s JOIN mv m ON m.market = s.market AND m.rn = s.rn + 1)"""


@register(f"WITH RECURSIVE {BARS}, {rsi_sql(features.RSI)} SELECT market, ts_us, " + ", ".join(r(f"CASE WHEN d{n} > 0 THEN 100 - 100 / (1 + u{n} / d{n}) WHEN u{n} > 0 THEN 100.0 END", f"rsi{n}", 4) for n in features.RSI) + " FROM st")
def f13_relative_strength(spark, sf):
    return rounded(features.rsi(hours(spark, sf)).select("market", "ts_us", *[f"rsi{n}" for n in features.RSI]), 4)


def wr_sql(n: int) -> str:
    over = f"OVER ({ORDER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(max(high) {over} - close) / nullif(max(high) {over} - min(low) {over}, 0) * 100"


feature_query("f14_williams_range", {f"wr{n}": wr_sql(n) for n in features.RSI}, features.williams)


def dma_sql(p: str) -> dict[str, str]:
    of = {"": ("sma", "close"), "h": ("smah", "high"), "l": ("smal", "low")}
    side = lambda s, c, n: f"{p}{c}" if n == 1 else f"({AVERAGES[f'{p}{s}{n}']})"
    return {f"{p}dma{k}{a}-{b}": f"{side(s, c, a)} - {side(s, c, b)}" for k, (s, c) in of.items() for a, b in features.PAIRS}


feature_query("f15_average_crossovers", dma_sql(""), lambda b: features.crossovers(features.averages(features.log_columns(b))))
feature_query("f16_log_average_crossovers", dma_sql("log"), lambda b: features.crossovers(features.averages(features.log_columns(b))))
feature_query("f17_below_highest", {f"lasthigh{n}": f"{roll_sql('max', 'loghigh', n)} - logclose" for n in features.LONG}, lambda b: features.extremes(features.log_columns(b)))
feature_query("f18_above_lowest", {f"lastlow{n}": f"{roll_sql('min', 'loglow', n)} - logclose" for n in features.LONG}, lambda b: features.extremes(features.log_columns(b)))


VOLATILITIES = ", ".join(
    f"{day_ret_sql(c).replace('dr AS', f'dr_{c} AS', 1)}, {ewm_sql(f'dr_{c}', 'ret', 100).replace('ew ', f'ew_{c} ', 1).replace('FROM ew e', f'FROM ew_{c} e').replace('vol AS (', f'vol_{c} AS (', 1).replace('FROM ew)', f'FROM ew_{c})')}" for c in ("close", "high", "low", "wavg")
)
STRENGTH = ", ".join(r(f"CASE WHEN d{n} > 0 THEN 100 - 100 / (1 + u{n} / d{n}) WHEN u{n} > 0 THEN 100.0 END", f"rsi{n}", 4) for n in features.RSI)


@register(
    f"WITH RECURSIVE {BARS}, {LOGS}, {VOLATILITIES}, {rsi_sql(features.RSI)}, "
    + f"made AS (SELECT market, ts_us, {', '.join(r(c, c, 4) for c in features.RAW)}, {', '.join(r(e, c, 4) for c, e in COLUMNS.items())} FROM x), "
    + f"str AS (SELECT market, ts_us, {STRENGTH} FROM st) "
    + f"SELECT made.*, {r('vol_close.vol', 'dvol', 4)}, {r('vol_high.vol', 'dvolh', 4)}, {r('vol_low.vol', 'dvoll', 4)}, {r('vol_wavg.vol', 'dvolwavg', 4)}, str.* EXCLUDE (market, ts_us) FROM made JOIN str ON str.market = made.market AND str.ts_us = made.ts_us "
    + " ".join(f"LEFT JOIN vol_{c} ON vol_{c}.market = made.market AND vol_{c}.ts_us = made.ts_us" for c in ("close", "high", "low", "wavg"))
)
def f_mass_features(spark, sf):
    return rounded(features.mass_features(hours(spark, sf)), 4)


# --- stationarity
def _long(spark, sf, names=("logclose", "hl", "logvolume")):
    rows = features.log_columns(clean.segments(hours(spark, sf), DAY))
    return stationarity.long_form(rows, list(names), ["market", "segment", "ts_us"])


def lags_sql(d: float, threshold: float, c: str) -> str:
    return " + ".join(f"({w!r}) * {lag_sql(c, k)}" if k else c for k, w in enumerate(reversed(stationarity.weights_fixed(d, threshold))))


FFD = " UNION ALL ".join(f"SELECT market, ts_us, '{c}' AS feature, {r(f'y_{c}', 'y')} FROM (SELECT *, {lags_sql(0.4, 0.01, e)} AS y_{c} FROM x) WHERE y_{c} IS NOT NULL" for c, e in {"logclose": "logclose", "hl": "(loghigh - loglow)", "logvolume": "logvolume"}.items()).replace("lag((loghigh - loglow)", "lag(loghigh - loglow")


@register(f"WITH {BARS}, {LOGS} {FFD}")
def d3_fixed_width_difference(spark, sf):
    return rounded(stationarity.difference_fixed(_long(spark, sf), 0.4, 0.01).select("market", "ts_us", "feature", "y"))


@register(f"WITH {BARS}, {LOGS} {FFD}")
def d2_fixed_weights_as_lags(spark, sf):
    return rounded(stationarity.difference_fixed_lags(_long(spark, sf), 0.4, 0.01).select("market", "ts_us", "feature", "y"))


@register(f"""WITH {BARS}, {LOGS}, q AS (SELECT market, ts_us, rn, logclose, max(rn) OVER (PARTITION BY market) AS n FROM x),
wk AS (WITH RECURSIVE k AS (SELECT 0 AS k, CAST(1 AS DOUBLE) AS w UNION ALL SELECT k + 1, -w / (k + 1) * (CAST(0.5 AS DOUBLE) - k) FROM k WHERE k < 20000) SELECT * FROM k WHERE k < (SELECT max(n) FROM q)),
sh AS (SELECT n, count(*) FILTER (cum / total > 0.05) AS skip FROM (SELECT m.n, sum(abs(w)) OVER (PARTITION BY m.n ORDER BY wk.k DESC) AS cum, sum(abs(w)) OVER (PARTITION BY m.n) AS total FROM (SELECT DISTINCT n FROM q) m JOIN wk ON wk.k < m.n) GROUP BY n)
SELECT a.market, a.ts_us, {r('sum(wk.w * p.logclose)', 'y', 5)} FROM q a JOIN sh ON sh.n = a.n JOIN q p ON p.market = a.market AND p.rn <= a.rn JOIN wk ON wk.k = a.rn - p.rn WHERE a.rn > sh.skip GROUP BY a.market, a.ts_us""")
def d4_expanding_difference(spark, sf):
    rows = _long(spark, sf, ("logclose",))
    return rounded(stationarity.difference_expanding(rows, 0.5, 0.05).select("market", "ts_us", "y"), 5)


ADF_ONE = """SELECT market, feature, count(*) AS n, sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*c) AS ac, sum(b*c) AS bc, sum(c*c) AS cc FROM (SELECT market, feature, a - avg(a) OVER g AS a, b - avg(b) OVER g AS b, c - avg(c) OVER g AS c FROM (SELECT market, feature, ts_us, lag(x) OVER o AS a, x - lag(x) OVER o AS c, lag(x) OVER o - lag(x, 2) OVER o AS b FROM lng WINDOW o AS (PARTITION BY market, feature ORDER BY ts_us)) WHERE b IS NOT NULL WINDOW g AS (PARTITION BY market, feature)) GROUP BY 1, 2"""


@register(
    f"WITH {BARS}, {LOGS}, lng AS (SELECT market, ts_us, 'logclose' AS feature, logclose AS x FROM x UNION ALL SELECT market, ts_us, 'hl', loghigh - loglow FROM x UNION ALL SELECT market, ts_us, 'logvolume', logvolume FROM x), m AS ({ADF_ONE}), "
    "e AS (SELECT *, aa * bb - ab * ab AS det FROM m), f AS (SELECT *, (bb * ac - ab * bc) / det AS beta, (aa * bc - ab * ac) / det AS phi FROM e) "
    f"SELECT market, feature, {r('beta / sqrt((cc - beta * ac - phi * bc) / (n - 3) * bb / det)', 'tau', 4)} FROM f"
)
def d5_unit_root_test(spark, sf):
    return rounded(stationarity.adf(_long(spark, sf), lags="one").select("market", "feature", "tau"), 4)


@register()
def d5_unit_root_p_values(spark, sf):
    return rounded(stationarity.adf(_long(spark, sf)))


# The p-value of a unit-root statistic: a polynomial, then the normal distribution by the series of the error function; beyond 6 it is 0 or 1 to six places.
ERF = "list_sum(list_transform(range(0, 90), lambda n: pow(-1, n) * pow(z / sqrt(2), 2 * n + 1) / (exp(lgamma(n + 1)) * (2 * n + 1))))"
P_VALUE = f"""zed AS (SELECT *, CASE WHEN tau > 2.74 THEN 9.0 WHEN tau < -18.83 THEN -9.0 WHEN tau <= -1.61 THEN 2.1659 + 1.4412 * tau + 0.038269 * tau * tau
  ELSE 1.7339 + 0.93202 * tau - 0.12745 * tau * tau - 0.010368 * tau * tau * tau END AS z FROM stat),
pv AS (SELECT *, CASE WHEN z < -6 THEN 0.0 WHEN z > 6 THEN 1.0 ELSE 0.5 + {ERF} / sqrt(pi()) END AS p FROM zed)"""
STAT = "e AS (SELECT *, aa * bb - ab * ab AS det FROM m), f AS (SELECT *, (bb * ac - ab * bc) / det AS beta, (aa * bc - ab * ac) / det AS phi FROM e), stat AS (SELECT *, beta / sqrt((cc - beta * ac - phi * bc) / (n - 3) * bb / det) AS tau FROM f)"


@register(
    f"WITH {BARS}, {LOGS}, lng AS (SELECT market, ts_us, 'logclose' AS feature, logclose AS x FROM x UNION ALL SELECT market, ts_us, 'hl', loghigh - loglow FROM x UNION ALL SELECT market, ts_us, 'logvolume', logvolume FROM x), m AS ({ADF_ONE}), {STAT}, {P_VALUE} "
    f"SELECT market, feature, {r('p', 'p_value', 5)} FROM pv"
)
def d5_unit_root_p_values_at_one_lag(spark, sf):
    return rounded(stationarity.adf(_long(spark, sf), lags="one").select("market", "feature", "p_value"), 5)


SMALL_GRID = (0.3, 0.6, 1.0)
GRID_SERIES = " UNION ALL ".join(
    f"SELECT market, ts_us, '{c}' || ':' || '{d}' AS feature, y AS x FROM (SELECT market, ts_us, {lags_sql(d, 0.01, c)} AS y FROM x) WHERE y IS NOT NULL" for d in SMALL_GRID for c in ("logclose", "logvolume")
)


@register(f"WITH {BARS}, {LOGS}, lng AS ({GRID_SERIES}), m AS ({ADF_ONE}), {STAT}, {P_VALUE} SELECT market, split_part(feature, ':', 1) AS feature, split_part(feature, ':', 2) AS d, {r('p', 'p_value', 5)} FROM pv")
def d6_d_values_of_a_small_grid(spark, sf):
    """Every feature takes part, whatever its own p-value, and widths are short, so that SQL can follow."""
    return rounded(stationarity.d_values(_long(spark, sf, ("logclose", "logvolume")), SMALL_GRID, 0.01, -1.0), 5).withColumn("d", F.col("d").cast("string"))


@register(
    f"WITH {BARS}, {LOGS}, lng AS ({GRID_SERIES}), m AS ({ADF_ONE}), {STAT}, {P_VALUE}, pick AS (SELECT market, split_part(feature, ':', 1) AS feature, coalesce(min(CASE WHEN p <= 0.0001 THEN CAST(split_part(feature, ':', 2) AS DOUBLE) END), 1.0) AS d FROM pv GROUP BY 1, 2) "
    f"SELECT l.market, p.feature, l.ts_us, {r('l.x', 'x', 5)} FROM lng l JOIN pick p ON l.market = p.market AND l.feature = p.feature || ':' || p.d"
)
def d7_make_stationary_on_a_small_grid(spark, sf):
    rows = _long(spark, sf, ("logclose", "logvolume"))
    made = stationarity.make_stationary(rows, materialize(stationarity.d_values(rows, SMALL_GRID, 0.01, -1.0)), 0.01)
    return rounded(made.where("x is not null").select("market", "feature", "ts_us", "x"), 5)


@register()
def d6_d_values(spark, sf):
    return rounded(stationarity.d_values(_derived(spark, sf)))


def _derived(spark, sf):
    """All columns that mass_features makes, in long form, by market and gap segment."""
    made = features.mass_features(clean.segments(hours(spark, sf), 7 * DAY), ("market", "segment"))
    return materialize(stationarity.long_form(made, _names(made), ["market", "segment", "ts_us"]))


def _names(made):
    return [c for c in made.columns if c not in ("market", "segment", "ts_us")]


@register()
def d7_make_stationary(spark, sf):
    rows = _derived(spark, sf)
    return rounded(stationarity.make_stationary(rows, materialize(stationarity.d_values(rows))))


# --- folds and importance
@register(
    f"WITH {BARS}, tst AS (SELECT market, min(ts_us) + 5 * {DAY} AS f, min(ts_us) + 8 * {DAY} AS l FROM b GROUP BY market) "
    "SELECT a.market, a.ts_us, a.t1 FROM lab a JOIN tst t ON a.market = t.market WHERE NOT (a.ts_us BETWEEN f AND l OR a.t1 BETWEEN f AND l OR (a.ts_us <= f AND l <= a.t1))"
)
def v1_purged_train_times(spark, sf):
    b = hours(spark, sf)
    tests = b.groupBy("market").agg((F.min("ts_us") + 5 * DAY).alias("first_us"), (F.min("ts_us") + 8 * DAY).alias("last_us"))
    return folds.purge(spans(b).drop("rn"), tests)


@register(f"WITH {BARS}, n AS (SELECT market, ts_us, rn, CAST(floor(count(*) OVER (PARTITION BY market) * CAST(0.01 AS DOUBLE)) AS BIGINT) AS s, max(ts_us) OVER (PARTITION BY market) AS last FROM b) SELECT a.market, a.ts_us, coalesce(z.ts_us, a.last) AS until_us FROM n a LEFT JOIN n z ON z.market = a.market AND z.rn = a.rn + a.s")
def v2_embargo_times(spark, sf):
    return folds.embargo(hours(spark, sf).select("market", "ts_us"), 0.01)


@register(
    f"""WITH {BARS}, o AS (SELECT market, ts_us, t1, row_number() OVER w - 1 AS pos, ntile(4) OVER w AS part, count(*) OVER (PARTITION BY market) AS n FROM lab WINDOW w AS (PARTITION BY market ORDER BY ts_us)),
tf AS (SELECT market, part AS fold, min(ts_us) AS s, max(t1) AS e FROM o GROUP BY 1, 2), tg AS (SELECT t.*, (SELECT min(pos) FROM o WHERE o.market = t.market AND o.ts_us >= t.e) AS r FROM tf t)
SELECT o.market, g.fold, o.ts_us, 'test' AS role FROM o JOIN tg g ON o.market = g.market AND o.part = g.fold
UNION ALL SELECT o.market, g.fold, o.ts_us, 'train' FROM o JOIN tg g ON o.market = g.market WHERE o.t1 <= g.s OR coalesce(o.pos >= g.r + floor(o.n * CAST(0.02 AS DOUBLE)), false)"""
)
def v3_purged_folds(spark, sf):
    return folds.purged_folds(spans(hours(spark, sf)), 4, 0.02)


FEATURES = ["hl", "logret", "1_1dvolume", "5_1dclose"]


def _learning(spark, sf):
    """Rows with a label, a weight and four features, and the roles of three folds."""
    b = materialize(hours(spark, sf))
    lab = spans(b)
    made = labels.label(b, lab.drop("rn")).join(weights.normalise(weights.span_weights(b, lab)).select("market", "ts_us", "w"), ["market", "ts_us"])
    rows = features.differences(features.log_columns(b), (1, 5)).select("market", "ts_us", *[F.col(f"`{c}`") for c in FEATURES]).dropna()
    rows = rows.join(made, ["market", "ts_us"]).select("market", "ts_us", F.when(F.col("bin") > 0, 1.0).otherwise(0.0).alias("label"), (F.col("w") + 0.01).alias("weight"), *[F.col(f"`{c}`") for c in FEATURES])
    return materialize(rows), materialize(folds.purged_folds(lab.drop("rn"), 3, 0.01))


def _forest():
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(numTrees=5, maxDepth=4, seed=7)


@register()
def v4_cross_validation(spark, sf):
    rows, roles = _learning(spark, sf)
    s = folds.cross_validate(_forest(), rows, roles, FEATURES)
    return rounded(spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "fold int, score double"))


def _model(rows):
    return _forest().setWeightCol("weight").fit(folds.assembled(rows, FEATURES))


CLUSTERS = {"price": ["hl", "logret", "5_1dclose"], "volume": ["1_1dvolume"]}


@register()
def v5_impurity_importance(spark, sf):
    rows, _ = _learning(spark, sf)
    return rounded(importance.impurity(_model(rows), FEATURES, spark))


GIVEN = """tr AS (SELECT market AS tree, 'hl' AS feature, avg(loghigh - loglow) AS v FROM x GROUP BY 1 UNION ALL SELECT market, 'oc', avg(abs(logopen - logclose)) FROM x GROUP BY 1
  UNION ALL SELECT market, 'size', CASE WHEN length(market) % 2 = 0 THEN avg(logvolume) ELSE 0 END FROM x GROUP BY 1)"""


def _given_trees(spark, sf):
    """A table of importances: each market is a tree, and features are means over its bars, some of them 0."""
    x = features.log_columns(hours(spark, sf))
    values = {"hl": F.avg(F.col("loghigh") - F.col("loglow")), "oc": F.avg(F.abs(F.col("logopen") - F.col("logclose"))), "size": F.when(F.length("market") % 2 == 0, F.avg("logvolume")).otherwise(0.0)}
    made = x.groupBy("market").agg(*[v.alias(k) for k, v in values.items()])
    return made.unpivot(["market"], list(values), "feature", "v").withColumnRenamed("market", "tree")


def importance_sql(rows: str) -> str:
    return f"im AS (SELECT feature, avg(v) AS mean, stddev_samp(v) / sqrt(count(*)) AS std FROM ({rows}) GROUP BY feature) SELECT feature, {r('mean / sum(mean) OVER ()', 'mean')}, {r('std / sum(mean) OVER ()', 'std')} FROM im"


@register(f"WITH {BARS}, {LOGS}, {GIVEN}, {importance_sql('SELECT feature, nullif(v, 0) AS v FROM tr')}")
def v5_importance_of_given_trees(spark, sf):
    return rounded(importance.by_trees(_given_trees(spark, sf)))


@register(f"WITH {BARS}, {LOGS}, {GIVEN}, {importance_sql(chr(39).join(('SELECT CASE WHEN feature = ', 'size', ' THEN ', 'volume', ' ELSE ', 'price', ' END AS feature, sum(nullif(v, 0)) AS v FROM tr GROUP BY tree, 1')))}")
def v8_clustered_importance_of_given_trees(spark, sf):
    table = spark.createDataFrame([("hl", "price"), ("oc", "price"), ("size", "volume")], "feature string, cluster_id string")
    return rounded(importance.by_trees(_given_trees(spark, sf), table))


@register(
    f"WITH {BARS}, g AS (SELECT l.market, ntile(3) OVER (PARTITION BY l.market ORDER BY l.ts_us) AS fold, rn % 2 AS label, (rn % 11 + 1) / CAST(13 AS DOUBLE) AS p, CAST(rn % 4 + 1 AS DOUBLE) AS w FROM lab l) "
    f"SELECT fold, {r('sum(w * ln(CASE WHEN label = 1 THEN p ELSE 1 - p END)) / sum(w)', 'neg_log_loss')}, {r('sum(CASE WHEN label = CAST(p > 0.5 AS INTEGER) THEN w ELSE 0 END) / sum(w)', 'accuracy')} FROM g GROUP BY fold"
)
def v4_scores_of_given_predictions(spark, sf):
    """Scores of test rows of purged folds under stated probabilities, which stand in for a classifier's."""
    from pyspark.ml.functions import array_to_vector

    lab = spans(hours(spark, sf))
    rows = lab.join(folds.purged_folds(lab.drop("rn"), 3).where("role = 'test'"), ["market", "ts_us"]).withColumn("p", (F.col("rn") % 11 + 1) / 13)
    given = rows.select("fold", (F.col("rn") % 2).cast("double").alias("label"), (F.col("p") > 0.5).cast("double").alias("prediction"), array_to_vector(F.array(1 - F.col("p"), F.col("p"))).alias("probability"), (F.col("rn") % 4 + 1).cast("double").alias("weight"))
    out = folds.scores(given, "neg_log_loss", ["fold"]).withColumnRenamed("score", "neg_log_loss").join(folds.scores(given, "accuracy", ["fold"]).withColumnRenamed("score", "accuracy"), "fold")
    return rounded(out.withColumn("fold", F.col("fold").cast("long")))


@register()
def v6_permutation_importance(spark, sf):
    rows, roles = _learning(spark, sf)
    return rounded(importance.permutation(_forest(), rows, roles, FEATURES))


@register()
def v7_single_feature_importance(spark, sf):
    rows, roles = _learning(spark, sf)
    return rounded(importance.alone(_forest(), rows, roles, {f: [f] for f in FEATURES}))


@register()
def v8_clustered_impurity_importance(spark, sf):
    rows, _ = _learning(spark, sf)
    table = spark.createDataFrame([(f, k) for k, fs in CLUSTERS.items() for f in fs], "feature string, cluster_id string")
    return rounded(importance.impurity(_model(rows), FEATURES, spark, table))


@register()
def v9_clustered_permutation_importance(spark, sf):
    rows, roles = _learning(spark, sf)
    return rounded(importance.permutation(_forest(), rows, roles, FEATURES, groups=CLUSTERS))


@register()
def v10_clustered_single_importance(spark, sf):
    rows, roles = _learning(spark, sf)
    return rounded(importance.alone(_forest(), rows, roles, CLUSTERS))


@register()
def v11_orthogonal_features(spark, sf):
    rows = features.log_columns(hours(spark, sf))
    return rounded(importance.orthogonal(rows, ["oh", "ol", "hl", "hc", "logvolume"], ["market", "ts_us"]))


NAMED = ["close", "volume", "value", "wavg"]
PAIRED = [(a, b) for i, a in enumerate(NAMED) for b in NAMED[i + 1 :]]


@register(f"WITH {BARS} " + " UNION ALL ".join(f"SELECT '{a}' AS f1, '{c}' AS f2, {r(f'round(sqrt((1 - corr({a}, {c})) / 2), 5)', 'distance')} FROM b" for a, c in PAIRED))
def v12_correlation_distance(spark, sf):
    return rounded(importance.distance(importance.correlations(hours(spark, sf), NAMED)))


@register(f"WITH {BARS} " + " UNION ALL ".join(f"SELECT '{a}' AS f1, '{c}' AS f2, {r(f'covar_samp({a}, {c}) / 1e6', 'cov', 3)}, {r(f'corr({a}, {c})', 'rho')} FROM b" for a, c in PAIRED))
def v13_covariance(spark, sf):
    b = hours(spark, sf)
    std = b.agg(*[F.stddev_samp(c).alias(c) for c in NAMED]).unpivot([], NAMED, "feature", "std")
    cov = importance.to_covariance(importance.correlations(b, NAMED), std)
    out = cov.join(importance.to_correlation(cov, std), ["f1", "f2"])
    return out.select("f1", "f2", (F.round(F.col("cov") / 1e6, 3) + 0.0).alias("cov"), (F.round("rho", 6) + 0.0).alias("rho"))


# --- bootstrap and bets
@register(f"WITH {BARS} SELECT l.market, l.ts_us AS label_us, b.rn - 1 AS bar_no FROM lab l JOIN b ON b.market = l.market AND b.ts_us BETWEEN l.ts_us AND l.t1")
def q1_indicator(spark, sf):
    b = hours(spark, sf)
    return bets.indicator(b, spans(b)).withColumn("bar_no", F.col("bar_no").cast("long"))


@register(f"WITH {BARS}, {CONC} SELECT market, ts_us AS label_us, {r('tw', 'uniqueness')} FROM wt")
def q2_average_uniqueness(spark, sf):
    b = stored(hours(spark, sf))
    return rounded(bets.average_uniqueness(bets.indicator(b, spans(b))))


@register()
def q3_sequential_bootstrap(spark, sf):
    b = hours(spark, sf)
    return bets.sequential_bootstrap(b, spans(b), 2)


def _signals(spark, sf):
    return spans(hours(spark, sf)).select("market", "ts_us", "t1", ((F.col("rn") % 21 - 10) / 10.0).cast("double").alias("signal"), (F.lit(0.4) + F.col("rn") % 11 * 0.05).alias("prob"), F.when(F.col("rn") % 2 == 0, 1.0).otherwise(-1.0).alias("pred"))


ACTIVE = "pts AS (SELECT market, ts_us AS p_us FROM lab UNION SELECT market, t1 FROM lab), act AS (SELECT p.market, p.p_us AS ts_us, coalesce(avg((l.rn % 21 - 10) / CAST(10 AS DOUBLE)), 0) AS signal FROM pts p LEFT JOIN lab l ON l.market = p.market AND l.ts_us <= p.p_us AND p.p_us < l.t1 GROUP BY 1, 2)"


# The distribution function of the standard normal by the series of the error function, which converges for all that 0.4 <= prob <= 0.9 gives.
SERIES = "list_sum(list_transform(range(0, 60), lambda n: pow(-1, n) * pow(z / sqrt(2), 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))"
SIZED = f"""zs AS (SELECT market, ts_us, t1, CASE WHEN rn % 2 = 0 THEN 1.0 ELSE -1.0 END AS pred, (p - 0.5) / sqrt(p * (1 - p)) AS z FROM (SELECT *, CAST(0.4 AS DOUBLE) + rn % 11 * CAST(0.05 AS DOUBLE) AS p FROM lab)),
sz AS (SELECT market, ts_us, t1, pred * 2 / sqrt(pi()) * {SERIES} AS s FROM zs),
pts AS (SELECT market, ts_us AS p_us FROM lab UNION SELECT market, t1 FROM lab), act AS (SELECT p.market, p.p_us AS ts_us, coalesce(avg(l.s), 0) AS signal FROM pts p LEFT JOIN sz l ON l.market = p.market AND l.ts_us <= p.p_us AND p.p_us < l.t1 GROUP BY 1, 2)"""


@register(f"WITH {BARS}, {SIZED} SELECT market, ts_us, {r('least(1, round_even(signal / CAST(0.05 AS DOUBLE), 0) * CAST(0.05 AS DOUBLE))', 'signal')} FROM act")
def g1_bet_sizes(spark, sf):
    return rounded(bets.bet_sizes(_signals(spark, sf).drop("signal"), 2, 0.05))


@register(f"WITH {BARS}, {ACTIVE} SELECT market, ts_us, {r('signal', 'signal')} FROM act")
def g2_average_active_signals(spark, sf):
    return rounded(bets.active_average(_signals(spark, sf)))


@register(f"WITH {BARS} SELECT market, ts_us, {r('least(1, round_even((rn % 21 - 10) / CAST(10 AS DOUBLE) * 1.5 / 0.25, 0) * 0.25)', 'signal')} FROM lab")
def g3_discrete_signals(spark, sf):
    s = _signals(spark, sf).withColumn("signal", F.col("signal") * 1.5)
    return rounded(bets.discrete(s, 0.25).select("market", "ts_us", "signal"))


# --- jobs
@register(f"WITH {BARS}, {SEGMENTS} SELECT market, segment, ts_us, {BAR_OUT} FROM seg")
def job_a_bars(spark, sf):
    return rounded(bars_job(ticks(spark, sf), "tb", gap_us=GAP).select("market", "segment", "ts_us", *B.COLUMNS))


@register()
def job_b_labels(spark, sf):
    return rounded(labels_job(hours(spark, sf), 0.5, 2.0, 0.5, 10.0))


@register()
def job_c_features(spark, sf):
    b = clean.segments(hours(spark, sf), 7 * DAY)
    return rounded(features_job(b, _names(features.mass_features(b, ("market", "segment"))))[1])
