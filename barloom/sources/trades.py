"""Trade tables: ticks from raw rows, batches of chunks, partitioned sinks, and what is still to do.

Ticks are (market, seq, ts_us, price, volume, value); ts_us are microseconds since 1970 in UTC. Order within a market is (ts_us, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([
    T.StructField("market", T.StringType()), T.StructField("chunk_id", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("time", T.DoubleType()), T.StructField("price", T.DoubleType()), T.StructField("volume", T.DoubleType()),
])


def null_nan(c: F.Column) -> F.Column:
    """Missing is null: a NaN would order last and spread through sums."""
    return F.when(~F.isnan(c), c)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw chunks (market, chunk_id, seq, time in unix seconds, price, volume); each file is read once."""
    return spark.read.schema(RAW).parquet(path)


def construct(raw: DataFrame) -> DataFrame:
    """Ticks from raw rows: time in microseconds, value = price * volume."""
    price, volume = null_nan(F.col("price")), null_nan(F.col("volume"))
    return raw.select("market", "seq", F.round(F.col("time") * 1_000_000).cast("long").alias("ts_us"), price.alias("price"), volume.alias("volume"), (price * volume).alias("value"))


def from_events(events: DataFrame) -> DataFrame:
    """The table ``events`` as ticks: types are markets, whole cents are prices, the number in ``props`` sets the volume."""
    price = F.round(F.col("value") * 100) + 100
    volume = F.get_json_object("props", "$.k").cast("double") + 1
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(F.col("event_type").alias("market"), F.col("event_id").alias("seq"), ts.alias("ts_us"), price.alias("price"), volume.alias("volume"), (price * volume).alias("value"))


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """The table ``lineitem`` as ticks with many equal times: flags are markets; whole rows order equal times."""
    ts = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity"))
    seq = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lineitem.select(F.col("l_returnflag").alias("market"), seq.alias("seq"), ts.alias("ts_us"), price.alias("price"), F.col("l_quantity").alias("volume"), (price * F.col("l_quantity")).alias("value"))


def resume(landing: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows of chunks after each market's greatest loaded one; a market not yet loaded comes whole."""
    last = loaded.groupBy("market").agg(F.max("chunk_id").alias("last"))
    return landing.join(last, "market", "left").where(F.col("last").isNull() | (F.col("chunk_id") > F.col("last"))).drop("last")


def since(raw: DataFrame, seconds: int) -> DataFrame:
    """Chunks whose id (nanoseconds) is not before ``seconds``."""
    return raw.where(F.col("chunk_id") >= F.lit(seconds * 1_000_000_000).cast("long"))


def write(df: DataFrame, path: str, by: tuple[str, ...] = ("market",)) -> None:
    """Partitioned Parquet; only the partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def unfinished(markets: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("market",)) -> DataFrame:
    """Rows of markets that have no output yet."""
    return markets.join(done.select(*keys).distinct(), list(keys), "left_anti")
