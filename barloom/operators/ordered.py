"""Work in order within keys: running numbers, bounded chunks, relays of chunks, decaying sums, look-back, and scans with carried state.

No task needs a whole key: rows are numbered within buckets and by the buckets' counts, and chunks of ``CHUNK`` numbers, with as many rows before
them as a calculation looks back, are groups of a bounded size. What is sequential becomes a relay: each chunk says, in one row, what it makes of any state it may be given; only
these rows are scanned in order, which gives each chunk its own start; then all chunks work side by side. A scan deals rows by key and sorts them within partitions, and
Arrow batches stream through, so a task holds one batch and the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import materialize

CHUNK, SPAN = 20_000, 30 * 86_400_000_000
Step = Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame | None]]


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """``step(state, rows)`` gives (state, output) for successive rows of one key; the state is None where a key begins."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for rows in batches:
            if not len(rows):
                continue
            marks = [rows[k].astype(object).where(rows[k].notna(), None).to_numpy() for k in keys]
            change = np.zeros(len(rows), bool)
            change[0] = True
            for m in marks:
                change[1:] |= m[1:] != m[:-1]
            edges = [*np.flatnonzero(change), len(rows)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(m[a] for m in marks)
                if now != key:
                    key, state = now, None
                state, out = step(state, rows.iloc[a:b])
                if out is not None and len(out):
                    yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(of, schema)


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: F.Column, name: str = "rn") -> DataFrame:
    """``df`` with the place, from 0, of each row within its key; ``bucket`` must follow the order."""
    t = df.withColumn("_bucket", bucket)
    counts = t.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    t = t.withColumn("_inner", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    return t.join(counts, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.col("_inner")).drop("_bucket", "_before", "_inner")


def by_span(span: int = SPAN) -> F.Column:
    return F.floor(F.col("ts_us") / span)


def chunked(df: DataFrame, keys: list[str], of: Callable[[pd.DataFrame], pd.DataFrame], schema: str, back: int = 0, chunk: int = CHUNK) -> DataFrame:
    """``of`` applied to rows in order of ``ts_us`` by chunks; it sees up to ``back`` rows before the chunk, and what it gives for those is left out."""
    rows = numbered(df, keys, ["ts_us"], by_span()).withColumn("_own", F.floor(F.col("rn") / chunk))
    last = F.floor((F.col("rn") + back) / chunk)
    rows = rows.withColumn("_chunk", F.explode(F.sequence("_own", last)))

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        mine = (pdf["_own"] == pdf["_chunk"]).to_numpy()
        return of(pdf)[mine] if mine.any() else of(pdf).iloc[:0]

    return rows.groupBy(*keys, "_chunk").applyInPandas(apply, schema)


def relay(df: DataFrame, keys: list[str], order: list[str], bucket: F.Column, summary: tuple[Callable[[pd.DataFrame], dict], str], carry: Callable[[Any, Any], Any], state: tuple[Callable[[Any], list], str], final: tuple[Callable[[pd.DataFrame], pd.DataFrame], str], chunk: int | None = None) -> DataFrame:
    """Sequential work in three passes. ``summary`` makes a chunk's rows, in order, a dict of its columns; ``carry(state, summary row)`` gives the state after the chunk (None
    before the first); ``state`` writes a state as columns; ``final`` sees a chunk's rows with the columns of the state that they start from. The numbered rows are written once."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = materialize(numbered(df, keys, order, bucket).withColumn("_chunk", F.floor(F.col("rn") / (chunk or CHUNK))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1][[*keys, "_chunk"]].assign(**{k: [v] for k, v in summary[0](pdf.sort_values("rn", ignore_index=True)).items()})

    def step(now: Any, pdf: pd.DataFrame):
        starts = []
        for row in pdf.itertuples(index=False):
            starts.append(state[0](now))
            now = carry(now, row)
        names = [x.split()[0] for x in state[1].split(", ")]
        return now, pdf[[*keys, "_chunk"]].assign(**{n: [s[i] for s in starts] for i, n in enumerate(names)})

    summaries = rows.groupBy(*keys, "_chunk").applyInPandas(one, f"{kinds}, _chunk long, {summary[1]}")
    starts = ordered_scan(summaries, keys, ["_chunk"], step, f"{kinds}, _chunk long, {state[1]}")
    return rows.join(starts, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(lambda pdf: final[0](pdf.sort_values("rn", ignore_index=True)), final[1])


def previous(df: DataFrame, keys: list[str], columns: list[str], name: str = "before", span: int = SPAN) -> DataFrame:
    """``df`` with the ``columns`` of the row before by ``ts_us`` as a struct, null for a key's first row: the row before in its bucket of time, or the last of the bucket before."""
    both = F.struct(*[F.col(f"`{c}`") for c in columns])
    rows = df.withColumn("_bucket", F.floor(F.col("ts_us") / span))
    left = rows.groupBy(*keys, "_bucket").agg(F.max_by(both, "ts_us").alias("_last"))
    left = left.select(*keys, "_bucket", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carried"))
    own = F.lag(both).over(Window.partitionBy(*keys, "_bucket").orderBy("ts_us"))
    return rows.withColumn("_own", own).join(left, [*keys, "_bucket"]).withColumn(name, F.coalesce("_own", "_carried")).drop("_bucket", "_own", "_carried")


def asof(values: DataFrame, asks: DataFrame, keys: list[str], columns: list[str], forward: bool = False, span: int = SPAN) -> DataFrame:
    """``asks`` (keys, at, ...) with ``found`` and the columns of the last row of ``values`` (keys, ts_us, ...) at or before ``at``, or ``forward`` the first at or after it.

    Each looks within its own bucket of time; what earlier buckets leave is carried in a table of one row a bucket. Times of ``values`` are unique within a key.
    """
    sign = -1 if forward else 1
    more = [c for c in asks.columns if c not in keys]
    bucket = lambda: F.floor(F.col("_at") / span)
    x = values.select(*keys, (sign * F.col("ts_us")).alias("_at"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_v"), F.lit(0).alias("_kind")).withColumn("_bucket", bucket())
    # what the rows of a bucket leave to all buckets up to the next one that has rows, and to one more at the end, where later asks look
    left = x.groupBy(*keys, "_bucket").agg(F.max_by("_v", "_at").alias("_carried"))
    last = F.max("_bucket").over(Window.partitionBy(*keys))
    until = F.coalesce(F.lead("_bucket").over(Window.partitionBy(*keys).orderBy("_bucket")), F.col("_bucket") + 1)
    left = left.select(*keys, "_carried", last.alias("_last"), (F.col("_bucket") + 1).alias("_from"), until.alias("_until"))
    left = left.select(*keys, "_carried", "_last", F.explode(F.sequence("_from", "_until")).alias("_bucket"))
    ends = left.groupBy(*keys).agg(F.first("_last").alias("_last"))
    a = asks.select(*keys, (sign * F.col("at")).alias("_at"), F.lit(1).alias("_kind"), F.struct(*more).alias("_ask")).withColumn("_bucket", bucket())
    a = a.join(ends, keys, "left").withColumn("_bucket", F.least("_bucket", F.col("_last") + 1)).drop("_last")
    within = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = x.unionByName(a, allowMissingColumns=True).withColumn("_own", F.last("_v", ignorenulls=True).over(within)).where("_kind = 1")
    asked = both.drop("_v").join(left.drop("_last"), [*keys, "_bucket"], "left").withColumn("_v", F.coalesce("_own", "_carried"))
    return asked.select(*keys, "_ask.*", F.col("_v").isNotNull().alias("found"), *[F.col("_v")[c].alias(c) for c in columns])


def _decay(x: np.ndarray, keep: np.ndarray, state: np.ndarray, block: int = 64) -> np.ndarray:
    """Running sums that ``keep`` shrinks at every row; within a block a triangle of powers, from block to block the last sum."""
    age = np.arange(block)[:, None] - np.arange(block)[None, :]
    power = np.where(age[None] >= 0, keep[:, None, None] ** np.maximum(age, 0)[None], 0.0)  # one triangle for each input
    fade = keep[None, :] ** np.arange(1, block + 1)[:, None]
    out = np.empty_like(x)
    for i in range(0, len(x), block):
        n = min(block, len(x) - i)
        out[i : i + n] = np.einsum("jab,bj->aj", power[:, :n, :n], x[i : i + n]) + fade[:n] * state
        state = out[i + n - 1]
    return out


def decaying_sums(df: DataFrame, keys: list[str], inputs: list[F.Column], keep: list[float], name: str = "sums", chunk: int = CHUNK) -> DataFrame:
    """(keys, ts_us, name): an array of sums over the rows up to each, in which input j is multiplied by keep[j] for every row after its own.

    Chunks give their own sums first, one row each; these are carried on from chunk to chunk, and each chunk starts from what came before it.
    """
    decay = np.array(keep)
    rows = df.select(*keys, "ts_us", F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in inputs]).alias("_x"))
    rows = numbered(rows, keys, ["ts_us"], by_span()).withColumn("_chunk", F.floor(F.col("rn") / chunk))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("rn")["_x"].to_list())
        weight = decay[None, :] ** np.arange(len(x) - 1, -1, -1)[:, None]
        return pdf.iloc[:1][[*keys, "_chunk"]].assign(_sum=[(x * weight).sum(axis=0)], _n=len(x))

    def carry(state, pdf: pd.DataFrame):
        out = []
        for own, n in zip(pdf["_sum"], pdf["_n"], strict=True):
            out.append(np.zeros(len(decay)) if state is None else state)
            state = decay**n * out[-1] + np.asarray(own)
        return state, pdf[[*keys, "_chunk"]].assign(_start=out)

    sums = rows.groupBy(*keys, "_chunk").applyInPandas(total, f"{kinds}, _chunk long, _sum array<double>, _n long")
    starts = ordered_scan(sums, keys, ["_chunk"], carry, f"{kinds}, _chunk long, _start array<double>")

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        out = _decay(np.stack(pdf["_x"].to_list()), decay, np.asarray(pdf["_start"].iloc[0]))
        return pdf[[*keys, "ts_us"]].assign(**{name: list(out)})

    return rows.join(starts, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(final, f"{kinds}, ts_us long, {name} array<double>")
