"""Mixing sources to target weights: a low-discrepancy schedule of slots over the sources' streams of equal-token blocks. DataFrame functions only.

Sizes are words, ``[^\\x20\\x09-\\x0D]+``. Sources by code point, null last, weigh 5, 2, 1, repeating; together they get 150 % of all sizes.
A target stops at twice its source's size; the excess is shared again by weight until none is above.

Schedule. The mix is a row of slots of one block each. A block has the same number of words in the whole mix: the total of the targets over
``SLOTS``, but at least one word and at most ``BLOCK``. Slot i maps the golden-ratio point frac((i + 1/2) * phi) through the cumulative targets to a source, and a
source's slots are ranked. A source's documents, shuffled by the MD5 of their id, form a stream of words that is read at most twice; its block r,
the words from r to r + 1 times the block, goes to its slot of rank r. So a source takes its number of slots times the block, which the points' low
discrepancy brings within a few blocks of its target (a block is at most 1 / ``SLOTS`` of the mix), spread evenly over the schedule. A block that
would read a stream a third time is cut there.

Scale. Sources are ranked by ranges of their names and slots by ranges of their numbers; running sums over a source go by ranges of the MD5 of at most about ``RANGE``
documents, then over the ranges. So no task holds a source, all sources or all slots. Shares are made equal by passes of sums over the sources.
Texts are read once, after a count of the rows: it sets the number of ranges and of the tasks, and so files, of what is written. Blocks are matched with slots as the result is read.

Cases: a null text has no words; a document or source without words takes 0; null is a source; null ids shuffle as the empty string; repeated
rows take their own places, in any order as they are equal; no rows or no words: no slots, all 0. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import counted, discard, fitted, materialize, table

SLOTS, BLOCK, RANGE, SHARE, REPEATS, CELLS = 1 << 16, 4096, 1000, 1.5, 2, 1024
WEIGHTS = (5, 2, 1)
PHI = 0.6180339887498949


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, place): place orders a source's documents."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), place.alias("place"))


def _within(of: list[str], order: list, value: F.Column) -> F.Column:
    """The sum of ``value`` over the rows before each within ``of``."""
    return F.sum(value).over(Window.partitionBy(*of).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - value


def _earlier(rows: DataFrame, of: list[str], part: str, value: F.Column) -> DataFrame:
    """(of, part, _earlier): the sum of ``value`` over the parts before each within ``of``."""
    totals = rows.groupBy(*of, part).agg(F.sum(value).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*of).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(*of, part, F.coalesce(earlier, F.lit(0)).alias("_earlier"))


def _before(rows: DataFrame, of: list[str], part: str, order: list, value: F.Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before each within ``of``: within its part, plus the parts before."""
    within = rows.withColumn("_within", _within([*of, part], order, value)).join(_earlier(rows, of, part, value), [*of, part])
    return within.withColumn(name, F.col("_earlier") + F.col("_within")).drop("_within", "_earlier")


def laid(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, source, size, part, within) as a written table, and the number of rows: part is a row's range of places, within the words before it in its source's range."""
    n = docs.count()
    part = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * -(-n // RANGE) / F.lit(2**32)).cast("long")
    rows = sized(docs).withColumn("part", part).withColumn("within", _within(["source", "part"], ["place", "doc_id", "size"], F.col("size")))
    return materialize(fitted(rows.drop("place"), n), "mix-rows"), n


def targets(sizes: DataFrame, n: int, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(sid, source, n_docs, source_size, weight, target, low, high): one row for each source; sid counts them by code point, low and high bound its share of the mix.
    ``n``: the rows of ``sizes``, and so the most that the sources can be.

    A source whose share of what is left exceeds its cap stays at the cap; the rest is shared again until no source is above.
    """
    by = F.col("source").asc_nulls_last()
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    per = materialize(fitted(per.repartitionByRange(by).withColumn("part", F.spark_partition_id()), n), "mix-sources")
    ranked = _before(per, [], "part", [by], F.lit(1), "sid").withColumn("sid", F.col("sid").cast("long"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int")).cast("long")
    ranked = fitted(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats), n)
    ranked, seen = counted(ranked, "mix-ranked", F.sum("source_size").alias("words"))
    total, level, capped = (seen["words"] or 0) * share, 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        r = ranked.agg(F.sum(F.when(above, F.col("cap"))).alias("cap"), F.sum(F.when(~above, F.col("weight"))).alias("weight"), F.count_if(above).alias("n")).first()
        if r.n == capped or not r.weight:
            break
        capped, level = r.n, (total - (r.cap or 0)) / r.weight
    level = F.lit(level) if r.weight else F.lit(float("inf"))
    goals = ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.when(F.col("cap") > 0, level * F.col("weight")).otherwise(0.0)))
    placed = _before(goals, [], "part", ["sid"], F.col("target"), "upto")
    whole = F.lit(goals.agg(F.sum("target").alias("t")).first().t or 0.0)
    low, high = F.col("upto") / whole, (F.col("upto") + F.col("target")) / whole
    out = placed.select("sid", "source", "n_docs", "source_size", "weight", "target", F.when(whole > 0, low).alias("low"), F.when(whole > 0, high).alias("high"))
    out = materialize(fitted(out, n), "mix-targets")
    discard(per, ranked)
    return out


def block_size(words: float, slots: int = SLOTS, most: int = BLOCK) -> int:
    """Words in each block of a mix of so many words."""
    return max(1, min(most, int(words // slots)))


def schedule(per_source: DataFrame, slots: int, n_sources: int) -> DataFrame:
    """(sid, slot, rank) of the slots 0 to ``slots`` - 1."""
    cells = max(CELLS, 4 * n_sources)
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1)).cast("int")
    bounds = per_source.where("low < high").select("sid", "low", "high").withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    points = per_source.sparkSession.range(slots).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 0.5) * F.lit(PHI), F.lit(1.0)).alias("u"))
    drawn = points.withColumn("cell", cell(F.col("u"))).join(bounds, "cell").where("low <= u and u < high").select("sid", "slot", F.floor(F.col("slot") / RANGE).alias("part"))
    ranked = _before(drawn, ["sid"], "part", ["slot"], F.lit(1), "rank")
    return ranked.select("sid", "slot", F.col("rank").cast("long").alias("rank"))


def streams(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Each row of ``laid`` with its source's columns and ``start``, the words before it in its source's shuffled stream."""
    rows = rows.join(per_source, rows["source"].eqNullSafe(per_source["source"])).drop(per_source["source"])
    placed = rows.join(_earlier(rows, ["sid"], "part", F.col("size")), ["sid", "part"])
    return placed.withColumn("start", F.col("_earlier") + F.col("within")).drop("_earlier", "within")


def mixture(placed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """(slot, sid, rank, reading, doc_id, start, words): the blocks of the mix in pieces of documents; read by slot and start they are the mix."""
    reading = F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("reading")
    part = placed.where("size > 0").select("doc_id", "sid", "start", "size", "source_size", reading)
    part = part.withColumn("a", F.col("start") + F.col("reading") * F.col("source_size")).withColumn("b", F.col("a") + F.col("size"))
    part = part.withColumn("rank", F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(b - 1) div {block}"))))
    words = F.least("b", (F.col("rank") + 1) * block) - F.greatest("a", F.col("rank") * block)
    return part.withColumn("words", words).join(slots, ["sid", "rank"]).select("slot", "sid", "rank", "reading", "doc_id", "start", "words")


def mix(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row."""
    rows, n = laid(docs)
    per_source = targets(rows, n)
    seen = per_source.agg(F.count("*").alias("n"), F.sum("target").alias("words")).first()
    placed = streams(rows, per_source)
    block = block_size(seen.words or 0.0, slots)
    count = int(-(-(seen.words or 0.0) // block))
    drawn = schedule(per_source, count, seen.n)
    taken = mixture(placed, drawn, block).groupBy("sid", "start").agg(F.sum("words").alias("words"))
    out = fitted(placed.join(taken, ["sid", "start"], "left"), REPEATS * n + count)  # as many pieces may be joined: each begins with a document or a block
    return out.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("words", F.lit(0))).otherwise(0).cast("long").alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap FROM per
), levels AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS k,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(CAST(sum(cap) OVER w AS DOUBLE), 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), flat AS (SELECT arg_min(level, k) AS level FROM levels WHERE level * weight <= cap),
goals AS (
  SELECT l.sid, l.source, l.source_size, least(CAST(l.cap AS DOUBLE), coalesce(f.level * l.weight, CAST(l.cap AS DOUBLE))) AS target FROM levels l LEFT JOIN flat f ON true
), edges AS (
  SELECT *, sum(target) OVER (ORDER BY sid) / sum(target) OVER () AS high, (sum(target) OVER (ORDER BY sid) - target) / sum(target) OVER () AS low FROM goals
), whole AS (
  SELECT sum(target) AS words, greatest(1, least(4096, CAST(floor(sum(target) / 65536) AS BIGINT))) AS block FROM goals
), points AS (
  SELECT ((i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS u FROM (SELECT unnest(range(CAST(ceil(words / block) AS BIGINT))) AS i FROM whole)
), slots AS (
  SELECT e.sid, count(*) AS n FROM edges e JOIN points p ON e.low <= p.u AND p.u < e.high GROUP BY e.sid
), placed AS (
  SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, g.source_size, g.target, coalesce(n, 0) * (SELECT block FROM whole) AS t,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS b
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN slots ON slots.sid = g.sid
)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(b, t) - (b - size)) + greatest(0, least(b + source_size, t) - (b - size + source_size)) AS BIGINT) AS taken
FROM placed
"""
