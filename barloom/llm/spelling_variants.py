"""Spelling variants: words one edit apart, found by permuterm rotations.

Words. Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, of which only A-Z are lower-cased. A run of a document loses one code point if ``ONE_IN`` divides the
crc32 of ``<doc_id>:<run>``: the contract's planted slips. Distinct words of at least ``LEAST`` code points and ``SEEN`` occurrences take part.

Search. Each word, marked by a terminator, is written in all its rotations. A rotation that starts behind the code point i ends with it; without that last code point it is the
word with place i open. Words that share such a key differ in one replaced code point; and a word whose whole rotation is the key is the one that lacks it. Spark sorts all
rotations by the key (a window) and each member is told how many others there are, and the best of them: no pair is written. A key is shared by no more
words than there are letters, so its window is small whatever the table. A code point that repeats its neighbour leaves the same word whichever of them is left out, and only the
first of a run counts.

A word's form is its near word of the largest n (ties: the smallest in code-point order), if that n is at least ``RATIO`` times its own. Forms grow at least by that factor from
step to step, so paths have no circles and are short; roots are found by pointer doubling.

Cases: a null text has no words; a null doc_id counts as the empty string. Repeated rows count each. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import counted, discard, materialize, table

ONE_IN, LEAST, SEEN, RATIO = 97, 5, 3, 2
END = "$"
RUNS = "[A-Za-zÀ-ÿ]+"


def words(docs: DataFrame, one_in: int = ONE_IN, least: int = LEAST, seen: int = SEEN) -> DataFrame:
    """(word, n) of the words that take part; partial counts before the shuffle."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.select("doc", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    runs = runs.withColumn("h", h)
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, CAST(h % length(run) AS INT))"), F.substring("run", at + 2, F.length("run")))
    made = runs.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)
    return made.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seen)


def rotations(counts: DataFrame) -> DataFrame:
    """(key, word, n, open, first): the whole rotations of each word (not open), and those with a place left open; ``first`` where the code point before differs."""
    size = F.length("word")
    at = counts.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    # substring counts from 1: before place i, the code point there, and what follows it
    head, tail = F.expr("substring(word, 1, i)"), F.expr("substring(word, i + 1, length(word))")
    after = F.expr("substring(word, i + 2, length(word))")
    first = (F.col("i") == 0) | (F.expr("substring(word, i + 1, 1)") != F.expr("substring(word, i, 1)"))
    whole = F.struct(F.concat(tail, F.lit(END), head).alias("key"), F.lit(False).alias("open"), F.lit(True).alias("first"))
    gap = F.struct(F.concat(after, F.lit(END), head).alias("key"), F.lit(True).alias("open"), first.alias("first"))
    both = F.when(F.col("i") < F.length("word"), F.array(whole, gap)).otherwise(F.array(whole))
    return at.select("word", "n", F.explode(both).alias("r")).select("r.key", "word", "n", "r.open", "r.first")


def neighbours(counts: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): how many words are one edit away, and the best of them; words without any are left out."""
    group = Window.partitionBy("key")
    ranked = group.orderBy(F.col("n").desc(), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("near"))
    # a whole rotation meets the open ones whose place is the first of its run; an open one meets all other open ones, and the whole one in that case
    opened, opened_first, whole = F.when(F.col("open"), me), F.when(F.col("open") & F.col("first"), me), F.when(~F.col("open"), me)
    told = rotations(counts).select(
        "word", "n", "open", "first",
        F.count(opened).over(group).alias("n_open"), F.count(opened_first).over(group).alias("n_first"), F.count(whole).over(group).alias("n_whole"),
        F.first(opened, True).over(ranked).alias("o1"), F.nth_value(opened, 2, True).over(ranked).alias("o2"),
        F.first(opened_first, True).over(ranked).alias("f1"), F.first(whole, True).over(ranked).alias("w1"),
    )
    meets = F.col("first") & (F.col("n_whole") > 0)
    n_near = F.when(F.col("open"), F.col("n_open") - 1 + F.when(meets, F.lit(1)).otherwise(F.lit(0))).otherwise(F.col("n_first"))
    other = F.when(F.col("o1.near") == F.col("word"), F.col("o2")).otherwise(F.col("o1"))
    best = F.when(F.col("open"), F.least(other, F.when(meets, F.col("w1")))).otherwise(F.col("f1"))
    found = told.select("word", n_near.alias("n_near"), best.alias("best")).where("n_near > 0")
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.minus")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the forms that follow one another. Every round doubles how far a word has looked."""
    now, seen = counted(links.select("word", F.col("form").alias("root")), "variant-roots")
    moved = seen["n"]
    while moved:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        made, seen = counted(step, "variant-roots", F.count_if("moved").alias("moved"))
        discard(now)
        now, moved = made.select("word", "root"), seen["moved"]
        now.written_to = made.written_to
    return now


def variants(docs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word that takes part."""
    counts = materialize(words(docs), "variant-words")
    near = counts.join(neighbours(counts), "word", "left")
    strong = F.col("form_n") >= ratio * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n"))
    near = materialize(near, "variant-near")
    out = near.join(roots(near.where("form is not null")), "word", "left")
    discard(counts)
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
