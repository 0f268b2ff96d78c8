"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that reveal what they find. DataFrame functions only.

Base kinds (leftmost non-overlapping, failing matches dropped, no retries): ``email``; ``ip`` with parts up to 255; ``card`` of 14 to 19 digits that
pass Luhn's test; ``phone`` of 10 to 15 digits.

Method. Every base match is a protected entity e, by kind and normalised value: digits of cards and phone numbers, small letters of emails, parts
of addresses without leading zeros. Terms are lower-case runs of 3 or more letters. All counts are of distinct texts: n(e,t) of those with t
within ``WINDOW`` characters of e, n(e) and n(t) of those with e and with t at all, N of all. What t reveals of e is their pointwise mutual
information in bits, log2(p(e|t) / p(e)), out of the log2(1 / p(e)) bits that there are to learn, with p(e) = n(e) / N and p(e|t) smoothed towards it:
(n(e,t) + ``PRIOR`` p(e)) / (n(t) + ``PRIOR``). So a single text is weaker evidence, but no entity is too rare to have terms. A term that leaves
``LEFT`` bits or fewer of an entity to learn (at 1.6, whoever reads the term guesses the entity with a chance of a third) is removed: each of its occurrences in any
document is a span of kind ``term``. The bits left, unlike their share of all, do not depend on how large the corpus is.

No text passes through a shuffle while the tables of terms are small: they are broadcast behind a count of their rows, and joined through shuffles beyond it.
Repeated texts are told by digest and counted once. Texts that make up more than one in ``HOT`` of the rows, of which there are fewer than ``HOT``, are joined to
their rows by a broadcast of that proven size.

Matches' positions come from the lengths of the pieces that the same pattern splits the text into.
Possessive repeats and the guard before a run keep the patterns linear and do not change what they match: a run's first character always matches if a
later one does.

Cases: a null text counts as empty: no spans, and the digest of the empty string. Null ids stay null. Repeated rows are found each and count once in
n(e,t), n(e), n(t) and N; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import counted, discard, materialize, small, table

WINDOW, PRIOR, LEFT, HOT, CHUNK = 80, 1.0, 1.6, 1000, 256
KINDS = ("email", "ip", "card", "phone", "term")
# What may stand in a text at all if the kind does, the pattern, and the test of a match v.
PATTERNS = {
    "email": ("contains(t, '@')", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    "ip": ("t rlike '[0-9]'", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "forall(split(v, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', substr(ltrim('0', p), 1, 3)) as int) <= 255)"),
    "card": (
        "t rlike '[0-9]'", r"[0-9](?:[\x20-]?[0-9])++",
        "length(regexp_replace(v, '[ -]', '')) between 14 and 19 and exists(array(regexp_replace(v, '[ -]', '')), d -> aggregate(sequence(1, length(d)), 0, (a, i) -> a + "
        "if((length(d) - i) % 2 = 1, cast(substr(d, i, 1) as int) * 2 - if(substr(d, i, 1) > '4', 9, 0), cast(substr(d, i, 1) as int))) % 10 = 0)",
    ),
    "phone": ("contains(t, '+')", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(v, '[^0-9]', '')) between 10 and 15"),
}
TERM = r"\p{L}{3,}"
# Forms of one value, by kind k, become one entity.
NORMAL = r"case w.k when 0 then lower(w.v) when 1 then regexp_replace(w.v, '(?<![0-9])0+(?=[0-9])', '') else regexp_replace(w.v, '[^0-9]', '') end"
_SPAN = "struct<s: int, k: int, e: int, v: string>"


def placed(text: str, pattern: str, kind: int) -> str:
    """SQL of all matches of ``pattern`` in ``text`` with their places, as an array of spans; summed in chunks, so the cost is linear."""
    one = f"named_struct('s', b.pos + length(x.p), 'k', {kind}, 'e', b.pos + length(x.p) + length(x.m), 'v', x.m)"
    inner = f"aggregate(c, named_struct('pos', a.pos, 'out', cast(array() as array<{_SPAN}>)), (b, x) -> named_struct('pos', b.pos + length(x.p) + length(x.m), 'out', concat(b.out, array({one}))))"
    outer = f"aggregate(cs, named_struct('pos', 0, 'out', cast(array() as array<array<{_SPAN}>>)), (a, c) -> transform(array({inner}), z -> named_struct('pos', z.pos, 'out', concat(a.out, array(z.out))))[0])"
    zipped = f"arrays_zip(regexp_extract_all({text}, r'{pattern}', 0) as m, split({text}, r'{pattern}', -1) as p)".replace(" as m", "").replace(" as p", "")
    named = f"transform(filter({zipped}, y -> y.`0` is not null), y -> named_struct('m', y.`0`, 'p', y.`1`))"
    chunks = f"transform(array({named}), y -> transform(sequence(0, size(y) div {CHUNK}), j -> slice(y, j * {CHUNK} + 1, {CHUNK})))"
    return f"flatten(transform({chunks}, cs -> {outer})[0].out)"


def base(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, t, found) and the columns ``more`` for each row: the text, and its base spans by start, then kind as listed."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("t"), *more)
    none = f"cast(array() as array<{_SPAN}>)"
    kinds = [f"if({guard}, filter({placed('t', pattern, k)}, w -> transform(array(w.v), v -> {test})[0]), {none})" for k, (guard, pattern, test) in enumerate(PATTERNS.values())]
    return docs.withColumn("found", F.expr(f"if(contains(t, '@') or t rlike '[0-9]', array_sort(concat({', '.join(kinds)})), {none})"))


def listed(spans: str) -> F.Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, w -> concat_ws(':', element_at(array({names}), w.k + 1), w.s, w.e)), ',')")


def digest_of(text: str) -> F.Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def texts_of(docs: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """((digest, t) of each row, null as empty; the number of different texts; (digest, copies) of these, written)."""
    texts = docs.select(digest_of("text").alias("digest"), F.coalesce("text", F.lit("")).alias("t"))
    copies, seen = counted(texts.groupBy("digest").agg(F.count("*").alias("copies")), "personal-digests")
    return texts, seen["n"], copies


def _terms_of(text: str) -> F.Column:
    return F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), 0))).alias("term")


def disclosing(found: DataFrame, texts: DataFrame, n_texts: int, window: int = WINDOW, prior: float = PRIOR, left: float = LEFT) -> DataFrame:
    """(term) of the terms that reveal a protected entity, written; ``found`` is (digest, t, found) of the texts with base spans, ``texts`` (digest, t) of all."""
    spans = found.select("digest", "t", F.explode("found").alias("w"))
    behind = F.expr(f"substring(t, greatest(w.s - {window}, 0) + 1, least({window}, w.s))")
    ahead = F.expr(f"substring(t, w.e + 1, {window})")
    # words that the window cuts are none
    behind = F.when(F.col("w.s") > window, F.regexp_replace(behind, r"^\p{L}+", "")).otherwise(behind)
    ahead = F.when(F.length("t") > F.col("w.e") + window, F.regexp_replace(ahead, r"\p{L}+$", "")).otherwise(ahead)
    spans = spans.select("digest", F.concat_ws(":", "w.k", F.expr(NORMAL)).alias("entity"), F.concat_ws("\n", behind, ahead).alias("context"))
    n_e = spans.select("entity", "digest").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    terms = spans.select("entity", "digest", _terms_of("context")).distinct()
    pairs = terms.groupBy("entity", "term").agg(F.count("*").alias("n_et")).join(n_e, "entity")
    p_e = F.col("n_e") / n_texts
    # the bits left grow with n(t): they are few enough up to ``most`` texts; nothing is left to learn of an entity that all texts hold
    most = (F.col("n_et") + prior * p_e) * 2.0**left * (1 + 1e-9) - prior
    pairs = pairs.where(p_e < 1).groupBy("term").agg(F.max(most).alias("most"))
    # what texts with matches alone hold too often needs no count over all
    within = found.select("digest", _terms_of("t")).distinct().groupBy("term").agg(F.count("*").alias("least"))
    wanted, seen = counted(pairs.join(within, "term").where("least <= most").select("term", "most"), "personal-wanted")
    held = texts.select("digest", _terms_of("t")).join(small(wanted.select("term"), seen["n"]), "term", "left_semi")
    n_t = held.distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    terms, seen = counted(wanted.join(n_t, "term").where("n_t <= most").select("term"), "personal-terms")
    terms.rows = seen["n"]
    discard(wanted)
    return terms


def spans(docs: DataFrame, window: int = WINDOW, prior: float = PRIOR, left: float = LEFT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, digest) for each row; digest is the text's MD5."""
    texts, n_texts, copies = texts_of(docs)
    some = base(docs.select("doc_id", "text", digest_of("text").alias("digest")), "digest").where(F.size("found") > 0)
    some = materialize(some.select("digest", "t", "found").dropDuplicates(["digest"]), "personal-found")
    terms = disclosing(some, texts, n_texts, window, prior, left)
    words = texts.select("digest", _terms_of("t")).join(small(terms, terms.rows), "term")
    own, seen = counted(words.groupBy("digest").agg(F.collect_set("term").alias("own")), "personal-own")  # no more than the text's words
    n_rows = copies.agg(F.sum("copies").alias("n")).first().n or 0
    hot = copies.where(F.col("copies") * HOT > n_rows).select("digest").join(own, "digest", "left")
    hot = materialize(hot.select("digest", F.col("own").alias("hot"), F.lit(True).alias("many")), "personal-hot")
    discard(some, terms, copies)
    rows = base(docs).withColumn("digest", digest_of("t"))
    # rows of the most copied texts have theirs already; their keys are spread, so that they do not meet in one task
    rows = rows.join(F.broadcast(hot), "digest", "left").withColumn("key", F.when(F.col("many"), F.md5(F.concat_ws(":", "digest", "doc_id").cast("binary"))).otherwise(F.col("digest")))
    rows = rows.join(small(own.select(F.col("digest").alias("key"), "own"), seen["n"]), "key", "left").withColumn("own", F.coalesce("hot", "own"))
    placed_terms = F.transform(F.expr(f"filter({placed('t', TERM, 4)}, w -> array_contains(own, lower(w.v)))"), lambda w: F.struct(w["s"].alias("s"), w["k"].alias("k"), w["e"].alias("e")))
    counts = [F.expr(f"cast(size(filter(found, w -> w.k = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    rows = rows.select("doc_id", "digest", *counts, F.expr("transform(found, w -> named_struct('s', w.s, 'k', w.k, 'e', w.e))").alias("found"), F.when(F.col("own").isNotNull(), placed_terms).alias("terms"))
    none = F.expr("cast(array() as array<struct<s: int, k: int, e: int>>)")
    rows = rows.withColumn("all", F.array_sort(F.concat("found", F.coalesce("terms", none))))
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS[:4]), F.sha2(listed("found"), 256).alias("base_sha256"), listed("all").alias("spans"), "digest")


def sanitise(docs: DataFrame, window: int = WINDOW, prior: float = PRIOR, left: float = LEFT) -> DataFrame:
    """(doc_id, text): base matches are generalised to their kind in brackets, disclosing terms removed; null texts stay null."""
    found = spans(docs, window, prior, left).select("digest", "spans").dropDuplicates(["digest"])
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).join(found, "digest")
    parts = "transform(filter(split(spans, ','), x -> x <> ''), x -> split(x, ':'))"
    mark = "if(x[0] = 'term', '', concat('[', upper(x[0]), ']'))"
    step = (
        f"aggregate({parts}, named_struct('at', 0, 'out', ''), (a, x) -> if(cast(x[1] as int) < a.at, a, named_struct('at', cast(x[2] as int), "
        f"'out', concat(a.out, substring(text, a.at + 1, cast(x[1] as int) - a.at), {mark}))))"
    )
    whole = F.expr(f"transform(array({step}), z -> concat(z.out, substring(text, z.at + 1)))[0]")
    return texts.select("doc_id", F.when(F.col("text").isNotNull(), whole).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents")).drop("digest")
