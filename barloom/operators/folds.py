"""Purged and embargoed folds, and scores of classifiers over them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import SPAN, asof, numbered
from .stored import materialize, work_dir

KEYS, SIDE_BY_SIDE = ("market",), 8


def purge(train: DataFrame, tests: DataFrame, keys: tuple[str, ...] = KEYS, span: int = SPAN) -> DataFrame:
    """Rows (keys, ts_us, t1) that overlap no interval (keys, first_us, last_us) of ``tests``: none starts or ends in one, or covers one.

    Trains by their ends and tests by their starts are ordered within buckets of time; what comes before a bucket is the latest end of the tests of all earlier ones, one
    row a bucket.
    """
    end = F.greatest("ts_us", F.coalesce("t1", "ts_us"))
    columns = [c for c in train.columns if c not in keys]
    own = train.select(*keys, F.struct(*columns).alias("row"), end.alias("at"), F.lit(1).alias("kind"), F.col("ts_us").alias("from"))
    spans = tests.select(*keys, F.lit(None).cast(own.schema["row"].dataType).alias("row"), F.col("first_us").alias("at"), F.lit(0).alias("kind"), F.col("last_us").alias("from"))
    both = own.unionByName(spans).withColumn("bucket", F.floor(F.col("at") / span))
    # a closed interval meets another that starts by its end if the latest end of such is not before its own start
    last = F.when(F.col("kind") == 0, F.col("from"))
    within = Window.partitionBy(*keys, "bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*keys, "bucket").agg(F.max(last).alias("most")).select(*keys, "bucket", F.max("most").over(earlier).alias("carried"))
    kept = both.withColumn("own", F.max(last).over(within)).where("kind = 1").join(carried, [*keys, "bucket"])
    latest = F.greatest("own", "carried")
    return kept.where(latest.isNull() | (latest < F.col("from"))).select(*keys, "row.*").select(train.columns)


def embargo(times: DataFrame, share: float, keys: tuple[str, ...] = KEYS, span: int = SPAN) -> DataFrame:
    """(keys, ts_us, until_us): the time int(n * share) rows later, at the end the last one."""
    rows = materialize(numbered(times.select(*keys, "ts_us"), list(keys), ["ts_us"], F.floor(F.col("ts_us") / span)))
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("ts_us").alias("last_us"))
    later = rows.select(*keys, F.col("rn").alias("to"), F.col("ts_us").alias("until_us"))
    out = rows.join(whole, list(keys)).withColumn("to", F.col("rn") + F.floor(F.col("n") * share)).join(later, [*keys, "to"], "left")
    return out.select(*keys, "ts_us", F.coalesce("until_us", "last_us").alias("until_us"))


def purged_folds(labels: DataFrame, k: int, share: float = 0.0, keys: tuple[str, ...] = KEYS, span: int = SPAN) -> DataFrame:
    """(keys, fold, ts_us, role): each of k runs of rows once as test; train rows end by its start, or follow its last end and the embargo.

    Places come from buckets of time and their counts, and a fold follows from the place. The first row at or after a fold's last end is looked up among those of one bucket.
    """
    rows = numbered(labels.select(*keys, "ts_us", "t1"), list(keys), ["ts_us"], F.floor(F.col("ts_us") / span), "pos")
    rows = rows.join(rows.groupBy(*keys).agg(F.count("*").alias("n")), list(keys))
    # the first n % k folds have one row more
    size, over = F.floor(F.col("n") / k), F.col("n") % k
    part = F.when(F.col("pos") < over * (size + 1), F.floor(F.try_divide("pos", size + 1))).otherwise(over + F.floor(F.try_divide(F.col("pos") - over * (size + 1), size)))
    rows = materialize(rows.withColumn("part", (part + 1).cast("int")))
    tests = rows.groupBy(*keys, F.col("part").alias("fold")).agg(F.min("ts_us").alias("start_us"), F.max("t1").alias("end_us"))
    after = asof(rows.select(*keys, "ts_us", F.col("pos").alias("right")), tests.withColumnRenamed("end_us", "at"), list(keys), ["right"], forward=True, span=span)
    tests = after.select(*keys, "fold", "start_us", F.when(F.col("at").isNotNull(), F.col("right")).alias("right"))
    pairs = rows.join(tests, list(keys))
    train = (F.col("t1") <= F.col("start_us")) | (F.col("pos") >= F.col("right") + F.floor(F.col("n") * share))
    role = F.when(F.col("part") == F.col("fold"), "test").when(train, "train")
    out = pairs.select(*keys, "fold", "ts_us", role.alias("role"), (F.coalesce(train, F.lit(False)) & (F.col("part") == F.col("fold"))).alias("both"))
    # a row that ends as its own fold starts is in both sets, as its times say
    more = out.where("both").select(*keys, "fold", "ts_us", F.lit("train").alias("role"))
    return out.where("role is not null").select(*keys, "fold", "ts_us", "role").unionByName(more)


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows)


def fits(classifier, jobs: dict[tuple, DataFrame]) -> dict[tuple, object]:
    """A weighted fit for each key's rows (label, weight, features), ``SIDE_BY_SIDE`` at a time.

    Models are written to the shared folder and loaded again: a fresh fit keeps its training summary and with it the session, which can't be sent to
    executors once anything in the session has been observed.
    """
    learner = classifier.copy({classifier.weightCol: "weight"})

    def one(rows: DataFrame):
        model, path = learner.fit(rows), work_dir(rows.sparkSession)
        model.write().save(path)
        return type(model).load(path)

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return dict(zip(jobs, pool.map(inheritable_thread_target(one), jobs.values()), strict=True))


def scores(predicted: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """(by, score): weighted negative log-loss or accuracy of (label, prediction, probability, weight), all groups in one aggregation."""
    if metric == "accuracy":
        value = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("weight")).otherwise(0.0)) / F.sum("weight")
    else:
        from pyspark.ml.functions import vector_to_array

        p = F.element_at(vector_to_array("probability"), F.col("label").cast("int") + 1)
        value = F.sum(F.col("weight") * F.log(F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15)))) / F.sum("weight")
    return predicted.groupBy(*by).agg(value.alias("score"))


def predictions(models: dict[tuple, object], tests: dict[tuple, DataFrame], names: list[str]) -> DataFrame:
    """(names, label, weight, prediction, probability[, name]) of each key's test rows under its model, the key's parts as ``names``."""
    out = None
    for key, rows in tests.items():
        made = models[key].transform(rows)
        made = made.select(*[F.lit(k).alias(n) for k, n in zip(key, names, strict=True)], *[c for c in ("name", "label", "weight", "prediction", "probability") if c in made.columns])
        out = made if out is None else out.unionByName(made)
    return out


def held(rows: DataFrame, roles: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, list[int]]:
    """Rows with the fold and role they have, cached for the fits that share them; and the folds."""
    data = rows.join(roles, [*keys, "ts_us"]).cache()
    return data, [r.fold for r in data.select("fold").distinct().orderBy("fold").collect()]


def fold_scores(classifier, rows: DataFrame, roles: DataFrame, groups: dict[str, list[str]], metric: str = "neg_log_loss", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(group, fold, score): each group's columns fitted on train rows and scored on test rows, both weighted. The fits run side by side over one cached
    table; all scores come from one aggregation."""
    data, numbers = held(rows, roles, keys)
    jobs = [(g, k) for g in groups for k in numbers]
    part = {(g, k, role): assembled(data.where((F.col("fold") == k) & (F.col("role") == role)), groups[g]).select("label", "weight", "features") for g, k in jobs for role in ("train", "test")}
    models = fits(classifier, {j: part[(*j, "train")] for j in jobs})
    out = materialize(scores(predictions(models, {j: part[(*j, "test")] for j in jobs}, ["group", "fold"]), metric, ["group", "fold"]))
    data.unpersist()
    return out


def cross_validate(classifier, rows: DataFrame, roles: DataFrame, features: list[str], metric: str = "neg_log_loss", keys: tuple[str, ...] = KEYS) -> list[float]:
    """The score of each fold of rows (keys, ts_us, label, weight, features), in order of the folds."""
    return [r.score for r in fold_scores(classifier, rows, roles, {"all": features}, metric, keys).orderBy("fold").collect()]
