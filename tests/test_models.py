"""Stationarity, purging, importance, bootstrap and jobs against plain loops."""

import math
import random

import numpy as np
import pytest

from barloom.operators import bars, bets, events, features, folds, importance, ordered, stationarity

H = bars.HOUR
LONG = "market string, segment long, ts_us long, feature string, x double"


def plain_adf(y, lags):
    """(tau, lag) of the augmented Dickey-Fuller test with a constant by least squares."""
    y = np.asarray([v for v in y if math.isfinite(v)])

    def fit(k, skip):
        d = np.diff(y)
        rows = range(skip, len(d))
        x = np.array([[y[i], *[d[i - j] for j in range(1, k + 1)], 1.0] for i in rows])
        target = d[skip:]
        beta, *_ = np.linalg.lstsq(x, target, rcond=None)
        rss = float(((target - x @ beta) ** 2).sum())
        se = math.sqrt(rss / (len(target) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])
        return beta[0] / se, len(target) * math.log(rss / len(target)) + 2 * x.shape[1]

    if lags == "one" or fit(0, 1)[1] > fit(1, 1)[1]:
        return fit(1, 1)[0], 1
    return fit(0, 0)[0], 0


def plain_difference(x, d, threshold):
    w, out = stationarity.weights_fixed(d, threshold)[::-1], {}
    filled, last = [], math.nan
    for v in x:
        last = v if not math.isnan(v) else last
        filled.append(last)
    there = [i for i, v in enumerate(filled) if not math.isnan(v)]
    for n, i in enumerate(there):
        if n >= len(w) - 1 and math.isfinite(x[i]):
            out[i] = sum(w[k] * filled[there[n - k]] for k in range(len(w)))
    return out


@pytest.fixture(scope="module")
def series(spark):
    rng, rows, by = random.Random(1), [], {}
    for m in ("a", "b"):
        for f, kind in (("walk", "walk"), ("noise", "noise"), ("gaps", "walk")):
            x, t = 100.0, 0
            for segment in (0, 1):
                own = []
                for _ in range(140):
                    x = x + rng.gauss(0, 1) if kind == "walk" else 100 + rng.gauss(0, 1)
                    v = math.nan if f == "gaps" and rng.random() < 0.05 else x
                    rows.append((m, segment, t, f, None if v != v else v))
                    own.append((t, v))
                    t += H
                by[m, f, segment] = own
    return spark.createDataFrame(rows, LONG), by


def test_d_values_and_stationary_features_follow_the_loop(spark, series):
    rows, by = series
    grid, threshold, want, chosen = (0.3, 0.6, 1.0), 0.02, {}, {}
    for m in "ab":
        for f in ("walk", "noise", "gaps"):
            raw = [v for s in (0, 1) for _, v in by[m, f, s]]
            if stationarity._p_value(plain_adf(raw, "aic")[0]) > stationarity.ENTER:
                for d in grid:
                    y = [v for s in (0, 1) for v in plain_difference([v for _, v in by[m, f, s]], d, threshold).values()]
                    want[m, f, d] = stationarity._p_value(plain_adf(y, "one")[0])
                chosen[m, f] = min((d for d in grid if want[m, f, d] <= 0.05), default=1.0)
    assert {f for _, f, _ in want} == {"walk", "gaps"}
    got = stationarity.d_values(rows, grid, threshold)
    values = {(r.market, r.feature, r.d): r.p_value for r in got.collect()}
    assert values.keys() == want.keys() and all(values[k] == pytest.approx(want[k], rel=1e-6, abs=1e-12) for k in want)
    made = {(r.market, r.feature, r.segment, r.ts_us): r.x for r in stationarity.make_stationary(rows, got, threshold, 0.05).collect()}
    expected = {}
    for (m, f, s), own in by.items():
        if (m, f) in chosen:
            expected |= {(m, f, s, own[i][0]): v for i, v in plain_difference([v for _, v in own], chosen[m, f], threshold).items()}
        else:
            expected |= {(m, f, s, t): v for t, v in own}
    assert made.keys() == expected.keys() and all(made[k] == pytest.approx(expected[k], abs=1e-9) for k in made)


def test_tests_choose_their_lag(spark, series):
    rows, by = series
    got = {(r.market, r.feature): (r.tau, r.lag) for r in stationarity.adf(rows).collect()}
    for m, f in got:
        tau, lag = plain_adf([v for s in (0, 1) for _, v in by[m, f, s]], "aic")
        assert got[m, f][1] == lag and got[m, f][0] == pytest.approx(tau, rel=1e-6)


def test_weights_are_those_of_the_binomial_series():
    for d in (0.1, 0.5, 1.0, 1.7):
        w = [1.0]
        for k in range(1, 200):
            w.append(-w[-1] * (d - k + 1) / k)
        assert stationarity.weights(d, 200) == pytest.approx(w[::-1], abs=1e-14)
        n = next(i for i, v in enumerate(w) if abs(v) <= 0.003)
        assert stationarity.weights_fixed(d, 0.003) == pytest.approx(w[n::-1], abs=1e-14)


def test_chunks_and_decaying_sums_do_not_depend_on_their_size(spark):
    rng = random.Random(2)
    rows = [(m, t * H, rng.choice([None, rng.gauss(0, 1), rng.gauss(5, 2)])) for m in "ab" for t in range(300)]
    df = spark.createDataFrame(rows, "market string, ts_us long, x double")

    def of(pdf):
        return pdf[["market", "ts_us"]].assign(s=pdf["x"].rolling(20, min_periods=1).sum())

    kept = [0.9, 0.5]
    for size in (7, 100, 10_000):
        got = {(r.market, r.ts_us): r.s for r in ordered.chunked(df, ["market"], of, "market string, ts_us long, s double", 19, size).collect()}
        sums = {(r.market, r.ts_us): r.sums for r in ordered.decaying_sums(df, ["market"], [df["x"], df["x"] * 2], kept, chunk=size).collect()}
        assert len(got) == len(sums) == 600
        for m in "ab":
            own, state = [x for k, _, x in rows if k == m], [0.0, 0.0]
            for i, x in enumerate(own):
                part = [v for v in own[max(0, i - 19) : i + 1] if v is not None]
                assert got[m, i * H] == (pytest.approx(sum(part)) if part else None)
                state = [state[0] * kept[0] + (x or 0), state[1] * kept[1] + 2 * (x or 0)]
                assert sums[m, i * H] == pytest.approx(state)


def test_features_do_not_depend_on_the_chunks(spark, monkeypatch):
    rng, rows, c = random.Random(3), [], 100.0
    for t in range(400):
        c = max(1.0, c + rng.gauss(0, 1))
        rows.append(("a", t * H, c, c + rng.random(), c - rng.random(), c, c, float(rng.randrange(1, 9)), c))
    b = spark.createDataFrame(rows, "market string, ts_us long, open double, high double, low double, close double, wavg double, volume double, value double")
    whole = {r.ts_us: r.asDict() for r in features.mass_features(b).collect()}
    monkeypatch.setattr(ordered.chunked, "__defaults__", (0, 90))
    monkeypatch.setattr(ordered.decaying_sums, "__defaults__", ("sums", 90))
    for r in features.mass_features(b).collect():
        assert {k: v for k, v in r.asDict().items() if isinstance(v, float)} == pytest.approx({k: v for k, v in whole[r.ts_us].items() if isinstance(v, float)}, rel=1e-8, abs=1e-7)


def test_purge_is_that_of_all_pairs(spark):
    rng = random.Random(4)
    train = [(m, a, None if rng.random() < 0.1 else a + rng.randrange(30), i) for m in "ab" for i, a in enumerate(rng.sample(range(2000), 150))]
    tests = [(m, a, a + rng.randrange(40)) for m in "ab" for a in rng.sample(range(2000), 9)] + [("c", 1, 2)]
    got = folds.purge(spark.createDataFrame(train, "market string, ts_us long, t1 long, n int"), spark.createDataFrame(tests, "market string, first_us long, last_us long"))
    clear = lambda m, a, b: not any(k == m and (f <= a <= l or b is not None and (f <= b <= l or a <= f and l <= b)) for k, f, l in tests)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in train if clear(*r[:3])), key=str) and got.columns == ["market", "ts_us", "t1", "n"]


@pytest.fixture(scope="module")
def learning(spark):
    rng, rows, roles = random.Random(5), [], []
    for i in range(240):
        label = float(rng.random() < 0.5)
        rows.append(("a", i * H, label, rng.random() + 0.1, label + rng.gauss(0, 0.5), rng.gauss(0, 1), label * 0.5 + rng.gauss(0, 1)))
        roles += [("a", fold, i * H, "test" if i % 3 == fold else "train") for fold in range(3)]
    return spark.createDataFrame(rows, "market string, ts_us long, label double, weight double, good double, bad double, fair double").cache(), spark.createDataFrame(roles, "market string, fold int, ts_us long, role string").cache()


FEATURES = ["good", "bad", "fair"]


def forest():
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(numTrees=4, maxDepth=3, seed=7)


def fitted(rows, columns):
    return forest().setWeightCol("weight").fit(folds.assembled(rows, columns))


def plain_score(model, rows, columns, metric):
    got = model.transform(folds.assembled(rows, columns)).collect()
    weight = sum(r.weight for r in got)
    if metric == "accuracy":
        return sum(r.weight * (r.label == r.prediction) for r in got) / weight
    return sum(r.weight * math.log(min(max(r.probability[int(r.label)], 1e-15), 1 - 1e-15)) for r in got) / weight


def summed(values):
    return {k: (np.mean(v), np.std(v, ddof=1) / math.sqrt(len(v))) for k, v in values.items()}


@pytest.mark.parametrize("metric", ["neg_log_loss", "accuracy"])
def test_permutation_and_single_importance_follow_the_loop(learning, metric):
    rows, roles = learning
    data, groups = rows.join(roles, ["market", "ts_us"]).cache(), {"good": ["good"], "rest": ["bad", "fair"]}
    dealt, alone, plain = {k: [] for k in groups}, {k: [] for k in groups}, []
    for fold in range(3):
        train, test = (data.where(f"fold = {fold} and role = '{x}'") for x in ("train", "test"))
        model = fitted(train, FEATURES)
        base = plain_score(model, test, FEATURES, metric)
        plain.append(base)
        for k, columns in groups.items():
            mixed = importance.permuted(test, columns, 0)
            before, after = ({r.ts_us: r for r in x.collect()} for x in (test, mixed))
            assert before.keys() == after.keys() and all(before[t][c] == after[t][c] for t in before for c in ("label", "weight", *FEATURES) if c not in columns)
            assert all(sorted(r[c] for r in before.values()) == sorted(r[c] for r in after.values()) and [before[t][c] for t in before] != [after[t][c] for t in before] for c in columns)
            now = plain_score(model, mixed, FEATURES, metric)
            dealt[k].append((base - now) / (1 - now if metric == "accuracy" else -now))
            alone[k].append(plain_score(fitted(train, columns), test, columns, metric))
    close = lambda got, want: {r.feature: (r["mean"], r["std"]) for r in got.collect()} == {k: pytest.approx(v) for k, v in summed(want).items()}
    assert folds.cross_validate(forest(), rows, roles, FEATURES, metric) == pytest.approx(plain)
    assert close(importance.permutation(forest(), rows, roles, FEATURES, metric, groups=groups), dealt)
    assert close(importance.alone(forest(), rows, roles, groups, metric), alone)


def test_impurity_importance_follows_the_loop(spark, learning):
    model = fitted(learning[0], FEATURES)
    trees = [t.featureImportances.toArray() for t in model.trees]
    for clusters in (None, {"good": "x", "bad": "y", "fair": "x"}):
        values = {}
        for t in trees:
            own = {}
            for f, v in zip(FEATURES, t, strict=True):
                if v:
                    own.setdefault(clusters[f] if clusters else f, []).append(v)
            for k, v in own.items():
                values.setdefault(k, []).append(sum(v))
        means = {k: np.mean(v) for k, v in values.items()}
        total = sum(means.values())
        table = clusters and spark.createDataFrame(list(clusters.items()), "feature string, cluster_id string")
        got = {r.feature: (r["mean"], r["std"]) for r in importance.impurity(model, FEATURES, spark, table).collect()}
        assert got.keys() == means.keys() or {k for k in got if got[k][0] is not None} == means.keys()
        for k, v in values.items():
            assert got[k][0] == pytest.approx(means[k] / total)
            assert len(v) < 2 or got[k][1] == pytest.approx(np.std(v, ddof=1) / math.sqrt(len(v)) / total)


def test_orthogonal_features_are_principal_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 4)) + 0.05 * rng.normal(size=(200, 4))
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double, c double, d double")
    got = importance.orthogonal(rows, list("abcd"), ["i"])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    order = np.argsort(-values)
    kept = int(np.searchsorted(np.cumsum(values[order]) / values.sum(), 0.95)) + 1
    made = np.array([r[1:] for r in got.orderBy("i").collect()])
    assert made.shape == (200, kept)
    for k in range(kept):
        want = z @ vectors[:, order[k]]
        assert made[:, k] == pytest.approx(want if made[:, k] @ want > 0 else -want, abs=1e-8)


def test_bootstrap_follows_the_loop_with_the_same_draws(spark):
    n = 60
    b = spark.createDataFrame([("a", i * H) for i in range(n)], "market string, ts_us long")
    spans = [(i, min(n - 1, i + 3 + i % 5)) for i in range(0, n - 9, 4)]
    lab = spark.createDataFrame([("a", i * H, j * H) for i, j in spans], "market string, ts_us long, t1 long")
    got = bets.sequential_bootstrap(b, lab, 2, seed=9).collect()
    for replicate in (0, 1):
        rng, drawn = np.random.default_rng([9, replicate]), []
        for _ in spans:
            mean = []
            for i, j in spans:
                cover = [1 + sum(spans[k][0] <= t <= spans[k][1] for k in drawn) for t in range(i, j + 1)]
                mean.append(sum(1 / c for c in cover) / len(cover))
            drawn.append(int(rng.choice(len(spans), p=np.array(mean) / sum(mean))))
        mine = sorted((r.draw, r.label_us // H) for r in got if r.replicate == replicate)
        assert [t for _, t in mine] == [spans[k][0] for k in drawn]


def test_bars_of_a_zone_follow_its_clocks(spark):
    import datetime as dt
    from zoneinfo import ZoneInfo

    zone, t0 = ZoneInfo("Europe/Berlin"), int(dt.datetime(2024, 3, 30, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000  # clocks go on at 2024-03-31 01:00 UTC
    rows = [("a", i, t0 + i * 1_800_000_000, float(i + 1), 1.0, float(i + 1)) for i in range(120)]
    got = bars.ohlc(spark.createDataFrame(rows, "market string, seq long, ts_us long, price double, volume double, value double"), 1440, zone="Europe/Berlin").collect()
    want = {}
    for _, _, t, p, *_ in rows:
        day = dt.datetime.fromtimestamp(t / 1e6, zone).replace(hour=0, minute=0, second=0, microsecond=0)
        want.setdefault(int(day.timestamp()) * 1_000_000, []).append(p)
    assert {r.ts_us: (r.open, r.close, r.trades) for r in got} == {t: (v[0], v[-1], len(v)) for t, v in want.items()}


def test_jobs_make_what_their_parts_make(spark):
    from barloom.plans import jobs
    from barloom.queries import hours

    b = hours(spark, "/root/testdata/sf0.001")
    made = jobs.labels_job(b, 0.5, 2.0, 0.5, 10.0).collect()
    vol = {(r.market, r.ts_us): r.vol for r in events.daily_vol(b).collect()}
    assert made and all(r.t1 > r.ts_us and r.bin == (r.ret > 0) - (r.ret < 0) and 0 < r.tw <= 1 and (r.market, r.ts_us) in vol for r in made)
    by = {}
    for r in made:
        by[r.market] = by.get(r.market, 0) + r.w
    n = {m: sum(r.market == m for r in made) for m in by}
    assert by == {m: pytest.approx(v) for m, v in n.items()} or sum(by.values()) == pytest.approx(len(made))


def test_jobs_run_from_the_command_line(spark, tmp_path):
    from barloom.plans.__main__ import run
    from barloom.queries import ticks

    folder = f"file://{tmp_path}"
    t = ticks(spark, "/root/testdata/sf0.001").where("market in ('click', 'view') or length(market) < 6")
    t.selectExpr("market", "0L chunk_id", "seq", "ts_us / 1e6 time", "price", "volume").write.parquet(f"{folder}/raw")
    run(spark, ["bars", "--input", f"{folder}/raw", "--output", f"{folder}/bars"])
    b = spark.read.parquet(f"{folder}/bars")
    assert b.count() > 0 and b.select("market").distinct().count() == t.select("market").distinct().count()
    b.where("open is not null").write.parquet(f"{folder}/whole")
    run(spark, ["labels", "--input", f"{folder}/whole", "--output", f"{folder}/labels", "--criterion", "0.5", "--days", "2", "--target", "0.5", "1"])
    made = spark.read.parquet(f"{folder}/labels")
    assert {r.target for r in made.select("target").distinct().collect()} <= {0.5, 1.0} and {"criterion", "days", "decay", "market", "bin", "dw"} <= set(made.columns)
    n = made.count()
    run(spark, ["labels", "--input", f"{folder}/whole", "--output", f"{folder}/labels", "--criterion", "0.5", "--days", "2", "--target", "0.5", "1"])
    assert spark.read.parquet(f"{folder}/labels").count() == n > 0
    run(spark, ["features", "--input", f"{folder}/whole", "--output", f"{folder}/features", "--names", "hl", "logclose"])
    assert {r.feature for r in spark.read.parquet(f"{folder}/features/stationary").select("feature").distinct().collect()} == {"hl", "logclose"}


def test_scores_and_importances_run_after_an_observation(spark, learning):
    from pyspark.sql import Observation

    from barloom.queries import QUERIES

    own, seen = spark.newSession(), Observation()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.range(5).observe(seen, importance.F.count("*").alias("n")).collect()
    assert seen.get == {"n": 5}
    for name in ("v4_cross_validation", "v6_permutation_importance", "v7_single_feature_importance", "v9_clustered_permutation_importance", "v10_clustered_single_importance"):
        assert QUERIES[name](own, "/root/testdata/sf0.001").count() > 0


def plain_expanding(x, d, threshold):
    """The expanding difference of one series by a loop."""
    filled, last = [], math.nan
    for v in x:
        last = last if math.isnan(v) else v
        filled.append(last)
    there = [i for i, v in enumerate(filled) if not math.isnan(v)]
    w = [1.0]
    for k in range(1, len(there)):
        w.append(-w[-1] / k * (d - k + 1))
    share = np.cumsum(np.abs(w[::-1]))
    skip = int((share / share[-1] > threshold).sum()) if there else 0
    out = {}
    for n, i in enumerate(there):
        past = [filled[there[n - k]] for k in range(n + 1)]
        if n >= skip and math.isfinite(x[i]):
            out[i] = sum(a * b for a, b in zip(w, past)) if all(map(math.isfinite, past)) else math.nan
    return out


@pytest.mark.parametrize("block", [7, 64, None])
def test_expanding_difference_follows_the_loop_in_blocks(spark, block):
    rng, rows, want = random.Random(12), [], {}
    for f, n in (("long", 300), ("gaps", 120), ("late", 50), ("infinite", 90), ("none", 5), ("one", 1)):
        x, at = [], 100.0
        for i in range(n):
            at += rng.gauss(0, 1)
            gone = f == "none" or (f == "gaps" and rng.random() < 0.2) or (f == "late" and i < 20)
            x.append(math.nan if gone else math.inf if f == "infinite" and i == 60 else at)
        rows += [("m", f, i * H, None if v != v else v) for i, v in enumerate(x)]
        want |= {(f, i): v for i, v in plain_expanding(x, 0.4, 0.1).items()}
    df = spark.createDataFrame(rows, "market string, feature string, ts_us long, x double")
    got = {(r.feature, r.ts_us // H): r.y for r in stationarity.difference_expanding(df, 0.4, 0.1, block=block).collect()}
    assert got.keys() == want.keys() and len(want) > 200
    assert all((got[k] is None or math.isnan(got[k])) if math.isnan(v) else got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_weights_of_far_lags_go_on_from_near_ones(monkeypatch):
    for d in (0.3, 1.0, 1.7):
        whole = stationarity._binomial(d, 30_000)
        monkeypatch.setattr(stationarity, "EXACT", 1000)
        assert stationarity._weights_at(d, 20_000, 500) == pytest.approx(whole[20_000:20_500], rel=1e-7, abs=1e-300)  # an error of 1 / EXACT ** 3
        monkeypatch.undo()
        share = np.cumsum(np.abs(whole[::-1]))
        assert stationarity._skipped(d, 30_000, 0.05, 999) == int((share / share[-1] > 0.05).sum())


def test_draws_from_the_tree_are_those_from_all_chances():
    rng = np.random.default_rng(3)
    low = np.sort(rng.integers(0, 400, 90))
    high = low + rng.integers(0, 40, 90)
    got = bets._draws(low, high, 150, np.random.default_rng(5))
    own, cover, want = np.random.default_rng(5), np.zeros(high.max() + 1), []
    for _ in range(150):
        mean = np.array([np.mean(1 / (cover[a : b + 1] + 1)) for a, b in zip(low, high, strict=True)])
        k = int(np.searchsorted(np.cumsum(mean) / mean.sum(), own.random(), "right"))
        want.append(k)
        cover[low[k] : high[k] + 1] += 1
    assert got == want


def test_normal_distribution(spark):
    z = [-40.0, -8.5, -3.001, -2.999, -0.5, 0.0, 1e-9, 0.7, 2.9999, 3.0, 5.5, 12.0, math.inf, -math.inf, None]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").coalesce(1).select(bets._normal(importance.F.col("z")).alias("p")).collect()]
    assert got[-1] is None
    for v, p in zip(z[:-1], got[:-1], strict=True):
        assert p == pytest.approx(0.5 * math.erfc(-v / math.sqrt(2)), rel=1e-9, abs=1e-15)
