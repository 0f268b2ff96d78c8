"""Market operators against literal loops on small series."""

import math
import random

import pytest

from barloom.operators import bars, bets, clean, events, folds, labels, stationarity, weights

H = bars.HOUR
TICKS = "market string, seq long, ts_us long, price double, volume double, value double"
BAR = "market string, ts_us long, open double, high double, low double, close double, wavg double, volume double, value double"


def make_ticks(spark, n=300, seed=1, markets=("a", "b")):
    rng, rows = random.Random(seed), []
    for m in markets:
        t = 0
        for i in range(n):
            t += rng.randrange(0, 900_000_000)
            p, v = float(rng.randrange(50, 150)), float(rng.randrange(0, 9))
            rows.append((m, i, t, p, v, p * v))
    return rows, spark.createDataFrame(rows, TICKS)


def make_bars(spark, closes, market="a", step=H):
    return spark.createDataFrame([(market, i * step, c, c, c, c, c, 1.0, c) for i, c in enumerate(closes)], BAR)


def loop_volume_bars(rows, limit, field):
    out, held, first = [], 0.0, 0
    for i, r in enumerate(rows):
        held += r[field]
        if held > limit:
            part = rows[first : i + 1]
            out.append((r[2], part[0][3], max(x[3] for x in part), min(x[3] for x in part), r[3], held, sum(x[9 - field] for x in part)))
            held, first = 0.0, i
    return out


@pytest.mark.parametrize("limit", [20.0, 27.0])
def test_volume_bars_follow_the_loop(spark, limit):
    rows, t = make_ticks(spark)
    got = bars.volume_bars(t, limit).orderBy("market", "bar_no").collect()
    for m in ("a", "b"):
        want = loop_volume_bars([r for r in rows if r[0] == m], limit, 4)
        assert [(g.ts_us, g.open, g.high, g.low, g.close, g.volume, g.value) for g in got if g.market == m] == want


def test_full_bars_keep_all_volume_but_the_tail(spark):
    rows, t = make_ticks(spark)
    total = sum(r[4] for r in rows if r[0] == "a")
    made = bars.volume_bars(t, 30, edges="full").where("market = 'a'").groupBy().sum("volume").first()[0]
    assert total - 31 - 9 <= made <= total


def test_time_bars_keep_empty_bins(spark):
    t = spark.createDataFrame([("a", 1, 0, 5.0, 2.0, 10.0), ("a", 2, 3 * H, 7.0, 0.0, 0.0)], TICKS)
    got = bars.time_bars(t).orderBy("ts_us").collect()
    assert [(g.close, g.volume, g.wavg) for g in got] == [(5.0, 2.0, 5.0), (None, 0.0, None), (None, 0.0, None), (7.0, 0.0, None)]


def test_tick_bars_edges(spark):
    t = spark.createDataFrame([("a", i, i * 10, float(i), 1.0, float(i)) for i in range(7)], TICKS)
    assert [(g.open, g.high, g.close, g.volume) for g in bars.tick_bars(t, 3, "full").orderBy("bar_no").collect()] == [(0.0, 2.0, 2.0, 3.0), (3.0, 5.0, 5.0, 3.0)]
    assert [(g.open, g.high, g.close, g.volume) for g in bars.tick_bars(t, 3).collect()] == [(0.0, 1.0, 2.0, 2.0)]


def test_rolling_limits_catch_up_one_at_a_tick(spark):
    rows, t = make_ticks(spark, 200, 3, ("a",))
    grains = bars.time_bars(t).orderBy("ts_us").collect()[1:]
    means, keys = [], [g.ts_us for g in grains]
    for i in range(len(grains)):
        means.append(sum(g.volume for g in grains[: i + 1]) / (i + 1))
    got = {r.seq: r.limit for r in bars.rolling_limits(t, "volume").collect()}
    k = 0
    for r in rows:
        if k < len(means) - 1 and r[2] > keys[k + 1]:
            k += 1
        assert got[r[1]] == pytest.approx(means[k])


def test_sample_refuses_unknown_names(spark):
    with pytest.raises(ValueError):
        bars.sample(None, "no such")


def test_segments_and_keep_last(spark):
    b = make_bars(spark, [1.0, 2.0]).unionByName(make_bars(spark, [3.0]).selectExpr("market", f"ts_us + {9 * H} as ts_us", "open", "high", "low", "close", "wavg", "volume", "value"))
    assert [r.segment for r in clean.segments(b, 2 * H).orderBy("ts_us").collect()] == [0, 0, 1]
    t = spark.createDataFrame([("a", 1, 5, 1.0, 1.0, 1.0), ("a", 2, 5, 2.0, 1.0, 2.0)], TICKS)
    assert [r.price for r in clean.keep_last(t).collect()] == [2.0]


def test_cusum_resets_one_side_and_on_missing(spark):
    x = [0.0, 3.0, 6.0, 1.0, -4.0, None, 0.0, 7.0, 13.0]
    s = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "market string, ts_us long, x double")
    up = down = 0.0
    want, before = [], None
    for i, v in enumerate(x):
        if i:
            d = None if v is None or before is None else v - before
            up, down = (max(0.0, up + d), min(0.0, down + d)) if d is not None else (0.0, 0.0)
            if down < -5:
                down = 0.0
                want.append(i)
            elif up > 5:
                up = 0.0
                want.append(i)
        before = v
    assert [r.ts_us for r in events.cusum_events(s, "x", 5.0).orderBy("ts_us").collect()] == want


def test_ewm_std_is_that_of_pandas(spark):
    import pandas as pd

    rng = random.Random(4)
    x = [rng.gauss(0, 1) for _ in range(50)]
    s = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "market string, ts_us long, x double")
    got = [r.vol for r in events.ewm_std(s, "x", 10).orderBy("ts_us").collect()]
    want = pd.Series(x).ewm(span=10).std().tolist()
    assert got[0] is None and got[1:] == pytest.approx(want[1:])


def test_barriers_follow_the_loop(spark):
    rng = random.Random(5)
    closes = [100.0]
    for _ in range(80):
        closes.append(max(1.0, closes[-1] + rng.choice([-3, -1, 1, 3])))
    b = make_bars(spark, closes)
    e = b.where(f"ts_us % {5 * H} = 0").selectExpr("market", "ts_us", "0.04D as trgt")
    got = {r.ts_us: r.t1 for r in labels.barrier_events(b, e, e, 1, 0.01, labels.vertical(b, e, 0.5), bucket=7 * H).collect()}
    for i in range(0, 81, 5):
        end = i + 12 if i + 12 <= 80 else None
        hits = [j for j in range(i, (80 if end is None else end) + 1) if abs(closes[j] / closes[i] - 1) > 0.04]
        first = min([x for x in (end, hits[0] if hits else None) if x is not None], default=None)
        assert got[i * H] == (None if first is None else first * H)


def test_weights_follow_the_loop(spark):
    closes = [100.0, 101.0, 103.0, 102.0, 105.0, 104.0, 108.0]
    b = make_bars(spark, closes)
    spans = [(0, 3), (2, 5), (5, 6)]
    lab = spark.createDataFrame([("a", i * H, j * H) for i, j in spans], "market string, ts_us long, t1 long")
    n = [sum(i <= k <= j for i, j in spans) for k in range(7)]
    for r, (i, j) in zip(weights.span_weights(b, lab).orderBy("ts_us").collect(), spans):
        assert r.tw == pytest.approx(sum(1 / n[k] for k in range(i, j + 1)) / (j - i + 1))
        assert r.w == pytest.approx(abs(sum(math.log(closes[k] / closes[k - 1]) / n[k] for k in range(i, j + 1) if k)))
    w = weights.normalise(weights.span_weights(b, lab))
    assert w.groupBy().sum("w").first()[0] == pytest.approx(3)


def test_fracdiff_weights_and_streams(spark):
    assert stationarity.weights_fixed(1.0, 1e-5)[::-1] == [1.0, -1.0, 0.0]
    rng = random.Random(6)
    x = [rng.random() for _ in range(60)]
    x[20] = None
    s = spark.createDataFrame([("a", "f", i, v) for i, v in enumerate(x)], "market string, feature string, ts_us long, x double")
    w = stationarity.weights_fixed(0.4, 0.01)
    filled = [x[19] if i == 20 else v for i, v in enumerate(x)]
    want = {i: sum(a * b for a, b in zip(w, filled[i - len(w) + 1 : i + 1])) for i in range(len(w) - 1, 60) if i != 20}
    got = {r.ts_us: r.y for r in stationarity.difference_fixed(s, 0.4, 0.01).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_p_values_and_unit_roots(spark):
    assert stationarity._p_value(-2.86) == pytest.approx(0.05, abs=0.001)
    assert stationarity._p_value(-3.43) == pytest.approx(0.01, abs=0.001)
    rng, walk = random.Random(8), [0.0]
    for _ in range(400):
        walk.append(walk[-1] + rng.gauss(0, 1))
    rows = [("a", "walk", i, v) for i, v in enumerate(walk)] + [("a", "noise", i, rng.gauss(0, 1)) for i in range(400)]
    s = spark.createDataFrame(rows, "market string, feature string, ts_us long, x double")
    p = {r.feature: r.p_value for r in stationarity.adf(s).collect()}
    assert p["noise"] < 0.001 < p["walk"]


def test_folds_split_rows_and_purge(spark):
    lab = spark.createDataFrame([("a", i * H, (i + 3) * H) for i in range(40)], "market string, ts_us long, t1 long")
    rows = folds.purged_folds(lab, 4).collect()
    tests = [r.ts_us for r in rows if r.role == "test"]
    assert sorted(tests) == [i * H for i in range(40)]
    for f in range(1, 5):
        test = [r.ts_us for r in rows if r.fold == f and r.role == "test"]
        low, high = min(test), max(test) + 3 * H
        assert all(r.ts_us + 3 * H <= low or r.ts_us >= high for r in rows if r.fold == f and r.role == "train")


def test_active_average_follows_the_loop(spark):
    rng = random.Random(9)
    sig = [("a", i * H, (i + rng.randrange(1, 6)) * H if i % 7 else None, rng.uniform(-1, 1)) for i in range(30)]
    s = spark.createDataFrame(sig, "market string, ts_us long, t1 long, signal double")
    for r in bets.active_average(s).collect():
        act = [x[3] for x in sig if x[1] <= r.ts_us and (x[2] is None or r.ts_us < x[2])]
        assert r.signal == pytest.approx(sum(act) / len(act) if act else 0, abs=1e-9)


def test_bootstrap_repeats_with_its_seed(spark):
    b = make_bars(spark, [float(i + 1) for i in range(20)])
    lab = spark.createDataFrame([("a", i * H, (i + 2) * H) for i in range(0, 15, 3)], "market string, ts_us long, t1 long")
    one, two = (sorted(map(tuple, bets.sequential_bootstrap(b, lab, 2, seed=3).collect())) for _ in range(2))
    assert one == two and len(one) == 10


def test_stream_gives_the_batch_bars(spark, tmp_path):
    from barloom.streaming.bars import stream_time_bars

    rows, t = make_ticks(spark, 100, 2, ("a",))
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = stream_time_bars(stream).writeStream.format("memory").queryName("live").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = {r.ts_us: (r.open, r.close, r.volume) for r in bars.time_bars(t).where("close is not null").collect()}
    assert {r.ts_us: (r.open, r.close, r.volume) for r in spark.table("live").collect()} == batch


def test_bars_and_events_of_one_market_are_split(spark, monkeypatch):
    """One market with all ticks runs in chunks of a few rows, to the same results."""
    from barloom.operators import ordered

    rows, t = make_ticks(spark, 1200, 7, ("a",))
    levels, walk, x = [], [], 100.0
    rng = random.Random(8)
    for i in range(1500):
        x += rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0])
        walk.append(("a", i * H, None if i % 211 == 7 else x))
        levels.append(("a", i * H, float(3 + i // 100 % 9)))
    s, limits = spark.createDataFrame(walk, "market string, ts_us long, x double"), spark.createDataFrame(levels, "market string, ts_us long, h double")
    made = lambda: [sorted(map(tuple, f().collect())) for f in (
        lambda: bars.volume_bars(t, 45.0), lambda: bars.value_bars(t, 900.0, "full"), lambda: bars.volume_bars(t, 2000.0), lambda: bars.rolling_volume_bars(t, 3),
        lambda: events.cusum_events(s, "x", 5.0), lambda: events.cusum_events_by(s, "x", limits), lambda: events.cusum_events(s, "x", 500.0),
    )]
    whole = made()
    monkeypatch.setattr(ordered, "CHUNK", 37)
    assert made() == whole and all(whole[:6])
    want = loop_volume_bars(rows, 45.0, 4)
    assert [r[2] for r in whole[0]] == [w[0] for w in want]


def test_look_back_and_ahead_over_buckets(spark):
    from barloom.operators.ordered import asof

    rng = random.Random(2)
    values = sorted({rng.randrange(0, 4000) for _ in range(60)})
    asks = [rng.randrange(-50, 4100) for _ in range(80)]
    v = spark.createDataFrame([("a", t, None if t % 5 == 0 else float(t)) for t in values], "market string, ts_us long, p double")
    a = spark.createDataFrame([("a", t, i) for i, t in enumerate(asks)], "market string, at long, i int")
    for forward in (False, True):
        got = {r.i: (r.found, r.p) for r in asof(v, a, ["market"], ["p"], forward, 300).collect()}
        for i, t in enumerate(asks):
            near = [x for x in values if (x >= t if forward else x <= t)]
            near = (min if forward else max)(near) if near else None
            assert got[i] == (near is not None, None if near is None or near % 5 == 0 else float(near))


def test_purge_and_folds_over_buckets(spark):
    rng = random.Random(3)
    rows = [(t, t + rng.randrange(0, 400)) for t in sorted(rng.sample(range(5000), 70))]
    tests = [(t, t + rng.randrange(0, 150)) for t in rng.sample(range(5000), 6)]
    lab = spark.createDataFrame([("a", *r) for r in rows], "market string, ts_us long, t1 long")
    cut = spark.createDataFrame([("a", *r) for r in tests], "market string, first_us long, last_us long")
    got = sorted((r.ts_us, r.t1) for r in folds.purge(lab, cut, span=200).collect())
    assert got == [r for r in rows if not any(r[0] <= z and a <= r[1] for a, z in tests)]
    assert sorted(map(tuple, folds.purged_folds(lab, 4, 0.02, span=200).collect())) == sorted(map(tuple, folds.purged_folds(lab, 4, 0.02).collect()))
    assert sorted(map(tuple, folds.embargo(lab, 0.1, span=200).collect())) == [("a", t, rows[min(69, i + 7)][0]) for i, (t, _) in enumerate(rows)]


def test_rows_before_over_buckets(spark):
    from barloom.operators.ordered import previous

    times = sorted(random.Random(4).sample(range(3000), 50))
    rows = spark.createDataFrame([("a", t, None if t % 3 == 0 else float(t)) for t in times], "market string, ts_us long, x double")
    got = {r.ts_us: r.before for r in previous(rows, ["market"], ["x", "ts_us"], span=200).collect()}
    assert got[times[0]] is None
    assert {t: (got[t].x, got[t].ts_us) for t in times[1:]} == {t: (None if u % 3 == 0 else float(u), u) for u, t in zip(times, times[1:])}
