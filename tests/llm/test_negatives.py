"""Hard negatives against brute force and the oracle."""

import math

import numpy as np
import pytest

from barloom.llm import hard_negatives

ROWS = "vec_id long, embedding array<float>, label int, score string, slice string, v string"


def plain(rows):
    best = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        own = (label, [math.floor(256 * float(np.float32(c))) for c in x])
        best[i] = min(best.get(i, own), own)
    most = max((len(v) for _, v in best.values()), default=0)
    best = {i: (label, v + [0] * (most - len(v))) for i, (label, v) in best.items()}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    out = []
    for a in sorted(i for i in best if i % 50 == 0):
        scored = sorted(((-dot(best[a][1], v), i) for i, (_, v) in best.items() if i != a))
        positives = [(i, -s) for s, i in scored if best[i][0] == best[a][0]][:5]
        for p, ps in positives:
            negatives = [(i, -s) for s, i in scored if best[i][0] != best[a][0] and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(a, p, k, i, ps, s) for k, (i, s) in enumerate(negatives, 1)]
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "s", "t", "u") for r in rows], ROWS)
    out = hard_negatives.mine(df)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def vectors(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dims))
    label = rng.integers(0, 10, n)
    label[: n // 3] = 4
    x = centres[label] * spread + rng.normal(size=(n, dims)) * rng.uniform(0.1, 2, size=(1, dims))
    return [(i, list(map(float, v)), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_negatives_are_those_of_brute_force_over_several_blocks(spark, monkeypatch, spread):
    monkeypatch.setattr(hard_negatives, "SLICE", 120)
    monkeypatch.setattr(hard_negatives, "GROUP", 4)
    rows = vectors(2, 500, 12, spread)
    for i in range(100, 160):  # ties: one vector, many ids
        rows[i] = (i, rows[100][1], rows[i][2])
    want = plain(rows)
    assert len(want) > 20
    assert got(spark, rows) == want


def test_negatives_of_awkward_rows(spark):
    rows = vectors(3, 120, 6, 1.0)
    rows += [(None, [1.0] * 6, 1), (200, None, 1), (250, [1.0] * 6, None), (300, [float("nan")] * 6, 1), (350, [float("inf")] * 6, 1), (400, [None] * 6, 1)]
    rows += [(500, [], 3), (550, [0.0] * 6, 3), (600, [-0.5] * 6, 3), (650, [2.0, 1.0], 3), (0, [9.0] * 6, 1), (50, [9.0] * 6, 1), rows[7], (51, [3.0] * 6, 9)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == [] and got(spark, [(50, [], 1), (51, [], 1)]) == plain([(50, [], 1), (51, [], 1)])
    assert got(spark, [(50, [1.0], 1), (51, [1.0], 2)]) == []


def test_query_equals_its_oracle(spark):
    from tests.oracle import differences

    assert differences(spark, hard_negatives.query, hard_negatives.ORACLE_SQL, "/root/testdata/sf0.001") == {}
    assert differences(spark, hard_negatives.query, hard_negatives.ORACLE_SQL, "/root/testdata/sf0.01") == {}


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(-300, 300, (n, 20)) * (rng.random(20) < 0.7) for n in (200, 30))
    for share in (0.0, 0.3, 0.9, 2.0):
        block = hard_negatives.Block(x, y, share)
        bound = block.bounds(slice(0, 30))
        exact = np.stack([block.score(i, np.arange(200)) for i in range(30)])
        assert (exact == y @ x.T).all() and (bound >= exact).all()
    assert hard_negatives.Block(x, y, 0.9).depth < 20
