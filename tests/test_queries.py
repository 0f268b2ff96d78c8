"""Registered queries against their oracles."""

import pytest

from barloom.queries import ORACLES, QUERIES

from .oracle import differences

#: The slowest market queries are left to the driver's run.
SOME = sorted(set(ORACLES) - {"f_mass_features"})


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_oracle(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001") == {}


def test_stationarity_is_registered_over_all_features_and_the_whole_grid(spark, monkeypatch):
    from barloom import queries
    from barloom.operators import stationarity

    seen = []
    monkeypatch.setattr(queries, "features_job", lambda b, names, grid=stationarity.D_GRID: seen.append((len(names), grid)) or (b, b))
    monkeypatch.setattr(stationarity, "long_form", lambda made, names, ids: seen.append(len(names)) or made.select(ids))
    monkeypatch.setattr(stationarity, "d_values", lambda rows, grid=stationarity.D_GRID: seen.append(grid) or rows)
    monkeypatch.setattr("barloom.queries.materialize", lambda rows: rows)
    QUERIES["job_c_features"](spark, "/root/testdata/sf0.001")
    QUERIES["d6_d_values"](spark, "/root/testdata/sf0.001")
    assert seen == [(286, stationarity.D_GRID), 286, stationarity.D_GRID]
