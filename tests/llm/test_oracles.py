"""Registered text queries against their oracles."""

from barloom.llm.queries import ORACLES, QUERIES
from tests.oracle import differences


def test_mix_equals_its_oracle(spark):
    assert differences(spark, QUERIES["op3_source_mix"], ORACLES["op3_source_mix"], "/root/testdata/sf0.001") == {}
