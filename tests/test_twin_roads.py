"""The carriageways of P7 and P11 are all lines, whole."""

from pyspark.sql import functions as F

from upland.queries import city
from upland.queries.tables import Tables


def test_every_line_has_a_twin_over_its_whole_length(spark, data):
    t = Tables(spark, data)
    want = {r["code"]: r["n"] for r in city.road_table(t).select("code", F.size("line").alias("n")).collect()}
    got = {r["code"]: r["n"] for r in city.twin_roads(t).select("code", F.size("line").alias("n")).collect()}
    assert max(want.values()) > 4 and {c % 3 for c in want} == {0, 1, 2}
    assert got == {**want, **{-c - 1: n for c, n in want.items()}}
