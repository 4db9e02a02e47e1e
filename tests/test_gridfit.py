import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from gridloom.operators import gridfit

SCHEMA = "s string, code int, e bigint, y bigint, n_obs string, cell string"


def fit(points, g, h, degree):
    """Weighted local polynomial at label g from (position, value), one reading at a time."""
    w = [(1 - ((x - g) / h) ** 2, x - g, y) for x, y in points if y is not None and -h < x - g <= h]
    s0 = sum(a for a, _, _ in w)
    if s0 <= 1e-9:
        return 0.0, None
    n_eff = s0 * s0 / sum(a * a for a, _, _ in w)
    if n_eff < 3 - 1e-6:
        return n_eff, None
    s1, s2 = sum(a * d for a, d, _ in w), sum(a * d * d for a, d, _ in w)
    t0, t1 = sum(a * y for a, _, y in w), sum(a * d * y for a, d, y in w)
    det = s0 * s2 - s1 * s1
    if degree == 0 or det <= 1e-6 * s0 * s0:
        return n_eff, t0 / s0
    return n_eff, (s2 * t0 - s1 * t1) / det


@pytest.mark.parametrize("degree", [0, 1])
def test_against_brute_force(spark, degree):
    rnd = random.Random(3)
    data = [(s, rnd.randrange(30), -rnd.randrange(1000), rnd.choice([None, rnd.randrange(1, 500)]), "x", "y") for s in "abc" for _ in range(25)]
    data += data[:5]  # repeated readings
    data += [("d", None, None, 5, "x", "y"), (None, 3, -10, 7, "x", "y"), ("e", -1, 0, 5, "x", "y")]
    df = spark.createDataFrame(data, SCHEMA)
    got = gridfit.grid_regression(df, ["s"], F.col("code"), F.col("e"), F.col("y"), n_cells=30, cell_width=1000, bandwidth=3, degree=degree).collect()
    assert len(got) == 30 * 6  # a, b, c, d, e and the null source
    for r in got:
        mine = [x for x in data if x[0] == r.s and x[1] is not None and x[1] >= 0]
        n_eff, estimate = fit([(x[1] + x[2] / 1000, x[3]) for x in mine], r.cell, 3, degree)
        n = sum(x[1] == r.cell for x in mine)
        assert r.n_obs == n
        assert r.n_eff == pytest.approx(n_eff, abs=1e-6)
        assert (r.estimate is None) == (estimate is None)
        if estimate is not None:
            assert r.estimate == pytest.approx(estimate, rel=1e-6)
        assert r.mark == ("observed" if n else "filled" if estimate is not None else "missing")


def test_a_line_is_reproduced(spark):
    df = spark.range(60).select(F.lit("s").alias("s"), (F.col("id") / 2).cast("int").alias("code"), F.when(F.col("id") % 2 == 0, -250).otherwise(-750).alias("e"))
    df = df.withColumn("y", (F.col("code") * 1000 + F.col("e")) * 2 + 7)
    got = gridfit.grid_regression(df.where("code not in (10, 11)"), ["s"], F.col("code"), F.col("e"), F.col("y"), 30, 1000, 4).where("cell between 5 and 25")
    for r in got.collect():
        assert r.estimate == pytest.approx(r.cell * 2000 + 7, rel=1e-9)
        assert r.mark == ("filled" if r.cell in (10, 11) else "observed")


def test_runs(spark):
    df = spark.createDataFrame([("a", c, 0, 1, "", "") for c in (3, 4, 9)] + [("b", None, 0, 1, "", ""), ("c", 6, 0, None, "", "")], SCHEMA)
    grid = gridfit.grid_regression(df, ["s"], F.col("code"), F.col("e"), F.col("y"), 12, 1000, 1)
    # a reading without value supports nothing, but its cell is not empty
    assert rows(gridfit.empty_runs(grid, ["s"], 3, 1)) == [("a", 0, 2), ("a", 5, 8), ("b", 0, 11), ("c", 0, 5), ("c", 7, 11)]
    assert rows(gridfit.empty_runs(grid, ["s"], 4, 1)) == [("a", 5, 8), ("b", 0, 11), ("c", 0, 5), ("c", 7, 11)]
    with pytest.raises(ValueError, match="bandwidth"):
        gridfit.empty_runs(grid, ["s"], 4, 3)


@pytest.mark.parametrize("bandwidth", [1, 2, 5])
def test_every_long_run_holds_a_cell_without_support(spark, bandwidth):
    rnd = random.Random(bandwidth)
    data = [(str(s), c, -rnd.randrange(1000), rnd.choice([None, 1, 5]), "", "") for s in range(40) for c in range(60) if rnd.random() < 0.15]
    grid = gridfit.grid_regression(spark.createDataFrame(data, SCHEMA), ["s"], F.col("code"), F.col("e"), F.col("y"), 60, 1000, bandwidth)
    want = []
    for s in {x[0] for x in data}:
        edges = [-1, *sorted({x[1] for x in data if x[0] == s}), 60]
        want += [(s, a + 1, b - 1) for a, b in zip(edges, edges[1:]) if b - a - 1 >= 2 * bandwidth]
    assert rows(gridfit.empty_runs(grid, ["s"], 2 * bandwidth, bandwidth)) == sorted(want, key=repr)
    none = grid.withColumn("n_eff", F.lit(1.0)).withColumn("mark", F.lit("filled"))
    assert rows(gridfit.empty_runs(none, ["s"], 2 * bandwidth, bandwidth)) == []  # no seeds, no runs


def test_empty_and_arguments(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert gridfit.grid_regression(empty, ["s"], F.col("code"), F.col("e"), F.col("y")).count() == 0
    with pytest.raises(ValueError, match="degree"):
        gridfit.grid_regression(empty, ["s"], F.col("code"), F.col("e"), F.col("y"), degree=3)
