"""Irregular readings onto a regular grid by compact-kernel local polynomial regression (problem 2).

The kernel is ``K(u) = 1 - u^2`` on ``|u| <= 1`` with a bandwidth of whole grid cells. Its support around a grid label
then covers whole cells, and because the kernel is a polynomial the weighted normal equations of *all* readings in the
support are exact functions of a few power sums per cell. So readings are first reduced to one row of power sums per
(source, cell), with map-side combine, and never gathered per source: a source with a third of all readings is at most
``n_cells`` rows after the first aggregation. Each cell row is then offered to the ``2 * bandwidth`` grid labels whose
support contains it (the index: cell number plus offset), and the labels' sums are solved in closed form.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.axis import MINUTE_MS, N_LABELS


def grid_regression(
    df: DataFrame,
    keys: Sequence[str],
    code: Column,
    offset: Column,
    value: Column,
    n_cells: int = N_LABELS,
    cell_width: int = MINUTE_MS,
    bandwidth: int = 5,
    degree: int = 1,
    min_support: float = 3.0,
) -> DataFrame:
    """A full grid per source: ``keys..., cell, n_obs, n_eff, estimate, mark``.

    ``code``: cell of a reading (0..n_cells-1; null or anything else: the reading belongs to no cell, its source still
    gets a grid). ``offset``: position relative to the cell's label in (-cell_width, 0]. ``value``: the reading; a null
    value counts as an observation of its cell but not in the fit.

    ``n_obs``: readings in the cell; ``n_eff``: Kish's effective number of readings in the support, (sum w)^2/sum w^2;
    ``estimate``: the local fit at the label, null where ``n_eff < min_support`` or all weight is at one place and the
    degree cannot be reduced; ``mark``: ``observed`` (n_obs > 0), ``filled`` (empty cell with an estimate), ``missing``.

    Where the readings' positions do not determine the slope, the fit falls back to the weighted mean. Repeated rows and
    ties count as separate readings. An empty table gives an empty grid. Columns other than ``keys`` are ignored.
    """
    if degree not in (0, 1):
        raise ValueError("degree must be 0 or 1")
    top = max(4, 2 * degree + 2)  # orders of e for the weighted sums and for the sum of squared weights
    width, h = float(cell_width), float(bandwidth)
    base = df.select(
        *[F.col(k).alias(k) for k in keys],
        F.when((code >= 0) & (code < n_cells), code).cast("int").alias("__cell"),
        F.when(value.isNotNull(), offset.cast("double")).alias("__e"),
        value.cast("double").alias("__y"),
    )
    e, y = F.col("__e"), F.col("__y")
    # Integer-valued power sums of milliseconds: exact as doubles while small, and their low bytes compress in the shuffle.
    cells = base.groupBy(*keys, "__cell").agg(
        F.count(F.lit(1)).alias("__n"),
        F.count(y).alias("__m0"),
        *[F.sum(_power(e, k)).alias(f"__m{k}") for k in range(1, top + 1)],
        *[F.sum(y * _power(e, k) if k else y).alias(f"__y{k}") for k in range(degree + 3)],
    )
    # The power sums of one reading follow from it: nulls in their place, made anew behind the next shuffle, cost that shuffle nothing.
    single = F.col("__m0") == 1
    derived = {f"__m{k}": _power(F.col("__m1"), k) for k in range(2, top + 1)} | {f"__y{k}": F.col("__y0") * _power(F.col("__m1"), k) for k in range(1, degree + 3)}
    cells = cells.withColumns({c: F.when(~single, F.col(c)) for c in derived})
    # The first cell of a source also opens the whole grid, so empty labels exist without a second pass over the input.
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__cell").asc_nulls_first())) == 1
    reach = F.when(first, F.sequence(F.lit(0), F.lit(n_cells - 1))).otherwise(
        F.sequence(F.greatest(F.lit(0), F.col("__cell") - bandwidth), F.least(F.lit(n_cells - 1), F.col("__cell") + bandwidth - 1))
    )
    opened = cells.select(*keys, "__cell", "__n", "__m0", "__m1", "__y0", *derived, reach.alias("__reach")).withColumns({c: F.when(single, v).otherwise(F.col(c)) for c, v in derived.items()})
    moments = [*[f"__m{k}" for k in range(top + 1)], *[f"__y{k}" for k in range(degree + 3)]]
    scaled = [
        *[(F.coalesce(F.col(f"__m{k}"), F.lit(0)) / F.lit(width**k)).alias(f"__m{k}") for k in range(top + 1)],
        *[(F.coalesce(F.col(f"__y{k}"), F.lit(0.0)) / F.lit(width**k)).alias(f"__y{k}") for k in range(degree + 3)],
    ]
    offered = opened.select(*keys, "__cell", "__n", *scaled, "__reach").select(*keys, "__cell", "__n", *moments, F.explode("__reach").alias("cell"))
    s = (F.col("__cell") - F.col("cell")).cast("double")
    inside = (F.col("__cell") - F.col("cell")).between(1 - bandwidth, bandwidth)

    def shifted(prefix: str, order: int) -> Column:
        """Sum of d^order (times y), d = e + s, from the sums about the cell's own label."""
        total = None
        for j in range(order + 1):
            term = F.col(f"__{prefix}{j}") * F.lit(float(comb(order, j)))
            for _ in range(order - j):
                term = term * s
            total = term if total is None else total + term
        return total

    def kernel_sum(prefix: str, order: int) -> Column:
        return shifted(prefix, order) - shifted(prefix, order + 2) / F.lit(h * h)

    w2 = shifted("m", 0) - shifted("m", 2) * F.lit(2.0 / h**2) + shifted("m", 4) / F.lit(h**4)
    add = lambda c, name: F.sum(F.when(inside, c)).alias(name)
    labels = offered.groupBy(*keys, "cell").agg(
        F.sum(F.when(F.col("__cell") == F.col("cell"), F.col("__n"))).alias("__n"),
        *[add(kernel_sum("m", k), f"__s{k}") for k in range(2 * degree + 1)],
        *[add(kernel_sum("y", k), f"__t{k}") for k in range(degree + 1)],
        add(w2, "__w2"),
    )
    s0, t0, w = F.col("__s0"), F.col("__t0"), F.col("__w2")
    # A reading right on the rim has weight 0 up to rounding; below this no reading has weight.
    has = s0 > 1e-9
    n_eff = F.when(has & (w > 0), s0 * s0 / w).otherwise(0.0)
    mean = t0 / s0
    if degree:
        s1, s2, t1 = F.col("__s1"), F.col("__s2"), F.col("__t1")
        det = s0 * s2 - s1 * s1
        fit = F.when(det > 1e-6 * s0 * s0, (s2 * t0 - s1 * t1) / det).otherwise(mean)
    else:
        fit = mean
    estimate = F.when(has & (F.col("n_eff") >= min_support - 1e-6), fit)  # equal weights make whole numbers up to rounding
    return (
        labels.withColumn("n_eff", n_eff)
        .withColumn("estimate", estimate)
        .select(
            *keys,
            "cell",
            F.coalesce(F.col("__n"), F.lit(0)).alias("n_obs"),
            "n_eff",
            "estimate",
            F.when(F.col("__n") > 0, "observed").when(F.col("estimate").isNotNull(), "filled").otherwise("missing").alias("mark"),
        )
    )


def _power(c: Column, k: int) -> Column:
    out = c
    for _ in range(k - 1):
        out = out * c
    return out


def empty_runs(grid: DataFrame, keys: Sequence[str], min_cells: int, bandwidth: int = 5) -> DataFrame:
    """Longest runs of at least ``min_cells`` successive cells with ``n_obs = 0``: ``keys..., first_cell, last_cell``.

    Runs are found by the marks of the regression: a cell without any effective support (``n_eff = 0``, so marked
    ``missing``) has no usable reading within the bandwidth. Such cells are the seeds; a run of ``2 * bandwidth`` or more
    empty cells holds one, so ``min_cells`` may not be less. Each seeded run is then checked exactly: readings without a
    usable value end it as well. Works inside the partitioning of the grid (one source at a time, at most n_cells rows
    each); no further shuffle.
    """
    if min_cells < 2 * bandwidth:
        raise ValueError("a run shorter than twice the bandwidth need not hold a cell without support")
    order = Window.partitionBy(*keys).orderBy("cell")
    seed = (F.col("mark") == "missing") & (F.col("n_eff") == 0)
    empty = grid.where(F.col("n_obs") == 0).select(*keys, "cell", seed.alias("__seed"), (F.col("cell") - F.row_number().over(order)).alias("__run"))
    return (
        empty.groupBy(*keys, "__run")
        .agg(F.min("cell").alias("first_cell"), F.max("cell").alias("last_cell"), F.bool_or("__seed").alias("__seeded"))
        .where(F.col("__seeded") & (F.col("last_cell") - F.col("first_cell") + 1 >= min_cells))
        .drop("__run", "__seeded")
    )
