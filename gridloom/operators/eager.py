"""Aggregates over a join without forming the join (problem 1: a few keys hold most records).

Both inputs are reduced to one compact state per join key (Spark's map-side combine reduces a hot key inside every
map task, so the shuffle carries at most one row per key and map task), the states are joined, and every aggregate of
the joined rows is put together algebraically: ``count = nL * nR``, ``sum(l) = sum_L(l) * nR``,
``sum(l * r) = sum_L(l) * sum_R(r)``. A roll-up then adds the states of coarser groups. No task ever holds the rows of
one key, so a key with a third of all rows costs what any other key costs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class PairAgg:
    """An aggregate over the joined rows. kind: ``count``, ``sum_left``, ``sum_right``, ``sum_product``, ``min_left``, ``max_left``, ``min_right``, ``max_right``."""

    name: str
    kind: str
    left: str | None = None
    right: str | None = None


def _state(df: DataFrame, keys: Sequence[str], extra: Sequence[str], columns: set[str], extremes: set[str], side: str) -> DataFrame:
    """One row per (key, extra roll-up columns): row count, sums and extremes, under names that cannot clash."""
    aggs: list[Column] = [F.count(F.lit(1)).alias(f"__{side}_n")]
    aggs += [F.sum(F.col(c)).alias(f"__{side}_sum_{c}") for c in sorted(columns)]
    for c in sorted(extremes):
        aggs += [F.min(F.col(c)).alias(f"__{side}_min_{c}"), F.max(F.col(c)).alias(f"__{side}_max_{c}")]
    needed = list(dict.fromkeys([*keys, *extra, *columns, *extremes]))
    state = df.select(*[F.col(c) for c in needed]).groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"__{side}_by_{c}") for c in extra]).agg(*aggs)
    return state


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str],
    aggs: Sequence[PairAgg],
    by_left: Sequence[str] = (),
    by_right: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """``select by..., aggs from left join right on keys group by by...`` in the eager form.

    ``by_left``/``by_right``: columns of either side to group the result by; empty: by the join keys, which come out
    under the left side's names. ``how``: inner, left or full.

    Defined results. Null keys match nothing (SQL); with left/full their rows count once, unmatched. Null values are
    skipped by sums and extremes; a group whose values are all null gives null. Empty inputs give the empty or the
    one-sided result. Repeated rows count each time. Other columns of the inputs, clashing names included, are ignored.
    Sums and products of integers are decimal(38,0); those of decimals keep their scale (the scales of both sides added, for a
    product). They are computed as whole numbers of the smallest unit: an overflow is an error under ANSI, never a wrapped value.
    """
    if how not in {"inner", "left", "full"}:
        raise ValueError(f"how must be inner, left or full: {how}")
    if len(left_on) != len(right_on) or not left_on:
        raise ValueError("left_on and right_on must name the same number of columns")
    sums_l = {a.left for a in aggs if a.kind in {"sum_left", "sum_product"}}
    sums_r = {a.right for a in aggs if a.kind in {"sum_right", "sum_product"}}
    ext_l = {a.left for a in aggs if a.kind in {"min_left", "max_left"}}
    ext_r = {a.right for a in aggs if a.kind in {"min_right", "max_right"}}
    ls = _state(left, left_on, by_left, sums_l, ext_l, "l")
    rs = _state(right, right_on, by_right, sums_r, ext_r, "r")
    keys = [f"__k{i}" for i in range(len(left_on))]
    joined = ls.join(rs, on=keys, how=how)
    types_l, types_r = dict(left.dtypes), dict(right.dtypes)

    n_l, n_r = F.col("__l_n"), F.col("__r_n")
    many_l = F.coalesce(n_l, F.lit(1)).cast(WIDE)
    many_r = F.coalesce(n_r, F.lit(1)).cast(WIDE)
    out: list[Column] = []
    for a in aggs:
        if a.kind == "count":
            value = F.sum((many_l * many_r).cast(WIDE)).cast(WIDE)
        elif a.kind == "sum_left":
            value = _sum_of_products(F.col(f"__l_sum_{a.left}"), types_l[a.left], many_r, "bigint")
        elif a.kind == "sum_right":
            value = _sum_of_products(F.col(f"__r_sum_{a.right}"), types_r[a.right], many_l, "bigint")
        elif a.kind == "sum_product":
            value = _sum_of_products(F.col(f"__l_sum_{a.left}"), types_l[a.left], F.col(f"__r_sum_{a.right}"), types_r[a.right])
        elif a.kind in {"min_left", "max_left", "min_right", "max_right"}:
            f, side = a.kind.split("_")
            column = a.left if side == "left" else a.right
            value = getattr(F, f)(F.col(f"__{side[0]}_{f}_{column}"))
        else:
            raise ValueError(f"unknown aggregate {a.kind}")
        out.append(value.alias(a.name))
    if by_left or by_right:
        groups = [F.col(f"__l_by_{c}").alias(c) for c in by_left] + [F.col(f"__r_by_{c}").alias(c) for c in by_right]
    else:
        groups = [F.col(k).alias(c) for k, c in zip(keys, left_on, strict=True)]
    return joined.groupBy(*groups).agg(*out)


def _scale(kind: str) -> int | None:
    """Digits after the point of an exact type; None for doubles and the like."""
    if kind in {"tinyint", "smallint", "int", "bigint"}:
        return 0
    return int(kind.rstrip(")").split(",")[1]) if kind.startswith("decimal") else None


def _units(c: Column, scale: int) -> Column:
    """An exact number as a whole number of its smallest unit; by its text, as a decimal product would cut the scale."""
    return c.cast(WIDE) if not scale else F.concat(c.cast("string"), F.lit(f"E{scale}")).cast(WIDE)


def _sum_of_products(a: Column, kind_a: str, b: Column, kind_b: str) -> Column:
    scale_a, scale_b = _scale(kind_a), _scale(kind_b)
    if scale_a is None or scale_b is None:
        return F.sum(a.cast("double") * b.cast("double"))
    scale = scale_a + scale_b
    if scale > 38:
        raise ValueError(f"a product of {kind_a} and {kind_b} has more than 38 digits after the point")
    total = F.sum((_units(a, scale_a) * _units(b, scale_b)).cast(WIDE)).cast(WIDE)
    return total if not scale else F.concat(total.cast("string"), F.lit(f"E-{scale}")).cast(f"decimal(38,{scale})")


def key_shares(tables: dict[str, DataFrame], by: str, key: str) -> DataFrame:
    """Rows of every (table, by, key) and of every (table, by): ``table_name, <by>, <key>, n_rows, n_total``.

    The tables' compact states (one row per by and key) are joined outer-wise on (by, key); totals are a roll-up of that
    join, joined back on ``by``. Null keys are counted as a key of their own; an empty table adds no row.
    """
    names = list(tables)
    states = None
    for i, name in enumerate(names):
        state = tables[name].select(F.col(by).alias("__by"), F.col(key).alias("__key")).groupBy("__by", "__key").agg(F.count(F.lit(1)).alias(f"__n{i}"))
        if states is None:
            states = state
        else:
            # null-safe: a null key of one table meets the null key of the other
            right = state.withColumnsRenamed({"__by": "__by2", "__key": "__key2"})
            states = (
                states.join(right, F.col("__by").eqNullSafe(F.col("__by2")) & F.col("__key").eqNullSafe(F.col("__key2")), "full")
                .withColumn("__by", F.coalesce("__by", "__by2"))
                .withColumn("__key", F.coalesce("__key", "__key2"))
                .drop("__by2", "__key2")
            )
    totals = states.groupBy(F.col("__by").alias("__tby")).agg(*[F.sum(f"__n{i}").alias(f"__t{i}") for i in range(len(names))])
    both = states.join(totals, F.col("__by").eqNullSafe(F.col("__tby")), "inner")
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("table_name"), F.col(f"__n{i}").alias("n_rows"), F.col(f"__t{i}").alias("n_total")) for i, n in enumerate(names)])).alias("__c")
    return both.select(F.col("__by").alias(by), F.col("__key").alias(key), cells).select("__c.table_name", by, key, "__c.n_rows", "__c.n_total").where(F.col("n_rows").isNotNull())
