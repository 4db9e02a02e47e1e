import numpy as np
import pytest

from gridloom.llm import mixing
from pyspark.sql import functions as F

TOKENS = "doc_id bigint, source string, lang string, topic string, n_tokens bigint"
TARGET = "source string, target_share double, max_repeats int"


def tokens(spark, n=4000):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise("tiny").alias("source"), F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("lang"), (F.col("id") % 4).cast("string").alias("topic"), (F.col("id") % 17 + 5).alias("n_tokens"))


def target(spark, rows=(("big", 0.3, 2), ("mid", 0.5, 5), ("tiny", 0.2, 1), ("none", 0.0, 3))):
    return spark.createDataFrame(list(rows), TARGET)


def test_shares_caps_and_marginals(spark):
    t = tokens(spark)
    cells = mixing.cells_of(t)
    cal = mixing.calibrate(cells, target(spark)).toPandas()
    total = t.agg(F.sum("n_tokens")).first()[0]
    by = cal.assign(used=cal.weight * cal.tokens).groupby("source")["used"].sum()
    assert by["big"] == pytest.approx(0.3 * total, rel=1e-3) and by["mid"] == pytest.approx(0.5 * total, rel=1e-3)
    assert (cal.weight <= cal.cap + 1e-9).all()
    assert by["tiny"] == pytest.approx(cal[cal.source == "tiny"].tokens.sum())  # all it has, once
    lang = cal.assign(used=cal.weight * cal.tokens).groupby("lang")["used"].sum()
    assert lang["en"] / lang.sum() == pytest.approx(cal[cal.lang == "en"].tokens.sum() / cal.tokens.sum(), rel=0.02)


def test_sample_is_capped_repeatable_and_near_the_target(spark):
    t = tokens(spark)
    cal = mixing.calibrate(mixing.cells_of(t), target(spark))
    one, two = (sorted(map(tuple, mixing.sample(x, cal).collect())) for x in (t, t.repartition(7)))
    assert one == two
    caps = {"big": 2, "mid": 5, "tiny": 1}
    assert all(0 < r[3] <= caps[r[1]] for r in one) and len({r[0] for r in one}) == len(one)
    report = {r.source: r for r in mixing.report(mixing.sample(t, cal), cal, target(spark), t).collect()}
    assert report["mid"].reached_share == pytest.approx(0.5, abs=0.02) and report["none"].used_tokens == 0
    assert report["tiny"].max_copies == 1 and sum(r.actual_share for r in report.values()) == pytest.approx(1, abs=1e-4)


def test_short_sources(spark):
    t, goal = tokens(spark), target(spark, (("big", 0.3, 2), ("mid", 0.5, 5), ("tiny", 0.2, 1), ("absent", 0.1, 6), ("zero", 0.0, 1), (None, 0.1, 1)))
    cells = mixing.cells_of(t)
    found = {r.source for r in mixing.short_sources(mixing.calibrate(cells, goal), cells, goal).collect()}
    assert found == {"tiny", "absent"}
    # the fit decides: with weights that reach every share nothing is short
    full = mixing.calibrate(cells, goal).withColumn("weight", F.lit(1e6))
    assert {r.source for r in mixing.short_sources(full, cells, goal).collect()} == {"absent"}


def test_a_large_number_of_cells_takes_the_distributed_way(spark, monkeypatch):
    cells = mixing.cells_of(tokens(spark))
    near = {(r.source, r.lang, r.topic): r.weight for r in mixing.calibrate(cells, target(spark)).collect()}
    monkeypatch.setattr(mixing, "MAX_CELLS", 3)
    far = {(r.source, r.lang, r.topic): r.weight for r in mixing.calibrate(cells, target(spark)).collect()}
    assert far.keys() == near.keys()
    for k, v in near.items():
        assert far[k] == pytest.approx(v, rel=1e-6)


def test_edges(spark):
    t = spark.createDataFrame([(1, None, "", "", 5), (2, "big", "", "", 0), (3, "other", "", "", 7)], TOKENS)
    cells = mixing.cells_of(t)
    goal = target(spark, (("big", 1.0, 2),))
    assert {r.source for r in mixing.short_sources(mixing.calibrate(cells, goal), cells, goal).collect()} == {"big"}
    empty = mixing.cells_of(t.limit(0))
    assert mixing.calibrate(empty, goal).count() == 0
    assert mixing.short_sources(mixing.calibrate(empty, goal), empty, goal).count() == 0  # a share of nothing is reached
    assert mixing.calibrate(cells, goal.limit(0)).count() == 0
    assert mixing.fit(*(np.zeros(0, int),) * 3, np.zeros(0), np.zeros(0), (np.zeros(0),) * 3).shape == (0,)


def test_null_texts_count_as_no_tokens(spark):
    docs = spark.createDataFrame([(1, None, "s", None, None), (2, "a b", "s", "en", "de")], "doc_id bigint, text string, source string, lang string, target_lang string")
    got = sorted(map(tuple, mixing.document_tokens(docs, "target_lang").collect()))
    assert got == [(1, "s", "", "", 0), (2, "s", "en", "de", 2)]


def skewed(spark):
    """Cells of very unequal size in which caps bite late and sources fall short, with their targets."""
    rnd = np.random.default_rng(1)
    data = [(f"s{s}", f"l{lang}", f"t{t}", 1, int(10 ** rnd.uniform(0, 5))) for s in range(5) for lang in range(4) for t in range(6) if rnd.random() < 0.5]
    cells = spark.createDataFrame(data, "source string, lang string, topic string, n_docs bigint, tokens bigint")
    return cells, target(spark, (("s0", 0.1, 1), ("s1", 0.4, 2), ("s2", 0.2, 3), ("s3", 0.25, 1), ("s4", 0.05, 1)))


def test_the_distributed_way_takes_the_same_steps(spark, monkeypatch):
    cells, goal = skewed(spark)
    monkeypatch.setattr(mixing, "ROUNDS", 6)
    near = {(r.source, r.lang, r.topic): r.weight for r in mixing.calibrate(cells, goal).collect()}
    monkeypatch.setattr(mixing, "MAX_CELLS", 3)
    far = {(r.source, r.lang, r.topic): r.weight for r in mixing.calibrate(cells, goal).collect()}
    assert far.keys() == near.keys()
    for k, v in near.items():
        assert far[k] == pytest.approx(v, rel=1e-9)


def test_short_sources_do_not_wait_for_the_fit(spark):
    cells, goal = skewed(spark)
    early = mixing.calibrate(cells, goal).withColumn("weight", F.col("cap") * (1 - 1e-6))  # raking that ended before the caps
    assert {r.source for r in mixing.short_sources(early, cells, goal).collect()} == {"s1", "s3"}
