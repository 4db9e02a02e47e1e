import json
import random

import numpy as np
from helpers import rows
from pyspark.sql import functions as F

from gridloom.operators import drift

LINES = "file_id bigint, line_no int, payload string, channel string"
FILES = "file_id bigint, channel int, trade_date string, delivered_at timestamp"


def tables(spark, files, order=None):
    """files: file_id -> list of dicts or raw texts, in order."""
    lines = [(fid, i, p if isinstance(p, str) or p is None else json.dumps(p), "clash") for fid, ps in files.items() for i, p in enumerate(ps)]
    ids = order or list(files)
    info = spark.sql("select * from values " + ", ".join(f"({fid}L, 1, '2024-01-{1 + i // 3:02d}', timestamp'2024-01-01 00:00:{i:02d}')" for i, fid in enumerate(ids)) + " as t(file_id, channel, trade_date, delivered_at)")
    return spark.createDataFrame(lines, LINES), info


def changes(spark, files):
    return rows(drift.changes(*tables(spark, files)))


def order(i, rnd, **names):
    base = {"symbol": f"{i % 3:06d}.XSHE", "time": 34_000_000 + i * 1000, "order_num": 100 + i * 7, "price": 100_000 + rnd.randrange(999) * 100, "side": 49 + i % 2, "volume": 100 * (1 + rnd.randrange(9)), "money": 10**7 + rnd.randrange(10**8)}
    return {names.get(k, k): v for k, v in base.items()}


def test_changes(spark):
    rnd = random.Random(2)
    many = lambda **names: [order(i, rnd, **names) for i in range(8)]
    second = many(order_num="orderid", volume="Volume")
    third = [{**r, "money": f"{r['money'] / 10000:.2f}", "note": "n1"} for r in second]
    fourth = [{k: (float(v) if k == "Volume" else v) for k, v in r.items() if k != "note"} | {"flag": True} for r in third]
    fifth = [{("qty" if k == "Volume" else k): (str(int(v)) if k == "Volume" else v) for k, v in r.items() if k != "money"} for r in fourth]
    lines, info = tables(spark, {11: many(), 5: second, 7: third, 3: fourth, 4: fifth})
    assert rows(drift.changes(lines, info)) == sorted(
        [
            (5, "orderid", "renamed"), (5, "Volume", "renamed"), (7, "money", "retyped"), (7, "note", "added"), (3, "note", "removed"), (3, "flag", "added"), (3, "Volume", "retyped"),
            (4, "money", "removed"), (4, "qty", "renamed"), (4, "qty", "retyped"),
        ],
        key=repr,
    )
    names = {(r.file_id, r.path): r.canonical for r in drift.schema_history(lines, info).collect()}
    assert names[4, "qty"] == "volume" and names[7, "orderid"] == "order_num"


def test_nulls_damage_and_empty_files(spark):
    files = {1: [{"a": 1, "b": None}, {"a": 2}], 2: [None, "not json", "[1]", ""], 3: [{"a": 1, "b": "x"}], 4: [{"a": None, "b": "x"}], 5: [{"a": 5, "b": "x"}], 6: [{"a": 5.0, "b": {"c": 1}}]}
    got = changes(spark, files)
    assert (2, "a", "removed") in got and (2, "b", "removed") in got
    assert (3, "a", "added") in got and (3, "b", "added") in got
    assert not [g for g in got if g[0] in (4, 5)]  # written as null only: the type stays
    assert (6, "a", "retyped") in got and (6, "b", "retyped") in got and (6, "b.c", "added") in got


def test_empty_tables(spark):
    lines, info = tables(spark, {1: [{"a": 1}]})
    assert rows(drift.changes(lines, info)) == []
    none = drift.schema_history(lines.limit(0), info)
    assert none.count() == 0 and rows(drift.changes(lines.limit(0), info)) == []
    assert drift.unify(lines.limit(0), none, drift.ORDER_COLUMNS).count() == 0


def test_the_flood_decides(spark, monkeypatch):
    """Without its scores nothing corresponds, whatever the names."""
    rnd = random.Random(5)
    many = lambda **names: [order(i, rnd, **names) for i in range(8)]
    files = {1: many(), 2: many(volume="vol"), 3: many(volume="vol", money="turnover")}
    assert changes(spark, files) == [(2, "vol", "renamed"), (3, "turnover", "renamed")]
    fields = lambda names: [drift.Field(n, "integer", 3.0, 0.3, 2.0) for n in names]
    pairs = [(fields("abc"), fields("abd"))]
    assert drift.compare_schemas(pairs) == [[("d", "renamed", "c")]]
    monkeypatch.setattr(drift, "flood_all", lambda ps: [np.zeros((len(a), len(b))) for a, b in ps])
    assert len(drift.compare_schemas(pairs)[0]) == 6


def test_scores_are_a_fixpoint_and_alone_or_together_alike():
    rnd = random.Random(7)
    def schema(n):
        return [drift.Field(rnd.choice(["order_num", "vol", "px", "a.b", "note"]) + str(i), rnd.choice(["integer", "string", "number"]), rnd.choice([None, rnd.random() * 8]), 0.3, 2.0, False, tuple(rnd.randrange(3) for _ in range(16))) for i in range(n)]
    pairs = [(schema(rnd.randrange(5)), schema(rnd.randrange(7))) for _ in range(12)]
    for f in (x for p in pairs for s in p for x in s):
        if f.size is None:
            f.spread = f.digits = None
    for (a, b), together in zip(pairs, drift.flood_all(pairs), strict=True):
        alone = drift.flood(a, b)
        assert alone.shape == (len(a), len(b)) and np.allclose(alone, together, atol=1e-12)
        if alone.size:
            assert alone.max() == 1.0
            assert np.allclose(drift.flood(b, a), alone.T, atol=1e-9)


def test_a_hot_file_and_long_history(spark):
    files = {1: [{"a": i, "b": "x"} for i in range(3000)]} | {i: [{"a": i, "c" if i % 2 else "b": "x"}] for i in range(2, 30)}
    got = changes(spark, files)
    assert len(got) == 27 and {k for _, _, k in got} == {"renamed"}


def test_unify(spark):
    first = [{"symbol": "a", "order_num": 7, "price": 101500, "volume": 300, "money": 30450000}]
    second = [{"symbol": "a", "order_num": "W134", "price": 10.15, "volume": "1,300", "money": "3045.00"}, {"symbol": "b", "order_num": "0000000117", "price": None, "volume": 100.0, "money": None}, "broken"]
    lines, info = tables(spark, {1: first * 3, 2: second})
    history = drift.schema_history(lines, info)
    by_join = drift.unify(lines, history, drift.ORDER_COLUMNS, broadcast_files=0)
    assert rows(by_join) == rows(drift.unify(lines, history, drift.ORDER_COLUMNS))
    got = rows(by_join, "file_id", "line_no", "channel", "symbol", "order_num", "price", "volume", "money")
    assert got[0] == (1, 0, "clash", "a", 7, 101500, 300, 30450000)
    assert got[3:] == [(2, 0, "clash", "a", 134, 101500, 1300, 30450000), (2, 1, "clash", "b", 117, None, 100, None), (2, 2, "clash", None, None, None, None, None)]


def test_flooding_prefers_names_types_and_values():
    f = drift.Field
    before = [f("order_num", "integer", 2.8, 0.3, 3.0), f("recv_seq", "integer", 0.6, 0.3, 1.0), f("note", "string", None, None, None, True, (1, 2, None))]
    after = [f("orderid", "string", 2.7, 0.3, 2.9), f("group", "string", None, None, None, True, (8, 9, None))]
    assert drift.compare_schemas([(before, after)]) == [[("group", "added", None), ("note", "removed", "note"), ("orderid", "renamed", "order_num"), ("orderid", "retyped", "order_num"), ("recv_seq", "removed", "recv_seq")]]
    scores = drift.flood(before, after)
    assert scores.max() == 1.0 and scores[0, 0] == 1.0
    assert drift.flood([], after).shape == (0, 2)


def test_json_types(spark):
    line = '{"a": 1, "b": 1.0, "c": 1e3, "d": "1", "e": true, "f": null, "g": [1], "h": {"i": {"j": 2}}, "k": 123456789012345678901, "x": "1,300", "y": "W134", "z": "000001.XSHE"}'
    df = spark.createDataFrame([(1, line), (2, '{"a": 1, "a": 2}')], "id bigint, p string")
    kinds = {r.path: r.k for r in drift.line_fields(df, "id", "p").select("path", drift.json_kind(F.col("value")).alias("k")).where("path is not null").collect()}
    assert kinds == {"a": "integer", "b": "number", "c": "number", "d": "string", "e": "boolean", "f": "null", "g": "array", "h": "object", "h.i": "object", "h.i.j": "integer", "k": "integer", "x": "string", "y": "string", "z": "string"}
    texts = spark.createDataFrame([("1,300",), ("W134",), ("000001.XSHE",), (None,)], "t string")
    assert [r[0] for r in texts.select(drift.number_text(F.col("t"))).collect()] == ["1300", "134", None, None]
