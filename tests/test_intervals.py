import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from gridloom.operators import intervals as iv


def expand(df):
    return sorted(n for lo, hi in rows(df, "lo", "hi") for n in range(lo, hi + 1))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(iv, "BLOCK", 8)


def test_set_algebra(spark, small_blocks):
    rnd = random.Random(1)
    for _ in range(2):
        a, b = {rnd.randrange(60) for _ in range(40)}, {rnd.randrange(60) for _ in range(25)}
        make = lambda x: spark.createDataFrame([("s", n) for n in x] * 2 + [("s", None)], "m string, n bigint")
        ia, ib = iv.to_intervals(make(a), ["m"], "n"), iv.to_intervals(make(b), ["m"], "n")
        assert expand(ia) == sorted(a)
        assert expand(iv.subtract(ia, ib, ["m"])) == sorted(a - b)
        merged = iv.merge(ia, ib, stream=["m"])
        assert expand(merged) == sorted(a | b)
        whole = rows(iv.compact(merged, ["m"]), "lo", "hi")
        assert all(y[0] > x[1] + 1 for x, y in zip(sorted(whole), sorted(whole)[1:]))
        records = make(range(60)).withColumn("block", F.lit("clash")).withColumn("lo", F.lit(0))
        got = rows(iv.records_in(records, iv.subtract(ia, ib, ["m"]), ["m"], "n"), "n")
        assert sorted(n for (n,) in got) == sorted([*(a - b)] * 2)
        assert rows(iv.records_in(records, iv.subtract(ia, ib, ["m"]), ["m"], "n", most_intervals=0), "n") == got


def test_streams_are_apart_and_empty(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "m string, n bigint")
    done = iv.to_intervals(df.where("m = 'a'"), ["m"], "n")
    gaps = iv.subtract(iv.to_intervals(df, ["m"], "n"), done, ["m"])
    assert rows(iv.records_in(df, gaps, ["m"], "n")) == [("b", 2)]
    assert rows(iv.to_intervals(df.limit(0), ["m"], "n")) == []
    assert rows(iv.subtract(iv.to_intervals(df.limit(0), ["m"], "n"), done, ["m"])) == []


FILES = "file_id bigint, dataset string, trade_date string, channel int, delivery int, delivered_at string, n_rows bigint, content_digest string, file_state string"
LOG = "log_id bigint, metric_name string, trade_date string, channel int, started_at string, finished_at string, run_status string, source_digest string"


def test_pending_files(spark, tmp_path):
    files = [
        (1, "weituo", "d1", 1, 1, "t1", 5, "A", "complete"),  # processed
        (2, "weituo", "d1", 2, 1, "t1", 5, "B", "complete"),  # replaced by 3, changed
        (3, "weituo", "d1", 2, 2, "t2", 5, "C", "complete"),
        (4, "weituo", "d2", 1, 1, "t1", 5, "D", "complete"),  # replaced by 5, unchanged
        (5, "weituo", "d2", 1, 2, "t2", 5, "D", "complete"),
        (6, "weituo", "d2", 2, 1, "t1", 5, "E", "partial"),  # never complete
        (7, "weituo", "d3", 1, 1, "t1", 5, "F", "complete"),  # failed and running only
        (8, "weituo", "d3", 2, 1, "t1", 5, "G", "complete"),  # an old success after a later one of other content
        (9, "weituo", "d3", 3, 2, "t2", 5, "H", "partial"),  # broken redelivery: the complete one counts
        (10, "weituo", "d3", 3, 1, "t1", 5, "I", "complete"),
    ]
    log = [
        (1, "order_count_min", "d1", 1, "a", "b", "success", "A"),
        (1, "order_count_min", "d1", 1, "a", "b", "success", "A"),
        (2, "order_count_min", "d1", 2, "a", "b", "success", "B"),
        (3, "order_count_min", "d2", 1, "a", "b", "success", "D"),
        (4, "order_count_min", "d3", 1, "a", "b", "failed", "F"),
        (5, "order_count_min", "d3", 1, "a", None, "running", "F"),
        (6, "order_count_min", "d3", 2, "a", "b", "success", "G"),
        (7, "order_count_min", "d3", 2, "a", "c", "success", "X"),
        (8, "order_count_min", "d3", 3, "a", "c", "success", "I"),
    ]
    inputs = {"order_count_min": "weituo"}

    def pending(files, log):
        day_file, run_log = spark.createDataFrame(files, FILES), spark.createDataFrame(log, LOG)
        ledger = iv.Ledger(spark, f"file://{tmp_path}/{len(files)}-{len(log)}", ["metric_name"])
        ledger.adopt(iv.processed_deliveries(day_file, run_log, inputs), "file_id")
        available = iv.current_deliveries(day_file, inputs)
        return rows(iv.records_in(available, ledger.gaps(available, "file_id"), ["metric_name"], "file_id"), "metric_name", "trade_date", "channel", "file_id")

    assert pending(files, log) == [("order_count_min", "d1", 2, 3), ("order_count_min", "d3", 1, 7), ("order_count_min", "d3", 2, 8)]
    assert pending([], log) == [] and len(pending(files, [])) == 6


def test_ledger_survives_failures_and_late_commits(spark, tmp_path):
    ledger = iv.Ledger(spark, f"file://{tmp_path}/ledger", ["m"])
    frame = lambda ns: spark.createDataFrame([("s", n, n * 10) for n in ns], "m string, n bigint, v bigint")
    assert ledger.output() is None
    assert ledger.run(frame([1, 2, 5]), "n", lambda df: df.select("n", "v")) == 0

    def broken(df):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        ledger.run(frame([1, 2, 3, 5, 6]), "n", broken)
    assert ledger.versions() == [0]
    # 3 was committed late, between numbers already processed
    assert ledger.run(frame([1, 2, 3, 5, 6]), "n", lambda df: df.select("n", "v")) == 1
    assert ledger.run(frame([1, 2, 3, 5, 6]), "n", lambda df: df.select("n", "v")) is None
    assert rows(ledger.output()) == [(n, n * 10) for n in (1, 2, 3, 5, 6)]
    assert expand(ledger.processed({"m": "string"})) == [1, 2, 3, 5, 6]
    with pytest.raises(Exception, match="committed"):
        ledger._commit(f"file://{tmp_path}/none", 1)


def test_processed_files_are_not_read_again(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path / "in"
    folder.mkdir()

    def deliver(name, ns, stream="s"):
        pq.write_table(pa.table({"m": pa.array([stream] * len(ns)), "n": pa.array(ns, pa.int64())}), folder / name)

    deliver("a.parquet", list(range(0, 10)))
    deliver("b.parquet", list(range(10, 20)))
    ledger = iv.Ledger(spark, f"file://{tmp_path}/ledger", ["m"])
    read = lambda: spark.read.parquet(str(folder))
    assert ledger.run(read(), "n", lambda df: df.select("m", "n")) == 0
    deliver("c.parquet", [20, 22])
    deliver("d.parquet", [5, 21])  # overlaps what is processed
    deliver("e.parquet", [3, 4], "t")  # the same numbers of another stream
    assert sorted(f[-9:] for f in ledger.unread(read(), "n").inputFiles()) == ["c.parquet", "d.parquet", "e.parquet"]
    assert ledger.run(read(), "n", lambda df: df.select("m", "n")) == 1
    assert rows(ledger.output()) == sorted([("s", n) for n in range(23)] + [("t", 3), ("t", 4)], key=repr)
    deliver("f.parquet", [21, 23])
    assert [f[-9:] for f in ledger.unread(read(), "n").inputFiles()] == ["f.parquet"]
    filtered = read().where("n <> 22")  # more than its files: nothing is skipped
    assert ledger.unread(filtered, "n") is filtered


def test_compact_joins_at_block_edges(spark, small_blocks):
    df = spark.createDataFrame([("s", n) for n in [*range(3, 27), 30, 40, 41, 47, 48]] + [("t", 8)], "m string, n bigint")
    assert rows(iv.compact(iv.to_intervals(df, ["m"], "n"), ["m"]), "m", "lo", "hi") == [("s", 3, 26), ("s", 30, 30), ("s", 40, 41), ("s", 47, 48), ("t", 8, 8)]
