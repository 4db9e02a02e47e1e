import datetime as dt
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import rows
from pyspark.sql import functions as F

from gridloom.plans import runner
from gridloom.sources import dayfiles, paths, published
from gridloom.streaming import daily

META = {"format_version": "1", "price_scale": "10000", "money_scale": "10000", "type_encoding": "1=1,2=2,3=U,50=50,85=85", "price_policy_version": "3"}


def write(root, dataset, day, columns, **meta):
    path = paths.input_path(root, dataset, day)
    path.parent.mkdir(parents=True, exist_ok=True)
    table = pa.table(columns)
    pq.write_table(table.replace_schema_metadata(META | meta), path)
    return path


def trades(day, k=1, symbols=("a", "b")):
    date = dt.datetime.strptime(str(day), "%Y%m%d").date()
    n = 5 * len(symbols)
    times = [34_200_000, 34_200_001, 41_400_000, 46_800_000, 54_000_000] * len(symbols)
    return {
        "symbol": pa.array([s for s in symbols for _ in range(5)]), "date": pa.array([date] * n), "time": pa.array(times, pa.uint32()), "volume": pa.array([k * (i % 5 + 1) for i in range(n)], pa.uint32()), "price": pa.array([100_500] * n, pa.int64()),
        "money": pa.array([None] + [10] * (n - 1), pa.int64()), "channel": pa.array([2011] * n, pa.uint16()), "buy_order_num": pa.array(range(n), pa.uint32()), "sell_order_num": pa.array([2] * n, pa.uint32()), "side": pa.array([49] * n, pa.uint8()),
    }


def test_paths(tmp_path):
    assert str(paths.input_path("r", "weituo", 20250102)) == "r/weituo/2025/202501/20250102_weituo.parquet"
    assert paths.date_text(dt.date(2025, 1, 2)) == paths.date_text("2025-01-02") == "20250102"
    for bad in ("2025012", 2025011, "x", True):
        with pytest.raises(ValueError):
            paths.date_text(bad)
    with pytest.raises(ValueError, match="dataset"):
        paths.input_path("r", "other", 20250102)
    for day in (20250102, 20250103):
        write(tmp_path, "chengjiao", day, trades(day))
    write(tmp_path, "weituo", 20250102, trades(20250102))
    (tmp_path / "chengjiao/2025/202501/20250104_weituo.parquet").write_text("not this data set")
    assert paths.discover_dates(tmp_path, "chengjiao") == ["20250102", "20250103"]
    with pytest.raises(FileNotFoundError, match="weituo 20250103"):
        paths.matching_dates(tmp_path, ["weituo", "chengjiao"])
    assert paths.matching_dates(tmp_path, ["weituo", "chengjiao"], end=20250102) == ["20250102"]
    with pytest.raises(ValueError, match="after"):
        paths.matching_dates(tmp_path, ["weituo"], 20250103, 20250102)
    with pytest.raises(FileNotFoundError, match="no day"):
        paths.matching_dates(tmp_path, ["weituo"], 20260101)
    for bad in ("../x_min", "X_min", "volume"):
        with pytest.raises(ValueError):
            paths.metric_root(tmp_path, bad)


def test_day_files(spark, tmp_path):
    path = write(tmp_path, "chengjiao", 20250102, trades(20250102))
    write(tmp_path, "chengjiao", 20250103, trades(20250103), price_scale="37")
    info = dayfiles.field_info(path, ["price", "volume", "time_ms", "money"], "chengjiao")
    assert info["price"] == {"physical_type": "int64", "scale": 10000, "normalized": True} and info["money"]["scale"] == 10000
    assert info["volume"] == {"physical_type": "uint32", "scale": None, "normalized": False} and info["time_ms"]["physical_type"] == "uint32"
    doubles = trades(20250109) | {"price": pa.array([10.5] * 10)}
    assert dayfiles.field_info(write(tmp_path, "chengjiao", 20250109, doubles), ["price"], "chengjiao")["price"] == {"physical_type": "double", "scale": None, "normalized": False}
    without = {k: v for k, v in trades(20250109).items() if k != "money"}
    assert dayfiles.field_info(write(tmp_path, "weituo", 20250109, without), ["money"], "weituo")["money"] == {"physical_type": "derived", "scale": None, "normalized": False}
    df = dayfiles.read_days(spark, tmp_path, "chengjiao", [20250102, "20250103"], ["time_ms", "price", "money", "timestamp"])
    assert df.columns == ["time_ms", "price", "money", "timestamp"]
    assert {r[0] for r in rows(df.select(F.round("price", 4)))} == {10.05, round(100_500 / 37, 4)}
    assert df.where("money is null").count() == 2
    assert rows(df.where("time_ms = 34200001").select(F.min("timestamp").cast("string"))) == [("2025-01-02 09:30:00.001",)]
    assert dayfiles.row_count([path]) == 10
    plan = df.select("time_ms")._jdf.queryExecution().executedPlan().toString()
    assert "money" not in plan.split("ReadSchema")[-1]
    for logical, text in (([], "no columns"), (["nothing"], "no column nothing")):
        with pytest.raises(ValueError, match=text):
            dayfiles.read_days(spark, tmp_path, "chengjiao", [20250102], logical)
    with pytest.raises(ValueError, match="policy"):
        dayfiles.read_days(spark, tmp_path, "chengjiao", [20250102], ["price"], price_policy="2")
    bare = {k: v for k, v in trades(20250104).items() if k != "money"}
    write(tmp_path, "chengjiao", 20250104, bare)
    with pytest.raises(ValueError, match="never recomputed"):
        dayfiles.read_days(spark, tmp_path, "chengjiao", [20250104], ["money"])
    write(tmp_path, "weituo", 20250104, bare)
    assert dayfiles.read_days(spark, tmp_path, "weituo", [20250104], ["money"]).first()[0] == pytest.approx(10.05)
    write(tmp_path, "chengjiao", 20250106, trades(20250105))  # another date than its name
    with pytest.raises(Exception, match="another date"):
        dayfiles.read_days(spark, tmp_path, "chengjiao", [20250106], ["trade_date"]).collect()


def plan_of(tmp_path, **run):
    values = {"input_root": str(tmp_path / "in"), "output_root": str(tmp_path / "out"), "state_root": str(tmp_path / "state"), "mode": "daily"} | run
    text = "[run]\n" + "".join(f"{k} = {json.dumps(v)}\n" for k, v in values.items()) + '[[task]]\nname = "basic"\ngroup = "trades_basic"\n[task.columns]\nchengjiao = ["symbol", "trade_date", "time_ms", "volume", "money", "buy_order_num"]\n'
    path = tmp_path / "plan.toml"
    path.write_text(text)
    return path


def test_publication(spark, tmp_path):
    days = (20250102, 20250103, 20250203)
    for i, day in enumerate(days):
        write(tmp_path / "in", "chengjiao", day, trades(day, i + 1))
    plan = runner.load_plan(plan_of(tmp_path, end="20250103"))
    code, reports = runner.run_plan(spark, plan)
    assert code == runner.OK and reports[0].status == "planned" and not (tmp_path / "out").exists()
    code, reports = runner.run_plan(spark, plan, execute=True)
    assert code == runner.OK, reports
    assert published.published_dates(plan.output_root, "trade_volume_min") == ["20250102", "20250103"]
    df = published.read_metric(spark, plan.output_root, "trade_volume_min")
    assert df.count() == 2 * 2 * 242
    assert [r[0] for r in rows(df.where("trade_date = '2025-01-03' and symbol = 'a' and trade_volume_min > 0").groupBy("trade_date").agg(F.sum("trade_volume_min")).select("sum(trade_volume_min)"))] == [30]
    # resume: only the new day
    code, reports = runner.run_plan(spark, runner.load_plan(plan_of(tmp_path)), execute=True)
    assert reports[0].days == ["20250203"]
    assert runner.run_plan(spark, runner.load_plan(plan_of(tmp_path)), execute=True)[1][0].status == "no_work"
    # overwrite: one day changes, the others stay
    write(tmp_path / "in", "chengjiao", 20250103, trades(20250103, 7))
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "out/trade_volume_min").rglob("*.parquet") if "2025-01-03" not in str(p)}
    code, reports = runner.run_plan(spark, runner.load_plan(plan_of(tmp_path, mode="repair", start="20250103", end="20250103")), execute=True)
    assert code == runner.OK and {p: p.stat().st_mtime_ns for p in kept} == kept
    df = published.read_metric(spark, plan.output_root, "trade_volume_min")
    assert df.where("trade_date = '2025-01-03'").agg(F.sum("trade_volume_min")).first()[0] == 2 * 15 * 7
    assert published.read_manifest(plan.state_root, "trade_volume_min_manifest")["status"] == "ok"
    # the strict month file
    config = plan.config()
    n = published.export_month(spark, plan.output_root, "trade_volume_min", "202501", str(tmp_path / "m/202501.parquet"), config)
    table = pq.read_table(tmp_path / "m/202501.parquet")
    assert n == table.num_rows == 2 * 2 * 242
    assert str(table.schema.field("minute").type) == "timestamp[ms, tz=Asia/Shanghai]" and not table.schema.field("symbol").nullable
    assert table.schema.metadata[b"metric_name"] == b"trade_volume_min"
    assert table.slice(0, 1).to_pylist()[0]["minute"].isoformat() == "2025-01-02T09:30:00+08:00"
    with pytest.raises(FileExistsError):
        published.pending_dates(["20250102"], ["20250102"], published.RunConfig("a", "b"))


def test_a_repeated_run_looks_again_at_skipped_days(spark, tmp_path):
    write(tmp_path / "in", "chengjiao", 20250102, trades(20250102))
    assert runner.run_plan(spark, runner.load_plan(plan_of(tmp_path)), execute=True)[0] == runner.OK
    day = next((tmp_path / "out/trade_volume_min").rglob("*.parquet"))
    table = pq.read_table(day)
    pq.write_table(table.slice(1), day)  # a cell is lost
    day.with_name(f".{day.name}.crc").unlink(missing_ok=True)
    spark.catalog.refreshByPath(str(tmp_path / "out/trade_volume_min"))
    code, reports = runner.run_plan(spark, runner.load_plan(plan_of(tmp_path)), execute=True)
    assert code == runner.FAILED and reports[0].problems["trade_volume_min"] == {"skipped_incomplete_days": 1}
    write(tmp_path / "in", "chengjiao", 20250103, trades(20250103))
    code, reports = runner.run_plan(spark, runner.load_plan(plan_of(tmp_path)), execute=True)
    assert code == runner.FAILED and reports[0].days == ["20250103"] and reports[0].problems["trade_volume_min"] == {"skipped_incomplete_days": 1}
    assert not (tmp_path / "state/staging").exists()


def test_publication_leaves_other_caches_alone(spark, tmp_path):
    kept = spark.range(3).persist()
    kept.count()
    write(tmp_path / "in", "chengjiao", 20250102, trades(20250102))
    assert runner.run_plan(spark, runner.load_plan(plan_of(tmp_path)), execute=True)[0] == runner.OK
    assert kept.storageLevel.useMemory and "InMemoryTableScan" in kept.groupBy().count()._jdf.queryExecution().executedPlan().toString()
    kept.unpersist()


def test_several_files_a_day_follow_each_other(spark, tmp_path):
    dense = spark.range(242 * 40).select(F.lit("2025-01-02").cast("date").alias("trade_date"), (F.lit("2025-01-02 09:30:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") % 242).cast("int"))).alias("minute"), F.format_string("s%02d", (F.col("id") / 242).cast("int")).alias("symbol"), F.col("id").alias("v_min"))
    published.write_days(dense, str(tmp_path), "v_min", published.RunConfig("a", "b", files_per_day=3))
    files = sorted((tmp_path / "v_min").rglob("*.parquet"))
    got = [(r["minute"], r["symbol"]) for f in files for r in pq.ParquetFile(f).read(columns=["minute", "symbol"]).to_pylist()]
    assert len(files) == 3 and len(got) == 242 * 40 and got == sorted(got)


def test_run_guards(spark, tmp_path):
    write(tmp_path / "in", "chengjiao", 20250102, trades(20250102))
    plan = runner.load_plan(plan_of(tmp_path))
    (tmp_path / "state").mkdir()
    (tmp_path / "state/run.lock").write_text("1")
    assert runner.run_plan(spark, plan, execute=True)[0] == runner.LOCKED
    (tmp_path / "state/run.lock").unlink()
    seen = []
    assert runner.run_plan(spark, plan, execute=True, check_ready=lambda days: seen.extend(days) or days.clear() or "late")[0] == runner.NOT_READY
    assert seen == ["20250102"]
    (tmp_path / "state/STOP").write_text("")
    assert runner.run_plan(spark, plan, execute=True)[1][0].status == "stopped"
    (tmp_path / "state/STOP").unlink()
    code, reports = runner.run_plan(spark, plan, execute=True, validate_output=lambda days: "bad")
    assert code == runner.FAILED and reports[0].status == "failed: bad"
    assert runner.bench_day(spark, plan, plan.tasks[0], "20250102")["rows"] == 10
    for bad in ({"mode": "x"}, {"validation": "x"}, {"state_root": str(tmp_path / "out/state")}, {"extra": 1}):
        with pytest.raises(ValueError):
            runner.load_plan(plan_of(tmp_path, **bad))
    assert runner.main(["nothing"]) == runner.BAD_ARGUMENTS
    assert runner.main(["run", str(plan_of(tmp_path))]) == runner.OK
    with pytest.raises(ValueError):
        published.RunConfig("a", "b", resume=True, overwrite_dates=True)
    with pytest.raises(ValueError, match="level"):
        published.compression_options("snappy", 3)
    assert published.compression_options("zstd", 3)["parquet.compression.codec.zstd.level"] == "3"
    days = lambda pairs: spark.createDataFrame(pairs, "day string, n_rows bigint")
    assert rows(runner.representative_days(days([("a", 1), ("b", 5), ("c", 2)]))) == [("a",), ("b",), ("c",)]
    assert rows(runner.representative_days(days([("a", 1)]))) == [("a",)] and rows(runner.representative_days(days([]))) == []
    for n in (0, 1, 4, 5, 6, 9, 12, 23):
        picked = {round(i * (n - 1) / 4) for i in range(5)} if n > 5 else set(range(n))
        assert rows(runner.sampled_days(days([(f"{i:02d}", 1) for i in range(n)]))) == [(f"{i:02d}",) for i in sorted(picked)]


def test_source_change_stops_publication(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "in", "chengjiao", 20250102, trades(20250102))
    plan = runner.load_plan(plan_of(tmp_path))
    original = runner.compute

    def changing(*args):
        out = original(*args)
        out.count()
        write(tmp_path / "in", "chengjiao", 20250102, trades(20250102, 9), other="1")
        return out

    monkeypatch.setattr(runner, "compute", changing)
    code, reports = runner.run_plan(spark, plan, execute=True)
    assert code == runner.FAILED and published.published_dates(plan.output_root, "trade_volume_min") == [] and path.exists()


def test_stream_batches_equal_batch(spark, tmp_path):
    schema = "trade_date date, symbol string, time_ms bigint, volume bigint, recv_time timestamp"
    for i in range(3):
        spark.sql(f"select date'2025-01-02' trade_date, 'a' symbol, {34_200_001 + i}L time_ms, {i + 1}L volume, timestamp'2025-01-02 09:30:00' recv_time").write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    stream = daily.tick_stream(spark, str(tmp_path / "in"), df.schema, max_files=1)
    daily.append_days(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows(daily.read_sums(spark, str(tmp_path / "out")), "minute_code", "volume", "n") == [(1, 6, 3)]
    daily.append_days(stream, str(tmp_path / "out"), str(tmp_path / "state"))  # nothing new: nothing twice
    assert rows(daily.read_sums(spark, str(tmp_path / "out")), "minute_code", "volume", "n") == [(1, 6, 3)]
    once = daily.deduplicated(stream.withColumn("recv_time", F.col("recv_time")), ["symbol", "trade_date"], "recv_time", "1 hour")
    q = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "state2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 1
    sums = daily.minute_sums(stream, "recv_time", "1 hour")
    assert sums.isStreaming and "minute_code" in sums.columns
