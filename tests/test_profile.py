import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import rows
from pyspark.sql import functions as F

from gridloom.operators import profile
from gridloom.sources import footer


def write(path, columns, **options):
    pq.write_table(pa.table(columns), path, **options)
    return str(path)


def test_profile_matches_the_values(spark, tmp_path):
    rnd = random.Random(1)
    n = 2000
    data = {
        "id": pa.array(range(n), pa.int64()),
        "money": pa.array([rnd.choice([None, rnd.randrange(50)]) for _ in range(n)], pa.int64()),
        "text": pa.array([rnd.choice(["aa", "b1", None, "", "é" * 90]) for _ in range(n)]),
        "empty": pa.array([None] * n, pa.int32()),
    }
    write(tmp_path / "a.parquet", data, row_group_size=300)
    write(tmp_path / "b.parquet", data, row_group_size=700, use_dictionary=False, write_statistics=False, compression="none")
    df = spark.read.parquet(str(tmp_path))
    got = {r.column_name: r for r in profile.profile_columns(df, ["id", "money", "text", "empty"], {"text": "[a-z]*", "money": "[0-9]"}).collect()}
    for c in data:
        values = [v for v in data[c].to_pylist() if v is not None]
        r = got[c]
        assert (r.n_rows, r.n_nulls, r.n_distinct) == (2 * n, 2 * (n - len(values)), len(set(values)))
        assert (r.min_value, r.max_value) == ((str(min(values)), str(max(values))) if values else (None, None))
    assert got["text"].n_violations == 2 * sum(v is not None and any(ch not in "abcdefghijklmnopqrstuvwxyz" for ch in v) for v in data["text"].to_pylist())
    assert got["money"].n_violations == 2 * sum(v is not None and v > 9 for v in data["money"].to_pylist())
    assert got["id"].n_violations is None
    assert got["id"].n_scanned < got["id"].n_chunks  # footers and dictionaries were enough for a part


def test_unused_dictionary_entries_are_no_values(spark, tmp_path):
    kinds = {"s": (["aaa", "bbb", "zzz"], pa.string()), "n": ([1, 2, 9], pa.int64())}
    made = {c: pa.DictionaryArray.from_arrays(pa.array([0, 1, None, 1], pa.int8()), pa.array(v, t)) for c, (v, t) in kinds.items()}
    write(tmp_path / "a.parquet", made)
    write(tmp_path / "b.parquet", {"s": pa.array(["aaa", "bbb"]), "n": pa.array([1, 2], pa.int64())})
    got = profile.profile_columns(spark.read.parquet(str(tmp_path)), ["s", "n"])
    assert rows(got, "column_name", "n_rows", "n_nulls", "n_distinct", "min_value", "max_value", "n_violations", "n_scanned") == [("n", 6, 1, 2, "1", "2", None, 0), ("s", 6, 1, 2, "aaa", "bbb", None, 1)]


def test_dictionary_pages(tmp_path):
    path = write(tmp_path / "a.parquet", {"x": pa.array([3, 1, None, 3, 2], pa.int64()), "s": pa.array(["b", "a", None, "b", "a"])})
    with footer.open_file(path) as f:
        group = pq.ParquetFile(f).metadata.row_group(0)
        assert sorted(footer.dictionary_values(f, group.column(0))) == [1, 2, 3]
        assert sorted(footer.dictionary_values(f, group.column(1))) == [b"a", b"b"]
    # too many values for one dictionary: later pages are plain, so the dictionary is not the whole set
    path = write(tmp_path / "b.parquet", {"x": pa.array(range(50_000), pa.int64())}, dictionary_pagesize_limit=1000)
    with footer.open_file(path) as f:
        assert footer.dictionary_values(f, pq.ParquetFile(f).metadata.row_group(0).column(0)) is None


def issues(loads, column="v"):
    """Straight from the definition."""
    out, prior = set(), None
    for load in sorted(loads):
        all_rows = loads[load]
        v = sorted(x for x in all_rows if x is not None)
        if len(all_rows) >= 20 and (len(all_rows) - len(v)) / len(all_rows) > 0.08:
            out.add((load, "nulls"))
        m = (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else None
        if len(v) >= 20:
            if v[0] <= 0 or v[-1] > 1000 * m or v[0] < m / 1000:
                out.add((load, "range"))
            if max(v.count(x) for x in set(v)) * 2 > len(v):
                out.add((load, "constant"))
            if prior and prior[1] >= 20 and (m > 3 * prior[0] or m < prior[0] / 3):
                out.add((load, "shift"))
        prior = (m, len(v))
    return out


def cases():
    rnd = random.Random(4)
    usual = lambda n, k=1: [rnd.randrange(100, 300) * k for _ in range(n)]
    return {
        1: usual(40), 2: usual(30) + [None] * 3, 3: usual(20) + [None] * 2, 4: usual(19), 5: usual(25, 4), 6: usual(25), 7: usual(25) + [0], 8: usual(25) + [-5], 9: usual(25) + [10**9], 10: [7] * 15 + usual(14), 11: [7] * 14 + usual(14),
        12: [None] * 30, 13: usual(25), 14: [None] * 5, 15: [5] * 40, 16: [2**62] * 25, 17: usual(21) + usual(20, 10),
    }


@pytest.mark.parametrize("one_load_files", [False, True])
def test_load_issues(spark, tmp_path, one_load_files):
    loads = cases()
    pairs = [(k, v) for k, vs in loads.items() for v in vs]
    if one_load_files:  # constant and null loads are then decided by their footers alone
        for k in loads:
            mine = [v for a, v in pairs if a == k]
            write(tmp_path / f"{k}.parquet", {"load_id": pa.array([k] * len(mine), pa.int64()), "v": pa.array(mine, pa.int64()), "column_name": pa.array(["clash"] * len(mine))})
    else:
        write(tmp_path / "all.parquet", {"load_id": pa.array([k for k, _ in pairs], pa.int64()), "v": pa.array([v for _, v in pairs], pa.int64()), "column_name": pa.array(["clash"] * len(pairs))}, row_group_size=50)
    df = spark.read.parquet(str(tmp_path))
    got = {(r.load_id, r.issue) for r in profile.load_issues({"t": (df, ["v"])}).collect()}
    assert got == issues(loads)


def test_middle_buckets_joined_or_sent_are_alike(spark, tmp_path):
    pairs = [(k, v) for k, vs in cases().items() for v in vs]
    write(tmp_path / "a.parquet", {"load_id": pa.array([k for k, _ in pairs], pa.int64()), "v": pa.array([v for _, v in pairs], pa.int64())})
    values = {"t": profile.load_values(spark.read.parquet(str(tmp_path)), "load_id", ["v"])}
    assert rows(profile.load_statistics(values, broadcast_rows=0)) == rows(profile.load_statistics(values))


def test_evidence_chunk_by_chunk(spark, tmp_path):
    """A file may hold decided and open chunks, and a chunk be decided for one column only."""
    columns = {"load_id": pa.array([1] * 30 + [2] * 30 + [2] * 15 + [3] * 15, pa.int64()), "v": pa.array([7] * 30 + list(range(100, 130)) + [9] * 30, pa.int64()), "w": pa.array([None] * 60 + list(range(200, 230)), pa.int64())}
    write(tmp_path / "a.parquet", columns, row_group_size=30)
    write(tmp_path / "b.parquet", {k: v.slice(0, 30) for k, v in columns.items()}, write_statistics=["load_id"])  # one candidate in the dictionary
    write(tmp_path / "c.parquet", {k: v.slice(30, 60) for k, v in columns.items()}, row_group_size=60)
    df = spark.read.parquet(str(tmp_path))
    got = {(r.path[-9:], r.row_group, r.column_name): (r.load, r.n_rows, r.n_nulls, r.value, r.by) for r in profile.chunk_evidence(df, "load_id", ["v", "w"]).collect()}
    assert got["a.parquet", 0, "v"] == (1, 30, 0, 7, "footer") and got["a.parquet", 0, "w"] == got["a.parquet", 0, "w"][:1] + (30, 30, None, "footer")
    assert got["a.parquet", 1, "v"][4] == "scan" and got["a.parquet", 1, "w"][::4] == (2, "footer") and got["a.parquet", 2, "v"][4] == "scan" and got["c.parquet", 0, "v"][4] == "scan"
    values = profile.load_values(df, "load_id", ["v", "w"])
    whole = profile.LoadValues(None, df.select("load_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in "vw"])).alias("c")).select("c.column_name", "load_id", "c.v"), None)
    assert rows(profile.load_statistics({"t": values})) == rows(profile.load_statistics({"t": whole}))
    assert values.decided.count() and values.rest.count() < 2 * df.count()


def test_a_table_that_is_more_than_its_files(spark, tmp_path):
    spark.range(40).select("id", (F.col("id") * 0.75 - 10).alias("x"), (F.col("id") * 1.5 - 20).cast("decimal(10,2)").alias("y"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"), F.lit(5).cast("long").alias("load_id"), (F.col("id") % 2).alias("p")).write.partitionBy("p").parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = {r.column_name: r for r in profile.profile_columns(df.where("id >= 9 and id < 30"), ["id", "x", "y", "s", "p"], {"s": "[0-9]"}).collect()}
    assert {r.n_rows for r in got.values()} == {21}
    assert (got["id"].min_value, got["id"].max_value) == ("9", "29") and (float(got["x"].min_value), float(got["x"].max_value)) == (-3.25, 11.75) and (got["y"].min_value, got["y"].max_value) == ("-6.50", "23.50")
    assert (got["s"].n_nulls, got["s"].n_distinct, got["s"].n_violations) == (7, 14, 14) and got["p"].n_distinct == 2
    whole = {r.column_name: r for r in profile.profile_columns(df, ["id", "x", "p"]).collect()}
    assert whole["id"].n_chunks and whole["p"].n_rows == 40 and (whole["x"].min_value, whole["x"].max_value) == ("-10.0", "19.25") and whole["p"].n_chunks is None
    assert profile.load_issues({"t": (df.where("id < 25"), ["id"])}).count() == 1 and profile.load_issues({"t": (df.where("id < 19"), ["id"])}).count() == 0


def test_empty(spark, tmp_path):
    path = write(tmp_path / "a.parquet", {"load_id": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    df = spark.read.parquet(path)
    assert profile.load_issues({"t": (df, ["v"])}).count() == 0
    assert rows(profile.profile_columns(df, ["v"]), "n_rows", "n_nulls", "n_distinct", "min_value") == [(0, 0, 0, None)]


def test_buckets_are_monotone(spark):
    values = sorted({s * (b + o) for b in [1, 2, 3, 10, 1000, 2**31, 2**53, 2**62] for o in (-1, 0, 1) for s in (-1, 1)})
    df = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", profile.value_bucket(F.col("v")).alias("b"))
    buckets = [b for _, b in sorted(tuple(r) for r in df.collect())]
    assert buckets == sorted(buckets)
