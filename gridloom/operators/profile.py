"""Column-level data quality profile (problem 5): footers first, dictionaries next, data only where those do not suffice.

``profile_columns``: per column of a table its rows, nulls, extrema, distinct count and pattern violations. Every column
chunk is judged by its footer; chunks whose statistics are exact are never read. Distinct candidates come from
dictionary pages; only chunks that fell back to plain pages, whose dictionary holds a violating candidate, or may hold
an unused entry, are read.

``load_issues``: per load and column the loads whose nulls, values or distribution stand out. Every column chunk is judged
by footer and dictionary; those they decide (one load, and all null or one single value) are never read, the others are
scanned with two or three columns. Exact medians come by selection: a histogram of logarithmic buckets per load says
which bucket holds the middle ranks, and only the values in that bucket are counted and ranked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import stored
from gridloom.sources import footer

BUCKETS_PER_OCTAVE = 64


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def profile_columns(df: DataFrame, columns: Sequence[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """``column_name, n_rows, n_nulls, n_distinct, min_value, max_value, n_violations, n_chunks, n_scanned`` of a table.

    ``patterns``: regular expressions that the text form of every non-null value of a column should match in full;
    ``n_violations`` counts rows that do not (null where the column has no pattern). Extrema are numeric for numbers
    and lexicographic for anything else, given as text; null for a column without values. NaN counts as the largest number.
    ``n_scanned``: chunks whose data pages had to be read. Clashing or extra columns are not looked at; an empty table gives
    one row per column with 0 rows.

    Footers and dictionaries speak for a table that is just its files and for columns of integers and text. Any other one
    (filtered, computed, partitioned by a column asked for, other types) is profiled from its rows, with the same result;
    ``n_chunks`` and ``n_scanned`` are null for those columns.
    """
    spark = df.sparkSession
    types = dict(df.dtypes)
    checks = dict(patterns or {})
    by_file = [c for c in columns if types[c] in {"tinyint", "smallint", "int", "bigint", "string"} and is_plain_scan(df, [c])]
    by_row = [c for c in columns if c not in by_file]
    parts = ([_profile_files(df, by_file, checks)] if by_file else []) + ([_profile_rows(df, by_row, checks)] if by_row else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _profile_rows(df: DataFrame, columns: Sequence[str], checks: dict[str, str]) -> DataFrame:
    """The profile by one pass over the rows: (column, value) counts with partial aggregation, then one row per column."""
    types = dict(df.dtypes)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("c")
    counts = df.select(cells).groupBy("c.column_name", "c.v").agg(F.count(F.lit(1)).alias("n"))
    is_number = [c for c in columns if types[c] in NUMBERS or types[c].startswith("decimal")]
    number = F.col("column_name").isin(*is_number) if is_number else F.lit(False)
    exact = [c for c in is_number if types[c] not in {"float", "double"}]
    whole = F.col("column_name").isin(*exact) if exact else F.lit(False)
    bad = F.lit(0).cast("long")
    for c, pattern in checks.items():
        if c in columns:
            bad = F.when((F.col("column_name") == c) & F.col("v").isNotNull() & ~F.col("v").rlike(f"^(?:{pattern})\\z"), F.col("n")).otherwise(bad)
    # of equal numbers any text will do; the order key decides
    key = F.struct(F.when(whole, F.col("v").try_cast("decimal(38,18)")).alias("a"), F.when(number & ~whole, F.col("v").try_cast("double")).alias("b"), F.when(~number, F.col("v")).alias("c"))
    value = F.when(F.col("v").isNotNull(), key)
    per = counts.groupBy("column_name").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("n_nulls"), F.count("v").alias("n_distinct"), F.min_by("v", value).alias("min_value"), F.max_by("v", value).alias("max_value"), F.sum(bad).alias("bad"))
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    none = F.lit(None).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return listed.join(per, "column_name", "left").select(
        "column_name", zero("n_rows"), zero("n_nulls"), zero("n_distinct"), "min_value", "max_value", F.when(F.col("column_name").isin(*checks) if checks else F.lit(False), F.coalesce("bad", F.lit(0))).alias("n_violations"), none.alias("n_chunks"), none.alias("n_scanned")
    )


def _profile_files(df: DataFrame, columns: Sequence[str], checks: dict[str, str]) -> DataFrame:
    """The profile from footers and dictionaries, and from the pages of chunks that these leave open."""
    spark = df.sparkSession
    types = dict(df.dtypes)
    wanted = list(columns)
    numeric = {c for c in wanted if types[c] != "string"}
    checks = {c: p for c, p in checks.items() if c in wanted}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with footer.open_file(path) as f:
                    file = pq.ParquetFile(f)
                    for g in range(file.metadata.num_row_groups):
                        group = file.metadata.row_group(g)
                        for j in range(group.num_columns):
                            chunk = group.column(j)
                            name = chunk.path_in_schema
                            if name in wanted:
                                yield _profile_chunk(file, f, g, group.num_rows, chunk, name, name in numeric, checks.get(name), pc)

    schema = "column_name string, n_rows bigint, n_nulls bigint, low string, high string, n_violations bigint, scanned int, vals array<string>"
    # written once: both the sums and the candidates come from it
    found = stored(footer.file_table(spark, df.inputFiles()).mapInArrow(read, schema), "chunks")
    low, high = F.col("low"), F.col("high")
    as_number = lambda c: F.when(F.col("column_name").isin(*numeric) if numeric else F.lit(False), c.cast("decimal(38,0)"))
    base = found.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_nulls").alias("n_nulls"),
        F.min(as_number(low)).alias("__ln"),
        F.max(as_number(high)).alias("__hn"),
        F.min(low).alias("__lt"),
        F.max(high).alias("__ht"),
        F.sum("n_violations").alias("n_violations"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum("scanned").cast("bigint").alias("n_scanned"),
    )
    # Candidates of all chunks meet by (column, value): partial de-duplication in each task, no column in one task.
    distinct = found.select("column_name", F.explode("vals").alias("v")).distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    is_number = F.col("column_name").isin(*numeric) if numeric else F.lit(False)
    listed = spark.createDataFrame([(c,) for c in wanted], "column_name string")
    return (
        listed.join(base, "column_name", "left")
        .join(distinct, "column_name", "left")
        .select(
            "column_name",
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            F.coalesce("n_nulls", F.lit(0)).alias("n_nulls"),
            F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
            F.when(is_number, F.col("__ln").cast("string")).otherwise(F.col("__lt")).alias("min_value"),
            F.when(is_number, F.col("__hn").cast("string")).otherwise(F.col("__ht")).alias("max_value"),
            F.when(F.col("column_name").isin(*checks) if checks else F.lit(False), F.coalesce("n_violations", F.lit(0))).alias("n_violations"),
            F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
            F.coalesce("n_scanned", F.lit(0)).alias("n_scanned"),
        )
    )


def _all_used(file, name, stats, values) -> bool:  # noqa: ANN001
    """Whether a dictionary page's entries all occur: Arrow writes unused ones of dictionary-typed columns, and extrema show those of others."""
    if pa.types.is_dictionary(file.schema_arrow.field(name).type) or stats is None or not stats.has_min_max:
        return False
    ends = [v.encode("utf-8") if isinstance(v, str) else v for v in (stats.min, stats.max)]
    return [footer.as_text(v) for v in ends] == [footer.as_text(v) for v in (min(values), max(values))]


def _profile_chunk(file, f, g, n_rows, chunk, name, is_number, pattern, pc) -> pa.RecordBatch:  # noqa: ANN001, PLR0913
    """One chunk's profile; reads its data pages only if footer and dictionary leave something open."""
    stats = chunk.statistics
    nulls = stats.null_count if stats is not None and stats.has_null_count else None
    low = high = None
    # Extrema of integers are exact; those of text may be cut short by the writer, so they come from the values.
    exact = nulls is not None and (nulls == n_rows or (is_number and stats.has_min_max))
    if exact and nulls < n_rows:
        low, high = footer.as_text(stats.min), footer.as_text(stats.max)
        exact = low is not None and high is not None
    values = [] if nulls == n_rows else footer.dictionary_values(f, chunk)
    texts = None if values is None else [footer.as_text(v) for v in values]
    if texts is not None and any(t is None for t in texts):
        texts = None
    test = re.compile(pattern) if pattern else None
    violations = 0
    scan = texts is None or nulls is None or bool(texts) and not _all_used(file, name, stats, values)
    if texts is not None and not exact and not is_number:
        low, high = (min(texts), max(texts)) if texts else (None, None)
    elif not exact:
        scan = True
    if test and texts is not None and any(not test.fullmatch(t) for t in texts):
        scan = True
    if scan:
        column = file.read_row_group(g, columns=[name]).column(0)
        if pa.types.is_dictionary(column.type):
            column = column.cast(column.type.value_type)
        nulls = column.null_count
        counts = pc.value_counts(column)
        pairs = [(c["values"].as_py(), c["counts"].as_py()) for c in counts]
        pairs = [(v if is_number else str(v) if not isinstance(v, bool) else str(v).lower(), n) for v, n in pairs if v is not None]
        low, high = (str(min(v for v, _ in pairs)), str(max(v for v, _ in pairs))) if pairs else (None, None)
        texts = [str(v) for v, _ in pairs]
        violations = sum(n for v, n in pairs if test and not test.fullmatch(str(v)))
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([n_rows], pa.int64()), pa.array([nulls], pa.int64()), pa.array([low], pa.string()), pa.array([high], pa.string()), pa.array([violations], pa.int64()), pa.array([int(scan)], pa.int32()), pa.array([texts], pa.list_(pa.string()))],
        names=["column_name", "n_rows", "n_nulls", "low", "high", "n_violations", "scanned", "vals"],
    )


EVIDENCE = "path string, row_group int, column_name string, load bigint, n_rows bigint, n_nulls bigint, value bigint, by string"


def chunk_evidence(df: DataFrame, load: str, columns: Sequence[str]) -> DataFrame:
    """What footer and dictionary say of every column chunk: ``path, row_group, column_name, load, n_rows, n_nulls, value, by``.

    A chunk is decided if its row group is of one load and its values are all null or all equal: then ``by`` is ``footer``
    (exact null count and equal extrema) or ``dictionary`` (the footer has no extrema, but the dictionary page holds one
    candidate and no page another encoding). ``by`` is ``scan`` for all others, which must be read.
    """
    wanted = list(columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                with footer.open_file(path) as f:
                    meta = pq.read_metadata(f)
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        chunks = {group.column(j).path_in_schema: group.column(j) for j in range(group.num_columns)}
                        one = _single(f, chunks.get(load), group.num_rows)
                        for c in wanted:
                            rows.append((path, g, c, *_decide(f, chunks.get(c), group.num_rows, one)))
            names = [p.split()[0] for p in EVIDENCE.split(", ")]
            types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return footer.file_table(df.sparkSession, df.inputFiles()).mapInArrow(read, EVIDENCE)


def _single(f: pa.NativeFile, chunk: object, n_rows: int) -> tuple[int, str] | None:
    """The one value of a chunk without nulls and where that is known from; None if there may be several."""
    stats = chunk.statistics if chunk is not None else None
    if stats is None or not stats.has_null_count or stats.null_count or not n_rows or chunk.physical_type not in footer.INTEGERS:
        return None
    if stats.has_min_max:
        return (int(stats.min), "footer") if stats.min == stats.max else None
    values = footer.dictionary_values(f, chunk)
    return (int(values[0]), "dictionary") if values is not None and len(values) == 1 else None


def _decide(f: pa.NativeFile, chunk: object, n_rows: int, load: tuple[int, str] | None) -> tuple[int | None, int, int, int | None, str]:
    """(load, rows, nulls, value, by) of a chunk."""
    stats = chunk.statistics if chunk is not None else None
    if load is None or stats is None or not stats.has_null_count or chunk.physical_type not in footer.INTEGERS:
        return None, n_rows, 0, None, "scan"
    nulls = stats.null_count
    if nulls == n_rows:
        return load[0], n_rows, nulls, None, load[1]
    if stats.has_min_max:
        if stats.min == stats.max:
            return load[0], n_rows, nulls, int(stats.min), load[1]
    else:
        values = footer.dictionary_values(f, chunk)
        if values is not None and len(values) == 1:
            return load[0], n_rows, nulls, int(values[0]), "dictionary"
    return None, n_rows, nulls, None, "scan"


def is_plain_scan(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether a table is nothing but its Parquet files: no filter, projection, union or other step, and no column from a folder's name."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or not df.inputFiles():
        return False
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or "Parquet" not in relation.fileFormat().getClass().getSimpleName():
        return False
    return not set(relation.partitionSchema().fieldNames()) & set(columns)


@dataclass
class LoadValues:
    """The values of integer columns per load: what is decided without reading, and how to read the rest, as often as needed.

    ``decided``: ``column_name, load_id, v, n`` from footers and dictionaries. ``rest``: ``column_name, load_id, v`` of every
    row of every other chunk.
    """

    decided: DataFrame | None
    rest: DataFrame | None
    evidence: DataFrame | None


def load_values(df: DataFrame, load: str, columns: Sequence[str]) -> LoadValues:
    """Evidence first, chunk by chunk and column by column; only undecided chunks are scanned.

    Files none of whose chunks is decided are scanned by Spark; of the others only the undecided chunks are read, one by
    one. A table that is more than its files (filtered, joined, with the load in a folder's name) is scanned as it is.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("long").alias("v")) for c in columns]))

    def scan(part: DataFrame) -> DataFrame:
        return part.select(F.col(load).cast("long").alias("load_id"), cells.alias("c")).select("c.column_name", "load_id", "c.v")

    if not is_plain_scan(df, [load, *columns]):
        return LoadValues(None, scan(df), None)
    evidence = stored(chunk_evidence(df, load, columns), "evidence")
    some = evidence.where("by <> 'scan'").select("path").distinct()
    n_some = some.count()
    if not n_some:
        return LoadValues(None, scan(df), evidence)
    both = F.array(F.struct(F.col("value").alias("v"), (F.col("n_rows") - F.col("n_nulls")).alias("n")), F.struct(F.lit(None).cast("long").alias("v"), F.col("n_nulls").alias("n")))
    decided = evidence.where("by <> 'scan'").select("column_name", F.col("load").alias("load_id"), F.explode(both).alias("c")).select("column_name", "load_id", "c.v", "c.n").where("n > 0")
    # chunks left over in files that have decided ones: read one by one
    open_chunks = evidence.where("by = 'scan'").join(some, "path", "left_semi").select("path", "row_group", "column_name")
    rest = _read_chunks(open_chunks, load)
    files = df.inputFiles()
    if n_some < len(files):
        # the driver plans the scan file by file anyway; this is one flag for each
        gone = {r.path for r in some.collect()}
        rest = rest.unionByName(scan(df.sparkSession.read.schema(df.schema).parquet(*[f for f in files if f not in gone])))
    return LoadValues(decided, rest, evidence)


def _read_chunks(chunks: DataFrame, load: str) -> DataFrame:
    """``column_name, load_id, v`` of the rows of single column chunks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for path, g, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with footer.open_file(path) as f:
                    part = pq.ParquetFile(f).read_row_group(g, columns=[load, c])
                for piece in part.to_batches(max_chunksize=65_536):
                    names = pa.array([c] * piece.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays([names, piece.column(piece.schema.get_field_index(load)).cast(pa.int64()), piece.column(piece.schema.get_field_index(c)).cast(pa.int64())], names=["column_name", "load_id", "v"])

    return chunks.repartition(4 * chunks.sparkSession.sparkContext.defaultParallelism).mapInArrow(read, "column_name string, load_id bigint, v bigint")


def value_bucket(v: Column) -> Column:
    """Logarithmic bucket of an integer, monotone in it: at most a few thousand buckets over all of bigint."""
    log = lambda x: F.floor(F.log2(x.cast("double")) * BUCKETS_PER_OCTAVE)
    return F.when(v > 0, log(v) + 1).when(v == 0, F.lit(0)).otherwise(-1 - log(-v.cast("double"))).cast("int")


def load_statistics(values: dict[str, LoadValues], broadcast_rows: int = 500_000) -> DataFrame:
    """Per (table, column, load): ``n_rows, n_nulls, n_values, low, high, n_mode, m2`` with ``m2`` twice the exact median.

    Two passes with little to shuffle. The first counts values by logarithmic bucket, a few thousand of them at most per
    load, and says which buckets hold the middle ranks. The second counts the values in those buckets only, ranks them and
    so finds the median. ``n_mode`` is how often a value occurs that is a middle one: a value that makes up more than half
    of a load is its median, so this is exact wherever it matters. Up to ``broadcast_rows`` middle buckets (some 50 bytes
    each) go to every task of the second pass; more are joined.
    """
    by = ["table_name", "column_name", "load_id"]
    tagged = lambda name, df: df.select(F.lit(name).alias("table_name"), "column_name", "load_id", "v", *([c for c in ("n",) if c in df.columns] or [F.lit(1).cast("long").alias("n")]))
    parts = [tagged(name, part) for name, v in values.items() for part in (v.decided, v.rest) if part is not None]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    valued = rows.withColumn("bucket", value_bucket(F.col("v")))
    hist = valued.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    w = Window.partitionBy(*by)
    known = F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(0)
    ranked = (
        hist.withColumn("known", known)
        .withColumn("n_rows", F.sum("n").over(w))
        .withColumn("n_values", F.sum("known").over(w))
        .withColumn("upto", F.sum("known").over(w.orderBy(F.col("bucket").asc_nulls_first())))
        .withColumn("l_low", F.min("low").over(w))
        .withColumn("l_high", F.max("high").over(w))
        .withColumn("r1", F.floor((F.col("n_values") + 1) / 2))
        .withColumn("r2", F.floor(F.col("n_values") / 2) + 1)
        .withColumn("before", F.col("upto") - F.col("known"))
    )
    # One or two buckets a load hold its middle ranks; a load without values keeps its null bucket.
    holds = (F.col("r1") > F.col("before")) & (F.col("r1") <= F.col("upto")) | (F.col("r2") > F.col("before")) & (F.col("r2") <= F.col("upto"))
    middle = stored(ranked.where(holds & F.col("bucket").isNotNull() | (F.col("n_values") == 0)).select(*by, "bucket", "n_rows", "n_values", "l_low", "l_high", "r1", "r2", "before"), "middle")
    wanted = middle.where(F.col("bucket").isNotNull()).select(*[F.col(c).alias(f"__{c}") for c in (*by, "bucket")])
    if wanted.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    else:
        valued = valued.groupBy(*by, "v", "bucket").agg(F.sum("n").alias("n"))  # repeated values are put together before the join
    same = F.lit(True)
    for c in (*by, "bucket"):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}")) if c == "load_id" else same & (F.col(c) == F.col(f"__{c}"))
    candidates = valued.where(F.col("v").isNotNull()).join(wanted, same, "left_semi").groupBy(*by, "bucket", "v").agg(F.sum("n").alias("vn"))
    inside = middle.join(candidates.select(*[F.col(c).alias(f"__{c}") for c in (*by, "bucket")], "v", "vn"), same, "left")
    order = Window.partitionBy(*by, "bucket").orderBy("v")
    picked = inside.withColumn("to", F.col("before") + F.sum("vn").over(order)).withColumn("from", F.col("to") - F.col("vn"))
    holds_rank = lambda r: (F.col(r) > F.col("from")) & (F.col(r) <= F.col("to"))
    at = lambda r: F.max(F.when(holds_rank(r), F.col("v"))).cast("decimal(38,0)")
    stats = picked.groupBy(*by).agg(
        F.first("n_rows").alias("n_rows"),
        F.first("n_values").alias("n_values"),
        F.first("l_low").alias("low"),
        F.first("l_high").alias("high"),
        F.max(F.when(holds_rank("r1") | holds_rank("r2"), F.col("vn"))).alias("n_mode"),
        (at("r1") + at("r2")).alias("m2"),
    )
    return stats.withColumn("n_nulls", F.col("n_rows") - F.col("n_values"))


def load_issues(tables: dict[str, tuple[DataFrame, Sequence[str]]], load: str = "load_id", min_rows: int = 20, null_percent: int = 8, range_factor: int = 1000, shift_factor: int = 3) -> DataFrame:
    """``table_name, column_name, load_id, issue`` of integer columns; see TESTDATA problem 5 for the four issues.

    ``shift`` compares with the next smaller load of the *table* (that has any row). Null values count for ``nulls`` only;
    repeated rows count each time; a load with fewer than ``min_rows`` values has no value issues. Empty tables have none.
    """
    stats = load_statistics({name: load_values(df, load, columns) for name, (df, columns) in tables.items()})
    # Every load of a table has a row for each of its columns (nulls are counted too), so the row before is the load before.
    w = Window.partitionBy("table_name", "column_name").orderBy("load_id")
    n, m2 = F.col("n_values"), F.col("m2")
    wide = lambda c: F.col(c).cast("decimal(30,0)")
    enough = n >= min_rows
    prior, prior_n = F.col("__prior"), F.col("__prior_n")
    issues = F.array_compact(
        F.array(
            F.when((F.col("n_rows") >= min_rows) & (F.col("n_nulls") * 100 > F.col("n_rows") * null_percent), "nulls"),
            F.when(enough & ((F.col("low") <= 0) | (wide("high") * 2 > m2 * range_factor) | (wide("low") * 2 * range_factor < m2)), "range"),
            F.when(enough & (F.col("n_mode") * 2 > n), "constant"),
            F.when(enough & (prior_n >= min_rows) & ((m2 > prior * shift_factor) | (m2 * shift_factor < prior)), "shift"),
        )
    )
    return (
        stats.withColumn("__prior", F.lag("m2").over(w))
        .withColumn("__prior_n", F.lag("n_values").over(w))
        .select("table_name", "column_name", "load_id", F.explode(issues).alias("issue"))
    )
