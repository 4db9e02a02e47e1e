"""Processing only new or changed records: processed sequence numbers as disjoint intervals (problem 3).

A *stream* (one or more columns) numbers its records with integers that need not arrive in order. What has been
processed is kept as disjoint closed intervals ``[lo, hi]``; a run subtracts them from the available numbers, processes
what is left (a late commit with a small number is simply a gap), and commits the merged intervals together with its
output in one rename. Only numbers really processed are ever covered, so nothing is skipped, and nothing covered is
read again.

All set algebra runs inside *blocks* of ``BLOCK`` successive numbers, the partitioning key next to the stream: a
stream with a third of all records is spread over as many tasks as it has blocks, and one task never holds more than
a block's numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.sources import footer

BLOCK = 1 << 16


def block_of(seq: Column) -> Column:
    return F.floor(seq / F.lit(BLOCK)).cast("long")


def to_intervals(df: DataFrame, stream: Sequence[str], seq: str) -> DataFrame:
    """Distinct sequence numbers as intervals ``stream..., block, lo, hi``, cut at block edges. Null numbers are left out; repeated ones count once."""
    numbers = df.where(F.col(seq).isNotNull()).select(*stream, F.col(seq).cast("long").alias("__s")).withColumn("block", block_of(F.col("__s"))).distinct()
    w = Window.partitionBy(*stream, "block").orderBy("__s")
    return numbers.withColumn("__g", F.col("__s") - F.row_number().over(w)).groupBy(*stream, "block", "__g").agg(F.min("__s").alias("lo"), F.max("__s").alias("hi")).drop("__g")


def merge(*parts: DataFrame, stream: Sequence[str]) -> DataFrame:
    """Union of interval sets as disjoint intervals; touching ones join, within their block."""
    rows = parts[0].select(*stream, "block", "lo", "hi")
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*stream, "block", "lo", "hi"))
    w = Window.partitionBy(*stream, "block").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    started = rows.withColumn("__new", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0))
    grouped = started.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*stream, "block", "__g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__g")


def subtract(available: DataFrame, processed: DataFrame, stream: Sequence[str]) -> DataFrame:
    """Gaps: parts of ``available`` intervals that no ``processed`` interval covers, by a sweep over their ends."""

    def ends(df: DataFrame, a: int, p: int) -> DataFrame:
        # both ends of an interval in one pass: two branches would compute the intervals twice
        up = F.struct(F.col("lo").alias("pos"), F.lit(a).alias("a"), F.lit(p).alias("p"))
        down = F.struct((F.col("hi") + 1).alias("pos"), F.lit(-a).alias("a"), F.lit(-p).alias("p"))
        return df.select(*stream, "block", F.explode(F.array(up, down)).alias("e")).select(*stream, "block", "e.pos", "e.a", "e.p")

    # placed once for the sum per position, the sweep and the merge
    points = ends(available, 1, 0).unionByName(ends(processed, 0, 1)).repartition(*stream, "block").groupBy(*stream, "block", "pos").agg(F.sum("a").alias("a"), F.sum("p").alias("p"))
    w = Window.partitionBy(*stream, "block").orderBy("pos")
    swept = points.select(*stream, "block", F.col("pos").alias("lo"), (F.lead("pos").over(w) - 1).alias("hi"), F.sum("a").over(w).alias("__a"), F.sum("p").over(w).alias("__p"))
    open_parts = swept.where((F.col("__a") > 0) & (F.col("__p") == 0) & F.col("hi").isNotNull()).drop("__a", "__p")
    return merge(open_parts, stream=stream)


def records_in(records: DataFrame, intervals: DataFrame, stream: Sequence[str], seq: str, most_intervals: int = 256) -> DataFrame:
    """Records whose number lies in an interval of their stream, each once, all columns kept; null numbers and streams are in none.

    The least and the greatest number of all intervals go to the scan, which leaves out files and row groups without any of
    them. Up to ``most_intervals`` intervals (some tens of bytes each) then go to every task, which looks up its records by
    block: nothing of the records is shuffled. More are swept per (stream, block) with the records' numbers. No range join.
    """
    ends = intervals.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not ends.n:
        return records.limit(0)
    within = records.where(F.col(seq).between(ends.lo, ends.hi))
    if ends.n > most_intervals:
        return _swept(within, intervals, stream, seq)
    names = [f"__k{i}" for i in range(len(stream))]
    keys = [F.col(c).alias(n) for c, n in zip(stream, names, strict=True)]
    # an interval lies in one block, so a record meets the intervals of one (stream, block)
    by_block = intervals.groupBy(*keys, F.col("block").alias("__block")).agg(F.collect_list(F.struct("lo", "hi")).alias("__parts"))
    number = F.col(seq).cast("long")
    match = block_of(number) == F.col("__block")
    for c, n in zip(stream, names, strict=True):
        match = match & (within[c] == F.col(n))
    inside = F.exists("__parts", lambda p: (number >= p["lo"]) & (number <= p["hi"]))
    return within.join(F.broadcast(by_block), match & inside, "left_semi")


def _swept(records: DataFrame, intervals: DataFrame, stream: Sequence[str], seq: str) -> DataFrame:
    """``records_in`` for any number of intervals: a sweep per (stream, block) marks the numbers covered."""
    names = [f"__k{i}" for i in range(len(stream))]
    keys = [F.col(c).alias(n) for c, n in zip(stream, names, strict=True)]
    numbers = records.where(F.col(seq).isNotNull()).select(*keys, F.col(seq).cast("long").alias("__pos")).distinct().withColumn("__block", block_of(F.col("__pos"))).withColumn("__d", F.lit(0)).withColumn("__is", F.lit(True))
    up = F.struct(F.col("lo").alias("p"), F.lit(1).alias("d"))
    down = F.struct((F.col("hi") + 1).alias("p"), F.lit(-1).alias("d"))
    ends = intervals.select(*keys, F.col("block").alias("__block"), F.explode(F.array(up, down)).alias("e")).select(*names, F.col("e.p").alias("__pos"), "__block", F.col("e.d").alias("__d"), F.lit(False).alias("__is"))
    w = Window.partitionBy(*names, "__block").orderBy("__pos").rangeBetween(Window.unboundedPreceding, 0)
    covered = numbers.unionByName(ends).withColumn("__open", F.sum("__d").over(w)).where(F.col("__is") & (F.col("__open") > 0)).select(*names, "__pos")
    match = F.col(seq).cast("long") == F.col("__pos")
    for c, n in zip(stream, names, strict=True):
        match = match & (records[c] == F.col(n))
    return records.join(covered, match, "left_semi")


def compact(intervals: DataFrame, stream: Sequence[str]) -> DataFrame:
    """Intervals joined across block edges, ``stream..., lo, hi``: what a report shows.

    Only intervals that touch an edge of their block can join others, at most two a block; all others stay where they are.
    """
    touching = (F.col("lo") == F.col("block") * BLOCK) | (F.col("hi") == (F.col("block") + 1) * BLOCK - 1)
    w = Window.partitionBy(*stream).orderBy("lo")
    edge = intervals.where(touching)
    started = edge.withColumn("__new", F.when(F.lag("hi").over(w) + 1 == F.col("lo"), 0).otherwise(1))
    joined = started.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*stream, "__g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__g")
    return joined.unionByName(intervals.where(~touching).select(*stream, "lo", "hi"))


def current_deliveries(day_file: DataFrame, metric_input: dict[str, str]) -> DataFrame:
    """``metric_name, trade_date, channel, file_id``: for each metric the latest ``complete`` delivery (by delivered_at, then
    delivery, then file_id) of each date and channel of the data set it reads; what there is to be processed."""
    names = F.create_map(*[x for d in sorted(set(metric_input.values())) for x in (F.lit(d), F.array(*[F.lit(m) for m in sorted(metric_input) if metric_input[m] == d]))])
    return (
        day_file.where(F.col("file_state") == "complete")
        .groupBy("dataset", "trade_date", "channel")
        .agg(F.max_by("file_id", F.struct("delivered_at", "delivery", "file_id")).alias("file_id"))
        .select(F.explode(F.element_at(names, F.col("dataset"))).alias("metric_name"), "trade_date", F.col("channel").cast("int").alias("channel"), "file_id")
    )


def processed_deliveries(day_file: DataFrame, run_log: DataFrame, metric_input: dict[str, str]) -> DataFrame:
    """``metric_name, file_id``: numbers of all deliveries whose content the latest finished ``success`` (by finished_at, then
    log_id) of their metric, date and channel has read; unchanged redeliveries have the same content and so are among them.
    Failed, running and unfinished entries count for nothing."""
    last = (
        run_log.where((F.col("run_status") == "success") & F.col("finished_at").isNotNull() & F.col("metric_name").isin(*metric_input))
        .groupBy("metric_name", "trade_date", F.col("channel").cast("int").alias("channel"))
        .agg(F.max_by("source_digest", F.struct("finished_at", "log_id")).alias("content_digest"))
        .withColumn("dataset", F.element_at(F.create_map(*[x for m, d in sorted(metric_input.items()) for x in (F.lit(m), F.lit(d))]), F.col("metric_name")))
    )
    files = day_file.select("dataset", "trade_date", F.col("channel").cast("int").alias("channel"), "content_digest", "file_id")
    return last.join(files, ["dataset", "trade_date", "channel", "content_digest"]).select("metric_name", "file_id").distinct()


class Ledger:
    """Commits of an incremental pipeline: every version holds its output and the merged intervals, made visible by one rename.

    A run that dies leaves only a staging folder, which no reader sees; the next run finds the same gaps. A run that lost
    a race for its version fails on the rename and repeats nothing. The folder must be on a file system whose rename is
    atomic and refuses an existing target (HDFS and POSIX are).
    """

    def __init__(self, spark: SparkSession, root: str, stream: Sequence[str]) -> None:
        self.spark, self.root, self.stream = spark, root.rstrip("/"), list(stream)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def processed(self, types: dict[str, str]) -> DataFrame:
        versions = self.versions()
        if not versions:
            fields = ", ".join([*(f"`{c}` {types[c]}" for c in self.stream), "block bigint, lo bigint, hi bigint"])
            return self.spark.createDataFrame([], fields)
        return self.spark.read.parquet(f"{self.root}/commits/v{versions[-1]:08d}/intervals")

    def output(self) -> DataFrame | None:
        """All committed output; None before the first commit."""
        paths = [p for v in self.versions() if self._fs.exists(self._path(p := f"{self.root}/commits/v{v:08d}/output"))]
        return self.spark.read.parquet(*paths) if paths else None

    def adopt(self, records: DataFrame, seq: str) -> int:
        """Commits the numbers of ``records`` as processed elsewhere, without output: how a pipeline with a log of its own moves in."""
        versions = self.versions()
        version = versions[-1] + 1 if versions else 0
        staging = f"{self.root}/staging/{uuid.uuid4().hex}"
        merge(self.processed(dict(records.dtypes)), to_intervals(records, self.stream, seq), stream=self.stream).write.parquet(f"{staging}/version/intervals")
        self._commit(f"{staging}/version", version)
        self._fs.delete(self._path(staging), True)
        return version

    def gaps(self, records: DataFrame, seq: str) -> DataFrame:
        """Intervals of the available numbers that are not processed yet, late ones included."""
        return subtract(to_intervals(records, self.stream, seq), self.processed(dict(records.dtypes)), self.stream)

    def unread(self, records: DataFrame, seq: str) -> DataFrame:
        """``records`` without the files that hold only processed numbers, by the extrema in their footers.

        For a table that is nothing but its Parquet files, in which the stream's columns have one value per file or there is
        one stream. Any other table is returned as it is; so nothing is ever left out that is not covered.
        """
        from gridloom.operators.profile import is_plain_scan

        versions = self.versions()
        if not versions or not is_plain_scan(records, [*self.stream, seq]):
            return records
        done = compact(self.processed(dict(records.dtypes)), self.stream)
        ranges = footer.column_ranges(self.spark, records.inputFiles(), [*self.stream, seq])
        one = F.lit(True)
        for c in self.stream:
            one = one & (F.col(f"low_{c}") == F.col(f"high_{c}"))
        # sweep: of each stream the processed interval that begins last at or before a file's least number
        keys = [f"__k{i}" for i in range(len(self.stream))]
        files = ranges.where(one & F.col(f"low_{seq}").isNotNull()).select(*[F.col(f"low_{c}").alias(k) for c, k in zip(self.stream, keys, strict=True)], F.col(f"low_{seq}").cast("long").alias("lo"), F.lit(1).alias("is_file"), F.col(f"high_{seq}").cast("long").alias("hi"), "path")
        covers = done.select(*[F.col(c).cast("string").alias(k) for c, k in zip(self.stream, keys, strict=True)], "lo", F.lit(0).alias("is_file"), "hi", F.lit(None).cast("string").alias("path"))
        w = Window.partitionBy(*keys).orderBy("lo", "is_file").rowsBetween(Window.unboundedPreceding, 0)
        swept = files.unionByName(covers).withColumn("__upto", F.max(F.when(F.col("is_file") == 0, F.col("hi"))).over(w))
        # the driver plans the scan file by file anyway; this is one name for each that can be skipped
        skip = {r.path for r in swept.where((F.col("is_file") == 1) & (F.col("hi") <= F.col("__upto"))).select("path").collect()}
        left = [f for f in records.inputFiles() if f not in skip]
        return records if not skip else self.spark.read.schema(records.schema).parquet(*left) if left else records.limit(0)

    def run(self, records: DataFrame, seq: str, process: Callable[[DataFrame], DataFrame]) -> int | None:
        """Processes the records not yet covered and commits; the new version, or None if there was nothing to do."""
        versions = self.versions()
        version = versions[-1] + 1 if versions else 0
        staging = f"{self.root}/staging/{uuid.uuid4().hex}"
        processed = self.processed(dict(records.dtypes))
        records = self.unread(records, seq)
        # Written, so that output and intervals are of the same gaps even if more records arrive meanwhile or a task is rerun.
        self.gaps(records, seq).write.parquet(f"{staging}/gaps")
        gaps = self.spark.read.parquet(f"{staging}/gaps")
        if gaps.isEmpty():
            self._fs.delete(self._path(staging), True)
            return None
        process(records_in(records, gaps, self.stream, seq)).write.parquet(f"{staging}/version/output")
        merge(processed, gaps, stream=self.stream).write.parquet(f"{staging}/version/intervals")
        self._commit(f"{staging}/version", version)
        self._fs.delete(self._path(staging), True)
        return version

    def _commit(self, staged: str, version: int) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/commits"))
        kind = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 0)
        target = self._path(f"{self.root}/commits/v{version:08d}")
        if self._fs.exists(target):
            raise FileExistsError(f"version {version} was committed by another run")
        self._context.rename(self._fs.makeQualified(self._path(staged)), self._fs.makeQualified(target), options)
