"""Mixing sources to target weights (problem 7): iterative proportional fitting of token weights, then calibrated sampling.

Documents are reduced to *cells* (source, language, topic) with their tokens. A weight per cell - how often each of its
documents is used on average - is raked in turn to the marginals of topic, language and source until it no longer
changes, never above the source's cap. Sampling then uses every document ``floor(weight)`` times plus once more with the
remaining probability, decided by a hash of its id, so a rerun of a lost task gives the same sample.

Cells are few (the product of the categories) and independent of the number of documents. Up to ``MAX_CELLS`` they are
raked on the driver; beyond it the same rounds and steps run as joins and aggregations, cut by tables in the checkpoint folder.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import tokenizer
from gridloom.session import checkpoint_dir

MAX_CELLS = 200_000
ROUNDS = 60
STEPS = 8  # of scaling within a round's marginal, as caps bite
TOLERANCE = 1e-7


def document_tokens(documents: DataFrame, topic: str, ranks_path: str = tokenizer.DEFAULT_RANKS) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens``; null texts have 0 tokens, null languages and topics are categories of their own."""
    picked = documents.select("doc_id", "source", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce(F.col(topic).cast("string"), F.lit("")).alias("topic"), "text")
    return tokenizer.count_tokens(picked, "text", ranks_path, keep=("doc_id", "source", "lang", "topic"))


def cells_of(tokens: DataFrame) -> DataFrame:
    """``source, lang, topic, n_docs, tokens`` with partial aggregation in every task."""
    return tokens.groupBy("source", "lang", "topic").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))


def _rake(weight: np.ndarray, tokens: np.ndarray, group: np.ndarray, target: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Scales the weights of each group to its target, again over the uncapped cells where caps bite."""
    weight = weight.copy()
    for _ in range(STEPS):
        have = np.bincount(group, weight * tokens, len(target))
        fixed = weight >= cap * (1 - 1e-12)
        held = np.bincount(group, np.where(fixed, weight * tokens, 0.0), len(target))
        free = have - held
        # growing groups grow their free cells only; shrinking ones shrink all
        grow = have < target
        factor = np.where(grow, np.where(free > 0, (target - held) / np.where(free > 0, free, 1.0), 1.0), target / np.where(have > 0, have, 1.0))
        new = np.minimum(np.where(fixed & grow[group], weight, weight * factor[group]), cap)
        if np.allclose(new, weight, rtol=1e-12, atol=0):
            return new
        weight = new
    return weight


def fit(source: np.ndarray, lang: np.ndarray, topic: np.ndarray, tokens: np.ndarray, cap: np.ndarray, targets: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Calibrated weight per cell; the arrays hold each cell's category numbers, tokens and cap, the targets tokens per category."""
    weight = np.minimum(np.where(cap > 0, 1.0, 0.0), cap)
    for _ in range(ROUNDS):
        before = weight
        for group, target in ((topic, targets[2]), (lang, targets[1]), (source, targets[0])):
            weight = _rake(weight, tokens, group, target, cap)
        if np.abs(weight - before).max(initial=0.0) < TOLERANCE:
            break
    return weight


def calibrate(cells: DataFrame, target: DataFrame) -> DataFrame:
    """``source, lang, topic, n_docs, tokens, cap, weight`` per cell of a source in ``target`` (source, target_share, max_repeats).

    Source marginals are ``target_share`` of all tokens; language and topic marginals are the shares these have in the sources
    taking part. Shares need not be reachable: such a source ends with every cell at its cap. A null source or one without target
    gets no cell; a repeated target source counts with the largest share.
    """
    spark = cells.sparkSession
    wanted = target.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.col("max_repeats").cast("double")).alias("cap"))
    folder = f"{checkpoint_dir(spark)}/mixing-{uuid.uuid4().hex}"
    # The token counts behind the cells are the dear part: written once, read by everything that follows.
    cells.write.parquet(f"{folder}/cells")
    stored = spark.read.parquet(f"{folder}/cells")
    total = float(stored.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    part = stored.join(wanted, "source").select("source", "lang", "topic", "n_docs", "tokens", "share", "cap")
    rows = part.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        return _calibrate_large(part, total, folder)
    schema = "source string, lang string, topic string, n_docs bigint, tokens bigint, share double, cap double, weight double"
    if not rows:
        return spark.createDataFrame([], schema)
    rows.sort(key=lambda r: (r.source, r.lang, r.topic))
    tokens, cap = np.array([float(r.tokens) for r in rows]), np.array([r.cap for r in rows])
    groups, sums = [], []
    share = {r.source: r.share for r in rows}
    for name in ("source", "lang", "topic"):
        names, group = np.unique(np.array([getattr(r, name) for r in rows]), return_inverse=True)
        groups.append(group)
        sums.append(np.array([share[s] * total for s in names]) if name == "source" else np.bincount(group, tokens, len(names)))
    reach = np.minimum(sums[0], np.bincount(groups[0], tokens * cap, len(sums[0]))).sum()
    for i in (1, 2):
        sums[i] = sums[i] * (reach / max(sums[i].sum(), 1.0))
    weight = fit(groups[0], groups[1], groups[2], tokens, cap, (sums[0], sums[1], sums[2]))
    return spark.createDataFrame([(r.source, r.lang, r.topic, r.n_docs, r.tokens, r.share, r.cap, float(w)) for r, w in zip(rows, weight, strict=True)], schema)


def _calibrate_large(part: DataFrame, total: float, folder: str) -> DataFrame:
    """``fit`` as DataFrame steps, each written to the shared folder so that the plan stays short; only the last two are kept."""
    spark = part.sparkSession
    columns = [*part.columns, "weight"]
    sums = part.groupBy("source").agg(F.sum("tokens").alias("t"), F.max("share").alias("s"), F.max("cap").alias("c"))
    reach = float(sums.agg(F.sum(F.least(F.col("t") * F.col("c"), F.col("s") * total))).first()[0])
    scale = reach / max(float(part.agg(F.sum("tokens")).first()[0]), 1.0)
    written: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/step{len(written)}"
        df.write.parquet(path)
        written.append(path)
        if len(written) > 2:
            old = spark._jvm.org.apache.hadoop.fs.Path(written[-3])
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        return spark.read.parquet(path)

    start = F.when(F.col("cap") > 0, F.least(F.lit(1.0), F.col("cap"))).otherwise(0.0)
    current = keep(part.withColumn("weight", start).withColumn("before", start))
    for _ in range(ROUNDS):
        for name in ("topic", "lang", "source"):
            for _ in range(STEPS):
                current = keep(_step(current, name, F.max("share") * total if name == "source" else F.sum("tokens") * scale).select(*columns, "before", "moved"))
                if not current.where("moved").take(1):
                    break
        if (current.agg(F.max(F.abs(F.col("weight") - F.col("before")))).first()[0] or 0.0) < TOLERANCE:
            break
        current = current.withColumn("before", F.col("weight"))
    return current.select(*columns)


def _step(current: DataFrame, name: str, goal: Column) -> DataFrame:
    """One step of ``_rake``; ``moved`` says which weights it changed."""
    fixed = F.col("weight") >= F.col("cap") * (1 - 1e-12)
    used = F.col("weight") * F.col("tokens")
    have = current.groupBy(F.col(name).alias("__g")).agg(F.sum(used).alias("__have"), F.sum(F.when(fixed, used).otherwise(0.0)).alias("__held"), goal.alias("__goal"))
    free = F.col("__have") - F.col("__held")
    grow = F.when(fixed, 1.0).when(free > 0, (F.col("__goal") - F.col("__held")) / free).otherwise(1.0)
    factor = F.when(F.col("__have") <= 0, 1.0).when(F.col("__have") < F.col("__goal"), grow).otherwise(F.col("__goal") / F.col("__have"))
    new = F.least(F.col("cap"), F.col("weight") * factor)
    scaled = current.join(have, F.col(name) == F.col("__g")).withColumn("__new", new)
    return scaled.withColumn("moved", F.abs(F.col("__new") - F.col("weight")) > 1e-12 * F.col("weight")).withColumn("weight", F.col("__new"))


def sample(tokens: DataFrame, calibrated: DataFrame, seed: int = 11) -> DataFrame:
    """``doc_id, source, n_tokens, copies`` of every document used at least once; never more than the source's cap."""
    weights = calibrated.select("source", "lang", "topic", "weight", "cap")
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    copies = F.least(F.floor("weight") + F.when(u < F.col("weight") - F.floor("weight"), 1).otherwise(0), F.col("cap")).cast("int")
    return tokens.join(weights, ["source", "lang", "topic"]).select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def short_sources(calibrated: DataFrame, cells: DataFrame, target: DataFrame) -> DataFrame:
    """Sources of ``target`` that cannot reach their share, by the fit: raking leaves them below it.

    A source without cells reaches nothing. The fit never uses a document beyond its cap, so a source that falls short is
    below its share at every step; one that only has not converged yet is told apart by an exact check of what it has.
    """
    total = F.lit(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).first()[0])
    reached = calibrated.groupBy("source").agg(F.sum(F.col("weight") * F.col("tokens")).alias("reached"), F.sum("tokens").alias("tokens"))
    wanted = target.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    fitted = wanted.join(reached, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0.0))).where(F.col("reached") < F.col("share") * total)
    return fitted.where(F.coalesce("tokens", F.lit(0)) * F.col("cap") < F.col("share") * total).select("source")


def report(sampled: DataFrame, calibrated: DataFrame, target: DataFrame, tokens: DataFrame) -> DataFrame:
    """``source, target_share, tokens, used_tokens, n_docs, max_copies, actual_share, reached_share`` per target source.

    ``actual_share``: of the tokens used; ``reached_share``: of the planned total, the tokens of all documents. Where some
    sources fall short the mixture is smaller than planned, so the others' actual shares lie above their targets.
    """
    used = sampled.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("max_copies"))
    have = calibrated.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    rows = target.select("source", "target_share").join(have, "source", "left").join(used, "source", "left").fillna(0, ["tokens", "used_tokens", "n_docs", "max_copies"])
    whole = used.agg(F.coalesce(F.sum("used_tokens"), F.lit(0))).first()[0]
    planned = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    share = lambda total: F.round(F.col("used_tokens") / F.lit(float(max(total, 1))), 6)
    return rows.select("source", "target_share", "tokens", "used_tokens", "n_docs", "max_copies", share(whole).alias("actual_share"), share(planned).alias("reached_share"))
