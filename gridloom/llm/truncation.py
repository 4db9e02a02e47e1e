"""Texts cut off by field limits or in transfer (problem 8).

Method: intact texts are cut artificially to make positives; hashed logistic regression is trained on closing
characters and words, closing punctuation and the distance to the source's length limit; then every record is scored.

* ``text_facts``: one pass over the texts writes a compact row of each - class of its end, lengths, hashed features of its
  closing part - and the text itself of a bounded sample only. Everything after it reads this table, not the texts.
* ``source_stats``: over all rows, per source and unit (characters, UTF-8 bytes), the lengths at which open ends pile up;
  the second unit's are sought among the open ends that the first one's do not explain.
* ``examples``: each intact text of the sample gives itself, itself without its closing punctuation (complete without
  it) and cuts: at a random place, as in transfer, and at its source's length limit, for which it is continued with another
  intact text of the source, as a field that is too short would cut it. The distance to the limit is measured like any other.
* ``score``: weights of every record's features, summed in Arrow batches; the weights are a fixed 2^18 numbers.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import stored

DIMENSIONS = 1 << 18
SAMPLE_ROWS = 12_000
THRESHOLD = 0.5
NATURAL_OPEN_RATE = 0.6  # a source above it has no closing punctuation by nature, or cuts most of its texts
STANDS_OUT = 3  # a limit of such a source holds so many times what lies next to it
CUTS = 1.0  # of each intact text with a closed end, anywhere in it; half as many of one without, which gives fewer intact examples too
LIMIT_CUTS = 2.0  # of each intact text, at its source's limits, times the share of the source's open ends that lie there
SOFT = 9  # a cut at a word's end leaves up to so many characters below the limit

STRONG = set(".!?。！？｡؟।")
ELLIPSIS = set("…⋯")
STOPS = STRONG | ELLIPSIS
TAIL = 128  # longer than anything the patterns below can match at the end of a text
CLOSERS = set("\"'”“’»›)）]】」』〉》")
OPENERS = {"(": ")", "（": "）", "“": "”", "«": "»", "„": "“", "[": "]"}
PAUSES = set(",，、;；:：")
DASHES = set("-–—‐")
INVISIBLE = set("\u200b\u200c\u200d\u2060\ufeff\u00ad")


def _is_symbol(ch: str) -> bool:
    """Emoji, their modifiers and other pictographs, which may follow a complete text."""
    return ch in "\ufe0f\u20e3" or unicodedata.category(ch) in {"So", "Sk", "Cf"} and ch not in "™®©°�"


def strip_noise(text: str) -> tuple[str, str]:
    """The text without trailing spaces, invisible characters and pictographs, and the class of what was there: ``""``, ``sp``, ``nl``, ``em``."""
    end = len(text)
    kinds = set()
    while end:
        ch = text[end - 1]
        if ch in "\n\r":
            kinds.add("nl")
        elif ch.isspace():
            kinds.add("sp")
        elif ch in INVISIBLE:
            pass
        elif _is_symbol(ch):
            kinds.add("em")
        else:
            break
        end -= 1
    return text[:end], next((k for k in ("em", "nl", "sp") if k in kinds), "")


MARK = re.compile(r"[\[(（【]\s{0,9}(?:\.{2,20}|…{1,20}|more|\+)\s{0,9}[\])）】]$")
ENTITY = re.compile(r"&[#A-Za-z0-9]{0,7}$")
TAG = re.compile(r"<[/A-Za-z][^<>]{0,80}$|<$")
WHOLE_TAG = re.compile(r"</?[A-Za-z][^<>]{0,80}>$")
ASIDE = re.compile(r"\s[(（][^()（）]{1,40}[)）]$")
Limits = tuple[Sequence[int], Sequence[int]]  # of a source, in characters and in bytes
DIGITS = re.compile(r"\d")
WORDS = re.compile(r"\S+")


def closing(text: str) -> tuple[str, str, str]:
    """(class of the closing punctuation, trailing noise, the text before both).

    Classes: ``strong``, ``ell`` (ellipsis), ``mark`` ([...]), ``pause``, ``dash``, ``bad`` (a damaged character),
    ``entity`` (an unfinished entity or tag) and ``none``.
    """
    core, noise = strip_noise(text)
    for _ in range(3):  # whole tags and short asides after the end of the text
        tail = core[-TAIL:]
        if not tail or tail[-1] not in ">)）":
            break
        m = WHOLE_TAG.search(tail) or (ASIDE.search(tail) if _terminated(core) is None and not MARK.search(tail) else None)
        before = strip_noise(core[: len(core) - len(tail) + m.start()])[0] if m else ""
        if not before:
            break
        core = before
    if core.endswith("�"):
        return "bad", noise, core.rstrip("�")
    tail = core[-TAIL:]
    cut = ENTITY.search(tail) or TAG.search(tail)
    if cut:
        return "entity", noise, core[: len(core) - len(tail) + cut.start()]
    mark = MARK.search(tail)
    if mark:
        return "mark", noise, core[: len(core) - len(tail) + mark.start()].rstrip()
    found = _terminated(core)
    if found:
        return found[0], noise, found[1]
    bare = core.rstrip("".join(CLOSERS))
    if bare and bare[-1] in PAUSES:
        return "pause", noise, bare.rstrip("".join(PAUSES) + " ")
    if core and core[-1] in DASHES:
        return "dash", noise, core.rstrip("".join(DASHES))
    return "none", noise, core


def _terminated(core: str) -> tuple[str, str] | None:
    """Class and rest of a text that ends in a full stop or ellipsis, closing quotes and brackets aside; None if it does not."""
    end = len(core)
    while end and (core[end - 1] in CLOSERS or core[end - 1].isspace()):
        end -= 1
    if not end or core[end - 1] not in STOPS:
        return None
    start = end
    while start and core[start - 1] in STOPS:
        start -= 1
    run = core[start:end]
    dots = run.startswith("..") or any(c in ELLIPSIS for c in run)
    return ("ell" if dots else "strong"), core[:start].rstrip()


MARKS = ("[...]", "[…]", "...", "…")


def cut_length(text: str, unit: str) -> int:
    """Length without what is put after a cut (markers, damaged characters), in characters or bytes."""
    t = text.rstrip("�") if text.endswith("�") else text
    mark = next((m for m in MARKS if t.endswith(m)), None)
    if mark:
        t = t[: -len(mark)]
        if mark[0] == "[":
            t = t.rstrip()
    return len(t) if unit == "chars" else len(t.encode("utf-8", "replace"))


def is_open(text: str) -> bool:
    """Whether the end of a text is not a full stop (an ellipsis counts as open)."""
    return closing(text)[0] != "strong"


def _shape(s: str) -> str:
    return DIGITS.sub("0", s)


def _unclosed(core: str) -> bool:
    """Whether the last opening bracket or quote of the closing part is not closed."""
    part = core[-400:]
    for a, b in OPENERS.items():
        i = part.rfind(a)
        if i >= 0 and b not in part[i + 1 :] and (a != "“" or not part[:i].count("„") > part[:i].count("“")):
            return True
    return False


def _near(length: int, limits: Sequence[int]) -> str:
    """Where a length lies against a source's limits: ``at`` one, ``just`` above (a damaged character), ``below``, ``far``, ``no`` limit."""
    if not limits:
        return "no"
    gaps = [limit - length for limit in limits]
    if 0 in gaps:
        return "at"
    if any(-3 <= d < 0 for d in gaps):
        return "just"
    return "below" if any(0 < d <= SOFT for d in gaps) else "far"


@dataclass(frozen=True)
class Facts:
    """What is kept of a text: the class of its end, its lengths without what follows a cut, and features in three lists -
    for any source, and for sources with low and high open rates."""

    kind: str
    chars: int
    bytes: int
    names: tuple[str, ...]
    low: tuple[str, ...]
    high: tuple[str, ...]


def facts(text: str) -> Facts:
    kind, noise, core = closing(text)
    group = "s" if kind == "strong" else "e" if kind == "ell" else "o"
    tail = _shape(core[-60:])
    words = tail.split()[-3:] if tail else []
    out = [f"k:{kind}", f"k:{kind}:{noise}"]
    by_rate = [(f"r:{group}:", "")]  # what stands before and after the rate
    g2 = "s" if group == "s" else "o"
    if words:
        out.append(f"w1:{g2}:{words[-1].lower()}")
        by_rate.append((f"w1r:{g2}:", f":{words[-1].lower()}"))
        if len(words) > 1:
            out.append(f"w2:{g2}:{' '.join(words[-2:]).lower()}")
        if len(words) > 2:
            out.append(f"w3:{g2}:{' '.join(words[-3:]).lower()}")
        last = words[-1]
        out.append(f"wl:{g2}:{min(len(last), 6)}:{'u' if last[:1].isupper() else 'd' if last[:1] == '0' else 'l'}")
    for n in (1, 2, 3, 4, 6, 8):
        if len(tail) >= n:
            out.append(f"c{n}:{g2}:{tail[-n:].lower()}")
    # the part since the last full stop
    i = max((core.rfind(ch) for ch in ".!?。！？…"), default=-1)
    part = core[i + 1 :]
    n = len(part.split()) if not re.search(r"[぀-ヿ一-鿿]", part) else len(part) // 2
    out.append(f"n:{g2}:{min(n, 9)}")
    by_rate.append((f"nr:{g2}:", f":{min(n, 9)}"))
    if _unclosed(core):
        out.append(f"u:{g2}")
    if part[:1].strip() and part.lstrip()[:1].islower():
        by_rate.append((f"lo:{g2}:", ""))
    return Facts(kind, cut_length(text, "chars"), cut_length(text, "bytes"), tuple(out), *(tuple(f"{a}{rate}{b}" for a, b in by_rate) for rate in ("lo", "hi")))


def limit_features(kind: str, chars: int, bytes_: int, limits: Limits) -> list[str]:
    """Features of the measured distance to the source's limits."""
    group = "s" if kind == "strong" else "e" if kind == "ell" else "o"
    c, b = _near(chars, limits[0]), _near(bytes_, limits[1])
    return [f"lc:{group}:{c}", f"lb:{group}:{b}", f"l:{group}:{'1' if 'at' in (c, b) or b == 'just' else 'n' if 'below' in (c, b) else '0'}"]


def features(text: str, limits: Limits, open_rate: float) -> list[str]:
    """Feature names of a text of a source."""
    f = facts(text)
    return [*f.names, *(f.high if open_rate > NATURAL_OPEN_RATE else f.low), *limit_features(f.kind, f.chars, f.bytes, limits)]


def hashed(names: Sequence[str]) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % DIMENSIONS for n in names]


SUFFIXES = ("", "", "", "", "…", "...", " [...]", "…", ",", "-", " ", "\n", "�", "&am")


def _spoils(piece: str, rest: str) -> bool:
    """Whether a cut is of no use: nothing is left, the rest is a whole sentence, or only punctuation was lost."""
    return not piece.strip() or bool(_terminated(piece.rstrip()) or _terminated(strip_noise(piece)[0])) or not re.search(r"\w", rest)


def cuts(text: str, rng: random.Random, times: float = CUTS) -> list[str]:
    """Artificial cuts of an intact text anywhere, with what transfers leave behind."""
    core, _ = strip_noise(text)
    out = []
    for _ in range(int(times + rng.random())):
        if len(core) < 6:
            break
        piece = core[: rng.randint(max(2, len(core) // 8), len(core) - 2)]
        if rng.random() < 0.35 and " " in piece:
            piece = piece.rsplit(" ", 1)[0]
        suffix = rng.choice(SUFFIXES)
        if not _spoils(piece, core[len(piece) :]):
            out.append(piece + suffix)
    return out


def cut_at_limits(text: str, following: str, limits: Limits, shares: Sequence[float], rng: random.Random) -> list[str]:
    """The text, continued by another one where it is shorter, cut at limits of its source: hard, at a damaged character, or back
    at a word's end. Each limit is taken as often as its share of the source's open ends says."""
    out = []
    often = iter(shares)
    for unit, found in zip(("chars", "bytes"), limits, strict=True):
        for limit in found:
            if rng.random() >= LIMIT_CUTS * next(often):
                continue
            whole = f"{text} {following}"
            while len(whole) < limit + SOFT and len(whole) < 64 * limit:
                whole = f"{whole} {following}"
            raw = whole[:limit] if unit == "chars" else whole.encode("utf-8", "replace")[:limit].decode("utf-8", "replace")
            piece = raw.rstrip("�")
            rest = whole[len(piece) :]
            if rng.random() < 0.3 and " " in piece and rest[:1].isalnum():
                short = piece.rsplit(" ", 1)[0]
                piece, rest, raw = (short, whole[len(short) :], short) if len(piece) - len(short) <= SOFT else (piece, rest, raw)
            if not _spoils(piece, rest):
                out.append(raw + rng.choice(("", "", "", "…", "...", " [...]")) if raw == piece else raw)
    return out


def trains(text: str | None, limits: Limits, open_rate: float) -> bool:
    """Whether a text counts as intact: its end is closed, or its source never closes its texts and no length limit explains the open end."""
    if text is None or not strip_noise(text)[0]:
        return False
    if not is_open(text):
        return True
    return open_rate > NATURAL_OPEN_RATE and all(_near(cut_length(text, unit), x) in ("no", "far") for unit, x in zip(("chars", "bytes"), limits, strict=True))


def examples(text: str, following: str, limits: Limits, shares: Sequence[float], open_rate: float) -> list[tuple[list[int], int]]:
    """Hashed training examples of an intact text; the random choices depend on the text only, so a rerun task gives the same.

    ``following``: another intact text of the source, which a text shorter than the limit is continued with."""
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    of = lambda t, y: (hashed(features(t, limits, open_rate)), y)
    out = [of(text, 0)]
    kind, _, core = closing(text)
    if kind in ("strong", "ell") and core:
        out.append(of(core, 0))
        if rng.random() < 0.5:
            out.append(of(core + rng.choice((" ", "…", "…", "…", "…", "……", "...", "\n", " 🙂")), 0))
    return out + [of(piece, 1) for piece in (*cuts(text, rng, CUTS if len(out) > 1 else CUTS / 2), *cut_at_limits(text, following, limits, shares, rng))]


def train(rows: Sequence[tuple[Sequence[int], int]], epochs: int = 120, decay: float = 2e-6, rate: float = 0.15) -> np.ndarray:
    """Weights of hashed logistic regression over (features, label) examples: full-batch Adam, the same for any order of rows."""
    rows = sorted((tuple(f), y) for f, y in rows)
    if not rows:
        return np.zeros(DIMENSIONS)
    width = max(len(f) for f, _ in rows)
    index = np.full((len(rows), width), DIMENSIONS, np.int64)
    for i, (f, _) in enumerate(rows):
        index[i, : len(f)] = f
    label = np.array([y for _, y in rows], float)
    used, compact = np.unique(index, return_inverse=True)
    compact = compact.reshape(index.shape)
    pad = len(used) - 1 if used[-1] == DIMENSIONS else None
    w, m, v = (np.zeros(len(used)) for _ in range(3))
    for step in range(1, epochs + 1):
        z = w[compact].sum(1)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(label)
        grad = np.bincount(compact.ravel(), np.repeat(error, width), len(used)) + decay * w
        if pad is not None:
            grad[pad] = 0.0
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    out = np.zeros(DIMENSIONS + 1)
    out[used] = w
    return out[:DIMENSIONS]


def probability(text: str | None, limits: Limits, open_rate: float, weights: np.ndarray) -> float:
    """Chance that a text was cut; 0 for a null, empty or blank one."""
    if text is None or not strip_noise(text)[0]:
        return 0.0
    z = float(weights[hashed(features(text, limits, open_rate))].sum())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _stands_out(histogram: dict[int, int], top: int, width: int, inside: int) -> bool:
    """Whether a pile-up is more than the shape of texts that are open by nature, whose lengths have a mode and favourites of their own.

    A hard limit holds ``STANDS_OUT`` times any length near it; a soft one as much against the windows on both sides, ends sharply,
    as cuts at a word's end do and the flank of a bell does not, and its window is at most a quarter of its length, which natural lengths spread over.
    """
    count = lambda a, b: sum(histogram.get(x, 0) for x in range(a, b))
    if not width:
        return inside >= STANDS_OUT * max(histogram.get(top + d, 0) for d in range(-5, 6) if d)
    sides = max(count(top - 2 * width - 1, top - width), count(top + 1, top + width + 2))
    last = count(top - 2, top + 1)
    return top >= 4 * SOFT and inside >= STANDS_OUT * sides and last >= 0.8 * 3 * inside / (width + 1) and count(top + 1, top + 4) <= 0.1 * last


def find_limits(histogram: dict[int, int], least: int = 4, significance: float = 6.0, natural: bool = False) -> list[tuple[float, int, float]]:
    """(score, length, open ends beyond the expected) of the lengths at which open ends pile up, best first, windows not overlapping.

    A hard limit is one length, a soft one (cuts at a word's end) a window of ``SOFT`` lengths up to it; either must hold
    far more open ends than the twenty lengths on both sides lead to expect. A soft limit must also end sharply and stand out
    from the lengths of complete open texts; with ``natural``, where most texts are open, a hard one too.
    """
    scored = []
    for top in histogram:
        for width in (0, SOFT - 1):
            inside = sum(histogram.get(x, 0) for x in range(top - width, top + 1))
            if inside < least:
                continue
            side = sum(histogram.get(x, 0) for x in range(top + 1, top + 21)) + sum(histogram.get(x, 0) for x in range(top - width - 20, top - width))
            expected = side * (width + 1) / 40
            score = (inside - expected) / math.sqrt(expected + 1)
            if score >= significance and (not (natural or width) or _stands_out(histogram, top, width, inside)):
                scored.append((score, top, width, inside - expected))
    scored.sort(key=lambda x: (-x[0], x[1], x[2]))
    kept: list[tuple[float, int, float]] = []
    for score, top, _, excess in scored:
        if all(abs(top - other) > 20 + SOFT for _, other, _ in kept):
            kept.append((score, top, excess))
    return kept


STATS_SCHEMA = "source_key string, n_rows bigint, open_rate double, char_limits array<int>, byte_limits array<int>, limit_shares array<double>"
FACTS_SCHEMA = "n_chars bigint, n_bytes bigint, kind string, features array<int>, low array<int>, high array<int>, sample string"


def text_facts(docs: DataFrame, kind: str, share: float) -> DataFrame:
    """``doc_id, source`` and the facts of every row's text, in one pass; ``kind`` is null for a null, empty or blank text.

    ``sample``: the text of about ``share`` of the rows, by hash of the id, if it may train; else null."""
    picked = docs.withColumn("pick", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = lambda names: hashed(names)
        for batch in batches:
            rows = []
            for t, pick in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if t is None or not strip_noise(t)[0]:
                    rows.append((None,) * 7)
                    continue
                f = facts(t)
                rows.append((f.chars, f.bytes, f.kind, ids(f.names), ids(f.low), ids(f.high), t if pick else None))
            ints = pa.list_(pa.int32())
            types = (pa.int64(), pa.int64(), pa.string(), ints, ints, ints, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=["doc_id", "source", *[x.split()[0] for x in FACTS_SCHEMA.split(", ")]])

    return picked.select("doc_id", "source", "text", "pick").mapInArrow(read, f"doc_id {kind}, source string, {FACTS_SCHEMA}")


def _clearest(joint: DataFrame, rates: DataFrame) -> DataFrame:
    """``source_key, unit, limit, share`` (of the source's open ends): the clearest limit of each source in either unit; no row without one."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        found = find_limits({int(x): int(n) for x, n in zip(pdf["length"], pdf["n_open"], strict=True)}, natural=float(pdf["open_rate"].iloc[0]) > NATURAL_OPEN_RATE)[:1]
        opened = float(pdf["n_opened"].iloc[0])
        return pd.DataFrame([(pdf["source"].iloc[0], pdf["unit"].iloc[0], top, excess / opened, score) for score, top, excess in found], columns=["source_key", "unit", "limit", "share", "score"])

    both = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(c).alias("length")) for u, c in (("bytes", "n_bytes"), ("chars", "n_chars"))])).alias("l")
    hist = joint.select("source", both, "n_open").groupBy("source", "l.unit", "l.length").agg(F.sum("n_open").alias("n_open"))
    rows = hist.join(rates, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # at most one row per length of a source: compact whatever the source's share of the documents
    found = rows.groupBy("source", "unit").applyInPandas(find, "source_key string, unit string, limit int, share double, score double")
    return found.groupBy("source_key").agg(F.max_by(F.struct("unit", "limit", "share"), F.struct("score", "unit")).alias("b")).select("source_key", "b.*")


def source_stats(known: DataFrame) -> DataFrame:
    """Per source (null is one): rows with text, share of open ends, length limits in characters and in bytes; over all rows of ``text_facts``.

    A text has both lengths, so a limit in one unit makes lengths pile up in the other too. So the clearest limit of each
    source is taken first, then the clearest among the open ends that lie at none so far, until there is none: as many
    rounds over a compact table of lengths as a source has limits.
    """
    rates = stored(known.where(F.col("kind").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.when(F.col("kind") != "strong", 1)) / F.count(F.lit(1))).alias("open_rate")), "rates")
    by_source = rates.select(F.col("source").alias("__s"), "open_rate", (F.col("open_rate") * F.col("n_rows")).alias("n_opened"))
    left = stored(known.where(F.col("kind") != "strong").groupBy("source", "n_chars", "n_bytes").agg(F.count(F.lit(1)).alias("n_open")), "lengths")
    limits = None
    while True:
        best = stored(_clearest(left, by_source), "limits")
        if best.isEmpty():
            break
        limits = best if limits is None else limits.unionByName(best)
        own = F.when(F.col("unit") == "chars", F.col("n_chars")).otherwise(F.col("n_bytes"))
        # a source without a further limit is done
        left = left.join(best, F.col("source").eqNullSafe(F.col("source_key"))).where(~own.between(F.col("limit") - SOFT, F.col("limit") + 3)).select("source", "n_chars", "n_bytes", "n_open")
    ints, doubles = F.array().cast("array<int>"), F.array().cast("array<double>")
    if limits is None:
        return rates.select(F.col("source").alias("source_key"), "n_rows", "open_rate", ints.alias("char_limits"), ints.alias("byte_limits"), doubles.alias("limit_shares"))
    of = lambda u: F.array_sort(F.collect_list(F.when(F.col("unit") == u, F.struct("limit", "share"))))
    per = limits.groupBy("source_key").agg(of("chars").alias("c"), of("bytes").alias("b"))
    return rates.join(per, F.col("source").eqNullSafe(F.col("source_key")), "left").select(
        F.col("source").alias("source_key"), "n_rows", "open_rate", F.coalesce("c.limit", ints).alias("char_limits"), F.coalesce("b.limit", ints).alias("byte_limits"), F.coalesce(F.concat("c.share", "b.share"), doubles).alias("limit_shares")
    )


def _training_rows(known: DataFrame) -> list[tuple[list[int], int]]:
    """Examples of the sampled texts; each is continued by the next sampled intact text of its source."""
    intact = known.where(F.col("sample").isNotNull())

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        limits = (list(pdf["char_limits"].iloc[0]), list(pdf["byte_limits"].iloc[0]))
        rate, shares = float(pdf["open_rate"].iloc[0]), list(pdf["limit_shares"].iloc[0])
        texts = sorted(t for t in pdf["sample"] if trains(t, limits, rate))
        out = [x for t, other in zip(texts, texts[1:] + texts[:1], strict=True) for x in examples(t, other, limits, shares, rate)]
        return pd.DataFrame({"f": [f for f, _ in out], "y": [y for _, y in out]})

    # the sample is bounded, so a source's part of it is too
    rows = intact.select("source", "sample", "open_rate", "char_limits", "byte_limits", "limit_shares").groupBy("source").applyInPandas(make, "f array<int>, y int").collect()
    return [(list(r.f), r.y) for r in rows]


def score(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", sample_rows: int = SAMPLE_ROWS, max_sources: int = 100_000) -> DataFrame:
    """``doc_id, source, p_cut`` of every row: the chance that its text lost its end.

    Null, empty and blank texts score 0. Repeated rows stay; other columns, clashing names included, are ignored. Texts of
    any length are read whole, once. An empty table gives no rows. The classifier is fitted on about ``sample_rows`` rows (by
    hash of the id) whose end is closed, or whose source never closes its texts and whose length is not at a limit;
    statistics are of all rows.
    """
    spark = df.sparkSession
    kind = df.schema[id_column].dataType.simpleString()
    docs = df.select(F.col(id_column).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    share = min(1.0, 1.15 * sample_rows / max(1, df.count()))  # the count comes from footers
    known = stored(text_facts(docs, kind, share), "facts")
    stats = stored(source_stats(known), "sources")
    if stats.limit(max_sources + 1).count() <= max_sources:  # size checked: a few numbers a source
        stats = F.broadcast(stats)
    none = F.array().cast("array<int>")
    placed = known.join(stats, F.col("source").eqNullSafe(F.col("source_key")), "left").select(
        "doc_id", "source", "kind", "n_chars", "n_bytes", F.coalesce("char_limits", none).alias("char_limits"), F.coalesce("byte_limits", none).alias("byte_limits"), F.coalesce("open_rate", F.lit(0.0)).alias("open_rate"), "limit_shares", "features", F.when(F.col("open_rate") > NATURAL_OPEN_RATE, F.col("high")).otherwise(F.col("low")).alias("by_rate"), "sample"
    )
    weights = spark.sparkContext.broadcast(train(_training_rows(placed)).astype(np.float32))

    def rate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        cached = lru_cache(maxsize=100_000)(lambda kind, chars, bytes_, lc, lb: float(w[hashed(limit_features(kind, chars, bytes_, (lc, lb)))].sum()))
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for i in (7, 8):
                lists = batch.column(i)
                at = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                z += np.bincount(at, w[lists.flatten().to_numpy(zero_copy_only=False)], batch.num_rows)
            kinds = batch.column(2).to_pylist()
            for i, row in enumerate(zip(kinds, *(batch.column(k).to_pylist() for k in (3, 4, 5, 6)), strict=True)):
                if row[0] is not None:
                    z[i] += cached(*row[:3], tuple(row[3]), tuple(row[4]))
            p = np.where([k is not None for k in kinds], 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64())], names=["doc_id", "source", "p_cut"])

    return placed.select("doc_id", "source", "kind", "n_chars", "n_bytes", "char_limits", "byte_limits", "features", "by_rate").mapInArrow(rate_rows, f"doc_id {kind}, source string, p_cut double")


def found(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.where(F.col("p_cut") > threshold).select("doc_id")


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``source, n_docs, n_cut, cut_rate`` per source."""
    cut = F.count(F.when(F.col("p_cut") > threshold, 1))
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), cut.alias("n_cut"), F.round(cut / F.count(F.lit(1)), 6).alias("cut_rate"))
