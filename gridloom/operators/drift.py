"""Schemas that drift between files: one consistent table and every change (problem 4).

1. ``file_schemas``: lines are parsed on the JVM as variants; one compact row per (file, field) - counts per JSON type,
   moments of magnitude and of significant digits, a sketch of fixed size - with partial aggregation in every task. A
   file or channel with a third of all lines is reduced before anything is shuffled.
2. ``correspondences``: each file and the file before it in its group meet as two compact schemas, whatever the group's
   length. Both become schema graphs (fields; whole names, name words, JSON types, value classes and parents as labelled
   nodes), and *similarity flooding* carries match scores over pairs of nodes joined by equal labels until they no
   longer change. Only the flooded scores select: best pairs first, each field once, down to a share of what the two
   fields reach elsewhere. A field without partner is added or removed.
3. ``schema_history``: canonical names by following the changes alone through a group.
4. ``unify``: every line under the canonical names, cast to the canonical types, on the JVM.

Scores start from names (equal but for case and underscores; else their words, rare ones counting more), types and value
classes. Value classes are the moments of magnitude, its spread and the number of significant digits; the last two stay
the same when a field changes its unit by a power of ten, so they speak for fields whose JSON type changes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import stored

BINS = 16  # of the sketch: the smallest hash of the values of each bin
DEPTH = 3  # levels of nested objects that are opened; deeper ones are one field of type object
KINDS = ("array", "boolean", "integer", "number", "object", "string")  # of JSON; a field with none of them is null only
NUMERIC = r"^\s*[A-Za-z]{0,2}([-+]?\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*$"

#: Score below which two fields never correspond, and the least share of the best score either field reaches with any other.
LEAST_SCORE, LEAST_SHARE = 0.08, 0.3
#: Weight in the flow of each kind of edge.
WEIGHTS = {"name": 1.5, "word": 0.6, "type": 0.5, "value": 1.5, "parent": 0.3}
#: Value classes: decades of magnitude that tell two fields apart, likewise spreads and significant digits, and their weights.
DECADES, SPREADS, DIGITS = 1.3, 0.6, 2.0
MAGNITUDE, SPREAD, SIGNIFICANT = 0.3, 0.2, 0.5
OTHER_UNIT = 0.5  # agreement in magnitude of fields of other JSON types that lie over UNIT_DECADES apart
UNIT_DECADES = 1.5
ROUNDS, TOLERANCE = 60, 1e-4


def json_kind(value: Column) -> Column:
    """JSON type of a variant: ``integer``, ``number`` (point or exponent), ``string``, ``boolean``, ``array``, ``object`` or ``null``.

    A whole number of 19 digits or more counts as integer even if it was written with a point.
    """
    s = F.schema_of_variant(value)
    whole = s.startswith("DECIMAL") & s.endswith(",0)") & (F.length(_text(value)) >= 19)
    return (
        F.when((s == "BIGINT") | whole, "integer")
        .when(s.startswith("DECIMAL") | (s == "DOUBLE"), "number")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .when(s.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _members(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def number_text(text: Column) -> Column:
    """Digits of a number as it may stand in a string: thousands separators, a short letter prefix, leading zeros; else null."""
    found = F.regexp_extract(text, NUMERIC, 1)
    return F.when(found != "", F.translate(found, ",", ""))


def line_fields(lines: DataFrame, file_id: str, payload: str, depth: int = DEPTH) -> DataFrame:
    """``file_id, path, value`` of every field of every line, nested ones as ``a.b``.

    A null, damaged or non-object line, one with a repeated name and one without fields give one row with a null path.
    """
    text = F.col(payload).cast("string")
    parsed = lines.select(F.col(file_id).cast("long").alias("file_id"), _members(F.try_parse_json(text)).alias("m"), text.rlike(r"\{[^{]*\{").alias("deep"))
    flat = F.map_entries("m")
    entries = F.when(F.col("deep"), _opened(flat, depth - 1)).otherwise(flat)
    return parsed.select("file_id", F.explode_outer(entries).alias("e")).select("file_id", F.col("e.key").alias("path"), "e.value")


def _opened(entries: Column, levels: int) -> Column:
    """Entries (key, value) with those of nested objects behind their own."""
    if not levels:
        return entries
    none = F.slice(entries, 1, 0)

    def with_inner(e: Column) -> Column:
        inner = F.transform(_opened(F.map_entries(_members(e["value"])), levels - 1), lambda i: F.struct(F.concat(e["key"], F.lit("."), i["key"]).alias("key"), i["value"].alias("value")))
        return F.concat(F.array(e), F.when(F.schema_of_variant(e["value"]).startswith("OBJECT"), inner).otherwise(none))

    return F.flatten(F.transform(entries, with_inner))


def file_schemas(lines: DataFrame, file_id: str, payload: str) -> DataFrame:
    """One row per (file, field): values per JSON type, moments of their magnitude and significant digits, the sketch.

    A field written only as null is present with no type; a file none of whose lines has a field has one row with a null path.
    """
    typed = line_fields(lines, file_id, payload).select("file_id", "path", F.when(F.col("path").isNotNull(), json_kind(F.col("value"))).alias("kind"), _text(F.col("value")).alias("text"))
    digits = F.when(F.col("kind") == "string", number_text(F.col("text"))).when(F.col("kind").isin("integer", "number"), F.col("text"))
    # explode keeps the optimizer from computing these once more for every aggregate that uses them
    valued = typed.select("file_id", "path", "kind", F.explode(F.array(F.struct(digits.alias("digits"), F.when(F.col("kind").isin("integer", "number", "string", "boolean"), F.col("text")).alias("text")))).alias("v"))
    x = F.col("v.digits").try_cast("double")
    x = F.when(F.abs(x) < float("inf"), x)
    cells = F.struct(
        F.log10(1 + F.abs(x)).alias("size"),
        F.when(x.isNotNull(), F.greatest(F.length(F.expr("trim(BOTH '0' FROM translate(substring_index(lower(v.digits), 'e', 1), '+-.', ''))")), F.lit(1))).alias("digits"),
        F.when(F.col("v.text").isNotNull(), F.xxhash64(F.coalesce(x.cast("string"), F.col("v.text")))).alias("hash"),
    )
    measured = valued.select("file_id", "path", "kind", F.explode(F.array(cells)).alias("c")).select("file_id", "path", "kind", "c.*")
    place = F.pmod("hash", F.lit(BINS))
    return measured.groupBy("file_id", "path").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS],
        F.count("size").alias("n_size"),
        F.sum("size").alias("size"),
        F.sum(F.col("size") * F.col("size")).alias("size2"),
        F.sum("digits").alias("digits"),
        *[F.min(F.when(place == i, F.col("hash"))).alias(f"b{i}") for i in range(BINS)],
    )


@dataclass
class Field:
    """What is known of one field of one file; ``size``, ``spread`` and ``digits`` are None where the values are no numbers."""

    path: str
    kind: str
    size: float | None = None  # mean log10 of the values
    spread: float | None = None
    digits: float | None = None  # mean number of significant digits
    few: bool = False  # at most three bins of the sketch are taken
    sketch: tuple[int | None, ...] = ()  # of values that are no numbers


@lru_cache(maxsize=100_000)
def words(name: str) -> tuple[str, ...]:
    """Lower-case words of a field's last path part."""
    found = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name.rsplit(".", 1)[-1])
    return tuple(w.lower() for w in found) or (name.lower(),)


def _plain(name: str) -> str:
    return name.lower().replace("_", "")


@lru_cache(maxsize=100_000)
def word_similarity(a: str, b: str) -> float:
    """1 for equal words, 0.8 where one starts or ends with the other, else the share of common letter pairs."""
    if a == b:
        return 1.0
    if min(len(a), len(b)) >= 2 and (a.startswith(b) or b.startswith(a) or a.endswith(b) or b.endswith(a)):
        return 0.8
    x, y = ({w[i : i + 2] for i in range(len(w) - 1)} for w in (f" {a} ", f" {b} "))
    return 2 * len(x & y) / (len(x) + len(y))


@lru_cache(maxsize=20_000)
def _name_graph(left: tuple[str, ...], right: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two lists of paths: similarity of the names, which are equal but for case and underscores, and words and parents with their edges."""
    wl, wr = [words(p) for p in left], [words(p) for p in right]
    cl, cr = Counter(w for x in wl for w in set(x)), Counter(w for x in wr for w in set(x))
    lv, rv = sorted(cl), sorted(cr)
    at_l, at_r = [[lv.index(w) for w in x] for x in wl], [[rv.index(w) for w in x] for x in wr]
    word = np.array([[word_similarity(a, b) for b in rv] for a in lv])
    near = word / np.maximum(np.array([cl[w] for w in lv])[:, None], np.array([cr[w] for w in rv])[None, :])  # rare words count more
    # each word of one name against the best one of the other, and back
    there = np.stack([near[:, x].max(1) for x in at_r], 1)
    back = np.stack([near[x].max(0) for x in at_l], 0)
    names = 0.4 * (np.stack([there[x].mean(0) for x in at_l], 0) + np.stack([back[:, x].mean(1) for x in at_r], 1))
    pl, pr = [_plain(p) for p in left], [_plain(p) for p in right]
    same = np.array([[float(a == b) for b in pr] for a in pl])
    names[same > 0] = 1.0

    def edges(rows: list[list[int]], n: int) -> np.ndarray:
        out = np.zeros((len(rows), n))
        for i, r in enumerate(rows):
            out[i, r] = 1.0
        return out

    parent = lambda p: p.rsplit(".", 1)[0] if "." in p else ""
    parents = sorted({parent(p) for p in (*left, *right)})
    return names, same, edges(at_l, len(lv)), edges(at_r, len(rv)), word, *(edges([[parents.index(parent(p))] for p in side], len(parents)) for side in (left, right))


_TYPES = {frozenset(("integer", "number")): 0.7, frozenset(("integer", "string")): 0.6, frozenset(("number", "string")): 0.6}


def type_similarity(a: str, b: str) -> float:
    return 1.0 if a == b else 0.5 if "null" in (a, b) else _TYPES.get(frozenset((a, b)), 0.0)


def value_similarity(left: Sequence[Field], right: Sequence[Field]) -> np.ndarray:
    """Of the value classes of every pair: magnitude, spread and significant digits of numbers, overlap of the sketches of other values."""
    number = lambda fs, name: np.array([np.nan if getattr(f, name) is None else getattr(f, name) for f in fs], float)
    kind_l, kind_r = np.array([f.kind for f in left]), np.array([f.kind for f in right])
    other_kind = kind_l[:, None] != kind_r[None, :]
    gap = lambda name: np.abs(number(left, name)[:, None] - number(right, name)[None, :])
    apart = gap("size")
    size = np.maximum(0.0, 1.0 - apart / DECADES)
    size = np.where(other_kind & (apart >= UNIT_DECADES), np.maximum(size, OTHER_UNIT), size)
    score = size * (MAGNITUDE + SPREAD * np.maximum(0.0, 1.0 - gap("spread") / SPREADS) + SIGNIFICANT * np.maximum(0.0, 1.0 - gap("digits") / DIGITS))
    score = np.where(np.array([f.few for f in left])[:, None] == np.array([f.few for f in right])[None, :], score, 0.7 * score)
    none_l, none_r = np.isnan(number(left, "size")), np.isnan(number(right, "size"))
    score[none_l[:, None] != none_r[None, :]] = 0.0
    for i in np.flatnonzero(none_l):
        for j in np.flatnonzero(none_r):
            a, b = left[i].sketch, right[j].sketch
            seen = sum(x is not None or y is not None for x, y in zip(a, b, strict=True))
            score[i, j] = 0.0 if left[i].kind != right[j].kind else sum(x is not None and x == y for x, y in zip(a, b, strict=True)) / seen if seen else 0.3
    score[(kind_l == "null"), :] = 0.3
    score[:, (kind_r == "null")] = 0.3
    return score


def flood_all(pairs: Sequence[tuple[Sequence[Field], Sequence[Field]]]) -> list[np.ndarray]:
    """Converged similarity of every field of the left with every field of the right schema, 1 for the best pair, of many pairs of schemas.

    Of each pair of schemas, pairs of nodes joined by edges of one label hand their scores on in equal shares. Fixpoint:
    s' = normalise(s0 + s + flow(s0 + s)); fields alike in neither name nor values form no pair. The graphs are padded to one size and iterated together, each until it no longer changes.
    """
    found = [np.zeros((len(a), len(b))) for a, b in pairs]
    todo = [k for k, (a, b) in enumerate(pairs) if a and b]
    if not todo:
        return found
    graphs = []
    for k in todo:
        left, right = pairs[k]
        names, same, wl, wr, word, pl, pr = _name_graph(tuple(f.path for f in left), tuple(f.path for f in right))
        kl, kr = sorted({f.kind for f in left}), sorted({f.kind for f in right})
        value = value_similarity(left, right)
        kinds = (np.array([[float(f.kind == x) for x in kl] for f in left]), np.array([[float(f.kind == x) for x in kr] for f in right]), np.array([[type_similarity(a, b) for b in kr] for a in kl]))
        one = (np.eye(len(left)), np.eye(len(right)))
        graphs.append((0.5 * names + 0.5 * value, {"name": (*one, same), "word": (wl, wr, word), "type": kinds, "value": (*one, value), "parent": (pl, pr, np.eye(pl.shape[1]))}))

    def pad(arrays: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(arrays), max(a.shape[0] for a in arrays), max(a.shape[1] for a in arrays)))
        for i, a in enumerate(arrays):
            out[i, : a.shape[0], : a.shape[1]] = a
        return out

    start = pad([g[0] for g in graphs])
    alike = start > 0
    labels = []
    for name, weight in WEIGHTS.items():
        left, right, nodes = (pad([g[1][name][i] for g in graphs]) for i in range(3))
        fan_in = np.maximum(left.sum(1)[:, :, None] * right.sum(1)[:, None, :], 1.0)
        fan_out = np.maximum(left.sum(2)[:, :, None] * right.sum(2)[:, None, :], 1.0)
        labels.append((left, left.transpose(0, 2, 1), right, right.transpose(0, 2, 1), nodes, fan_in, fan_out, weight))
    top = lambda x: np.maximum(x.max((1, 2), keepdims=True), 1e-300)
    fields, others = start, [x[4] for x in labels]
    live = np.ones((len(graphs), 1, 1), bool)
    for _ in range(ROUNDS):
        base = start + fields
        raw, after = base.copy(), []
        for (left, left_t, right, right_t, nodes, fan_in, fan_out, weight), s in zip(labels, others, strict=True):
            raw += weight * (left @ ((nodes + s) / fan_in) @ right_t) / fan_out
            after.append(nodes + s + nodes * (left_t @ (base / fan_out) @ right) / fan_in)
        raw = np.where(alike, raw, 0.0)
        new = raw / top(raw)
        others = [np.where(live, x / top(x), s) for x, s in zip(after, others, strict=True)]
        moved = np.abs(new - fields).max((1, 2), keepdims=True) >= TOLERANCE
        fields = np.where(live, new, fields)
        live &= moved
        if not live.any():
            break
    for i, k in enumerate(todo):
        a, b = pairs[k]
        found[k] = fields[i, : len(a), : len(b)]
    return found


def flood(left: Sequence[Field], right: Sequence[Field]) -> np.ndarray:
    return flood_all([(left, right)])[0]


def select(left: Sequence[Field], right: Sequence[Field], scores: np.ndarray) -> list[tuple[Field, Field]]:
    """Consistent correspondences by flooded scores alone: best first, each field once, none below ``LEAST_SCORE`` or below
    ``LEAST_SHARE`` of the best score that either of its fields reaches with any other."""
    if not scores.size:
        return []
    best = np.maximum(scores.max(1)[:, None], scores.max(0)[None, :])
    usable = (scores >= LEAST_SCORE) & (scores >= LEAST_SHARE * best)
    order = sorted(zip(*np.nonzero(usable), strict=True), key=lambda p: (-scores[p], left[p[0]].path, right[p[1]].path))
    used_l: set[int] = set()
    used_r: set[int] = set()
    pairs = []
    for i, j in order:
        if i not in used_l and j not in used_r:
            used_l.add(i)
            used_r.add(j)
            pairs.append((left[i], right[j]))
    return pairs


def compare_schemas(pairs: Sequence[tuple[Sequence[Field], Sequence[Field]]]) -> list[list[tuple[str, str, str | None]]]:
    """Changes of each pair of schemas, ``(path, change_kind, path before)``.

    Schemas of the same names are the same fields. A field that is only null on either side is not retyped.
    """
    out: list[list[tuple[str, str, str | None]]] = []
    moved = [k for k, (a, b) in enumerate(pairs) if {f.path for f in a} != {f.path for f in b}]
    scores = dict(zip(moved, flood_all([pairs[k] for k in moved]), strict=True))
    for k, (before, after) in enumerate(pairs):
        if k in scores:
            matched = select(before, after, scores[k])
        else:
            named = {f.path: f for f in before}
            matched = [(named[g.path], g) for g in after]
        changes: list[tuple[str, str, str | None]] = []
        for f, g in matched:
            if f.path != g.path:
                changes.append((g.path, "renamed", f.path))
            if f.kind != g.kind and "null" not in (f.kind, g.kind):
                changes.append((g.path, "retyped", f.path))
        kept_l, kept_r = {f.path for f, _ in matched}, {g.path for _, g in matched}
        changes += [(g.path, "added", None) for g in after if g.path not in kept_r]
        changes += [(f.path, "removed", f.path) for f in before if f.path not in kept_l]
        out.append(sorted(changes))
    return out


FIELD = "struct<path:string,kind:string,size:double,spread:double,digits:double,few:boolean,sketch:array<bigint>>"
CHANGES_SCHEMA = "group_id bigint, place bigint, file_id bigint, path string, change_kind string, before string"


def _field_rows(schemas: DataFrame) -> DataFrame:
    """``file_id, field``: type (the most frequent one; null if there is none) and value class of each field; a null field for a file without any."""
    n = lambda k: F.col(f"n_{k}")
    most = F.greatest(*[n(k) for k in KINDS])
    kind = F.lit("null")
    for k in reversed(KINDS):  # of equal ones the first by name
        kind = F.when((most > 0) & (n(k) == most), k).otherwise(kind)
    values = sum((n(k) for k in KINDS), F.lit(0))
    numbers = (F.col("n_size") > 0) & (F.col("n_size") >= 0.9 * values)
    mean = F.col("size") / F.col("n_size")
    return schemas.select(
        "file_id",
        F.when(
            F.col("path").isNotNull(),
            F.struct(
                "path",
                kind.alias("kind"),
                F.when(numbers, mean).alias("size"),
                F.when(numbers, F.sqrt(F.greatest(F.lit(0.0), F.col("size2") / F.col("n_size") - mean * mean))).alias("spread"),
                F.when(numbers, F.col("digits") / F.col("n_size")).alias("digits"),
                (sum((F.when(F.col(f"b{i}").isNotNull(), 1).otherwise(0) for i in range(BINS)), F.lit(0)) <= 3).alias("few"),
                F.when(~F.coalesce(numbers, F.lit(False)), F.array(*[F.col(f"b{i}") for i in range(BINS)])).alias("sketch"),
            ),
        ).alias("field"),
    )


def _fields(rows: list[dict] | None) -> list[Field]:
    made = [Field(r["path"], r["kind"], r["size"], r["spread"], r["digits"], r["few"], tuple(r["sketch"] or ())) for r in rows or []]
    return sorted(made, key=lambda f: f.path)


def compact_schemas(lines: DataFrame, file_id: str, payload: str) -> DataFrame:
    """The fields of all files, written once: everything that follows reads these few numbers per field and no line."""
    return stored(_field_rows(file_schemas(lines, file_id, payload)), "schemas")


def schema_changes(fields: DataFrame, info: DataFrame, batch_cells: int = 2_000_000) -> DataFrame:
    """``group_id, place, file_id, path, change_kind, before`` of every file against the one before it in its group.

    A file and its predecessor meet as one row of two schemas; a group's files are never gathered. A field that is only
    null in a file keeps the type and class it had while it stays in the files under its name.
    """
    here = fields.select("file_id").distinct()
    order = Window.partitionBy("group_id").orderBy("ord1", "ord2", "file_id")
    # ids only: a few bytes for each file of a group
    places = info.join(here, "file_id", "left_semi").select("group_id", "file_id", F.row_number().over(order).cast("long").alias("place"), F.lag("file_id").over(order).alias("__before"))
    placed = fields.where(F.col("field").isNotNull()).join(places, "file_id")
    run = Window.partitionBy("group_id", "field.path").orderBy("place")
    filled = placed.withColumn("__run", F.col("place") - F.row_number().over(run))
    known = F.last(F.when(F.col("field.kind") != "null", F.col("field")), True).over(Window.partitionBy("group_id", "field.path", "__run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    known = F.coalesce(known, F.col("field"))
    # one row per file: its fields, and their names and types to tell files apart that changed nothing
    whole = filled.select("file_id", known.alias("field")).groupBy("file_id").agg(F.collect_list("field").alias("fields"))
    whole = whole.withColumn("__shape", F.array_sort(F.transform("fields", lambda f: F.concat_ws("\n", f["kind"], f["path"]))))
    before = whole.select(F.col("file_id").alias("__before"), F.col("fields").alias("__fields_before"), F.col("__shape").alias("__shape_before"))
    # a file without fields has no row in whole
    pairs = places.where(F.col("__before").isNotNull()).join(whole, "file_id", "left").join(before, "__before", "left")
    pairs = pairs.where(~F.col("__shape").eqNullSafe(F.col("__shape_before"))).select("group_id", "place", "file_id", F.col("fields").cast(f"array<{FIELD}>").alias("fields"), F.col("__fields_before").cast(f"array<{FIELD}>").alias("before"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, batch_cells):
                made = [(_fields(b), _fields(a)) for a, b in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)]
                found = compare_schemas(made)
                at = np.repeat(np.arange(len(found)), [len(x) for x in found])
                flat = [c for x in found for c in x]
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(pa.array(at)) for i in range(3)], *[pa.array([c[i] for c in flat], pa.string()) for i in range(3)]], names=["group_id", "place", "file_id", "path", "change_kind", "before"])

    # a few hundred bytes a field, but the dear part is what follows: over all cores
    return pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism).mapInArrow(compare, CHANGES_SCHEMA)


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose padded graphs stay below so many cells."""
    import pyarrow.compute as pc

    sizes = [max(a or 0, b or 0, 1) for a, b in zip(*(pc.list_value_length(batch.column(i)).to_pylist() for i in (3, 4)), strict=True)]
    start, wide = 0, 1
    for i, n in enumerate(sizes):
        wide = max(wide, n)
        if i > start and (i + 1 - start) * wide * wide > most:
            yield batch.slice(start, i - start)
            start, wide = i, n
    if start < len(sizes):
        yield batch.slice(start)


HISTORY_SCHEMA = "group_id bigint, file_id bigint, path string, canonical string"


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """Canonical names from one group's renames, additions and removals in order: the rows where a name begins to mean something."""
    names: dict[str, str] = {}  # of the fields that are there now
    known: dict[str, str] = {}  # of every name seen
    out = []
    for place, rows in pdf.sort_values(["place", "path"]).groupby("place", sort=True):
        now = dict(names)
        for r in rows.itertuples(index=False):
            if r.change_kind in ("removed", "renamed"):
                now.pop(r.before, None)
        fresh = {r.path: names.get(r.before, r.before) for r in rows.itertuples(index=False) if r.change_kind == "renamed"}
        taken = set(now.values()) | set(fresh.values())
        for r in rows.itertuples(index=False):
            if r.change_kind == "added":
                # a field that comes back: under a known name, else a canonical name of its own
                name = known.get(r.path, r.path)
                fresh[r.path] = r.path if name in taken else name
                taken.add(fresh[r.path])
        now |= fresh
        known |= fresh
        names = now
        out += [(int(pdf["group_id"].iloc[0]), int(place), p, c) for p, c in fresh.items()]
    return pd.DataFrame(out, columns=["group_id", "place", "path", "canonical"])


def _info(files: DataFrame, file_id: str, group: str, order: Sequence[str]) -> DataFrame:
    return files.select(F.col(file_id).cast("long").alias("file_id"), F.col(group).cast("long").alias("group_id"), F.col(order[0]).cast("string").alias("ord1"), F.date_format(F.col(order[1]), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ord2")).dropDuplicates(["file_id"])


def changes(lines: DataFrame, files: DataFrame, file_id: str = "file_id", payload: str = "payload", group: str = "channel", order: Sequence[str] = ("trade_date", "delivered_at")) -> DataFrame:
    """``file_id, column_name, change_kind`` of every file against the one before it in its group: added, removed, renamed, retyped.

    ``files`` gives each file's group and order (two columns; ties by file_id). Files without lines are left out; lines of
    unknown files too. Empty tables have no changes.
    """
    found = schema_changes(compact_schemas(lines, file_id, payload), _info(files, file_id, group, order))
    return found.select("file_id", F.col("path").alias("column_name"), "change_kind")


def schema_history(lines: DataFrame, files: DataFrame, file_id: str = "file_id", payload: str = "payload", group: str = "channel", order: Sequence[str] = ("trade_date", "delivered_at")) -> DataFrame:
    """``group_id, file_id, path, canonical`` of every field of every file with lines.

    Only a group's changes of names meet in one task, a few bytes each; everything else stays apart by file and field.
    """
    info = _info(files, file_id, group, order)
    schemas = compact_schemas(lines, file_id, payload)
    turns = schema_changes(schemas, info).where("change_kind <> 'retyped'").groupBy("group_id").applyInPandas(_follow, "group_id bigint, place bigint, path string, canonical string")
    here = schemas.select("file_id").distinct()
    by_group = Window.partitionBy("group_id").orderBy("ord1", "ord2", "file_id")
    places = info.join(here, "file_id", "left_semi").select("group_id", "file_id", F.row_number().over(by_group).cast("long").alias("place"))
    fields = schemas.where(F.col("field").isNotNull()).select("file_id", F.col("field.path").alias("path")).join(places, "file_id")
    # the last turn of the name up to the file, per (group, name); a name without turn means itself
    rows = fields.select("group_id", "place", "path", "file_id", F.lit(None).cast("string").alias("canonical")).unionByName(turns.select("group_id", "place", "path", F.lit(None).cast("long").alias("file_id"), "canonical"))
    upto = Window.partitionBy("group_id", "path").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("canonical", F.coalesce(F.last("canonical", True).over(upto), "path")).where(F.col("file_id").isNotNull()).select("group_id", "file_id", "path", "canonical")


#: Canonical columns of the order table: name, how to read its values.
ORDER_COLUMNS = {"symbol": "text", "time": "integer", "order_num": "integer", "price": "scaled", "side": "integer", "volume": "integer", "money": "scaled", "type": "integer"}


def unify(lines: DataFrame, history: DataFrame, columns: dict[str, str], file_id: str = "file_id", payload: str = "payload", scale: int = 10000, broadcast_files: int = 200_000) -> DataFrame:
    """Every line with its fields under canonical names: the other columns of ``lines``, then ``columns``.

    kinds: ``text``; ``integer`` (``1,300``, ``W134``, ``0000000117`` and ``100.0`` are read as their number; null if not whole
    or unreadable); ``scaled`` (integers as they are; numbers with a point, and strings with one, times ``scale``). A field the
    line does not hold is null; other fields are dropped. Every line gives one row, damaged ones with nulls only.

    The names of at most ``broadcast_files`` files (about 100 bytes each) go to every task; those of more are joined, where
    adaptive execution splits a file that holds most lines.
    """
    names = list(columns)
    mapping = (
        history.where(F.col("canonical").isin(*columns))
        .groupBy(F.col("file_id").alias("__file"))
        .agg(*[F.min(F.when(F.col("canonical") == c, F.col("path"))).alias(f"__path{i}") for i, c in enumerate(names)])
    )
    mapping = stored(mapping, "names")
    if mapping.count() <= broadcast_files:
        mapping = F.broadcast(mapping)
    kept = [c for c in lines.columns if c != payload]
    # the nested levels of a path are opened one by one
    parsed = lines.select(*[F.col(c).alias(f"__in{i}") for i, c in enumerate(kept)], F.col(file_id).cast("long").alias("__id"), _members(F.try_parse_json(F.col(payload).cast("string"))).alias("__m"))
    joined = parsed.join(mapping, F.col("__id") == F.col("__file"), "left")

    def value_at(path: Column) -> Column:
        out = F.try_element_at("__m", path)
        parts = F.split(path, r"\.")
        node = F.try_element_at("__m", parts[0])
        for level in range(1, DEPTH):
            node = F.try_element_at(_members(node), F.get(parts, level))
            out = F.when(out.isNotNull(), out).when(F.size(parts) == level + 1, node)
        return out

    found = joined.select(*[f"__in{i}" for i in range(len(kept))], *[value_at(F.col(f"__path{i}")).alias(f"__v{i}") for i in range(len(names))])
    # explode keeps the optimizer from looking a value up once more for every use of it
    held = F.explode(F.array(F.struct(*[F.struct(json_kind(F.col(f"__v{i}")).alias("kind"), _text(F.col(f"__v{i}")).alias("text")).alias(f"o{i}") for i in range(len(names))]))).alias("__o")
    read = found.select(*[f"__in{i}" for i in range(len(kept))], held)
    return read.select(*[F.col(f"__in{i}").alias(c) for i, c in enumerate(kept)], *[_read(F.col(f"__o.o{i}.kind"), F.col(f"__o.o{i}.text"), columns[c], scale).alias(c if c not in kept else f"{c}_payload") for i, c in enumerate(names)])


def _read(kind: Column, text: Column, wanted: str, scale: int) -> Column:
    if wanted == "text":
        return F.when(kind.isin("string", "integer", "number", "boolean"), text)
    digits = F.when(kind == "string", number_text(text)).when(kind == "boolean", F.when(text == "true", "1").otherwise("0")).when(kind.isin("integer", "number"), text)
    exact = digits.try_cast("decimal(38,10)")
    if wanted == "scaled":
        pointed = (kind == "number") | (kind == "string") & digits.rlike("[.eE]")
        return F.when(pointed, F.bround(exact * scale, 0)).otherwise(exact).try_cast("bigint")
    return F.when(exact == F.floor(exact), exact).try_cast("bigint")
